"""The stored index: increments, masks, skipping and its plan."""

import os
import random
import re

from pyspark.sql import functions as F

from marginalia.operators import chunks as C
from marginalia.operators import retrieval as R
from marginalia.operators import token_index as TI
from marginalia.scale import materialize


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)


def found(spark, queries, index, k=3):
    rows = R.retrieve(spark.createDataFrame(queries, "query_id int, query string"), index, k).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.chunk_id, r.overlap, r.phrase) for r in rows]


def plain(docs, queries, k=3):
    out = []
    for q, text in queries:
        bag = re.findall("[a-z0-9_]+", text)
        ranked = []
        for d, body in docs.items():
            have = re.findall("[a-z0-9_]+", body)
            n = sum(min(bag.count(t), have.count(t)) for t in set(bag))
            if n:
                ranked.append((text not in body, -n, f"{d}:document:0"))
        out += [(q, c, -n, not p) for p, n, c in sorted(ranked)[:k]]
    return out


def test_increments_changes_and_removals(spark, tmp_path):
    r = random.Random(1)
    words = ["the", "of"] * 8 + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(4, 30)))
    docs = {i: text() for i in range(120)}
    queries = [(i, text()) for i in range(6)] + [(6, docs[5]), (7, "absent")]
    path = str(tmp_path / "index")
    index = TI.refresh(frame(spark, docs), path, C.chunk_documents)
    assert found(spark, queries, index) == plain(docs, queries)
    before = files(path)
    again = TI.refresh(frame(spark, docs), path, C.chunk_documents)
    assert again.segments == index.segments and files(path) == before
    # Two new documents: a second segment, the first is left as it is.
    docs |= {200: docs[5], 201: text()}
    cut = []
    more = TI.refresh(frame(spark, docs), path, lambda df: cut.append(df.select("doc_id").collect()) or C.chunk_documents(df))
    assert sorted(x.doc_id for x in cut[0]) == [200, 201] and len(more.segments) == 2 and set(before) <= set(files(path))
    assert found(spark, queries, more) == plain(docs, queries)
    # One is gone, one has another text; then the old text comes back.
    old = docs[5]
    docs[5] = "entirely new words"
    del docs[201]
    third = TI.refresh(frame(spark, docs), path, C.chunk_documents)
    assert third.live and len(third.segments) == 3
    assert found(spark, queries, third) == plain(docs, queries)
    assert TI.refresh(frame(spark, docs), path, C.chunk_documents) == third
    docs[5] = old
    fourth = TI.refresh(frame(spark, docs), path, C.chunk_documents)
    assert fourth.segments == third.segments and found(spark, queries, fourth) == plain(docs, queries)
    assert TI.open_index(spark, f"{path}/format={TI.FORMAT}") == fourth


def test_blocks_below_the_bound_are_skipped(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"{i}:document:0", " ".join(r.choice([f"g{i % 7}x{j}" for j in range(30)] + ["the"] * 5) for _ in range(40))) for i in range(3000)]
    index = TI.of_chunks(spark.createDataFrame(rows, "doc_id int, chunk_id string, text string"), str(tmp_path / "index"))
    bags = R.query_bags(spark.createDataFrame([(1, "the g3x1 g3x2 g3x5 g3x7 g3x9 g3x11")], "query_id int, query string"))
    upper, low = R.bounds(bags, index, 3)
    bound = low.first()["bound"]
    total, kept = upper.agg(F.count("*"), F.count_if(F.col("upper") >= bound)).first()
    assert total > 40 and kept < total / 2
    # No text of a skipped block reaches the bound.
    skipped = upper.where(F.col("upper") < bound).select("query_id", "range", "block")
    assert R.overlaps(bags, index, skipped).where(F.col("overlap") >= bound).count() == 0


def test_hot_token_is_spread_and_sums_need_no_exchange(spark, tmp_path):
    rows = [(i, f"{i}:document:0", f"the w{i} w{i % 50}") for i in range(6000)]
    index = TI.of_chunks(spark.createDataFrame(rows, "doc_id int, chunk_id string, text string").repartition(6), str(tmp_path / "index"))
    hot = index.blocks().where("token = 'the'")
    ranges = hot.groupBy("range").agg(F.sum("n_texts").alias("n")).collect()
    assert len(ranges) >= 4 and sum(x.n for x in ranges) == 6000 and max(x.n for x in ranges) <= TI.BLOCK_TEXTS * TI.RANGE_BLOCKS
    # With query tables that are small against the index, which is what candidates() writes.
    bags = materialize(R.query_bags(spark.createDataFrame([(1, "the w7 w8")], "query_id int, query string")))
    wanted = materialize(R.block_bounds(bags, index).select("query_id", "range", "block"))
    plan = R.overlaps(bags, index, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan


def test_a_phrase_is_sought_in_texts_with_all_of_its_rarest_tokens(spark, tmp_path):
    """a text with one rare token of the query, but not the others, is not read for the phrase."""
    chunks = spark.createDataFrame([(1, "1:0", "go red green blue black now"), (2, "2:0", "red lamp"), (3, "3:0", "blue sky, red"), (4, "4:0", "x red green blue black y")],
                                   "doc_id int, chunk_id string, text string")
    index = TI.of_chunks(chunks, str(tmp_path / "index"))
    queries = spark.createDataFrame([(7, "o red green blue black n"), (8, "red lamp")], "query_id int, query string")
    bags = R.query_bags(queries)
    docs = lambda pairs: sorted((r.query_id, r.doc_id) for r in pairs.join(index.owners(), "text_no").collect())
    assert docs(R._phrase_pairs(queries, bags, index)) == [(7, 1), (7, 4), (8, 1), (8, 2), (8, 3), (8, 4)]
    assert docs(R.phrase_matches(queries, index)) == [(7, 1), (8, 2)]


def test_small_sides_of_index_joins_are_stored_first(spark, tmp_path, monkeypatch):
    """Their measured size lets them travel to the index, whose entries are not exchanged."""
    named, store = set(), R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: (named.add(name), store(df, name))[1])
    chunks = spark.createDataFrame([(i, f"{i}:0", f"red w{i} blue") for i in range(50)], "doc_id int, chunk_id string, text string")
    index = TI.of_chunks(chunks, str(tmp_path / "index"))
    assert R.retrieve(spark.createDataFrame([(1, "a red w7 blue b")], "query_id int, query string"), index, 3).count() == 3
    assert {"seeds", "alive", "phrase-tokens", "phrase-pairs"} <= named


def test_blocks_come_from_texts_without_stored_tokens(spark, tmp_path):
    """tokens are neither exchanged nor stored; blocks that go over batches stay whole."""
    import pyarrow as pa
    texts = {n: [f"t{n % 3}", "all", "all"] if n % 5 else [] for n in range(60, 200)}
    rows = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.list_(pa.string()))], names=["text_no", "tokens"])
    got = [r for b in TI._blocks(iter([rows.slice(0, 10), rows.slice(10, 0), rows.slice(10, 90), rows.slice(100)])) for r in b.to_pylist()]
    want = {}
    for n, tokens in texts.items():
        for t in set(tokens):
            want.setdefault((n // 64, t), []).append(tokens.count(t) << 6 | n % 64)
    assert len(got) == len(want) and {(r["block"], r["token"]): r["entries"] for r in got} == want
    assert all(r["n_texts"] == len(r["entries"]) and r["max_n"] == max(r["entries"]) >> 6 and r["range"] == r["block"] // 64 for r in got)
    chunks = spark.createDataFrame([(1, "1:0", "a b"), (2, "2:0", "a b"), (3, "3:0", "?")], "doc_id int, chunk_id string, text string")
    index = TI.of_chunks(chunks, str(tmp_path / "index"))
    assert sorted(index._all("texts").columns) == ["text", "text_id", "text_no"] and index.texts().count() == 2


def test_entries_stay_in_their_buckets_when_many_blocks_are_wanted(spark, tmp_path):
    """Wanted blocks that are too many to be broadcast reach the entries, which are not exchanged for them."""
    rows = [(i, f"{i}:document:0", f"the w{i} w{i % 50}") for i in range(2000)]
    index = TI.of_chunks(spark.createDataFrame(rows, "doc_id int, chunk_id string, text string"), str(tmp_path / "index"))
    bags = materialize(R.query_bags(spark.createDataFrame([(1, "the w7 w8"), (2, "w7 of")], "query_id int, query string")))
    block = F.floor(F.col("id") / 2)
    other = index.blocks().select("block").distinct().where("block % 2 = 0").select(F.lit(1).alias("query_id"), F.floor(F.col("block") / TI.RANGE_BLOCKS).alias("range"), "block")
    many = spark.range(1 << 21).select((F.col("id") % 2 + 3).cast("int").alias("query_id"), F.floor(block / TI.RANGE_BLOCKS).alias("range"), block.alias("block"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        got = R.overlaps(bags, index, other.unionByName(many))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
        found = {(r.query_id, r.text_no): (r.overlap, r.total) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    count = lambda text: sum(w in text.split(" ") for w in ("the", "w7", "w8"))
    want = {(1, r.text_no): (count(r.text), 3) for r in index.texts().collect() if r.text_no // TI.BLOCK_TEXTS % 2 == 0}
    assert found == want

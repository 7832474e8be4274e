from pyspark.sql import functions as F

from marginalia.llm import sharding


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side ** dims).select(*[F.pmod(F.floor(F.col("id") / side ** d), F.lit(side)).cast("int").alias(f"x{d}") for d in range(dims)])
        rows = sorted(cells.withColumn("h", sharding.hilbert([F.col(f"x{d}") for d in range(dims)], bits)).collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(side ** dims))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[f"x{d}"] - b[f"x{d}"]) for d in range(dims)) == 1


def test_shards_are_even_and_gapless(spark):
    rows = [(i % 90, None if i % 7 == 0 else f"t{i % 11}" * (i % 5), None if i % 13 == 0 else "en", None if i % 3 else f"s{i % 4}", "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    out = sharding.document_shards(docs).collect()
    assert len(out) == 100
    by: dict = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} <= {6, 7}
    assert next(r for r in out if r["doc_id"] == 0)["text_crc32"] == 0


def test_empty_and_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert sharding.document_shards(spark.createDataFrame([], schema)).count() == 0
    one = sharding.document_shards(spark.createDataFrame([(None, None, None, None)], schema)).collect()
    assert [(r["size"], r["shard"], r["slot"]) for r in one] == [(1, 0, 0)]


def test_order_against_a_plain_sort_with_clashing_names(spark):
    import random
    import zlib
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(9)]), rnd.choice(["a", "b", None]), "long " * rnd.choice([0, 1, 40000]) + rnd.choice(["", "é", "x"]), i, i, i, i, i) for i in range(203)]
    names = ["a.b", "_s_x", "text", "_rank", "_one", "row", "rank", "one"]
    docs = spark.createDataFrame(rows, "`a.b` int, `_s_x` string, text string, `_rank` int, `_one` int, row int, rank int, one int").withColumn("slot", F.lit("old"))
    out = sharding.assign_shards(docs, ["a.b", "_s_x"], 7, ["_rank"])
    assert out.columns == [*names, "curve", "shard", "slot"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[:8] for r in got if r[0] is not None and r[1]) == sorted(r for r in rows if r[0] is not None and r[1]) and len(got) == len(rows)
    placed = [(rank * 7 // 203, r) for rank, r in enumerate(sorted(got, key=lambda r: (r[8], r[3])))]
    slots: dict = {}
    for shard, r in placed:
        assert (r[9], r[10]) == (shard, slots.setdefault(shard, 0))
        slots[shard] += 1
    texts = spark.createDataFrame([(i, r[2], "en", "s", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, _rank int")
    for r in sharding.document_shards(texts).collect():
        text = rows[r["doc_id"]][2].encode()
        assert (r["text_crc32"], r["size"]) == (zlib.crc32(text), len(text) + 1)


def test_manifest_and_files(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("a"), (F.col("id") % 20).alias("b"))
    out = sharding.assign_shards(docs, ["a", "b"], 8, ["a"])
    spans = sharding.manifest(out, ["a", "b"]).collect()
    assert sum(r["rows"] for r in spans) == 400
    assert sum((r["max_a"] - r["min_a"] + 1) * (r["max_b"] - r["min_b"] + 1) for r in spans) < 0.6 * 8 * 400 * 20
    sharding.write_shards(out, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 400

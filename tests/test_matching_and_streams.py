import pytest
from marginalia.operators import title_join as TJ
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marginalia.operators import metadata as M
from marginalia.streaming import jobs as J

CAND = "doc_id int, provider string, pos int, title string, authors array<string>, year string, venue string, doi string, url string"
OURS = "doc_id int, our_title string, our_authors array<string>, our_year string, our_venue string, our_doi string, our_arxiv string"


def test_rerank_against_the_library_matcher(spark):
    rnd = random.Random(4)
    words = ["deep", "graph", "nets", "for", "image", "parsing", "study"]
    title = lambda: " ".join(rnd.choices(words, k=5))
    ours = [(i, title(), ["Ann Lee", "Bo Li"], "2001", "Journal A", f"10.1/{i}", "") for i in range(12)]
    cands = []
    for i, t, *_ in ours:
        cands += [(i, "crossref", 1, t.upper() + ".", ["ann lee", "Bo  Li"], "2001", "journal a", f"https://doi.org/10.1/{i}" if i % 3 == 0 else "", ""),
                  (i, "crossref", 2, title(), ["Bo Li"], "1999", "The Journal A", "", ""), (i, "arxiv", 3, t[:12], [], "2001", "", "", "")]
    got = M.rerank(spark.createDataFrame(cands, CAND), spark.createDataFrame(ours, OURS)).collect()
    by = {(r.doc_id, r.pos): r for r in got}
    for i, t, *_ in ours:
        a = by[i, 1]
        assert (a.title_similarity, a.author_match_score, a.venue_match_score, a.local_rank) == (1.0, 1.0, 1.0, 1)
        assert a.local_match_score == 1.0 and a.doi_match == (i % 3 == 0) and a.provider_rank == 1
        b = by[i, 2]
        assert b.title_similarity == round(SequenceMatcher(None, t, [c for c in cands if c[0] == i][1][3]).ratio(), 4)
        assert (b.author_match_score, b.venue_match_score, b.provider_rank, b.provider_global_rank) == (0.2, 0.85, 2, 2)
        assert abs(b.local_match_score - (b.title_similarity * .62 + .2 * .23 + .85 * .07)) < 6e-5
        assert sorted(by[i, p].local_rank for p in (1, 2, 3)) == [1, 2, 3]


def test_simple_score_and_best(spark):
    ours = spark.createDataFrame([(1, "Deep graph nets", ["Lee"], "2001", "", "10.1/x", "")], OURS)
    c = spark.createDataFrame([(1, "openalex", 1, "Deep graph nets", ["Ann Lee"], "2001", "", "", ""), (1, "crossref", 2, "other", [], "", "", "10.1/X", ""), (1, "crossref", 3, "other", [], "", "", "10.1/x", "")], CAND)
    s = {r.pos: r.confidence for r in M.simple_score(c, ours).collect()}
    assert s == {1: 0.95, 2: 0.98, 3: 0.98}
    assert M.pick_best(M.simple_score(c, ours)).first().pos == 2


def test_corpus_match_collapses_copies(spark):
    docs = [(i, "same hot title here", "") for i in range(30)] + [(100, "rare title alpha", ""), (101, "nothing shared", "10.1/z")]
    cands = [(i, "Same hot title here!", "") for i in range(40, 10, -1)] + [(90, "rare title alphas", ""), (91, "zzz", "10.1/Z")]
    got = {r.doc_id: (r.cand_id, r.by_doi) for r in M.match_corpus(spark.createDataFrame(docs, "doc_id int, title string, doi string"), spark.createDataFrame(cands, "cand_id int, title string, doi string")).collect()}
    assert all(got[i] == (11, False) for i in range(30)) and got[100] == (90, False) and got[101] == (91, True)


def test_corpus_match_seeks_near_titles_only_where_they_can_show(spark, monkeypatch):
    asked = []
    real = M.similar_titles
    monkeypatch.setattr(M, "similar_titles", lambda ours, theirs, permille: asked.append({x.t for x in ours.collect()}) or real(ours, theirs, permille))
    docs = spark.createDataFrame([(1, "exact title here", ""), (2, "near title heres", "")], "doc_id int, title string, doi string")
    cands = spark.createDataFrame([(10, "exact title here", ""), (11, "exact title herd", ""), (12, "near title here", "")], "cand_id int, title string, doi string")
    one, two = ({(x.doc_id, x.cand_id) for x in M.match_corpus(docs, cands, k).collect()} for k in (1, 2))
    assert one == {(1, 10), (2, 12)} and two == {(1, 10), (1, 11), (2, 12)}
    assert asked == [{"near title heres"}, {"exact title here", "near title heres"}]


@pytest.mark.parametrize("permille", [900, 940])
def test_title_join_loses_no_pair(spark, permille):
    r = random.Random(permille)
    base = ["".join(r.choice("abcde fg") for _ in range(n)).strip() for n in (1, 2, 3, 5, 8, 9, 10, 11, 12, 15, 21, 40, 80) for _ in range(4)]
    def worn(t):
        t = list(t)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(t) + 1)
            t[at:at + r.choice([0, 1])] = r.choice(["", "x", "a", "é"])
        return " ".join("".join(t).split())
    ours, theirs = sorted({worn(t) for t in base for _ in range(3)} | {""}), sorted({worn(t) for t in base for _ in range(3)} | {""})
    got = TJ.similar_titles(*(spark.createDataFrame([(t,) for t in x], "t string") for x in (ours, theirs)), permille)
    want = {(a, b) for a in ours for b in theirs if a and b and SequenceMatcher(None, a, b).ratio() >= permille / 1000 - 1e-12}
    rows = [(x.our, x.their) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 60
    # The bounds leave few pairs for the matcher.
    sent = TJ.plausible_pairs(*(spark.createDataFrame([(t,) for t in x if t], "t string") for x in (ours, theirs)), permille).count()
    assert sent < len(ours) * len(theirs) / 10


def test_bounds_are_never_below_the_ratio(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aabcé .") for _ in range(r.randrange(0, 14)))
    rows = [(word(), word()) for _ in range(500)]
    a, b = F.col("a"), F.col("b")
    for x in spark.createDataFrame(rows, "a string, b string").select("a", "b", TJ.length_bound(a, b).alias("l"), TJ.letter_bound(a, b, TJ.letter_counts(a), TJ.letter_counts(b)).alias("m")).collect():
        ratio = SequenceMatcher(None, x.a, x.b).ratio() if x.a and x.b else 0.0
        assert x.l + 1e-12 >= x.m >= ratio - 1e-12


def test_fragments_merge(spark):
    rows = [("c", 1, 0, "id1", "f", '{"a'), ("c", 2, 1, "", "", "x"), ("c", 3, 0, "", "", '":1}'), ("c", 4, 2, "", "g", None)]
    m = J.merge_call_fragments(spark.createDataFrame(rows, "k string, pos int, idx int, id string, name string, args string"), ["k"])
    assert {(r.idx, r.call_id, r.name, r.arguments) for r in m.collect()} == {(0, "id1", "f", '{"a":1}'), (2, "call_3", "g", "{}")}


def test_folded_stream_keeps_call_order_and_closes_silent_turns(spark, tmp_path):
    rows = [("tool_call", "a", None), ("tool_call", "b", None), ("tool_result", "b", "rb"), ("tool_result", "a", "ra"), ("step_end", None, None),
            ("final_delta", None, "he"), ("final_delta", None, "llo"), ("final_end", None, None), ("done", None, "success"), ("final_delta", None, "late")]
    data = [(1, "t", i, k, c, x, f"2024-01-01 00:00:{i:02d}") for i, (k, c, x) in enumerate(rows)] + [(2, "u", 0, "tool_call", "z", None, "2024-01-01 00:00:00"), (3, "v", 0, "final_end", None, None, "2024-01-02 00:00:00")]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(data, "session_id bigint, turn_id string, pos bigint, kind string, tool_call_id string, content string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    out = J.run_to_table(J.fold_stream(J.read_stream(spark, src, df.schema)), "t")
    one = [(r.event_type, r.tool_call_id, r.content) for r in out.where("session_id = 1").orderBy("position").collect()]
    assert one == [("tool/call", "a", None), ("tool/call", "b", None), ("tool/result", "a", "ra"), ("tool/result", "b", "rb"), ("step/end", None, None), ("assistant/message", None, "hello"), ("turn/end", None, "success")]
    assert [(r.event_type, r.content) for r in out.where("session_id = 2").orderBy("position").collect()] == [("tool/call", None), ("turn/end", "error")]


def test_interleaved_steps_keep_their_own_results(spark, tmp_path):
    rows = [("tool_call", 1, "a"), ("tool_call", 2, "b"), ("tool_result", 2, "b"), ("tool_result", 1, "a"), ("step_end", 2, None), ("step_end", 1, None), ("tool_call", 3, "c"), ("tool_result", 3, "c"), ("done", 3, None)]
    schema = "session_id bigint, turn_id string, pos bigint, kind string, step int, tool_call_id string, content string, ts timestamp"
    for part, chunk in enumerate([rows[:2], rows[2:4], rows[4:6], rows[6:]]):
        data = [(1, "t", part * 10 + i, k, s, c, c, datetime(2024, 1, 1, 0, 0, part)) for i, (k, s, c) in enumerate(chunk)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = J.run_to_table(J.fold_stream(J.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)), "t")
    got = [(r.event_type, r.tool_call_id) for r in out.orderBy("position").collect()]
    assert got == [("tool/call", "a"), ("tool/call", "b"), ("tool/result", "b"), ("step/end", None), ("tool/result", "a"), ("step/end", None), ("tool/call", "c"), ("tool/result", "c"), ("turn/end", None)]


def test_registered_queries_and_oracles(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    for sql in o.values():
        duckdb.extract_statements(sql)
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "overlap", "total", "phrase"]


def four_files(spark, rows, schema, folder, r):
    """The rows dealt to four files, each shuffled; event times go over the borders by less than the lateness."""
    rows = sorted(rows, key=lambda x: x[-1].timestamp() + r.uniform(0, 200))
    n = -(-len(rows) // 4)
    for at in range(0, len(rows), n):
        part = rows[at:at + n]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_numbers_by_event_time(spark, tmp_path):
    r = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(r.randrange(3), i, start + timedelta(seconds=r.randrange(4000))) for i in range(400)] + [(9, 999, start + timedelta(days=1))]
    four_files(spark, rows, "session_id long, event_id long, ts timestamp", str(tmp_path / "in"), r)
    stream = J.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "session_id long, event_id long, ts timestamp").schema, 1)
    got = {(x.session_id, x.seq, x.event_id) for x in J.run_to_table(J.number_stream(stream), "n").collect()}
    want = set()
    for session in range(3):
        mine = sorted((ts, e) for s, e, ts in rows if s == session)
        want |= {(session, i + 1, e) for i, (_, e) in enumerate(mine)}
    assert got == want


def test_fragment_stream_equals_its_batch_twin(spark, tmp_path):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(20):
        at = k * 200
        for pos in range(r.randrange(1, 30)):
            at += r.randrange(3)
            rows.append((f"s{k}", pos, r.randrange(3), r.choice(["", "", f"id{pos}"]), r.choice([None, "", f"f{pos}"]), r.choice([None, "", '{"a', "é", str(pos)]), start + timedelta(seconds=at)))
    rows.append(("end", 0, 0, "x", "y", "z", start + timedelta(days=1)))
    schema = "k string, pos long, idx long, id string, name string, args string, ts timestamp"
    four_files(spark, rows, schema, str(tmp_path / "in"), r)
    stream = J.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    got = sorted(tuple(x) for x in J.run_to_table(J.merge_fragment_stream(stream, ["k"], "10 minutes"), "c").collect())
    batch = J.merge_call_fragments(spark.createDataFrame(rows, schema).where("k <> 'end'"), ["k"])
    assert got == sorted(tuple(x) for x in batch.select("k", "idx", "call_id", "name", "arguments").collect()) and len(got) > 20


def test_fragment_stream_needs_no_python_worker(spark, tmp_path):
    deltas = J.read_stream(spark, str(tmp_path), spark.createDataFrame([], "k string, pos long, idx long, id string, name string, args string, ts timestamp").schema)
    assert "InPa" not in J.merge_fragment_stream(deltas, ["k"])._jdf.queryExecution().toString()


def test_stream_states_are_not_asked_turn_by_turn(spark, tmp_path, monkeypatch):
    """Turns of one bucket share a call to Python."""
    monkeypatch.setattr(J, "BUCKETS", 2)
    start = datetime(2024, 1, 1)
    rows = [(s, f"t{t}", 3 * t + i, k, f"c{t}", str(t), start + timedelta(seconds=i)) for s in range(4) for t in range(5) for i, k in enumerate(["tool_call", "tool_result", "step_end"])]
    rows.append((9, "end", 0, "final_end", None, None, start + timedelta(days=1)))
    schema = "session_id long, turn_id string, pos long, kind string, tool_call_id string, content string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    folded = J.fold_stream(J.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
    got = {(x.session_id, x.turn_id, x.position, x.event_type, x.tool_call_id, x.content) for x in J.run_to_table(folded, "t").collect()}
    want = {(s, f"t{t}", p, k, c and f"c{t}", x) for s in range(4) for t in range(5)
            for p, k, c, x in [(1, "tool/call", True, None), (2, "tool/result", True, str(t)), (3, "step/end", None, str(t)), (4, "turn/end", None, "error")]}
    assert got == want | {(9, "end", 1, "assistant/message", None, "")}
    plan = folded._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "[bucket" in plan


def test_sessions_of_a_bucket_are_numbered_in_one_call():
    """one call and one state serve many sessions; rows wait until the watermark has passed them."""
    class State:
        hasTimedOut, exists, get, timeout, passed = False, False, None, None, 0

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

        def getCurrentWatermarkMs(self):
            return self.passed

    state, rows = State(), [("1", 10, 5_000_000), ("2", 11, 4_000_000), (None, 12, 3_000_000), ("1", 9, 5_000_000), ("1", 8, 9_000_000)]
    batch = pd.DataFrame(rows, columns=["session", "event_id", "ts_us"])
    assert list(J._number_bucket((0,), iter([batch[:2], batch[2:]]), state)) == [] and state.timeout == 3001
    state.hasTimedOut, state.passed = True, 5001
    out = pd.concat(J._number_bucket((0,), iter([]), state))
    assert [tuple(None if pd.isna(v) else int(v) for v in r) for r in out.itertuples(index=False)] == [(None, 1, 12), (2, 1, 11), (1, 1, 9), (1, 2, 10)]
    state.passed = 9001
    assert pd.concat(J._number_bucket((0,), iter([]), state)).values.tolist() == [[1, 3, 8]]

import json

from pyspark.sql import functions as F

from marginalia.operators import budget as B
from marginalia.operators import history as H
from marginalia.operators import sessions as S
from marginalia.sources import files as I

EVENT = "session_id string, seq bigint, turn_id string, event_type string, tool_call_id string, status string, content string"


def log(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], EVENT)


def two_turns(spark, status="success"):
    return log(spark, [
        ("s", 1, "t1", "user/message", None, None, "hi"), ("s", 2, "t1", "turn/start"), ("s", 3, "t1", "tool/call", "a"), ("s", 4, "t1", "tool/call", "b"), ("s", 5, "t1", "tool/result", "b"),
        ("s", 6, "t1", "step/end"), ("s", 7, "t1", "assistant/message", None, None, "done"), ("s", 8, "t1", "turn/end", None, status),
        ("s", 9, "t2", "user/message", None, None, "again"), ("s", 10, "t2", "turn/start"), ("s", 11, "t2", "step/start")])


def test_turns_status_and_open_turns(spark):
    e = two_turns(spark)
    r = {x.turn_id: (x.status, x.user_input, x.final_answer) for x in S.turn_rollup(e).collect()}
    assert r == {"t1": ("success", "hi", "done"), "t2": ("incomplete", "again", None)}
    assert [x.turn_id for x in S.incomplete_turns(e).collect()] == ["t2"]
    assert {(x.turn_id, x.safe) for x in S.safe_boundaries(e).collect()} == {("t1", True)}


def test_safe_boundary_with_overlapping_turns(spark):
    e = log(spark, [("s", 1, "a", "turn/start"), ("s", 2, "b", "turn/start"), ("s", 3, "a", "turn/end", None, "success"), ("s", 4, "b", "turn/end", None, "success"), ("s", 5, "a", "late"), ("s", 6, "c", "turn/start"), ("s", 7, "c", "turn/end")])
    assert {x.seq: x.safe for x in S.safe_boundaries(e).collect()} == {3: False, 4: True, 7: False}


def test_messages_of_a_turn(spark):
    m = H.turn_messages(two_turns(spark)).orderBy("ord_seq", "ord_kind", "ord_call").collect()
    assert [x.role for x in m] == ["user", "assistant", "tool", "assistant", "assistant"]
    assert m[1].content == "calls:b" and m[2].content == "b:success" and m[3].content.endswith("：a") and m[4].content == "done"
    failed = H.turn_messages(two_turns(spark, "error")).orderBy("ord_seq", "ord_kind").collect()
    assert failed[-2].content.startswith("失败旧轮次") and failed[-1].content.startswith("该旧轮次")


def test_history_keeps_the_payload(spark):
    rows = [
        (1, "user/message", None, None, 'ask "x"', None, None, None, None, None),
        (2, "tool/call", "a", None, None, "find", '{"q": 1}', None, None, None),
        (3, "tool/call", "b", None, None, 'r"ead', None, None, None, None),
        (4, "tool/call", "c", None, None, "open", "{}", None, None, None),
        (5, "tool/call", "", None, None, "find", "{}", None, None, None),
        (6, "tool/call", "d", None, None, "", "{}", None, None, None),
        (7, "tool/result", "b", None, None, None, None, None, "line\nend", None),
        (8, "tool/result", "a", "success", None, None, None, '{"n": 2}', "s", None),
        (9, "error", None, None, None, None, None, None, None, '{"code": "E1"}'),
        (10, "error", None, None, None, None, None, None, None, None),
        (11, "assistant/message", None, None, None, None, None, None, None, None),
        (12, "turn/end", None, "error", None, None, None, None, None, None),
        (13, "user/message", None, None, "after the end", None, None, None, None, None),
    ]
    e = spark.createDataFrame([("s", "t", *r) for r in rows], "session_id string, turn_id string, seq bigint, event_type string, tool_call_id string, status string, content string, "
                              "name string, arguments string, history_result string, summary string, error string")
    m = H.history_messages(e).orderBy("ord_seq", "ord_kind", "ord_call").collect()
    assert [(r.role, r.tool_call_id, r.name) for r in m] == [("user", None, None), ("assistant", None, None), ("tool", "a", "find"), ("tool", "b", 'r"ead'), ("assistant", None, None), ("assistant", None, None)]
    assert [tuple(c) for c in m[1].tool_calls] == [("a", "find", '{"q": 1}'), ("b", 'r"ead', "{}")] and m[1].content == ""
    assert m[2].content == '{"n": 2}' and json.loads(m[3].content) == {"tool": 'r"ead', "status": "error", "summary": "line\nend"}
    assert m[4].content.endswith('：["open"]') and m[5].content.endswith('错误记录：[{"code": "E1"}, {}]')
    assert H.history_messages(e.limit(0)).count() == 0


def test_fifo_pairs_against_a_queue(spark):
    import random
    rnd = random.Random(5)
    kinds = [rnd.choice(["llm/input", "llm/output", "llm/error"]) for _ in range(300)]
    pairs, queue = set(), []
    for i, k in enumerate(kinds, 1):
        if k == "llm/input":
            queue.append(i)
        else:
            pairs.add((queue.pop(0) if queue else None, i))
    pairs |= {(i, None) for i in queue}
    t = spark.createDataFrame([("s", "t", i, k) for i, k in enumerate(kinds, 1)], "session_id string, turn_id string, trace_seq bigint, event_type string")
    assert {(r.input_seq, r.end_seq) for r in S.pair_model_calls(t, S.TURN).collect()} == pairs


def test_trace_links_use_the_latest_call(spark):
    rows = [(1, "tool/call_debug", "a"), (2, "tool/call_debug", "a"), (3, "tool/result_debug", "a"), (4, "tool/result_debug", "x")]
    t = spark.createDataFrame([("s", "t", n, k, c) for n, k, c in rows], "session_id string, turn_id string, trace_seq bigint, event_type string, tool_call_id string")
    got = {(r.side, r.trace_seq): r.other_seq for r in S.link_trace_calls(t).collect()}
    assert got == {("call", 1): None, ("call", 2): 3, ("result", 3): 2, ("result", 4): None}


def test_checkpoint_fold_against_a_loop(spark):
    import random
    rnd = random.Random(2)
    rows, bounds = [], {5, 10, 20, 30}
    for n in range(1, 40):
        rows.append((100 + n, rnd.choice([None, *[100 + m for m in range(max(1, n - 3), n)]]), rnd.choice([5, 10, 20, 30, 7])))
    seq, cov, n = None, 0, 0
    for s, p, c in rows:
        if p == seq and c in bounds and c >= cov:
            seq, cov, n = s, c, n + 1
    c = spark.createDataFrame([("s", *r) for r in rows], "session_id string, seq bigint, previous_seq bigint, covered bigint")
    b = spark.createDataFrame([("s", x) for x in bounds], "session_id string, seq bigint")
    r = S.accepted_checkpoints(c, b).first()
    assert (r.seq, r.covered, r.accepted) == (seq, cov, n)


def test_recent_messages_and_titles(spark):
    roles = ["user", "assistant", "tool", "user", "assistant", "user"]
    m = spark.createDataFrame([("s", i, r, f"m{i}") for i, r in enumerate(roles)], "session_id string, turn int, role string, text string")
    assert [r.text for r in S.recent_messages(m, 4).orderBy("turn").collect()] == ["m1", "m3", "m4", "m5"]
    heads = spark.createDataFrame([("s", None, 1), ("z", "kept", 2), ("q", None, 3)], "session_id string, title string, updated_at int")
    got = {r.session_id: (r.title, r.backfilled) for r in H.backfill_titles(heads, two_turns(spark)).collect()}
    assert got == {"s": ("hi", True), "z": ("kept", False), "q": ("新对话", True)}


def test_memory_and_profile(spark):
    store = spark.createDataFrame([("theme", "RAG")], "category string, entry string")
    e = spark.createDataFrame([(1, "theme", " rag "), (2, "paper", "New  one"), (3, "finding", "new one"), (4, "x", "y"), (5, "paper", "z" * 501)], "ord int, category string, entry string")
    assert [r.outcome for r in H.append_memory(store, e).orderBy("ord").collect()] == ["duplicate", "added", "duplicate", "unknown_category", "bad_length"]
    prof = spark.createDataFrame([("u", "university", "A"), ("u", "preferences", "x\ny")], "user_id string, field string, value string")
    u = spark.createDataFrame([("u", 1, "university", ["B"]), ("u", 2, "university", [" "]), ("u", 3, "preferences", ["p", "P ", "q"])], "user_id string, ord int, field string, vals array<string>")
    got = {r.field: (r.value, r.changed) for r in H.upsert_profile(prof, u).collect()}
    assert got == {"university": ("B", True), "preferences": ("p\nq", True)}


def test_budget_limits_at_equality(spark):
    df = spark.createDataFrame([(6899,), (6900,), (6901,)], "input_size int")
    got = B.with_budget(df, window=10000, output=3000, safety=100).collect()
    assert all((r.budget, r.trigger_x100, r.target_x100) == (6900, 690000, 552000) for r in got)
    assert [r.hard_exceeded for r in got] == [False, True, True] and [r.trigger_reached for r in got] == [False, True, True]


def test_input_size_equals_serialized_length(spark):
    import json
    msgs = [("user", "héllo \"q\"\n中"), ("assistant", "a\\b\t")]
    want = len(json.dumps({"messages": [{"role": r, "content": c} for r, c in msgs], "tools": []}, ensure_ascii=False).encode()) + 16 * 3
    df = spark.createDataFrame([("c", r, t) for r, t in msgs], "k string, role string, text string")
    assert B.measure(df, ["k"]).first().input_size == want


def test_fold_keeps_recent_turns_but_at_least_the_oldest(spark):
    rows = [("a", 1, 7000, True), ("a", 2, 1400, True), ("b", 1, 3000, True), ("b", 2, 1600, False), ("b", 3, 10, True), ("c", 1, 100, True)]
    t = spark.createDataFrame(rows, "session_id string, ord bigint, size bigint, compressible boolean")
    f = {(r.session_id, r.ord): r.fold for r in B.turns_to_fold(t, F.lit(1920)).collect()}
    assert f == {("a", 1): True, ("a", 2): False, ("b", 1): True, ("c", 1): True}
    p = {r.session_id: (r.chosen, r.reason) for r in B.fitting_prefix(B.turns_to_fold(t, F.lit(1920)), 100, 5000).collect()}
    assert p == {"a": (0, "summary_input_budget_no_complete_prefix"), "b": (1, "ok"), "c": (1, "ok")}


def test_canonical_ids_and_stale_files(spark):
    reg = spark.createDataFrame([(7, "A"), (8, "old")], "paper_id int, content_hash string")
    arr = spark.createDataFrame([(10, "A"), (11, "B"), (12, "B"), (13, "old")], "doc_id int, content_hash string")
    live = I.live_registry(reg, spark.createDataFrame([(7,)], "paper_id int"))
    got = {r.doc_id: (r.paper_id, r.reused) for r in I.canonical_ids(arr, live).collect()}
    assert got == {10: (7, True), 11: (11, False), 12: (11, True), 13: (13, False)}


def test_requested_pages_last_marker_wins(spark):
    df = spark.createDataFrame([(1, "--- Page 1 ---\na\n--- Page 2 ---\n\nb\n--- Page 1 ---\nc")], "doc_id int, raw_text string")
    got = {r.page: (r.text, r.found) for r in I.requested_pages(df, F.array(F.lit(1), F.lit(2), F.lit(3))).collect()}
    assert got == {1: ("c", True), 2: ("b", True), 3: ("", False)}


def test_binary_files_and_session_files(spark, tmp_path):
    import hashlib
    (tmp_path / "a_x.pdf").write_bytes(b"AA")
    (tmp_path / "b.pdf").write_bytes(b"AA")
    got = {r.file_name: (r.content_hash, r.size_bytes) for r in I.read_binary(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(b"AA").hexdigest(), 2) for n in ("a_x.pdf", "b.pdf")}
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "1.json").write_text('{"session_id":" s1 ","paper_id":"p","active_paper_ids":["q","p"],"updated_at":"t"}')
    (folder / "2.json").write_text("{broken")
    p = I.read_session_files(spark, str(folder)).withColumn("ord", F.lit(1))
    empty = spark.createDataFrame([], "session_id string, paper_id string")
    heads, links = I.import_sessions(p, empty.select("session_id"), empty)
    assert [r.session_id for r in heads.collect()] == ["s1"] and {r.paper_id for r in links.collect()} == {"p", "q"}
    assert I.import_sessions(p, heads, links)[1].count() == 0


def test_pages_reassemble_the_log(spark):
    fields = [(1, s, f, p, v) for s in range(1, 6) for f, (p, v) in enumerate([("a.text", "x" * (s * 211)), ("ref.chunk_id", "c_" + str(s) * 40), ("b", "é" * 33)])]
    df = spark.createDataFrame(fields, "session_id int, seq long, field_index long, path string, value string")
    seq, field, offset, got = 1, 0, 0, {}
    for _ in range(40):
        req = spark.createDataFrame([(9, 1, seq, 5, 512, field, offset)], "request_id int, session_id int, start_seq long, end_seq long, max_chars int, field_index long, offset long")
        rows = H.page_fields(req, df).orderBy("seq", "field_index").collect()
        assert rows[0].error is None
        for r in rows:
            value = next(v for _, s, f, _, v in fields if (s, f) == (r.seq, r.field_index))
            got[r.seq, r.field_index] = got.get((r.seq, r.field_index), "") + value[r.offset:r.offset + r.shown_chars]
            assert r.path != "ref.chunk_id" or r.shown_chars in (0, len(value))
        last = rows[-1]
        if last.whole:
            break
        seq, field, offset = last.seq, last.field_index, last.next_offset
    assert got == {(s, f): v for _, s, f, _, v in fields}


def test_refused_pages_say_why(spark):
    df = spark.createDataFrame([(1, s, 0, "p", "v" * 10) for s in range(1, 151)], "session_id int, seq long, field_index long, path string, value string")
    asked = [(1, 1, 1, 150, 1000, 0, 0), (2, 1, 5, 4, 1000, 0, 0), (3, 1, 1, 5, 100, 0, 0), (4, 1, 149, 160, 1000, 0, 0), (5, 1, 1, 5, 1000, 1, 0), (6, 1, 1, 5, 1000, 0, 11), (7, 1, 51, 150, 4000, 0, 10), (8, 2, 1, 1, 1000, 0, 0)]
    req = spark.createDataFrame(asked, "request_id int, session_id int, start_seq long, end_seq long, max_chars int, field_index long, offset long")
    got = {r.request_id: r.error for r in H.page_fields(req, df).select("request_id", "error").distinct().collect()}
    wide, gone = "history_read_invalid_range_or_limit", "history_reference_unavailable"
    assert got == {1: wide, 2: wide, 3: wide, 4: gone, 5: "history_read_invalid_field_index", 6: "history_read_invalid_offset", 7: None, 8: gone}
    ended = df.where("seq < 3").select("session_id", "seq")
    assert H.page_fields(req.where("request_id = 7"), df, ended).first().error == gone


def test_active_documents_by_iso_time(spark):
    rows = [(1, "2024-05-01T10:00:00.5Z", "b"), (1, "2024-05-01T10:00:00.5Z", "a"), (1, "2023-01-01T00:00:00Z", "z"), (1, "soon", "q"), (1, None, "n"), (2, "2024-05-01T10:00:00Z", "a")]
    got = S.active_documents(spark.createDataFrame(rows, "session_id int, added_at string, doc_id string")).where("session_id = 1").orderBy("position").collect()
    assert [r.doc_id for r in got] == ["n", "q", "z", "a", "b"] and [r.position for r in got] == [1, 2, 3, 4, 5]

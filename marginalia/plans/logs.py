"""Session log queries (JN-2 .. JN-8, JN-10, JN-12, AG-*, WN-1, WN-2, WN-5 .. WN-8, TK-3 .. TK-5, SE-*, HP-*, ME-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions.json_tables import json_text
from marginalia.operators import headings as DH
from marginalia.operators import history as H
from marginalia.operators import quality as Q
from marginalia.operators import sessions as S
from marginalia.operators import summaries as SU
from marginalia.plans.base import documents, papers, query, session_events, sql_collapse, sql_list, sql_strip, table, trace_events, with_views
from marginalia.plans.search import ASK, PAPER_WITH, VERSIONED, _requests, _versioned
from marginalia.plans.structure import SECTIONS_WITH
from marginalia.scale import block_of, number_rows, running, time_block

EV = with_views("session_events_v")
TR = with_views("trace_events_v")


@query("wn1_session_sequence", """WITH old AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
   SELECT event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) + coalesce(n, 0) AS seq FROM events e LEFT JOIN old USING (user_id) WHERE ts >= TIMESTAMP '2024-01-10'""")
def _(spark, d):
    """Events up to a day are the log (numbered already), later ones arrive."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    log = number_rows(e.where(F.col("ts") < cut), ["user_id"], ["ts", "event_id"], time_block("ts"), "seq")
    return S.append_numbered(log, e.where(F.col("ts") >= cut), ["user_id"], ["ts", "event_id"], time_block("ts")).select("event_id", "user_id", "seq")


@query("wn2_trace_sequence", TR + "SELECT session_id, turn_id, trace_seq, event_type, size_chars FROM trace_events_v")
def _(spark, d):
    return trace_events(spark, d).drop("props")


@query("jn2_call_results", EV + """SELECT c.session_id, c.turn_id, c.tool_call_id, c.seq AS call_seq, r.seq AS result_seq, r.seq IS NOT NULL AS confirmed FROM session_events_v c
   LEFT JOIN session_events_v r ON r.event_type = 'tool/result' AND r.session_id = c.session_id AND r.turn_id = c.turn_id AND r.tool_call_id = c.tool_call_id WHERE c.event_type = 'tool/call'""")
def _(spark, d):
    return S.pair_calls(session_events(spark, d))


CALL_ID = "CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS VARCHAR)"


def _trace_calls(spark, d):
    call = (F.get_json_object("props", "$.k").cast("bigint") % 3).cast("string")
    return trace_events(spark, d).withColumn("tool_call_id", call)


@query("jn3_trace_links", TR + f""", t AS (SELECT session_id, turn_id, {CALL_ID} AS id, trace_seq, event_type FROM trace_events_v),
   c AS (SELECT * FROM t WHERE event_type = 'tool/call_debug'), r0 AS (SELECT * FROM t WHERE event_type = 'tool/result_debug'),
   r AS (SELECT r0.*, (SELECT max(c.trace_seq) FROM c WHERE c.session_id = r0.session_id AND c.turn_id = r0.turn_id AND c.id = r0.id AND c.trace_seq < r0.trace_seq) AS cs FROM r0)
   SELECT session_id, turn_id, id AS tool_call_id, 'result' AS side, trace_seq, cs AS other_seq FROM r
   UNION ALL SELECT c.session_id, c.turn_id, c.id, 'call', c.trace_seq, (SELECT max(r.trace_seq) FROM r WHERE r.session_id = c.session_id AND r.turn_id = c.turn_id AND r.id = c.id AND r.cs = c.trace_seq) FROM c""")
def _(spark, d):
    return S.link_trace_calls(_trace_calls(spark, d))


FIFO = TR + """, t AS (SELECT session_id, turn_id, trace_seq, event_type = 'llm/input' AS i FROM trace_events_v WHERE event_type IN ('llm/input', 'llm/output', 'llm/error')),
   w AS (SELECT *, sum(CASE WHEN i THEN 1 ELSE -1 END) OVER o AS s, count(*) FILTER (i) OVER o AS ni, count(*) FILTER (NOT i) OVER o AS ne FROM t WINDOW o AS (PARTITION BY session_id, turn_id ORDER BY trace_seq)),
   m AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY session_id, turn_id ORDER BY trace_seq)) AS lost FROM w),
   p AS (SELECT *, NOT i AND lost > coalesce(lag(lost) OVER (PARTITION BY session_id, turn_id ORDER BY trace_seq), 0) AS orphan FROM m)"""


@query("jn4_fifo_pairs", FIFO + """ SELECT a.session_id, a.turn_id, a.trace_seq AS input_seq, b.trace_seq AS end_seq FROM p a LEFT JOIN p b ON b.session_id = a.session_id AND b.turn_id = a.turn_id AND NOT b.i AND NOT b.orphan AND b.ne - b.lost = a.ni WHERE a.i
   UNION ALL SELECT session_id, turn_id, NULL, trace_seq FROM p WHERE orphan""")
def _(spark, d):
    return S.pair_model_calls(trace_events(spark, d), S.TURN).select("session_id", "turn_id", "input_seq", "end_seq")


# Steps: 1 for tool events, 2 for the answer; the trace is cut into three steps per turn.
STEPS = with_views("session_events_v", "trace_events_v", extra="""se AS (SELECT session_id, turn_id, seq, CASE WHEN event_type LIKE 'tool/%' THEN 1 WHEN event_type IN ('assistant/message', 'turn/end') THEN 2 END AS step FROM session_events_v),
   te AS (SELECT session_id, concat('t', CAST(substring(turn_id, 9, 2) AS INT)) AS turn_id, trace_seq, 1 + trace_seq % 3 AS step FROM trace_events_v)""")


def _stepped(spark, d):
    t = F.col("event_type")
    se = session_events(spark, d).withColumn("step", F.when(t.startswith("tool/"), 1).when(t.isin("assistant/message", "turn/end"), 2).cast("bigint"))
    te = trace_events(spark, d).withColumn("turn_id", F.concat(F.lit("t"), F.substring("turn_id", 9, 2).cast("int").cast("string"))).withColumn("step", 1 + F.col("trace_seq") % 3)
    return se, te


@query("jn5_joined_steps", STEPS + """, a AS (SELECT session_id, turn_id, step, count(*) AS semantic_events, min(seq) AS semantic_first, max(seq) AS semantic_last FROM se WHERE step IS NOT NULL GROUP BY 1, 2, 3),
   b AS (SELECT session_id, turn_id, step, count(*) AS trace_events, min(trace_seq) AS trace_first, max(trace_seq) AS trace_last FROM te GROUP BY 1, 2, 3)
   SELECT *, CASE WHEN trace_events IS NULL THEN 'semantic' WHEN semantic_events IS NULL THEN 'trace' ELSE 'both' END AS found_in FROM a FULL OUTER JOIN b USING (session_id, turn_id, step)""")
def _(spark, d):
    return S.join_logs(*_stepped(spark, d))


@query("jn6_range_coverage", EV + """, m AS (SELECT session_id, max(seq) AS n FROM session_events_v GROUP BY 1), r AS (SELECT session_id, 'R1' AS ref_id, CAST(1 AS BIGINT) AS start_seq, n AS end_seq FROM m UNION ALL SELECT session_id, 'R2', n, n + 3 FROM m)
   SELECT r.*, (SELECT count(*) FROM session_events_v e WHERE e.session_id = r.session_id AND e.seq BETWEEN start_seq AND end_seq) AS n, ref_id = 'R1' AS complete FROM r""")
def _(spark, d):
    e = session_events(spark, d)
    m = e.groupBy("session_id").agg(F.max("seq").alias("m"))
    one = F.lit(1).cast("bigint")
    refs = m.select("session_id", F.lit("R1").alias("ref_id"), one.alias("start_seq"), F.col("m").alias("end_seq")).unionByName(
        m.select("session_id", F.lit("R2").alias("ref_id"), F.col("m").alias("start_seq"), (F.col("m") + 3).alias("end_seq")))
    return S.range_coverage(refs, e)


OPEN = "SELECT DISTINCT session_id, turn_id FROM session_events_v WHERE event_type = 'turn/start' EXCEPT SELECT session_id, turn_id FROM session_events_v WHERE event_type = 'turn/end'"


@query("jn7_incomplete_turns", EV + OPEN)
def _(spark, d):
    return S.incomplete_turns(session_events(spark, d))


@query("se2_started_except_ended", EV + OPEN)
def _(spark, d):
    e = session_events(spark, d)
    kind = lambda k: e.where(F.col("event_type") == k).select(*S.TURN).distinct()
    return kind("turn/start").exceptAll(kind("turn/end"))


def _sessions(spark, d):
    """Headers of the conversations: some have no title yet, some events have no header."""
    i = F.col("conv_id")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.where(i % 13 != 0).select(i.alias("session_id"), F.when(i % 4 != 0, F.concat(F.lit("T"), i.cast("string"))).alias("title"), (1000 + F.col("n") * 10).alias("updated_at"))


SESS = """sess AS (SELECT conv_id AS session_id, CASE WHEN conv_id % 4 <> 0 THEN concat('T', conv_id) END AS title, 1000 + count(*) * 10 AS updated_at FROM conversations WHERE conv_id % 13 <> 0 GROUP BY conv_id)"""


def _links(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), (F.col("turn") % 4).alias("doc_id"), F.col("turn").alias("added_at")).groupBy("session_id", "doc_id").agg(F.min("added_at").alias("added_at"))


LINKS = "lk AS (SELECT conv_id AS session_id, turn % 4 AS doc_id, min(turn) AS added_at FROM conversations GROUP BY 1, 2)"


@query("jn8_restore_view", with_views("session_events_v", extra=SESS + ", " + LINKS + f", op AS ({OPEN})") + """SELECT s.session_id, coalesce(title, '新对话') AS title, (SELECT count(*) FROM lk WHERE lk.session_id = s.session_id) AS active_docs,
   (SELECT count(*) FROM op WHERE op.session_id = s.session_id) AS incomplete_turns, e.seq, e.turn_id, e.event_type FROM sess s LEFT JOIN session_events_v e ON e.session_id = s.session_id""")
def _(spark, d):
    v = S.restore_view(_sessions(spark, d), _links(spark, d), session_events(spark, d))
    return v.select("session_id", "title", "active_docs", "incomplete_turns", "seq", "turn_id", "event_type")


@query("jn10_scoped_references", f"WITH {LINKS}, r AS (SELECT conv_id AS session_id, turn, turn % 6 AS doc_id FROM conversations) SELECT r.session_id, r.turn, r.doc_id, EXISTS (SELECT 1 FROM lk WHERE lk.session_id = r.session_id AND lk.doc_id = r.doc_id) AS allowed FROM r")
def _(spark, d):
    refs = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", (F.col("turn") % 6).alias("doc_id"))
    return S.scoped_refs(refs, _links(spark, d)).select("session_id", "turn", "doc_id", "allowed")


# Every session proposes a checkpoint in its last turn, at boundaries of different quality.
CKPT = """ends AS (SELECT session_id, turn_id, seq FROM session_events_v WHERE event_type = 'turn/end'),
  tn AS (SELECT session_id, turn_id, min(seq) AS first, bool_or(event_type = 'turn/end') AS ended, min(CASE WHEN event_type = 'turn/end' THEN seq END) AS e FROM session_events_v GROUP BY 1, 2),
  cur AS (SELECT session_id, arg_max(turn_id, first) AS turn_id, max(first) AS first FROM tn GROUP BY 1),
  ck AS (SELECT session_id, 100 + min(seq) AS seq, min(seq) AS covered FROM ends WHERE session_id % 5 = 0 GROUP BY 1),
  pr AS (SELECT c.session_id, c.turn_id, CASE WHEN c.session_id % 10 = 0 THEN (SELECT seq FROM ck WHERE ck.session_id = c.session_id) END AS previous_seq,
     CAST(CASE c.session_id % 4 WHEN 0 THEN c.first + 1 WHEN 1 THEN greatest(c.first - 2, 0) ELSE coalesce((SELECT max(seq) FROM ends WHERE ends.session_id = c.session_id AND seq < c.first), 0) END AS BIGINT) AS covered_seq FROM cur c)"""


def _checkpoints(spark, d):
    e = session_events(spark, d)
    ends = e.where("event_type = 'turn/end'").select("session_id", "seq")
    first = e.groupBy(*S.TURN).agg(F.min("seq").alias("first"))
    cur = first.groupBy("session_id").agg(F.max_by("turn_id", "first").alias("turn_id"), F.max("first").alias("first"))
    ck = ends.where("session_id % 5 = 0").groupBy("session_id").agg((F.min("seq") + 100).alias("seq"), F.min("seq").alias("covered"))
    before = ends.join(cur.select("session_id", "first"), "session_id").where("seq < first").groupBy("session_id").agg(F.max("seq").alias("b"))
    i = F.col("session_id")
    p = cur.join(before, "session_id", "left").join(ck.select("session_id", F.col("seq").alias("ck")), "session_id", "left")
    p = p.select("session_id", "turn_id", F.when(i % 10 == 0, F.col("ck")).alias("previous_seq"),
                 F.when(i % 4 == 0, F.col("first") + 1).when(i % 4 == 1, F.greatest(F.col("first") - 2, F.lit(0))).otherwise(F.coalesce("b", F.lit(0))).cast("bigint").alias("covered_seq"))
    return e, p, ck


@query("jn12_checkpoint_admission", with_views("session_events_v", extra=SESS + ", " + CKPT) + """SELECT p.session_id, p.turn_id, p.previous_seq, p.covered_seq, CASE WHEN s.session_id IS NULL THEN 'checkpoint_session_deleted'
    WHEN k.seq IS DISTINCT FROM p.previous_seq THEN 'checkpoint_conflict' WHEN t.ended THEN 'checkpoint_current_turn_not_active' WHEN p.covered_seq < coalesce(k.covered, 0) OR p.covered_seq >= t.first THEN 'checkpoint_invalid_boundary'
    WHEN NOT EXISTS (SELECT 1 FROM ends e WHERE e.session_id = p.session_id AND e.seq = p.covered_seq) THEN 'checkpoint_boundary_must_end_old_turn'
    WHEN EXISTS (SELECT 1 FROM tn o WHERE o.session_id = p.session_id AND o.first <= p.covered_seq AND (o.e IS NULL OR o.e > p.covered_seq)) THEN 'checkpoint_would_cover_incomplete_turn' ELSE 'ok' END AS reason
   FROM pr p LEFT JOIN sess s USING (session_id) LEFT JOIN ck k ON k.session_id = p.session_id LEFT JOIN tn t ON t.session_id = p.session_id AND t.turn_id = p.turn_id""")
def _(spark, d):
    e, p, ck = _checkpoints(spark, d)
    return S.admit_checkpoints(p, _sessions(spark, d), e, ck)


# ---- rollups ------------------------------------------------------------------------------------

ROLL = """SELECT session_id, turn_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, arg_min(content, seq) FILTER (event_type = 'user/message') AS user_input,
   arg_max(content, seq) FILTER (event_type = 'assistant/message') AS final_answer, false AS has_error,
   CASE WHEN bool_or(event_type = 'turn/end' AND status <> 'success') THEN 'error' WHEN bool_or(event_type = 'turn/end') THEN 'success' ELSE 'incomplete' END AS status FROM session_events_v GROUP BY 1, 2"""


@query("ag1_turn_rollup", EV + ROLL)
def _(spark, d):
    return S.turn_rollup(session_events(spark, d))


@query("ag2_turn_status", EV + f"SELECT status, count(*) AS n FROM ({ROLL}) GROUP BY 1")
def _(spark, d):
    return S.turn_rollup(session_events(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("ag3_step_rollup", STEPS + """SELECT session_id, turn_id, 1 + trace_seq % 3 AS step, min(trace_seq) AS first_seq, max(trace_seq) AS last_seq, count(*) FILTER (event_type = 'llm/input') AS model_calls,
   count(*) FILTER (event_type = 'tool/call_debug') AS tool_calls, count(*) FILTER (event_type = 'tool/result_debug') AS tool_results, CAST(0 AS BIGINT) AS context_events FROM trace_events_v GROUP BY 1, 2, 3""")
def _(spark, d):
    t = trace_events(spark, d).withColumn("step", 1 + F.col("trace_seq") % 3)
    return S.step_rollup(t, [*S.TURN, "step"])


@query("ag3_step_timeline", TR + "SELECT session_id, turn_id, 1 + trace_seq % 3 AS step, trace_seq, event_type, row_number() OVER (PARTITION BY session_id, turn_id, trace_seq % 3, event_type ORDER BY trace_seq) AS kind_ordinal FROM trace_events_v")
def _(spark, d):
    t = trace_events(spark, d).withColumn("step", 1 + F.col("trace_seq") % 3)
    return S.step_timeline(t, [*S.TURN, "step"]).select("session_id", "turn_id", "step", "trace_seq", "event_type", "kind_ordinal")


@query("ag4_document_summary", SECTIONS_WITH + f"""SELECT doc_id, count(*) FILTER (content <> '') AS n_sections, CAST(sum(least(length(content), 1200)) AS BIGINT) AS preview_chars, count(*) FILTER (length(content) > 1200) AS n_truncated,
    max(CASE WHEN section = 'abstract' AND content = '' THEN 'abstract' END) AS missing FROM sections GROUP BY doc_id""")
def _(spark, d):
    w = Q.wide_sections(papers(spark, d))
    secs = F.filter(F.array(*[F.col(k) for k in K.SECTION_KEYS]), lambda s: s != "")
    view = F.transform(secs, lambda s: F.struct(F.left(s, F.lit(1200)).alias("preview"), (F.length(s) > 1200).alias("truncated")))
    v = w.select("doc_id", view.alias("v"), F.when(F.col("abstract") == "", "abstract").alias("missing"))
    return v.select("doc_id", F.size("v").cast("bigint").alias("n_sections"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["preview"])).alias("preview_chars"),
                    F.size(F.filter("v", lambda x: x["truncated"])).cast("bigint").alias("n_truncated"), "missing")


# Documents with a title but for every fourth, one author where the source is known, sections by rule with pages of two, and the numbered
# entries after the last heading of references.
AG4_SQL = SECTIONS_WITH.rstrip() + """,
  tail AS (SELECT doc_id, CASE WHEN contains(raw_text, concat(chr(10), 'References', chr(10))) THEN string_split(raw_text, concat(chr(10), 'References', chr(10)))[-1] END AS t FROM papers_v),
  piece2 AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\[[0-9]+\\] ')) AS x, generate_subscripts(regexp_split_to_array(t, '\\[[0-9]+\\] '), 1) AS pos FROM tail WHERE t IS NOT NULL),
  refs AS (SELECT doc_id, count(*) AS n, string_agg(concat(pos, '|', string_split(x, '.')[1], '|', nullif(regexp_extract(x, '(19|20)[0-9][0-9]'), ''), '|', length(x) > 800, '|', sha256(substring(x, 1, 800))), ';' ORDER BY pos) AS list FROM piece2 WHERE x <> '' GROUP BY 1),
  numbered AS (SELECT *, list_position([{keys}], section) AS pos FROM sections WHERE content <> ''),
  secs AS (SELECT doc_id, count(*) AS n, string_agg(concat(pos, '|', section, '|1|', (pos + 1) // 2, '|', (pos + 1) // 2 + 1, '|', source, '|', length(content) > 1200, '|', sha256(substring(content, 1, 1200))), ';' ORDER BY pos) AS list,
      max(CASE WHEN section = 'abstract' THEN content END) AS abstract FROM numbered GROUP BY 1)
  SELECT p.doc_id, coalesce(s.n, 0) AS n_sections, coalesce(s.list, '') AS sections, coalesce(r.n, 0) AS n_references, coalesce(r.list, '') AS refs, CAST(length(p.raw_text) // 3000 + 1 AS BIGINT) AS page_count,
    CASE WHEN length(p.raw_text) < 3000 THEN 'one page' ELSE '' END AS warnings,
    concat_ws(',', CASE WHEN p.doc_id % 4 = 0 THEN 'title' END, CASE WHEN d.source IS NULL THEN 'authors' END, CASE WHEN coalesce(s.abstract, '') = '' THEN 'abstract' END, CASE WHEN s.n IS NULL THEN 'sections' END) AS missing
  FROM papers_v p JOIN documents d USING (doc_id) LEFT JOIN secs s USING (doc_id) LEFT JOIN refs r USING (doc_id)""".replace("{keys}", sql_list(K.SECTION_KEYS))


@query("ag4_full_summary", AG4_SQL)
def _(spark, d):
    p, i = papers(spark, d), F.col("doc_id")
    found = DH.extract_sections(p).where("content <> ''")
    pos = F.array_position(F.array(*[F.lit(k) for k in K.SECTION_KEYS]), F.col("section"))
    page = F.floor((pos + 1) / 2)
    sections = found.select("doc_id", pos.alias("pos"), F.col("content").alias("text"), F.col("section").alias("title"), F.lit(1).alias("level"), page.alias("page_start"), (page + 1).alias("page_end"), "source")
    tail = F.substring_index("raw_text", "\nReferences\n", -1)
    entries = p.where(F.contains("raw_text", F.lit("\nReferences\n"))).select("doc_id", F.posexplode(F.split(tail, "\\[[0-9]+\\] ")).alias("pos", "text")).where("text <> ''")
    year = F.nullif(F.regexp_extract("text", "(19|20)[0-9][0-9]", 0), F.lit(""))
    references = entries.select("doc_id", (F.col("pos") + 1).alias("pos"), "text", F.substring_index("text", ".", 1).alias("title"), year.alias("year"))
    abstract = found.where("section = 'abstract'").select("doc_id", F.col("content").alias("abstract"))
    n = F.length("raw_text")
    docs = p.select("doc_id", F.when(i % 4 != 0, "a title").alias("title"), (F.floor(n / 3000) + 1).alias("page_count"), F.when(n < 3000, F.array(F.lit("one page"))).alias("warnings"))
    docs = docs.join(documents(spark, d).select("doc_id", F.when(F.col("source").isNotNull(), F.array("source")).alias("authors")), "doc_id").join(abstract, "doc_id", "left")
    m = SU.document_summaries(docs, sections, references)
    bar = lambda *xs: F.concat(*[y for n, x in enumerate(xs) for y in ([F.lit("|")] if n else []) + [F.coalesce(x.cast("string"), F.lit(""))]])
    tell = lambda c, *names: F.array_join(F.transform(c, lambda x: bar(x["pos"], *[x[k] for k in names], x["truncated"], F.sha2(x["preview"], 256))), ";")
    return m.select("doc_id", F.size("sections").cast("bigint").alias("n_sections"), tell("sections", "title", "level", "page_start", "page_end", "source").alias("sections"),
                    F.size("references").cast("bigint").alias("n_references"), tell("references", "title", "year").alias("refs"), "page_count",
                    F.array_join("warnings", ",").alias("warnings"), F.array_join("missing_fields", ",").alias("missing"))


@query("ag5_section_lengths", SECTIONS_WITH + "SELECT doc_id, " + ", ".join(f"max(CASE WHEN section = '{k}' THEN length END) AS len_{k}" for k in K.SECTION_KEYS) + " FROM sections GROUP BY doc_id")
def _(spark, d):
    w = Q.wide_sections(papers(spark, d))
    return w.select("doc_id", *[F.length(k).cast("bigint").alias(f"len_{k}") for k in K.SECTION_KEYS])


@query("ag6_compression", TR + """SELECT session_id, turn_id, CAST(sum(size_chars) AS BIGINT) AS model_size, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS history_size FROM trace_events_v WHERE event_type = 'tool/result_debug' GROUP BY 1, 2""")
def _(spark, d):
    t = trace_events(spark, d).where("event_type = 'tool/result_debug'").select(*S.TURN, F.col("size_chars").alias("model_size"), F.get_json_object("props", "$.k").cast("bigint").alias("history_size"))
    return S.compression(t, S.TURN).drop("ratio")


@query("ag7_first_user_message", EV + "SELECT session_id, arg_min(content, seq) AS first_message FROM session_events_v WHERE event_type = 'user/message' GROUP BY 1")
def _(spark, d):
    return S.first_user_message(session_events(spark, d))


@query("ag8_cited_sections", PAPER_WITH + VERSIONED + ASK + """, f AS (SELECT request_id, section, min(rank) AS first_pos FROM rbest GROUP BY 1, 2)
   SELECT request_id, section, first_pos, row_number() OVER (PARTITION BY request_id ORDER BY first_pos) AS ordinal FROM f""")
def _(spark, d):
    from marginalia.operators.retrieval import retrieve_scoped
    v = _versioned(spark, d)
    hits = retrieve_scoped(_requests(spark, d), v, 3)
    ev = hits.join(v.select("doc_id", "chunk_id", "section").distinct(), ["doc_id", "chunk_id"])
    return S.cited_sections(ev, "request_id", "rank").select("request_id", "section", "first_pos", "ordinal")


ORIG = """CASE WHEN role = 'system' THEN 'system' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'current_turn' ELSE concat('session_', role) END"""


def _origins(spark, d):
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    no = F.lit(False)
    return c.join(last, "conv_id").withColumn("origin", S.message_origin(F.col("role"), no, F.col("turn") == F.col("_last"), no))


@query("ag10_message_origins", f"SELECT conv_id, origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS content_length FROM (SELECT *, {ORIG} AS origin FROM conversations) GROUP BY 1, 2")
def _(spark, d):
    return _origins(spark, d).groupBy("conv_id", "origin").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("content_length"))


@query("ag11_usage_totals", """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS call_id, event_id AS pos, unnest(['prompt', 'output']) AS counter, unnest([CAST(floor(value) AS BIGINT), CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END]) AS value FROM events),
   l AS (SELECT user_id, call_id, counter, arg_max(value, pos) AS value FROM d WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT user_id, counter, CAST(sum(value) AS BIGINT) AS total, count(*) AS n_calls FROM l GROUP BY 1, 2""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    both = F.array(F.struct(F.lit("prompt").alias("counter"), F.floor("value").cast("bigint").alias("value")), F.struct(F.lit("output").alias("counter"), F.when(F.col("event_type") != "error", k).alias("value")))
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("call_id"), F.col("event_id").alias("pos"), F.explode(both).alias("c")).select("user_id", "call_id", "pos", "c.*")
    return S.usage_totals(e, ["user_id", "call_id"], ["user_id"])


@query("ag12_lookup_profile", "SELECT user_id AS batch_id, count(*) AS tool_count, max(CAST(floor(value * 1000) AS BIGINT)) AS parallel_ms, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS sum_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.floor(F.col("value") * 1000).cast("bigint").alias("duration_ms"), (F.col("event_type") == "error").alias("has_error"))
    return S.lookup_profile(e)


@query("ag13_single_source", """WITH r AS (SELECT doc_id, 'grobid' AS parser, source AS title FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'pymupdf', lang FROM documents WHERE doc_id % 3 = 0)
   SELECT d.doc_id, count(r.parser) AS n, CASE WHEN count(r.parser) = 1 THEN max(title) END AS title, coalesce(string_agg(r.parser, ',' ORDER BY r.parser), '') AS parsers, CASE WHEN count(r.parser) = 0 THEN 'No cached parser result; call a parser Tool first.' ELSE '' END AS warning FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def _(spark, d):
    docs = documents(spark, d)
    r = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("grobid").alias("parser"), F.col("source").alias("title")).unionByName(
        docs.where("doc_id % 3 = 0").select("doc_id", F.lit("pymupdf").alias("parser"), F.col("lang").alias("title")))
    return S.single_source(docs.select("doc_id"), r)


# ---- windows and limits -----------------------------------------------------------------------------

SAFE = """run AS (SELECT session_id, turn_id, seq, event_type, sum(CASE WHEN seq = (SELECT min(x.seq) FROM session_events_v x WHERE x.session_id = v.session_id AND x.turn_id = v.turn_id) THEN 1 ELSE 0 END
    - CASE WHEN event_type = 'turn/end' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS open_turns FROM session_events_v v),
  safe AS (SELECT session_id, turn_id, seq, open_turns = 0 AS safe FROM run WHERE event_type = 'turn/end')"""


@query("wn5_safe_boundaries", with_views("session_events_v", extra=SAFE) + "SELECT * FROM safe")
def _(spark, d):
    return S.safe_boundaries(session_events(spark, d))


CHAIN = with_views("session_events_v", extra="/*recursive*/ " + SAFE + """,
  en AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM session_events_v WHERE event_type = 'turn/end'),
  ck AS (SELECT e.session_id, e.seq + 100000 AS seq, CASE WHEN n % 3 = 0 THEN 7 ELSE prev + 100000 END AS previous_seq, e.seq AS covered FROM en e JOIN safe s ON s.session_id = e.session_id AND s.seq = e.seq WHERE s.safe),
  nx AS (SELECT p.session_id, p.seq, min(c.seq) AS nxt FROM ck p JOIN ck c ON c.session_id = p.session_id AND c.previous_seq = p.seq AND c.covered >= p.covered AND c.seq > p.seq GROUP BY 1, 2),
  ch AS (SELECT session_id, min(seq) AS seq, 1 AS accepted FROM ck WHERE previous_seq IS NULL GROUP BY 1 UNION ALL SELECT ch.session_id, nx.nxt, ch.accepted + 1 FROM ch JOIN nx ON nx.session_id = ch.session_id AND nx.seq = ch.seq)""")


@query("wn8_accepted_checkpoints", CHAIN + "SELECT session_id, max(seq) AS seq, max(seq) - 100000 AS covered, CAST(max(accepted) AS BIGINT) AS accepted FROM ch GROUP BY 1")
def _(spark, d):
    """Each session's ends propose checkpoints that name the one before, some with a wrong name."""
    e = session_events(spark, d)
    b = S.safe_boundaries(e).where("safe")
    n = number_rows(e.where("event_type = 'turn/end'").select("session_id", "seq"), ["session_id"], ["seq"], block_of("seq"), "n")
    n = running(n, ["session_id"], ["seq"], block_of("seq"), {"prev": ("last", F.col("seq") + 100000, False)})
    c = n.select("session_id", (F.col("seq") + 100000).alias("seq"), F.when(F.col("n") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("prev")).alias("previous_seq"), F.col("seq").alias("covered"))
    return S.accepted_checkpoints(c, b)


@query("tk3_newest_sessions", f"WITH {SESS} SELECT session_id, updated_at FROM sess ORDER BY updated_at DESC, session_id DESC")
def _(spark, d):
    return S.newest_sessions(_sessions(spark, d)).select("session_id", "updated_at")


@query("tk4_recent_messages", f"""SELECT conv_id, turn, role, rn AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant') AND {sql_strip('text')} <> '') WHERE rn <= 4""")
def _(spark, d):
    return S.recent_messages(table(spark, d, "conversations"), 4, ["conv_id"]).select("conv_id", "turn", "role", "from_end")


@query("tk5_active_documents", f"WITH {LINKS} SELECT session_id, doc_id, row_number() OVER (PARTITION BY session_id ORDER BY added_at, doc_id) AS position FROM lk")
def _(spark, d):
    return S.active_documents(_links(spark, d)).select("session_id", "doc_id", "position")


@query("se1_ordered_distinct", """WITH v AS (SELECT user_id, event_type AS v, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, v AS value, row_number() OVER (PARTITION BY user_id ORDER BY o, v) AS position FROM v""")
def _(spark, d):
    v = table(spark, d, "events").select("user_id", F.concat(F.lit(" "), "event_type").alias("value"), "event_id")
    return S.ordered_distinct(v, "user_id", "value", "event_id").select("user_id", "value", "position")


@query("se3_source_catalog", """WITH p AS (SELECT user_id, event_type AS c, 0 AS part, event_id AS o FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT user_id, concat(event_type, '/', CAST(json_extract(props, '$.k') AS BIGINT) % 4), 1, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'
     UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'), f AS (SELECT user_id, c, min(part * 1099511627776 + o) AS o FROM p GROUP BY 1, 2)
   SELECT user_id AS session_id, concat('R', row_number() OVER (PARTITION BY user_id ORDER BY o, c)) AS ref_id, c AS content FROM f""")
def _(spark, d):
    e = table(spark, d, "events")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    row = lambda df, c: df.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), c.alias("content"))
    late = e.where(F.col("ts") >= cut)
    both = row(late, F.col("event_type")).unionByName(row(late, F.concat("event_type", F.lit("/"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string"))))
    return S.source_catalog(row(e.where(F.col("ts") < cut), F.col("event_type")), both)


# ---- history -----------------------------------------------------------------------------------------

MSG = """cl AS (SELECT session_id, turn_id, min(seq) AS start_seq, min(CASE WHEN event_type = 'turn/end' THEN seq END) AS end_seq, arg_min(status, seq) FILTER (event_type = 'turn/end') AS st FROM session_events_v GROUP BY 1, 2 HAVING end_seq IS NOT NULL),
  e AS (SELECT v.*, st FROM session_events_v v JOIN cl USING (session_id, turn_id) WHERE v.seq <= end_seq),
  k AS (SELECT c.session_id, c.turn_id, c.tool_call_id, (SELECT min(f.seq) FROM e f WHERE f.session_id = c.session_id AND f.turn_id = c.turn_id AND f.seq > c.seq AND f.event_type IN ('user/message', 'assistant/message', 'tool/result')) AS fs,
      EXISTS (SELECT 1 FROM e r WHERE r.session_id = c.session_id AND r.turn_id = c.turn_id AND r.tool_call_id = c.tool_call_id AND r.event_type = 'tool/result') AS done FROM e c WHERE event_type = 'tool/call'),
  msg AS (SELECT session_id, turn_id, seq AS ord_seq, 9 AS ord_kind, CASE event_type WHEN 'user/message' THEN 'user' ELSE 'assistant' END AS role,
      CASE WHEN event_type = 'assistant/message' AND st <> 'success' THEN concat('失败旧轮次曾输出的文本（不是成功完成的回答）：', chr(10), content) ELSE content END AS content FROM e WHERE event_type IN ('user/message', 'assistant/message')
    UNION ALL SELECT session_id, turn_id, fs, 0, 'assistant', concat('calls:', tool_call_id) FROM k WHERE done UNION ALL SELECT session_id, turn_id, fs, 1, 'tool', concat(tool_call_id, ':success') FROM k WHERE done
    UNION ALL SELECT session_id, turn_id, fs, 2, 'assistant', concat('旧轮次中以下工具调用没有已保存的结果，执行状态未确认：', tool_call_id) FROM k WHERE NOT done
    UNION ALL SELECT session_id, turn_id, 1152921504606846976, 10, 'assistant', '该旧轮次已结束但失败/中断，未完成用户目标。错误记录：0' FROM cl WHERE st <> 'success')"""


@query("hp1_turn_messages", with_views("session_events_v", extra=MSG) + "SELECT session_id, turn_id, ord_seq, CAST(ord_kind AS BIGINT) AS ord_kind, role, content FROM msg")
def _(spark, d):
    m = H.turn_messages(session_events(spark, d))
    return m.select("session_id", "turn_id", "ord_seq", F.col("ord_kind").cast("bigint").alias("ord_kind"), "role", "content")


# The log with its payload: every call twice (the second under another id), results of both in reverse order in even
# sessions and of the first only in odd ones, errors in place of the starts of failed turns.  What was said last gives
# arguments, summaries and errors, so quotes, line ends and all scripts of the texts come through.
PAYLOAD_SQL = """ev AS (SELECT *, last_value(content IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS said FROM session_events_v),
  pe AS (SELECT session_id, seq * 4 + k AS seq, turn_id, CASE WHEN event_type = 'turn/start' AND session_id % 11 = 0 THEN 'error' ELSE event_type END AS event_type, content, said,
      CASE WHEN event_type = 'tool/result' AND session_id % 7 = 0 THEN NULL WHEN event_type = 'tool/result' THEN 'success' ELSE status END AS status,
      CASE WHEN tool_call_id IS NOT NULL THEN concat(tool_call_id, CASE WHEN (event_type = 'tool/call' AND k = 1) OR (event_type = 'tool/result' AND session_id % 2 = 0 AND k = 0) THEN 'b' ELSE '' END) END AS id,
      CASE session_id % 5 WHEN 0 THEN 'retrieve "context"' WHEN 1 THEN 'parse_pages' WHEN 2 THEN '' WHEN 3 THEN 'save_note' END AS name
    FROM ev, (VALUES (0), (1)) t(k) WHERE k = 0 OR event_type = 'tool/call' OR (event_type = 'tool/result' AND session_id % 2 = 0)),
  cl AS (SELECT session_id, turn_id, min(seq) FILTER (event_type = 'turn/end') AS end_seq, arg_min(status, seq) FILTER (event_type = 'turn/end') AS st FROM pe GROUP BY 1, 2 HAVING end_seq IS NOT NULL),
  e AS (SELECT pe.*, st FROM pe JOIN cl USING (session_id, turn_id) WHERE seq <= end_seq),
  k AS (SELECT c.*, (SELECT min(f.seq) FROM e f WHERE f.session_id = c.session_id AND f.turn_id = c.turn_id AND f.seq > c.seq AND f.event_type IN ('user/message', 'assistant/message', 'tool/result')) AS fs,
      r.id IS NOT NULL AS done, r.status AS rs, r.said AS rsaid FROM e c LEFT JOIN e r ON r.session_id = c.session_id AND r.turn_id = c.turn_id AND r.id = c.id AND r.event_type = 'tool/result'
    WHERE c.event_type = 'tool/call' AND c.name <> ''),
  full_msg AS (SELECT session_id, turn_id, seq AS ord_seq, 9 AS ord_kind, 0 AS ord_call, CASE event_type WHEN 'user/message' THEN 'user' ELSE 'assistant' END AS role,
      CASE WHEN event_type = 'assistant/message' AND st <> 'success' THEN concat('失败旧轮次曾输出的文本（不是成功完成的回答）：', chr(10), content) ELSE content END AS content, NULL AS calls, NULL AS call_id, NULL AS name
      FROM e WHERE event_type IN ('user/message', 'assistant/message') AND content IS NOT NULL
    UNION ALL SELECT session_id, turn_id, fs, 0, 0, 'assistant', '', string_agg(concat(id, '|', name, '|{"query": ', CAST(to_json(said) AS VARCHAR), '}'), ';' ORDER BY seq), NULL, NULL FROM k WHERE done GROUP BY 1, 2, 3
    UNION ALL SELECT session_id, turn_id, fs, 1, seq, 'tool', CASE WHEN session_id % 4 = 0 THEN concat('{"chars": ', length(rsaid), ', "text": ', CAST(to_json(rsaid) AS VARCHAR), '}')
        ELSE concat('{"tool": ', CAST(to_json(name) AS VARCHAR), ', "status": "', coalesce(rs, 'error'), '", "summary": ', CAST(to_json(rsaid) AS VARCHAR), '}') END, NULL, id, name FROM k WHERE done
    UNION ALL SELECT session_id, turn_id, fs, 2, 0, 'assistant', concat('旧轮次中以下工具调用没有已保存的结果，执行状态未确认：[', string_agg(CAST(to_json(name) AS VARCHAR), ', ' ORDER BY seq), ']'),
        string_agg(concat(id, '|', name, '|{"query": ', CAST(to_json(said) AS VARCHAR), '}'), ';' ORDER BY seq), NULL, NULL FROM k WHERE NOT done GROUP BY 1, 2, 3
    UNION ALL SELECT session_id, turn_id, 1152921504606846976, 10, 0, 'assistant', concat('该旧轮次已结束但失败/中断，未完成用户目标。工具结果仅表示当时已确认的执行事实。错误记录：[',
        coalesce(string_agg(CASE WHEN event_type = 'error' THEN concat('{"message": ', CAST(to_json(said) AS VARCHAR), '}') END, ', ' ORDER BY seq), ''), ']'), NULL, NULL, NULL FROM e WHERE st <> 'success' GROUP BY 1, 2)"""


def _payload_events(spark, d):
    e = running(session_events(spark, d), ["session_id"], ["seq"], block_of("seq"), {"said": ("last", "content", True)})
    s, kind, zero_one = F.col("session_id"), F.col("event_type"), F.array(F.lit(0), F.lit(1))
    call, result = kind == "tool/call", kind == "tool/result"
    e = e.withColumn("k", F.explode(F.when(call | (result & (s % 2 == 0)), zero_one).otherwise(F.array(F.lit(0)))))
    other = (call & (F.col("k") == 1)) | (result & (s % 2 == 0) & (F.col("k") == 0))
    text = json_text(F.col("said"))
    error = (kind == "turn/start") & (s % 11 == 0)
    return e.select(
        "session_id", (F.col("seq") * 4 + F.col("k")).alias("seq"), "turn_id", F.when(error, "error").otherwise(kind).alias("event_type"), "content",
        F.when(result, F.when(s % 7 != 0, "success")).otherwise(F.col("status")).alias("status"), F.concat("tool_call_id", F.when(other, "b").otherwise("")).alias("tool_call_id"),
        F.when(call, F.when(s % 5 == 0, 'retrieve "context"').when(s % 5 == 1, "parse_pages").when(s % 5 == 2, "").when(s % 5 == 3, "save_note")).alias("name"),
        F.when(call, F.concat(F.lit('{"query": '), text, F.lit("}"))).alias("arguments"), F.when(result, F.col("said")).alias("summary"),
        F.when(result & (s % 4 == 0), F.concat(F.lit('{"chars": '), F.length("said").cast("string"), F.lit(', "text": '), text, F.lit("}"))).alias("history_result"),
        F.when(error, F.concat(F.lit('{"message": '), text, F.lit("}"))).alias("error"))


@query("hp1_model_history", with_views("session_events_v", extra=PAYLOAD_SQL)
       + "SELECT session_id, turn_id, ord_seq, CAST(ord_kind AS BIGINT) AS ord_kind, CAST(ord_call AS BIGINT) AS ord_call, role, content, calls, call_id, name FROM full_msg")
def _(spark, d):
    m = H.history_messages(_payload_events(spark, d))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["id"], F.lit("|"), c["name"], F.lit("|"), c["arguments"])), ";")
    return m.select("session_id", "turn_id", "ord_seq", F.col("ord_kind").cast("bigint").alias("ord_kind"), "ord_call", "role", "content",
                    calls.alias("calls"), F.col("tool_call_id").alias("call_id"), "name")


@query("hp2_history_window", with_views("session_events_v", extra=MSG + """, cut AS (SELECT session_id, max(start_seq) AS cutoff FROM cl GROUP BY 1), acc AS (SELECT session_id, min(end_seq) AS covered FROM cl WHERE session_id % 2 = 0 GROUP BY 1)""")
       + "SELECT cl.session_id, cl.turn_id, cl.start_seq, cl.end_seq FROM cl JOIN cut USING (session_id) LEFT JOIN acc USING (session_id) WHERE end_seq < cutoff AND end_seq > coalesce(covered, 0)")
def _(spark, d):
    t = H.closed_turns(session_events(spark, d))
    cut = t.groupBy("session_id").agg(F.max("start_seq").alias("cutoff_seq"))
    acc = t.where("session_id % 2 = 0").groupBy("session_id").agg(F.min("end_seq").alias("covered"))
    return H.history_before(t, cut, acc).select("session_id", "turn_id", "start_seq", "end_seq")


@query("hp3_checkpoint_validity", """SELECT conv_id, turn, CASE conv_id % 8 WHEN 1 THEN 'version' WHEN 2 THEN 'sections' WHEN 3 THEN 'empty_section' WHEN 4 THEN 'covered' WHEN 5 THEN 'reference' WHEN 6 THEN 'reference_order' WHEN 7 THEN 'unknown_citation' ELSE 'ok' END AS reason FROM conversations""")
def _(spark, d):
    c = table(spark, d, "conversations")
    i = F.col("conv_id") % 8
    body = F.replace(F.replace("text", F.lit("["), F.lit("(")), F.lit("\n## "), F.lit("\n"))
    secs = []
    for n, h in enumerate(K.SUMMARY_HEADINGS):
        text = F.when((i == 3) & F.lit(n == 4), "  ").otherwise(F.concat(body, F.when(i == 7, " [R9]").otherwise(" [R1]")) if n == 1 else F.lit("无"))
        part = F.concat(F.lit(f"## {h}\n"), text)
        secs.append(F.when(~((i == 2) & F.lit(n == 6)), part))
    summary = F.concat_ws("\n\n", *secs)
    ref = lambda id_, s, e: F.struct(F.lit(id_).alias("id"), F.lit("events").alias("kind"), F.lit(s).cast("bigint").alias("start_seq"), F.lit(e).cast("bigint").alias("end_seq"), *[F.lit("").alias(x) for x in ("doc_id", "parser", "cache_version", "chunk_id")])
    refs = F.when(i == 5, F.array(ref("R1", 5, 3))).when(i == 6, F.array(ref("R2", 1, 2), ref("R1", 3, 4))).otherwise(F.array(ref("R1", 1, 2), ref("R2", 3, 4)))
    reason = H.checkpoint_reason(F.when(i == 1, 2).otherwise(1), summary, F.when(i == 4, 0).otherwise(10), refs)
    return c.select("conv_id", "turn", reason.alias("reason"))


# Requests of five kinds: the whole log from its first field or from its second, too wide, too small a cap, beyond the log.
@query("hp4_field_pages", EV + """, req AS (SELECT session_id, max(seq) AS n, session_id % 5 AS kind FROM session_events_v GROUP BY 1),
   f AS (SELECT session_id AS request_id, seq, 0 AS fi, 'content' AS path, coalesce(content, '') AS v FROM session_events_v UNION ALL SELECT session_id, seq, 1, 'event_type', event_type FROM session_events_v),
   ok AS (SELECT session_id AS request_id, kind FROM req WHERE kind IN (0, 1) AND n <= 100),
   b AS (SELECT f.*, coalesce(sum(length(v) + length(path) + 32) OVER (PARTITION BY request_id ORDER BY seq, fi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f JOIN ok USING (request_id) WHERE kind = 0 OR seq > 1 OR fi > 0),
   w AS (SELECT *, length(v) + length(path) + 32 <= 1000 - before AS whole FROM b), g AS (SELECT *, coalesce(max(NOT whole) OVER (PARTITION BY request_id ORDER BY seq, fi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cut FROM w)
   SELECT request_id, NULL AS error, seq, CAST(fi AS BIGINT) AS field_index, path, whole, CAST(CASE WHEN whole THEN length(v) ELSE greatest(0, 1000 - before - length(path) - 32) END AS BIGINT) AS shown_chars FROM g WHERE NOT cut
   UNION ALL SELECT session_id, CASE WHEN kind IN (2, 3) OR n > 100 AND kind <> 4 OR n + 1 > 100 THEN 'history_read_invalid_range_or_limit' ELSE 'history_reference_unavailable' END, NULL, NULL, NULL, NULL, NULL FROM req WHERE kind > 1 OR n > 100""")
def _(spark, d):
    e = session_events(spark, d)
    two = F.array(F.struct(F.lit(0).alias("field_index"), F.lit("content").alias("path"), F.coalesce("content", F.lit("")).alias("value")),
                  F.struct(F.lit(1).alias("field_index"), F.lit("event_type").alias("path"), F.col("event_type").alias("value")))
    fields = e.select("session_id", "seq", F.explode(two).alias("f")).select("session_id", "seq", F.col("f.field_index").cast("bigint").alias("field_index"), "f.path", "f.value")
    kind, one = F.col("session_id") % 5, F.lit(1).cast("bigint")
    req = e.groupBy("session_id").agg(F.max("seq").alias("n")).select(
        F.col("session_id").alias("request_id"), "session_id", one.alias("start_seq"), F.when(kind == 2, F.col("n") + 200).when(kind == 4, F.col("n") + 1).otherwise(F.col("n")).alias("end_seq"),
        F.when(kind == 3, 100).otherwise(1000).alias("max_chars"), F.when(kind == 1, one).otherwise(F.lit(0).cast("bigint")).alias("field_index"))
    return H.page_fields(req, fields).select("request_id", "error", "seq", "field_index", "path", "whole", "shown_chars")


@query("hp5_result_order", TR + f""", c AS (SELECT session_id, turn_id, {CALL_ID} AS id, min(trace_seq) AS cs FROM trace_events_v WHERE event_type = 'tool/call_debug' GROUP BY 1, 2, 3),
   r AS (SELECT session_id, turn_id, {CALL_ID} AS id, trace_seq FROM trace_events_v WHERE event_type = 'tool/result_debug')
   SELECT r.session_id, r.turn_id, r.id AS tool_call_id, r.trace_seq AS arrived_seq, row_number() OVER (PARTITION BY r.session_id, r.turn_id ORDER BY coalesce(cs, r.trace_seq + 1099511627776), r.trace_seq) AS emit_position FROM r LEFT JOIN c USING (session_id, turn_id, id)""")
def _(spark, d):
    t = _trace_calls(spark, d).withColumn("event_type", F.regexp_replace("event_type", "_debug$", "")).withColumnRenamed("trace_seq", "seq")
    return H.result_order(t).select("session_id", "turn_id", "tool_call_id", "arrived_seq", "emit_position")


@query("hp6_backfilled_titles", with_views("session_events_v", extra=SESS + ", fm AS (SELECT session_id, arg_min(content, seq) AS m FROM session_events_v WHERE event_type = 'user/message' GROUP BY 1)") +
       f"""SELECT session_id, updated_at, title IS NULL AS backfilled, coalesce(title, CASE WHEN {sql_collapse('m')} = '' THEN '新对话' WHEN length({sql_collapse('m')}) > 40 THEN concat(substring({sql_collapse('m')}, 1, 39), '…') ELSE {sql_collapse('m')} END, '新对话') AS title FROM sess LEFT JOIN fm USING (session_id)""")
def _(spark, d):
    return H.backfill_titles(_sessions(spark, d), session_events(spark, d)).select("session_id", "updated_at", "backfilled", "title")


@query("hp7_history_records", """SELECT doc_id AS call_id, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 7 = 0 THEN concat('error=', substring(text, 1, 300)) ELSE CASE doc_id % 4 WHEN 0 THEN concat('doc=d', doc_id, ';cache_created=true')
     WHEN 1 THEN concat('doc=d', doc_id, ';title=', source) WHEN 2 THEN concat('doc=d', doc_id, ';query=', substring(text, 1, 300), ';chunks=2;sections=a,b') ELSE 'other completed' END END AS facts,
     CASE WHEN doc_id % 2 = 0 THEN CAST(64 AS BIGINT) ELSE 0 END AS refs_kept, CASE WHEN doc_id % 2 = 0 THEN CAST(6 AS BIGINT) ELSE 1 END AS refs_omitted FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    good = lambda n: F.struct(F.lit("p").alias("doc_id"), F.lit("grobid").alias("parser"), F.lit("sha256:" + "a" * 64).alias("cache_version"), F.concat(F.lit("c_"), F.lpad(n.cast("string"), 64, "0")).alias("chunk_id"))
    bad = F.array(F.struct(F.lit("p").alias("doc_id"), F.lit("grobid").alias("parser"), F.lit("old").alias("cache_version"), F.lit("c").alias("chunk_id")))
    r = documents(spark, d).select(
        i.alias("call_id"), F.when(i % 4 == 0, "parse_document").when(i % 4 == 1, "get_info").when(i % 4 == 2, "retrieve_context").otherwise("other").alias("tool"), (i % 7 != 0).alias("ok"),
        F.concat(F.lit("d"), i.cast("string")).alias("doc_id"), F.lit("grobid").alias("parser"), F.col("text").alias("query"), F.col("source").alias("title"), F.lit(2).alias("n_chunks"),
        F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("sections"), F.when(i % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(70)), good)).otherwise(bad).alias("refs"), F.lit(False).alias("cached"), F.lit(True).alias("saved"), F.col("text").alias("error"))
    h = H.history_record(r)
    return h.select("call_id", "status", "facts", F.size("evidence_refs").cast("bigint").alias("refs_kept"), "refs_omitted")


@query("me1_memory_entries", f"""WITH e AS (SELECT doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'theme' WHEN 2 THEN 'finding' ELSE 'other' END AS category, {sql_collapse("concat(CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END, ' ', CASE WHEN doc_id % 3 = 0 THEN source ELSE text END)")} AS entry FROM documents),
   st AS (SELECT DISTINCT lower({sql_collapse("concat(lang, ' ', source)")}) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
   f AS (SELECT lower(entry) AS k, min(ord) AS o FROM e WHERE category <> 'other' AND length(entry) BETWEEN 1 AND 500 GROUP BY 1)
   SELECT ord, category, entry, CASE WHEN category = 'other' THEN 'unknown_category' WHEN length(entry) NOT BETWEEN 1 AND 500 THEN 'bad_length' WHEN st.k IS NOT NULL OR ord > f.o THEN 'duplicate' ELSE 'added' END AS outcome FROM e LEFT JOIN st ON st.k = lower(entry) LEFT JOIN f ON f.k = lower(entry)""")
def _(spark, d):
    i = F.col("doc_id")
    docs = documents(spark, d)
    lang = F.when(i % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    e = docs.select(i.alias("ord"), F.when(i % 4 == 0, "paper").when(i % 4 == 1, "theme").when(i % 4 == 2, "finding").otherwise("other").alias("category"),
                    F.concat(lang, F.lit("  "), F.when(i % 3 == 0, F.col("source")).otherwise(F.col("text"))).alias("entry"))
    store = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.lit("theme").alias("category"), F.concat("lang", F.lit(" "), "source").alias("entry"))
    return H.append_memory(store, e)


@query("me2_profiles", """WITH u AS (SELECT user_id, event_id AS ord, CASE event_type WHEN 'view' THEN 'university' WHEN 'click' THEN 'education' WHEN 'signup' THEN 'preferences' WHEN 'purchase' THEN 'research_interest' ELSE 'nonsense' END AS field,
     concat('v', CAST(json_extract(props, '$.k') AS BIGINT) % 5) AS v, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k FROM events),
   l AS (SELECT user_id, field, arg_max(CASE WHEN field IN ('university', 'education') THEN v ELSE concat(v, chr(10), 'x') END, ord) AS nv FROM u WHERE field <> 'nonsense' AND NOT (field IN ('university', 'education') AND k = 0) GROUP BY 1, 2),
   s AS (SELECT DISTINCT user_id, unnest(['university', 'identity']) AS field, 'v1' AS value FROM events)
   SELECT user_id, field, coalesce(nv, value) AS value, nv IS NOT NULL AND nv IS DISTINCT FROM value AS changed FROM s FULL OUTER JOIN l USING (user_id, field)""")
def _(spark, d):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint") % 5
    field = F.when(t == "view", "university").when(t == "click", "education").when(t == "signup", "preferences").when(t == "purchase", "research_interest").otherwise("nonsense")
    v = F.concat(F.lit(" v"), k.cast("string"))
    scalar = t.isin("view", "click")
    vals = F.when(scalar & (k == 0), F.array(F.lit("  "))).when(scalar, F.array(v)).otherwise(F.array(v, F.lit("x"), F.upper(v)))
    e = table(spark, d, "events")
    u = e.select("user_id", F.col("event_id").alias("ord"), field.alias("field"), vals.alias("vals"))
    store = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("university"), F.lit("identity"))).alias("field"), F.lit("v1").alias("value"))
    return H.upsert_profile(store, u)

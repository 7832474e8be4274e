"""Registry of runnable queries and their oracle SQL, and the derived input views.

The test tables hold no sectioned papers, agent logs or provider candidates.  The views below derive them
from the given tables, in Spark with the DataFrame API and in the oracle with SQL text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.scale import block_of, materialize, number_rows, running, time_block
from marginalia.sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- Spark side -----------------------------------------------------------------------------

def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents", spread=True)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def papers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, paper_language, raw_text: documents cut in six parts under headings of four numbering styles."""
    t = documents(spark, d).select("doc_id", "lang", "text", F.floor(F.col("n_chars") / 6.0).cast("int").alias("w"))
    i, nl = F.col("doc_id"), F.lit("\n")
    part = lambda n: F.substr("text", (F.col("w") * n + 1).cast("int"), F.col("w"))
    line = lambda *xs: F.concat(*xs, nl)
    intro = F.when(i % 4 == 0, "1 Introduction").when(i % 4 == 1, "I. introduction").when(i % 4 == 2, "一、引言").otherwise("第一章 绪论")
    method = F.when(i % 3 == 0, "2. Proposed Method").when(i % 3 == 1, "二、材料与方法").otherwise("III. Methodology")
    raw = F.concat(
        F.when(i % 5 == 0, "").otherwise(F.concat(line(F.lit("Abstract")), line(part(0)))), line(intro), line(part(1)),
        F.when(i % 7 == 0, "").otherwise(F.concat(line(method), line(part(2)))), line(F.lit("3 Experiments")), line(part(3)),
        F.when(i % 6 == 0, F.concat(line(F.lit("3.1 Results")), line(part(3)))).otherwise(""), line(F.lit("Conclusion")), line(part(4)),
        F.when(i % 8 == 0, line(F.lit("[1] A. [2] B. doi see References"))).otherwise(""),
        F.when(i % 9 == 0, "").otherwise(F.concat(line(F.lit("References")), F.lit("[1] "), part(5))))
    return t.select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("zh").alias("paper_language"), raw.alias("raw_text"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """session_id, seq, turn_id, event_type, tool_call_id, status, content: a log made from the conversations."""
    c = table(spark, d, "conversations")
    c = running(c, ["conv_id"], ["turn"], block_of("turn"), {"turn_no": ("sum", F.when(F.col("role") == "user", 1).otherwise(0).cast("bigint"), True)})
    user, answer, tools = F.col("role") == "user", F.col("role") == "assistant", F.col("conv_id") % 3 == 0
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    subs = F.when(user, ints(1, 2)).when(answer & tools & (F.col("turn") % 4 != 3), ints(3, 4, 5, 6)).when(answer & tools, ints(3, 5, 6)).when(answer, ints(5, 6))
    c = c.withColumn("sub", F.explode(subs)).withColumn("_o", F.col("turn") * 8 + F.col("sub"))
    c = number_rows(c, ["conv_id"], ["_o"], block_of("_o", 32768), "seq")
    sub = F.col("sub")
    kinds = F.create_map(*[F.lit(x) for kv in {1: "user/message", 2: "turn/start", 3: "tool/call", 4: "tool/result", 5: "assistant/message", 6: "turn/end"}.items() for x in kv])
    log = c.select(
        F.col("conv_id").alias("session_id"), "seq", F.concat(F.lit("t"), F.col("turn_no").cast("string")).alias("turn_id"), kinds[sub].alias("event_type"),
        F.when(sub.isin(3, 4), F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("tool_call_id"),
        F.when(sub == 6, F.when(F.col("conv_id") % 11 == 0, "error").otherwise("success")).alias("status"), F.when(sub.isin(1, 5), F.col("text")).alias("content"))
    # A log is a stored table; it is written once and read by every branch of a query.
    return materialize(log, "session-events")


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    """session_id, turn_id, trace_seq, event_type, size_chars, props: one trace per user and day."""
    e = table(spark, d, "events").withColumn("_day", F.col("ts").cast("date").cast("string"))
    e = number_rows(e, ["user_id", "_day"], ["ts", "event_id"], time_block("ts"), "trace_seq")
    t = F.col("event_type")
    kind = F.when(t == "view", "llm/input").when(t == "click", "llm/output").when(t == "signup", "tool/call_debug").when(t == "purchase", "tool/result_debug").otherwise("llm/error")
    log = e.select(F.col("user_id").alias("session_id"), F.col("_day").alias("turn_id"), "trace_seq", kind.alias("event_type"),
                    F.floor(F.col("value") * 100).cast("bigint").alias("size_chars"), "props")
    return materialize(log, "trace-events")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, provider, pos, title, year, doi: three candidates per document."""
    t = documents(spark, d).select("doc_id", F.left("text", F.lit(60)).alias("title"))
    j = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("next_title")), "doc_id")
    kinds = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(n).alias("pos")) for n, p in enumerate(["crossref", "openalex", "arxiv"], 1)])
    j = j.withColumn("p", F.explode(kinds)).select("doc_id", "p.*", "title", "next_title")
    pos = F.col("pos")
    return j.select(
        "doc_id", "provider", "pos", F.when(pos == 3, F.col("next_title")).otherwise(F.left("title", F.when(pos == 2, 40).otherwise(60))).alias("title"),
        (1990 + F.col("doc_id") % 30 + F.when(pos == 2, 1).otherwise(0)).cast("int").cast("string").alias("year"),
        F.when((pos == 1) & (F.col("doc_id") % 4 == 0), F.concat(F.lit("https://doi.org/10.1234/Ab."), F.col("doc_id").cast("string"))).alias("doi"))


# ---- oracle side ----------------------------------------------------------------------------

VIEWS = {
    "papers_v": """SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS paper_language,
  concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Abstract', chr(10), substring(text, 1, w), chr(10)) END,
    CASE doc_id % 4 WHEN 0 THEN '1 Introduction' WHEN 1 THEN 'I. introduction' WHEN 2 THEN '一、引言' ELSE '第一章 绪论' END, chr(10),
    substring(text, w + 1, w), chr(10),
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(CASE doc_id % 3 WHEN 0 THEN '2. Proposed Method' WHEN 1 THEN '二、材料与方法' ELSE 'III. Methodology' END, chr(10), substring(text, 2 * w + 1, w), chr(10)) END,
    '3 Experiments', chr(10), substring(text, 3 * w + 1, w), chr(10),
    CASE WHEN doc_id % 6 = 0 THEN concat('3.1 Results', chr(10), substring(text, 3 * w + 1, w), chr(10)) ELSE '' END,
    'Conclusion', chr(10), substring(text, 4 * w + 1, w), chr(10),
    CASE WHEN doc_id % 8 = 0 THEN concat('[1] A. [2] B. doi see References', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('References', chr(10), '[1] ', substring(text, 5 * w + 1, w)) END) AS raw_text
FROM (SELECT doc_id, lang, text, CAST(floor(n_chars / 6.0) AS INT) AS w FROM documents WHERE text IS NOT NULL) d""",
    "session_events_v": """SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS BIGINT) AS seq,
  concat('t', CAST(turn_no AS VARCHAR)) AS turn_id, event_type, tool_call_id, status, content
FROM (SELECT conv_id, turn, turn_no, s.sub,
    CASE s.sub WHEN 1 THEN 'user/message' WHEN 2 THEN 'turn/start' WHEN 3 THEN 'tool/call' WHEN 4 THEN 'tool/result' WHEN 5 THEN 'assistant/message' ELSE 'turn/end' END AS event_type,
    CASE WHEN s.sub IN (3, 4) THEN concat('c', CAST(turn AS VARCHAR)) END AS tool_call_id,
    CASE WHEN s.sub = 6 THEN CASE WHEN conv_id % 11 = 0 THEN 'error' ELSE 'success' END END AS status,
    CASE WHEN s.sub IN (1, 5) THEN text END AS content
  FROM (SELECT conv_id, turn, role, text, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn_no FROM conversations) c
  JOIN (SELECT 1 AS sub UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) s
    ON (c.role = 'user' AND s.sub IN (1, 2)) OR (c.role = 'assistant' AND ((s.sub = 3 AND conv_id % 3 = 0) OR (s.sub = 4 AND conv_id % 3 = 0 AND turn % 4 <> 3) OR s.sub IN (5, 6)))) e""",
    "trace_events_v": """SELECT user_id AS session_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS turn_id,
  CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS trace_seq,
  CASE event_type WHEN 'view' THEN 'llm/input' WHEN 'click' THEN 'llm/output' WHEN 'signup' THEN 'tool/call_debug' WHEN 'purchase' THEN 'tool/result_debug' ELSE 'llm/error' END AS event_type,
  CAST(floor(value * 100) AS BIGINT) AS size_chars, props FROM events""",
    "candidates_v": """SELECT d.doc_id, p.provider, p.pos, substring(CASE WHEN p.pos = 3 THEN n.text ELSE d.text END, 1, CASE WHEN p.pos = 2 THEN 40 ELSE 60 END) AS title,
  CAST(CAST(1990 + d.doc_id % 30 + CASE WHEN p.pos = 2 THEN 1 ELSE 0 END AS INT) AS VARCHAR) AS year,
  CASE WHEN p.pos = 1 AND d.doc_id % 4 = 0 THEN concat('https://doi.org/10.1234/Ab.', CAST(d.doc_id AS VARCHAR)) END AS doi
FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1
CROSS JOIN (SELECT 'crossref' AS provider, 1 AS pos UNION ALL SELECT 'openalex', 2 UNION ALL SELECT 'arxiv', 3) p""",
}


def with_views(*names: str, extra: str = "") -> str:
    """WITH clause that defines the named views; ``extra`` adds further definitions."""
    defs = [f"{n} AS ({VIEWS[n]})" for n in names]
    if extra:
        defs.append(extra.strip().rstrip(","))
    recursive = "RECURSIVE " if "/*recursive*/" in extra else ""
    return f"WITH {recursive}" + ",\n".join(defs) + "\n"


def sql_strip(x: str) -> str:
    return f"trim({x}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(12288)))"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)

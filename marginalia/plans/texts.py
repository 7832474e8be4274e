"""Cleaning and scalar queries (PR-1 .. PR-18, UD-1, UD-2, UD-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.functions.json_tables import json_leaves, safe_json, usage_counts
from marginalia.functions.registry import register_all
from marginalia.functions.similarity import similarity
from marginalia.plans.base import documents, query, sql_collapse, sql_list, sql_strip, table
from marginalia.sources.files import read_table

# Values of many kinds: unclear marks, short and long texts.
VALUE_SQL = """CASE doc_id % 9 WHEN 0 THEN '未明确提及' WHEN 1 THEN concat(' ', source, ' ') WHEN 2 THEN 'N/A' WHEN 3 THEN '  ' WHEN 4 THEN 'NULL' WHEN 5 THEN NULL ELSE text END"""


def _value():
    i = F.col("doc_id") % 9
    return F.when(i == 0, "未明确提及").when(i == 1, F.concat(F.lit(" "), "source", F.lit(" "))).when(i == 2, "N/A").when(i == 3, "  ") \
        .when(i == 4, "NULL").when(i == 5, None).otherwise(F.col("text"))


_clear_sql = lambda v: f"coalesce({sql_strip(v)} NOT IN ({sql_list(K.UNCLEAR_VALUES)}) AND lower({sql_strip(v)}) NOT IN ({sql_list(K.UNCLEAR_LOWER)}), false)"


@query("pr1_clear_values", f"""WITH v AS (SELECT doc_id, {VALUE_SQL} AS v, [{VALUE_SQL}, 'unknown'] AS l FROM documents)
   SELECT doc_id, {_clear_sql('v')} AS clear_title, {_clear_sql('v')} AND length({sql_strip('v')}) >= 20 AS clear_abstract, {_clear_sql('v')} AS clear_list FROM v""")
def _(spark, d):
    v = documents(spark, d).select("doc_id", _value().alias("v"))
    return v.select("doc_id", T.is_clear(F.col("v"), "title").alias("clear_title"), T.is_clear(F.col("v"), "abstract").alias("clear_abstract"),
                    T.has_clear(F.array("v", F.lit("unknown"))).alias("clear_list"))


@query("pr2_collapsed_text", f"SELECT doc_id, sha256({sql_collapse('text')}) AS text_hash, length({sql_collapse('text')}) AS n FROM documents")
def _(spark, d):
    c = T.collapse(F.col("text"))
    return documents(spark, d).select("doc_id", F.sha2(c, 256).alias("text_hash"), F.length(c).cast("bigint").alias("n"))


_mt = lambda x: (f"""trim(rtrim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), '：', ':'), '\\s+', ' ', 'g'), '\\s*:\\s*', ': ', 'g'), '["''“”‘’`]+', '', 'g'), ' .,;:，。；：!?？！'))""")


@query("pr3_match_text", f"SELECT doc_id, {_mt('concat(text, chr(10), $$“x”：y .。!$$)')} AS normalized FROM documents")
def _(spark, d):
    x = F.concat("text", F.lit("\n“x”：y .。!"))
    return documents(spark, d).select("doc_id", T.match_text(x).alias("normalized"))


@query("pr4_stripped_markup", f"""SELECT page_id, sha256({sql_collapse("regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'), '<[^>]+>', ' ', 'g')")}) AS text_hash FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_markup(F.col("html")), 256).alias("text_hash"))


IDS = """CASE doc_id % 5 WHEN 0 THEN concat('see 10.1234/Ab.', doc_id, ' and') WHEN 1 THEN concat('arXiv: 2401.0', 1000 + doc_id % 9000, 'v2 x') WHEN 2 THEN concat('cs.LG/', 1000000 + doc_id, ' y') WHEN 3 THEN concat('https://doi.org/10.5555/X', doc_id) ELSE '' END"""


@query("pr5_identifiers", f"""WITH t AS (SELECT doc_id, concat(substring(text, 1, 30), ' ', {IDS}, ' ', substring(text, 31)) AS t FROM documents),
   e AS (SELECT doc_id, t, regexp_extract(t, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b', 0) AS doi, regexp_extract(t, '(?i)(?:arXiv[:\\s]*)?(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS a1,
      regexp_extract(t, '(?i)(?:arXiv[:\\s]*)?([a-z-]+(?:\\.[A-Z]{{2}})?/\\d{{7}})', 1) AS a2 FROM t)
   SELECT doc_id, doi, CASE WHEN a1 <> '' THEN a1 ELSE a2 END AS arxiv, replace(lower(doi), 'https://doi.org/', '') AS doi_norm, lower(CASE WHEN a1 <> '' THEN a1 ELSE a2 END) AS arxiv_norm,
     regexp_matches(substring(t, 1, 5000), '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b') AS has_doi, regexp_matches(substring(t, 1, 5000), '\\b\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?\\b') AS has_arxiv FROM e""")
def _(spark, d):
    i, s = F.col("doc_id"), lambda x: x.cast("string")
    mark = F.when(i % 5 == 0, F.concat(F.lit("see 10.1234/Ab."), s(i), F.lit(" and"))).when(i % 5 == 1, F.concat(F.lit("arXiv: 2401.0"), s(1000 + i % 9000), F.lit("v2 x"))) \
        .when(i % 5 == 2, F.concat(F.lit("cs.LG/"), s(1000000 + i), F.lit(" y"))).when(i % 5 == 3, F.concat(F.lit("https://doi.org/10.5555/X"), s(i))).otherwise("")
    t = documents(spark, d).select("doc_id", F.concat(F.left("text", F.lit(30)), F.lit(" "), mark, F.lit(" "), F.substr("text", F.lit(31))).alias("t"))
    doi, arx = T.extract_doi(F.col("t")), T.extract_arxiv(F.col("t"))
    has_doi, has_arxiv = T.identifier_flags(F.col("t"))
    return t.select("doc_id", doi.alias("doi"), arx.alias("arxiv"), T.normalize_doi(doi).alias("doi_norm"), T.normalize_arxiv(F.col("t")).alias("arxiv_norm"),
                    has_doi.alias("has_doi"), has_arxiv.alias("has_arxiv"))


@query("pr6_title_guess", f"""WITH l AS (SELECT doc_id, {sql_strip('unnest(string_split(substring(concat($$--- Page 1 ---$$, chr(10), text), 1, 2000), chr(10)))')} AS l, generate_subscripts(string_split(substring(concat($$--- Page 1 ---$$, chr(10), text), 1, 2000), chr(10)), 1) AS i FROM documents)
   SELECT d.doc_id, coalesce(arg_min(l, i) FILTER (NOT starts_with(l, '--- Page') AND length(l) BETWEEN 8 AND 220), '') AS title FROM documents d JOIN l USING (doc_id) GROUP BY d.doc_id""")
def _(spark, d):
    return documents(spark, d).select("doc_id", T.title_guess(F.concat(F.lit("--- Page 1 ---\n"), "text")).alias("title"))


@query("pr7_script_tests", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('论文', text) WHEN doc_id % 4 = 1 THEN lang ELSE text END AS t FROM documents)
   SELECT doc_id, regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AS has_cjk, NOT regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(t, '[A-Za-z]{{8,}}') AS signal,
     NOT regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 8 AND length({sql_strip('t')}) >= 12 AS english FROM t""")
def _(spark, d):
    i = F.col("doc_id")
    t = documents(spark, d).select("doc_id", F.when(i % 4 == 0, F.concat(F.lit("论文"), "text")).when(i % 4 == 1, F.col("lang")).otherwise(F.col("text")).alias("t"))
    return t.select("doc_id", T.has_cjk(F.col("t")).alias("has_cjk"), T.english_title_signal(F.col("t")).alias("signal"), T.looks_english_title(F.col("t")).alias("english"))


_keys = "(?:api[_ -]?key|authorization|secret|token|password|credential)"
REDACT_SQL = (f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(["'']?{_keys}["'']?\\s*[:=]\\s*["''])(.*?)(["''])', '\\1<redacted>\\3', 'g'),
   '(?i)(["'']?{_keys}["'']?\\s*[:=]\\s*)([^"''\\s,}}]+)', '\\1<redacted>', 'g'), '(?i)\\bbearer\\s+[a-z0-9._-]+', 'Bearer <redacted>', 'g'), '\\bsk-[a-zA-Z0-9_-]{{8,}}\\b', '<redacted-api-key>', 'g')""")


@query("pr8_redacted_text", f"SELECT doc_id, sha256({REDACT_SQL}) AS text_hash, {REDACT_SQL} <> text AS changed FROM documents")
def _(spark, d):
    r = documents(spark, d).select("doc_id", "text", T.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2("r", 256).alias("text_hash"), (F.col("r") != F.col("text")).alias("changed"))


@query("pr9_bounded_preview", f"""WITH r AS (SELECT doc_id, source, {REDACT_SQL} AS t FROM documents)
   SELECT doc_id, CASE WHEN length(t) > 2000 THEN concat(substring(t, 1, 2000), '…') ELSE t END AS body, '[redacted]' AS api_key, '[redacted]' AS deep_key, 'Bearer <redacted> x' AS deep_note, source AS source FROM r""")
def _(spark, d):
    deep = F.struct(F.struct(F.lit("p").alias("Password"), F.lit("bearer abc.def x").alias("note")).alias("b"))
    j = F.to_json(F.struct(F.col("text").alias("body"), F.lit("sk-12345678").alias("user_API_KEY"), F.array(deep).alias("a"), "source"))
    p = documents(spark, d).select("doc_id", safe_json(j).alias("j"))
    at = lambda path, name: F.get_json_object("j", path).alias(name)
    return p.select("doc_id", at("$.body", "body"), at("$.user_API_KEY", "api_key"), at("$.a[0].b.Password", "deep_key"), at("$.a[0].b.note", "deep_note"), at("$.source", "source"))


@query("pr10_json_leaves", """SELECT event_id, unnest(['a.b.c.d.e', 'props.k', 't.0', 't.1']) AS path, unnest([CAST(user_id AS VARCHAR), CAST(json_extract(props, '$.k') AS VARCHAR), event_type, '{}']) AS value FROM events""")
def _(spark, d):
    j = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":'), F.col("user_id").cast("string"), F.lit('}}}},"props":'), "props", F.lit(',"t":["'), "event_type", F.lit('",{}]}'))
    return json_leaves(table(spark, d, "events").withColumn("j", j), ["event_id"], "j")


@query("ud4_nested_leaves", """SELECT event_id, unnest(['props.k', 'tags.0', 'tags.1', 'empty']) AS path, unnest([CAST(json_extract(props, '$.k') AS VARCHAR), event_type, CAST(user_id AS VARCHAR), '{}']) AS value FROM events""")
def _(spark, d):
    register_all(spark)
    j = F.concat(F.lit('{"props":'), "props", F.lit(',"tags":["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit('],"empty":{}}'))
    table(spark, d, "events").select("event_id", j.alias("j")).createOrReplaceTempView("ud4_events")
    return spark.sql("SELECT event_id, l.path, l.value FROM ud4_events, LATERAL json_leaves(ud4_events.j) l")


@query("pr11_usage_counts", """SELECT event_id, user_id AS prompt_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS cached_tokens, CAST(7 AS BIGINT) AS deep_tokens, CAST(3 AS BIGINT) AS n_counters FROM events""")
def _(spark, d):
    u = F.concat(F.lit('{"prompt_tokens":'), F.col("user_id").cast("string"), F.lit(',"api_token":"x","model":"m","completion_tokens":"12","flag_tokens":true,"prompt_tokens_details":{"cached_tokens":'),
                 F.get_json_object("props", "$.k"), F.lit(',"note":"y","audio_tokens_details":{"x_tokens":{"y_tokens":7}}}}'))
    c = read_table(spark, d, "events", spread=True).select("event_id", usage_counts(u).alias("c"))
    n = lambda key, name: F.try_element_at("c", F.lit(key)).cast("bigint").alias(name)
    return c.select("event_id", n("prompt_tokens", "prompt_tokens"), n("prompt_tokens_details.cached_tokens", "cached_tokens"),
                    n("prompt_tokens_details.audio_tokens_details.x_tokens.y_tokens", "deep_tokens"), F.size("c").cast("bigint").alias("n_counters"))


@query("pr12_rescued_json", """SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 < 3 AS ok FROM events""")
def _(spark, d):
    i, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(i == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nbye"))).when(i == 1, F.concat(F.lit("answer "), p, F.lit(" end"))).when(i == 2, p) \
        .when(i == 3, F.concat(F.lit("["), p)).otherwise(F.lit("no object"))
    raw = F.when(i == 3, F.concat(F.lit("{\"k\": "), p)).otherwise(raw)
    r = table(spark, d, "events").select("event_id", T.rescue_json(raw).alias("j"))
    return r.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.col("j").isNotNull().alias("ok"))


@query("pr13_overflow_errors", """SELECT event_id, event_id % 4 IN (0, 1) AND event_id % 3 <> 2 AND event_id % 5 <> 4 AS overflow FROM events""")
def _(spark, d):
    i = F.col("event_id")
    body = F.when(i % 4 == 0, '{"error":{"code":"context_length_exceeded","message":""}}').when(
        i % 4 == 1, F.concat(F.lit('{"error":{"message":"This model\'s maximum context length is '), F.col("user_id").cast("string"), F.lit(' tokens, however you requested more"}}'))) \
        .when(i % 4 == 2, '{"error":{"code":"rate_limit","message":"slow down"}}').otherwise("not json")
    provider = F.when(i % 3 == 2, "other").when(i % 3 == 1, "deepseek").otherwise("openai_compatible")
    status = F.when(i % 5 == 4, 500).when(i % 5 == 3, None).otherwise(400)
    return table(spark, d, "events").select("event_id", T.overflow_error(provider, status.cast("int"), body).alias("overflow"))


@query("pr14_result_summaries", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'retrieved 2 relevant chunks' WHEN 1 THEN 'grobid parsed 1 sections, title missing' WHEN 2 THEN 'grobid failed: boom' WHEN 3 THEN substring(text, 1, 200) WHEN 4 THEN 'retrieved paper information' ELSE 'tool completed' END AS summary FROM documents""")
def _(spark, d):
    i = F.col("doc_id") % 6
    content = F.when(i == 0, '{"chunks":[1,2]}').when(i == 1, '{"parser":"grobid","sections":[{}],"missing_fields":["title"]}').when(i == 2, '{"parser":"grobid","success":false,"error":"boom"}') \
        .when(i == 4, F.to_json(F.struct(F.col("source").alias("title")))).otherwise("plain")
    return documents(spark, d).select("doc_id", T.result_summary(F.lit("tool"), i != 3, F.when(i == 3, F.col("text")), content).alias("summary"))


@query("pr15_request_errors", f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat('a b', doc_id) ELSE concat('d_', doc_id) END AS id, doc_id % 10 AS k, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS q FROM documents)
   SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'bad_id' WHEN k NOT BETWEEN 1 AND 8 THEN 'bad_top_k' WHEN length({sql_strip('q')}) NOT BETWEEN 1 AND 2000 THEN 'bad_query' END AS error FROM r""")
def _(spark, d):
    i = F.col("doc_id")
    ident = F.when(i % 7 == 0, F.concat(F.lit("a b"), i.cast("string"))).otherwise(F.concat(F.lit("d_"), i.cast("string")))
    return documents(spark, d).select("doc_id", T.request_error(ident, i % 10, F.when(i % 11 == 0, " ").otherwise(F.col("text"))).alias("error"))


@query("pr16_names", """WITH u AS (SELECT page_id, url, regexp_extract(rtrim(url, '/'), '[^/]*$', 0) AS b FROM pages)
   SELECT page_id, b AS base_name, replace(b, ' ', '_') AS safe_name, concat(CASE WHEN s = '' THEN 'paper_sections' ELSE s END, '.json') AS json_name, CASE page_id % 3 WHEN 0 THEN 'en' ELSE 'zh' END AS language
   FROM (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(b, '^.+\\.[^.]+$') THEN regexp_replace(b, '\\.[^.]+$', '') ELSE b END, '[<>:"/\\\\|?*]', '_', 'g'), ' ._') AS s FROM u)""")
def _(spark, d):
    u, i = F.col("url"), F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", T.base_name(u).alias("base_name"), T.safe_name(u).alias("safe_name"), T.safe_json_name(u).alias("json_name"),
                                           T.language(F.when(i == 0, " EN ").when(i == 1, "fr")).alias("language"))


@query("pr17_session_titles", f"""SELECT conv_id, turn, CASE WHEN {sql_collapse('text')} = '' THEN NULL WHEN length({sql_collapse('text')}) > 40 THEN concat(substring({sql_collapse('text')}, 1, 39), '…') ELSE {sql_collapse('text')} END AS title FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.session_title(F.col("text")).alias("title"))


@query("pr18_chinese_front_matter", f"""SELECT doc_id, CASE WHEN length({sql_collapse('text')}) < 30 THEN '' ELSE substring({sql_collapse('text')}, 1, 1500) END AS abstract, '深度学习;图像-文本' AS keywords, '张三;欧阳小明' AS authors FROM documents""")
def _(spark, d):
    raw = F.concat(F.lit("题目\n张三1，欧阳小明2\n摘 要："), "text", F.lit("\n关键词：深度学习；图像-文本；abc\nAbstract\n"))
    t = documents(spark, d).select("doc_id", raw.alias("raw"))
    names = T.author_names(F.get(F.split("raw", "\n"), F.lit(1)))
    return t.select("doc_id", T.zh_abstract(F.col("raw")).alias("abstract"), F.array_join(T.zh_keywords(F.col("raw")), ";").alias("keywords"), F.array_join(names, ";").alias("authors"))


@query("ud1_similarity")
def _(spark, d):
    """Every document's head against the head of the next document and against itself."""
    t = documents(spark, d).select("doc_id", F.left("text", F.lit(120)).alias("a"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.join(n, "doc_id").select("doc_id", similarity(F.col("a"), F.col("b")).alias("next_similarity"), similarity(F.col("a"), F.upper("a")).alias("self_similarity"))


# Texts with known answers: a text against itself, against nothing, and with a second half that shares no letter with the first.
@query("ud2_registered_functions", """SELECT doc_id, CAST(1.0 AS DOUBLE) AS same, CAST(0.0 AS DOUBLE) AS none, CAST(0.5 AS DOUBLE) AS half, length(source) AS n_chunks, 'a.0' AS first_path FROM documents""")
def _(spark, d):
    register_all(spark)
    documents(spark, d).createOrReplaceTempView("ud2_documents")
    return spark.sql("""SELECT doc_id, any_value(text_similarity(source, source)) AS same, any_value(text_similarity(source, '')) AS none,
        any_value(text_similarity(concat(source, repeat('#', length(source))), concat(repeat('%', length(source)), source))) AS half,
        CAST(count(*) AS BIGINT) AS n_chunks, any_value(l.path) AS first_path
        FROM ud2_documents, LATERAL chunk_text(ud2_documents.source, 1, 0) c, LATERAL json_leaves('{"a":[1]}') l GROUP BY doc_id""")

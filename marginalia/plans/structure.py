"""Document structure queries (DS-1 .. DS-6, DS-8 .. DS-23, SK-1, WN-3, WN-9, WN-10, TK-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.operators import blocks as B
from marginalia.operators import headings as H
from marginalia.operators import layout as L
from marginalia.operators import planning as P
from marginalia.operators import quality as Q
from marginalia.plans.base import documents, papers, query, sql_collapse, sql_list, sql_strip, table, with_views
from marginalia.scale import materialize
from marginalia.sources import markup as M
from marginalia.sources import sinks as S

# ---- shared oracle pieces --------------------------------------------------------------------

_alias_rows = ", ".join(f"('{w}', '{s}', '{src}')" for src, tab in (("rule_zh", K.ZH_ALIASES), ("rule_en", K.EN_ALIASES)) for s, ws in tab.items() for w in ws)
_num = (r"(?:\p{Nd}+(?:[.．]\p{Nd}+)*(?:[.．、])?|[IVXLCDM]+\.?|[一二三四五六七八九十百]+[、.．]|第[一二三四五六七八九十百\p{Nd}]+[章节]"
        r"|[（(][一二三四五六七八九十百\p{Nd}]+[）)]|[一二三四五六七八九十百\p{Nd}]+[）)])")


def _sql_line(tab: dict, flags: str) -> str:
    alts = "|".join(sorted({w for ws in tab.values() for w in ws}, key=lambda w: (-len(w), w)))
    return rf"{flags}^[ \t　]*(?:{_num}[ \t　]*)?({alts})[ \t　]*(?:[:：.。．\-])?[ \t　]*$"


HEADS_SQL = f"""alias(word, section, source) AS (VALUES {_alias_rows}),
  ln0 AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS l, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM papers_v),
  ln AS (SELECT doc_id, l, i, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM ln0),
  cand AS (SELECT *, regexp_extract(l, '{_sql_line(K.ZH_ALIASES, "")}', 1) AS zh, lower(regexp_extract(l, '{_sql_line(K.EN_ALIASES, "(?i)")}', 1)) AS en FROM ln),
  hit AS (SELECT c.doc_id, c.st AS start, c.st + length(c.l) AS "end", trim(c.l) AS title, a.section, a.source, regexp_replace(c.l, '\\s+', '', 'g') AS flat
          FROM cand c JOIN alias a ON (a.source = 'rule_zh' AND a.word = c.zh) OR (a.source = 'rule_en' AND a.word = c.en)),
  head AS (SELECT doc_id, start, "end", title, section, source, CAST(greatest(0, least(100,
        CASE source WHEN 'rule_zh' THEN 90 ELSE 88 END + CASE WHEN section IN ({sql_list(K.PLAIN_TITLE_SECTIONS)}) THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(title, '^\\s*(?:\\p{{Nd}}+|[一二三四五六七八九十百]+|第)') THEN 4 ELSE 0 END
        - CASE WHEN (source = 'rule_zh' AND length(flat) > 60) OR (source = 'rule_en' AND length(flat) > 120) THEN 25 ELSE 0 END
        - CASE WHEN regexp_matches(title, '[。！？.!?]$') AND section NOT IN ('abstract', 'keywords') THEN 8 ELSE 0 END)) AS BIGINT) AS confidence
     FROM hit WHERE NOT (regexp_matches(flat, '[。！？]') AND length(flat) > 12) AND length(flat) <= CASE source WHEN 'rule_zh' THEN 80 ELSE 140 END
       AND length(flat) - length(regexp_replace(flat, '[，,；;]', '', 'g')) < 2)"""

SECTIONS_SQL = HEADS_SQL + f""",
  nxt AS (SELECT h.*, lead(start, 1, length(p.raw_text)) OVER (PARTITION BY doc_id ORDER BY start) AS nx, p.raw_text FROM head h JOIN papers_v p USING (doc_id)),
  piece AS (SELECT *, {sql_strip('substring(raw_text, "end" + 1, nx - "end")')} AS body FROM nxt WHERE section NOT IN ({sql_list(K.BOUNDARY_SECTIONS)})),
  joined AS (SELECT doc_id, section, string_agg(body, concat(chr(10), chr(10)) ORDER BY start) AS content, arg_min(source, start) AS source, arg_min(title, start) AS matched_title,
      arg_min("end", start) AS start_char, max(nx) AS end_char, arg_min(confidence, start) AS confidence, arg_min(body, start) AS first_body FROM piece WHERE body <> '' GROUP BY 1, 2),
  grid AS (SELECT doc_id, paper_language, unnest([{sql_list(K.SECTION_KEYS)}]) AS section FROM papers_v),
  sections AS (SELECT g.doc_id, g.paper_language, g.section, coalesce(j.content, '') AS content, coalesce(j.source, 'missing') AS source, coalesce(matched_title, '') AS matched_title,
      length(coalesce(j.content, '')) AS length, coalesce(start_char, -1) AS start_char, coalesce(end_char, -1) AS end_char, coalesce(confidence, 0) AS confidence,
      CASE WHEN j.content IS NULL THEN 'section not found' WHEN g.section <> 'abstract' AND length(first_body) BETWEEN 1 AND 149 THEN 'rule section is very short; LLM correction may be useful' ELSE '' END AS warning
    FROM grid g LEFT JOIN joined j USING (doc_id, section))"""
SECTIONS_WITH = with_views("papers_v", extra=SECTIONS_SQL)


def _sections(spark, d):
    return H.extract_sections(papers(spark, d), keep=["paper_language"])


@query("ds1_headings", with_views("papers_v", extra=HEADS_SQL) + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ordinal, start, "end", title, section, source FROM head""")
def _(spark, d):
    return H.find_headings(papers(spark, d)).drop("confidence")


@query("ds2_heading_confidence", with_views("papers_v", extra=HEADS_SQL) + "SELECT section, source, title, confidence, count(*) AS n FROM head GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return H.find_headings(papers(spark, d)).groupBy("section", "source", "title", "confidence").agg(F.count("*").alias("n"))


@query("ds3_sections", SECTIONS_WITH + "SELECT doc_id, section, sha256(content) AS content_hash, source, matched_title, length, start_char, end_char, confidence, warning FROM sections")
def _(spark, d):
    return _sections(spark, d).select("doc_id", "section", F.sha2("content", 256).alias("content_hash"), "source", "matched_title", "length", "start_char", "end_char", "confidence", "warning")


@query("wn3_next_heading", with_views("papers_v", extra=HEADS_SQL) + "SELECT doc_id, start, lead(start, 1, length(raw_text)) OVER (PARTITION BY doc_id ORDER BY start) AS next_start FROM head JOIN papers_v USING (doc_id)")
def _(spark, d):
    h = H.with_headings(papers(spark, d), "raw_text").withColumn("n", F.length("raw_text").cast("bigint"))
    nxt = F.transform("_heads", lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(F.col("_heads"), i + 1)["start"], F.col("n")).alias("next_start")))
    return h.select("doc_id", F.explode(nxt).alias("h")).select("doc_id", "h.*")


# Chinese papers with the abstract on its heading line: the texts of the given documents.
INLINE = """SELECT doc_id, concat('题目', chr(10), CASE WHEN doc_id % 4 = 3 THEN '正文' ELSE concat('摘要：', replace(CASE doc_id % 4 WHEN 0 THEN source ELSE text END, chr(10), ' ')) END, chr(10),
   CASE WHEN doc_id % 4 = 2 THEN '' ELSE concat('关键词：甲；乙', chr(10)) END, CASE WHEN doc_id % 4 = 2 THEN 'x' ELSE '一、引言' END, chr(10), text) AS raw_text FROM documents"""


@query("ds4_inline_abstract", f"""WITH p AS ({INLINE}), b AS (SELECT doc_id, raw_text, doc_id % 4 AS m, strpos(raw_text, '摘要：') + 2 AS st,
    CASE WHEN doc_id % 4 = 2 THEN least(length(raw_text), strpos(raw_text, '摘要：') + 2 + 2000) ELSE strpos(raw_text, concat(chr(10), '关键词')) END AS en FROM p WHERE doc_id % 4 <> 3),
  c AS (SELECT *, {sql_strip('substring(raw_text, st + 1, en - st)')} AS body FROM b)
  SELECT doc_id, '摘要' AS title, sha256(substring(body, 1, 2000)) AS content_hash, least(length(body), 2000) AS n, CAST(st AS BIGINT) AS start_char, CAST(CASE WHEN length(body) > 2000 THEN st + 2000 ELSE en END AS BIGINT) AS end_char,
    CAST(CASE WHEN length(body) < 30 THEN 65 ELSE 95 END AS BIGINT) AS confidence FROM c WHERE body <> ''""")
def _(spark, d):
    i, m, nl = F.col("doc_id"), F.col("doc_id") % 4, F.lit("\n")
    head = F.replace(F.when(m == 0, F.col("source")).otherwise(F.col("text")), nl, F.lit(" "))
    raw = F.concat(F.lit("题目\n"), F.when(m == 3, "正文").otherwise(F.concat(F.lit("摘要："), head)), nl, F.when(m == 2, "").otherwise("关键词：甲；乙\n"),
                   F.when(m == 2, "x").otherwise("一、引言"), nl, F.col("text"))
    p = documents(spark, d).select("doc_id", raw.alias("raw_text"))
    a = p.select("doc_id", H.inline_abstract(F.col("raw_text")).alias("a")).where("a IS NOT NULL")
    return a.select("doc_id", "a.title", F.sha2("a.content", 256).alias("content_hash"), F.length("a.content").cast("bigint").alias("n"), "a.start_char", "a.end_char", "a.confidence")


# The alternate extraction offers the sixth of the original text that a section has by its number, for some (document, section) pairs.
ALT = f"""alt AS (SELECT doc_id, s.section, substring(text, CAST(floor(n_chars / 6.0) AS INT) * s.k + 1, CAST(floor(n_chars / 6.0) AS INT)) AS alt_content FROM documents,
   (SELECT unnest([{sql_list(K.SECTION_KEYS)}]) AS section, unnest([0, 1, 2, 3, 4, 5]) AS k) s WHERE (doc_id + s.k) % 3 = 0)"""


@query("ds5_merged_sections", with_views("papers_v", extra=SECTIONS_SQL + ", " + ALT) + f""", m AS (
   SELECT s.doc_id, s.section, s.source, s.start_char, s.end_char, p.raw_text, {sql_strip('s.content')} AS r, {sql_strip("coalesce(a.alt_content, '')")} AS a, d.text AS e
   FROM sections s LEFT JOIN alt a USING (doc_id, section) JOIN papers_v p USING (doc_id) JOIN documents d USING (doc_id)),
  c AS (SELECT *, CASE WHEN r <> '' AND section <> 'abstract' AND length(r) < 150 AND length(a) > length(r) THEN 'corrected' WHEN r <> '' THEN 'rule' WHEN a <> '' THEN 'filled'
      WHEN section = 'abstract' AND e <> '' THEN 'abstract' ELSE 'missing' END AS choice FROM m),
  t AS (SELECT *, CASE choice WHEN 'rule' THEN r WHEN 'corrected' THEN a WHEN 'filled' THEN a WHEN 'abstract' THEN e ELSE '' END AS merged FROM c)
  SELECT doc_id, section, choice, sha256(merged) AS content_hash, length(merged) AS length, CASE choice WHEN 'rule' THEN source WHEN 'missing' THEN 'missing' ELSE 'llm' END AS source,
    CASE WHEN choice = 'rule' THEN start_char WHEN choice = 'missing' OR strpos(raw_text, merged) = 0 THEN -1 ELSE strpos(raw_text, merged) - 1 END AS start_char,
    CASE WHEN choice = 'rule' THEN end_char WHEN choice = 'missing' OR strpos(raw_text, merged) = 0 THEN -1 ELSE strpos(raw_text, merged) - 1 + length(merged) END AS end_char FROM t""")
def _(spark, d):
    docs = documents(spark, d)
    keys = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("k")) for k, s in enumerate(K.SECTION_KEYS)])
    sixth = F.floor(F.col("n_chars") / 6.0).cast("int")
    alt = docs.select("doc_id", "text", "n_chars", F.explode(keys).alias("s")).where((F.col("doc_id") + F.col("s.k")) % 3 == 0).select(
        "doc_id", "s.section", F.substr("text", sixth * F.col("s.k") + 1, sixth).alias("alt_content"))
    p = papers(spark, d)
    base = p.select("doc_id", "raw_text").join(docs.select("doc_id", F.col("text").alias("existing_abstract")), "doc_id")
    m = H.merge_sections(H.extract_sections(p), alt, base)
    return m.select("doc_id", "section", "choice", F.sha2("content", 256).alias("content_hash"), "length", "source", "start_char", "end_char")


@query("ds6_needs_fallback", SECTIONS_WITH + f"""SELECT s.doc_id, bool_or((section IN ('method', 'experiments') AND content = '') OR (section <> 'abstract' AND length({sql_strip('content')}) BETWEEN 1 AND 149)) AS needs_fallback,
   CASE WHEN bool_or((section IN ('method', 'experiments') AND content = '') OR (section <> 'abstract' AND length({sql_strip('content')}) BETWEEN 1 AND 149)) THEN least(length(any_value(raw_text)), 40000) END AS prefix_chars
   FROM sections s JOIN papers_v p USING (doc_id) GROUP BY s.doc_id""")
def _(spark, d):
    p = papers(spark, d)
    r = H.needs_fallback(H.extract_sections(p), p)
    return r.select("doc_id", "needs_fallback", F.length("fallback_input").cast("bigint").alias("prefix_chars"))


# ---- quality ---------------------------------------------------------------------------------

def _min_sql(tab: dict) -> str:
    return "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tab.items()) + " END"


def _re(p: str, i: str = "(?i)") -> str:
    return "'" + i + p + "'"


_half = "substring(c, CAST(floor(length(c) / 2) AS BIGINT) + 1)"
_kinds = " + ".join(f"CASE WHEN regexp_matches({_half}, {_re(p)}) THEN 1 ELSE 0 END" for p in K.REFERENCE_PATTERNS)
_heads = " + ".join(f"len(regexp_extract_all(c, {_re(p, '(?im)')}))" for p in K.HEADING_COUNT_PATTERNS)
QUALITY_SQL = f""", qc AS (SELECT doc_id, paper_language, section, content, source, {sql_strip('content')} AS c FROM sections),
  qf AS (SELECT *, section IN ('method', 'experiments', 'conclusion') AS major, c IN ({sql_list(K.UNCLEAR_SECTION_VALUES)}) AS miss,
     length(c) < CASE WHEN paper_language = 'zh' THEN {_min_sql(K.ZH_MIN_LENGTHS)} ELSE {_min_sql(K.EN_MIN_LENGTHS)} END AS short,
     section IN ('method', 'experiments', 'conclusion') AND length(c) >= 80 AND (({_kinds}) >= 2 OR len(regexp_extract_all({_half}, '\\[\\s*\\d+\\s*\\]')) >= 2) AS refs,
     section = 'abstract' AND regexp_matches(c, {_re(K.KEYWORD_MARKERS)}) AS kw, section = 'abstract' AND length(c) >= 300 AND regexp_matches(c, {_re(K.INTRO_MARKERS)}) AS intro,
     section = 'conclusion' AND regexp_matches(c, {_re(K.CONCLUSION_MARKERS)}) AS tail, regexp_matches(c, {_re(K.RESULT_TERMS)}) AS rt, regexp_matches(c, {_re(K.METHOD_TERMS)}) AS mt,
     ({_heads}) >= 2 AS multi, section IN ('method', 'experiments', 'conclusion') AND source IN ('', 'missing') AS nosrc FROM qc),
  qs AS (SELECT *, CASE WHEN miss THEN 0 WHEN short THEN 55 ELSE 100 END - CASE WHEN refs THEN 35 ELSE 0 END - CASE WHEN kw THEN 25 ELSE 0 END - CASE WHEN intro THEN 35 ELSE 0 END
     - CASE WHEN tail THEN 35 ELSE 0 END - CASE WHEN section = 'method' AND rt THEN 10 ELSE 0 END - CASE WHEN section = 'experiments' AND mt AND NOT rt THEN 15 ELSE 0 END - CASE WHEN multi THEN 10 ELSE 0 END AS raw FROM qf),
  quality AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN nosrc THEN least(raw, 40) ELSE raw END)) AS BIGINT) AS score,
     list_sort(list_filter([CASE WHEN miss THEN 'missing' END, CASE WHEN short AND NOT miss THEN 'missing_or_too_short' END, CASE WHEN refs THEN 'references_pollution' END,
       CASE WHEN kw OR intro THEN 'abstract_boundary_issue' END, CASE WHEN tail THEN 'conclusion_pollution' END, CASE WHEN nosrc THEN 'meta_source_missing' END], lambda x: x IS NOT NULL)) AS issues,
     list_sort(list_filter([CASE WHEN section = 'method' AND rt THEN 'possible_experiment_content' END, CASE WHEN section = 'experiments' AND mt AND NOT rt THEN 'possible_method_content' END,
       CASE WHEN multi THEN 'contains_multiple_section_headings' END], lambda x: x IS NOT NULL)) AS warnings FROM qs)"""

EVAL_SQL = QUALITY_SQL + f""", ev AS (SELECT *, CASE WHEN section IN ({sql_list(K.DEFAULT_REQUIRED)}) THEN 'required' WHEN section IN ({sql_list(K.DEFAULT_OPTIONAL)}) THEN 'optional' ELSE 'ignored' END AS status FROM quality),
  evb AS (SELECT *, CASE WHEN status = 'required' THEN list_sort(list_filter([CASE WHEN score < CASE section WHEN 'conclusion' THEN 40 ELSE 45 END THEN 'low_quality' END,
      CASE WHEN miss OR short THEN 'missing_or_too_short' END, CASE WHEN nosrc THEN 'meta_source_missing' END, CASE WHEN refs THEN 'references_pollution' END,
      CASE WHEN section = 'abstract' AND (kw OR intro) THEN 'abstract_boundary_issue' END, CASE WHEN section = 'conclusion' AND tail THEN 'conclusion_pollution' END], lambda x: x IS NOT NULL)) ELSE [] END AS blocking FROM ev)"""


def _scored(spark, d):
    return Q.score_sections(_sections(spark, d))


_list = lambda c: F.array_join(c, ",").alias(c)


@query("ds8_section_quality", SECTIONS_WITH.rstrip() + QUALITY_SQL + " SELECT doc_id, section, score, length(c) AS clean_length, array_to_string(issues, ',') AS issues, array_to_string(warnings, ',') AS warnings FROM quality")
def _(spark, d):
    return _scored(spark, d).select("doc_id", "section", "score", "clean_length", _list("issues"), _list("warnings"))


@query("ds9_blocking_issues", SECTIONS_WITH.rstrip() + EVAL_SQL + """ SELECT doc_id, section, status, array_to_string(blocking, ',') AS blocking,
   CASE WHEN status = 'optional' AND miss THEN concat(section, ' optional_missing') WHEN status = 'optional' AND len(issues) > 0 THEN concat(section, ' optional_quality_issue') END AS optional_warning FROM evb""")
def _(spark, d):
    return Q.evaluate(_scored(spark, d)).select("doc_id", "section", "status", _list("blocking"), "optional_warning")


@query("ds9_repair_reasons", SECTIONS_WITH.rstrip() + EVAL_SQL + """, r AS (SELECT doc_id, concat(section, ' ', unnest(blocking)) AS reason FROM evb)
   SELECT p.doc_id, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, count(reason) > 0 AS needs_repair FROM papers_v p LEFT JOIN r USING (doc_id) GROUP BY p.doc_id""")
def _(spark, d):
    return Q.repair_reasons(Q.evaluate(_scored(spark, d))).select("doc_id", _list("reasons"), "needs_repair")


@query("ds10_duplicate_sections")
def _(spark, d):
    return Q.duplicate_sections(Q.wide_sections(papers(spark, d)))


def _repaired(spark, d, kept_texts=True):
    """Sections are scored once, with their document's raw text at hand, and stored; repair reads what it needs of them."""
    sections = H.extract_sections(papers(spark, d), keep=["paper_language", "raw_text"])
    return Q.repair(Q.evaluate(materialize(Q.fresh_abstract(Q.score_sections(sections)), "scored")), kept_texts=kept_texts)


@query("ds11_repaired_sections", SECTIONS_WITH.rstrip() + EVAL_SQL + f""", nd AS (SELECT doc_id, bool_or(len(blocking) > 0) AS needs FROM evb GROUP BY 1),
  ab AS (SELECT doc_id, {sql_strip('regexp_replace(regexp_extract(raw_text, $$(?ims)^[ 	　]*(?:摘\\s*要|内容摘要|中文摘要|Abstract)[ 	　]*[:：]?[ 	　]*(.*)$$, 1), $$(?ims)^[ 	　]*(?:关\\s*键\\s*词|关键字|Keywords|Index Terms|引言|绪论|Introduction)[ 	　]*[:：.。．\\-]?.*$$, $$$$)')} AS fresh FROM papers_v WHERE doc_id IN (SELECT doc_id FROM evb WHERE section = 'abstract' AND (kw OR intro))),
  k AS (SELECT e.*, needs, regexp_extract(content, $$(?is)^(.*?)(?:参考文献|\\bReferences\\b|\\bBibliography\\b)$$, 1) AS cutx, regexp_matches(content, $$(?i)参考文献|\\bReferences\\b|\\bBibliography\\b$$) AS hasref FROM evb e JOIN nd USING (doc_id)),
  a AS (SELECT *, CASE WHEN NOT needs THEN 'kept' WHEN section IN ('method', 'experiments', 'conclusion') AND (refs OR tail) AND hasref AND length({sql_strip('cutx')}) > 0 AND length({sql_strip('cutx')}) < length(c) THEN 'truncated'
      WHEN c <> '' AND ((section IN ('method', 'experiments') AND (score < 45 OR miss OR short OR nosrc)) OR (section = 'conclusion' AND (score < 40 OR miss OR short OR nosrc OR refs OR tail))) THEN 'recopied' ELSE 'kept' END AS action FROM k)
  SELECT doc_id, section, action, score AS score_before, sha256(CASE action WHEN 'truncated' THEN {sql_strip('cutx')} WHEN 'recopied' THEN c ELSE content END) AS content_hash FROM a WHERE section <> 'abstract'""")
def _(spark, d):
    r = _repaired(spark, d).where("section <> 'abstract'")
    return r.select("doc_id", "section", "action", "score_before", F.sha2("content", 256).alias("content_hash"))


@query("ds11_unresolved_sections")
def _(spark, d):
    return Q.unresolved(Q.rescored(_repaired(spark, d, kept_texts=False))).select("doc_id", "section", "score", "score_before", "action")


# ---- plans -----------------------------------------------------------------------------------

# Type rules re-keyed to words of the test prose; the weights and the form are unchanged.
FIXTURE_RULES = [("review", 4, r"(?i)\bble|und"), ("experimental_research", 5, r"eau"), ("engineering_system", 5, r"sch"),
                 ("algorithm_paper", 5, r"(?i)tion|method"), ("algorithm_paper", 3, r"(?i)que|model"), ("thesis_or_report", 4, r"第一章|绪论")]
CAND_SQL = r"""(?i)^(?:(?:\d+(?:[.．]\d+)*(?:[.．、])?|[IVXLCDM]+\.?|[一二三四五六七八九十百]+[、.．]|第[一二三四五六七八九十百\d]+[章节])\s*)?(?:[A-Za-z][A-Za-z \-]{2,80}|[\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}A-Za-z0-9、与及和\-—— ]{1,50})$"""
TITLES_SQL = f"""tl AS (SELECT doc_id, {sql_collapse('l')} AS l, i FROM (SELECT doc_id, unnest(string_split(substring(raw_text, 1, 60000), chr(10))) AS l, generate_subscripts(string_split(substring(raw_text, 1, 60000), chr(10)), 1) AS i FROM papers_v)),
  tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM tl WHERE l <> '' AND NOT starts_with(l, '--- Page') AND length(l) <= 120 AND NOT regexp_matches(l, '[。！？]') AND regexp_matches(l, '{CAND_SQL}')),
  td AS (SELECT doc_id, arg_min(l, i) AS title, min(i) AS i FROM tk WHERE rn <= 40 GROUP BY doc_id, lower(l)),
  titles AS (SELECT doc_id, string_agg(title, chr(10) ORDER BY i) AS titles, count(*) AS n FROM td GROUP BY doc_id)"""
_types = list(K.DOC_TYPES)


def _score_sql(kind: str) -> str:
    parts = [f"CASE WHEN regexp_matches(alltext, '{p}') THEN {w} ELSE 0 END" for t, w, p in FIXTURE_RULES if t == kind]
    if kind == "thesis_or_report":
        parts.append("CASE WHEN len > 120000 THEN 2 ELSE 0 END")
    return " + ".join(parts) if parts else "1"


TYPES_SQL = TITLES_SQL + f""", base AS (SELECT p.doc_id, paper_language, raw_text, length(raw_text) AS len, coalesce(titles, '') AS titles, concat_ws(chr(10), titles, substring(raw_text, 1, 3000), '', '') AS alltext
     FROM papers_v p LEFT JOIN titles USING (doc_id)),
  sc AS (SELECT *, {', '.join(f'CAST({_score_sql(t)} AS BIGINT) AS s_{t}' for t in _types)} FROM base),
  ty AS (SELECT *, greatest({', '.join('s_' + t for t in _types)}) AS best, greatest({' + '.join('s_' + t for t in _types if t != 'generic_research')}, 1) AS total FROM sc),
  typed AS (SELECT *, CASE {' '.join(f"WHEN s_{t} = best THEN '{t}'" for t in _types)} END AS paper_type FROM ty)"""


@query("ds12_heading_candidates", with_views("papers_v", extra=TITLES_SQL) + "SELECT p.doc_id, coalesce(titles, '') AS titles FROM papers_v p LEFT JOIN titles USING (doc_id)")
def _(spark, d):
    return P.with_heading_candidates(papers(spark, d)).select("doc_id", F.array_join("titles", "\n").alias("titles"))


@query("ds13_document_type", with_views("papers_v", extra=TYPES_SQL) + f"SELECT doc_id, paper_type, best AS best_score, CAST(total AS BIGINT) AS total_signal, {', '.join('s_' + t + ' AS score_' + t for t in _types)} FROM typed")
def _(spark, d):
    t = P.with_document_type(P.with_heading_candidates(papers(spark, d)), rules=FIXTURE_RULES)
    return t.select("doc_id", "paper_type", "best_score", "total_signal", *[f"score_{x}" for x in _types])


@query("ds14_size_level", """SELECT doc_id, CASE WHEN n * 10 >= 120000 OR pages > 50 THEN 'huge' WHEN n * 10 >= 40000 THEN 'large' ELSE 'normal' END AS size_level, (n * 10 >= 40000 OR pages > 50) AS use_chunking
   FROM (SELECT doc_id, n_chars AS n, CAST(floor(n_chars / 300) AS BIGINT) AS pages FROM documents)""")
def _(spark, d):
    level = P.size_level(F.col("n_chars") * 10, F.floor(F.col("n_chars") / 300))
    return documents(spark, d).select("doc_id", level.alias("size_level"), (level != "normal").alias("use_chunking"))


def _conf_sql(part: int, col: str = "paper_type") -> str:
    val = lambda v: "'" + (",".join(v) if isinstance(v, list) else v) + "'"
    return f"CASE {col} " + " ".join(f"WHEN '{t}' THEN {val(c[part])}" for t, c in K.DOC_TYPES.items()) + " END"


# Some papers carry an identifier in their first lines, so that the lookup policy has every case.
PLAN_DOCS = """pd AS (SELECT doc_id, paper_language, CASE WHEN doc_id % 3 = 1 THEN '' ELSE substring(title0, 1, 60) END AS title,
     concat(CASE doc_id % 5 WHEN 1 THEN concat('doi: 10.1234/ab.', doc_id, chr(10)) WHEN 2 THEN concat('arXiv: 2401.0', 1000 + doc_id % 9000, chr(10)) ELSE '' END, raw_text) AS raw_text
   FROM papers_v JOIN (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS title0 FROM documents) USING (doc_id))"""


def _plan_docs(spark, d):
    p = papers(spark, d).join(documents(spark, d).select("doc_id", F.left(F.regexp_replace("text", "\\s+", " "), F.lit(60)).alias("t")), "doc_id")
    i = F.col("doc_id")
    mark = F.when(i % 5 == 1, F.concat(F.lit("doi: 10.1234/ab."), i.cast("string"), F.lit("\n"))).when(
        i % 5 == 2, F.concat(F.lit("arXiv: 2401.0"), (1000 + i % 9000).cast("string"), F.lit("\n"))).otherwise("")
    return p.select("doc_id", "paper_language", F.when(i % 3 == 1, "").otherwise(F.col("t")).alias("title"), F.concat(mark, "raw_text").alias("raw_text"))


PLAN_SQL = PLAN_DOCS + ", " + TYPES_SQL.replace("papers_v", "pd").replace("substring(raw_text, 1, 3000), '', '')", "substring(raw_text, 1, 3000), title, '')") \
    .replace("SELECT p.doc_id, paper_language, raw_text,", "SELECT p.doc_id, paper_language, title, raw_text,") + f""",
  ids AS (SELECT *, regexp_matches(substring(raw_text, 1, 3000), '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b') AS has_doi, regexp_matches(substring(raw_text, 1, 3000), '\\b\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?\\b') AS has_arxiv,
      title <> '' AND NOT regexp_matches(title, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(title, '[A-Za-z]{{8,}}') AS eng FROM typed),
  plan AS (SELECT *, paper_language = 'zh' AND NOT (has_doi OR has_arxiv OR eng) AS blocked, paper_language = 'en' AND title <> '' AS titled,
      CASE WHEN len >= 120000 THEN 'huge' WHEN len >= 40000 THEN 'large' ELSE 'normal' END AS size_level FROM ids),
  planned AS (SELECT *, CASE WHEN blocked THEN false WHEN titled THEN true ELSE has_doi OR has_arxiv END AS use_external_lookup,
      CASE WHEN blocked THEN '' WHEN titled OR has_arxiv THEN 'arxiv,crossref,openalex' WHEN has_doi THEN 'crossref,openalex' ELSE '' END AS allowed_tools FROM plan)"""


@query("ds15_rule_plan", with_views("papers_v", extra=PLAN_SQL) + f"""SELECT doc_id, paper_type, {_conf_sql(2)} AS structure_type, {_conf_sql(0)} AS required, {_conf_sql(1)} AS optional, {_conf_sql(3)} AS focus,
   use_external_lookup, allowed_tools, size_level, concat_ws(',', CASE WHEN size_level <> 'normal' THEN 'large_document_truncation_risk' END, CASE WHEN paper_type = 'generic_research' THEN 'weak_paper_type_signal' END) AS risks, has_doi, has_arxiv AS has_arxiv_id FROM planned""")
def _(spark, d):
    p = P.rule_plan(_plan_docs(spark, d), rules=FIXTURE_RULES)
    return p.select("doc_id", "paper_type", "structure_type", _list("required"), _list("optional"), _list("focus"), "use_external_lookup", _list("allowed_tools"),
                    "size_level", _list("risks"), "has_doi", "has_arxiv_id")


@query("ds16_validated_plan", with_views("papers_v", extra=PLAN_SQL) + f""", ext AS (SELECT *, doc_id % 10 >= 7 AS acc, CASE doc_id % 7 WHEN 0 THEN 'bogus' WHEN 1 THEN 'review' WHEN 2 THEN 'algorithm_paper' ELSE 'thesis_or_report' END AS et,
     CASE WHEN doc_id % 3 = 0 THEN ['method', 'nonsense', 'discussion'] ELSE [] END AS er, CASE WHEN doc_id % 2 = 0 THEN ['discussion', 'abstract'] ELSE [] END AS eo, doc_id % 4 = 0 AS rep, doc_id % 9 AS rounds FROM planned WHERE doc_id % 11 <> 0),
  m AS (SELECT p.doc_id, p.paper_type AS pt0, coalesce(acc, false) AS acc, acc IS NOT NULL AS given, CASE WHEN acc AND et <> 'bogus' THEN et ELSE p.paper_type END AS pt, et, er, eo, rep, rounds, p.blocked, p.use_external_lookup AS u
     FROM planned p LEFT JOIN ext e USING (doc_id)),
  n AS (SELECT *, CASE WHEN NOT acc THEN string_split({_conf_sql(0, 'pt0')}, ',') WHEN len(er) > 0 THEN ['method', 'discussion'] ELSE string_split({_conf_sql(0, 'pt')}, ',') END AS req FROM m),
  o AS (SELECT *, CASE WHEN NOT acc THEN string_split({_conf_sql(1, 'pt0')}, ',') WHEN len(list_filter(eo, lambda x: NOT list_contains(req, x))) > 0 THEN list_filter(eo, lambda x: NOT list_contains(req, x))
     ELSE list_filter(string_split({_conf_sql(1, 'pt')}, ','), lambda x: NOT list_contains(req, x)) END AS opt FROM n)
  SELECT doc_id, acc AS accepted, pt AS paper_type, array_to_string(req, ',') AS required, array_to_string(opt, ',') AS optional, CASE WHEN NOT acc THEN u WHEN blocked THEN false ELSE true END AS use_external_lookup,
    CAST(CASE WHEN acc AND rounds > 0 THEN least(rounds, 1) ELSE 1 END AS BIGINT) AS repair_rounds,
    concat_ws(',', CASE WHEN given AND NOT acc THEN 'low_confidence' END, CASE WHEN acc AND et = 'bogus' THEN 'invalid_paper_type' END, CASE WHEN acc AND len(er) = 0 THEN 'required_sections_defaulted' END,
      CASE WHEN acc AND blocked THEN 'lookup_forced_off' END, CASE WHEN acc AND rep THEN 'repair_not_enabled' END) AS warnings FROM o""")
def _(spark, d):
    plan = P.rule_plan(_plan_docs(spark, d), rules=FIXTURE_RULES)
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    ext = documents(spark, d).where(i % 11 != 0).select(
        "doc_id", ((i % 10) / 10).alias("ext_confidence"), F.when(i % 7 == 0, "bogus").when(i % 7 == 1, "review").when(i % 7 == 2, "algorithm_paper").otherwise("thesis_or_report").alias("ext_type"),
        F.when(i % 3 == 0, words("method", "nonsense", "discussion")).otherwise(none).alias("ext_required"), F.when(i % 2 == 0, words("discussion", "abstract")).otherwise(none).alias("ext_optional"),
        F.lit(True).alias("ext_use_lookup"), (i % 4 == 0).alias("ext_repair"), (i % 9).cast("int").alias("ext_rounds"))
    v = P.validate_plan(plan, ext)
    return v.select("doc_id", "accepted", "paper_type", _list("required"), _list("optional"), "use_external_lookup", "repair_rounds", _list("warnings"))


@query("ds22_plan_decisions", with_views("papers_v", extra=TYPES_SQL) + """SELECT doc_id, concat('classified_as_', paper_type) AS decision,
    CASE WHEN titles <> '' THEN concat('Detected section titles: ', array_to_string(string_split(titles, chr(10))[1:8], ', ')) ELSE 'No strong section titles detected; used bounded text keyword signals' END AS reason FROM typed
   UNION ALL SELECT doc_id, 'enable_large_pdf_strategy', concat('raw_text_length=', len, ', page_count=None') FROM typed WHERE len >= 40000""")
def _(spark, d):
    return P.plan_decisions(P.rule_plan(papers(spark, d), rules=FIXTURE_RULES)).drop("confidence")


@query("ds22_verify_decisions", SECTIONS_WITH.rstrip() + EVAL_SQL + """ SELECT doc_id, concat(section, '_missing_but_optional') AS decision, section AS reason, CAST(90 AS BIGINT) AS confidence FROM evb WHERE status = 'optional' AND miss
   UNION ALL SELECT doc_id, 'needs_section_repair', concat('required section issue: ', section, ' ', unnest(blocking)), CAST(85 AS BIGINT) FROM evb""")
def _(spark, d):
    return Q.verify_decisions(Q.evaluate(_scored(spark, d)))


@query("ds22_section_report", SECTIONS_WITH + """SELECT doc_id, section, concat('- ', section, ': source=', source, ', matched_title=''', matched_title, ''', length=', length, ', confidence=', confidence, ', warning=', warning) AS line FROM sections""")
def _(spark, d):
    return Q.section_report(_sections(spark, d))


_pivot_sql = ", ".join(f"max(CASE WHEN section = '{k}' THEN content END) AS {k}" for k in K.SECTION_KEYS)


@query("sk1_section_pivot", SECTIONS_WITH + "SELECT doc_id, " + ", ".join(f"sha256(max(CASE WHEN section = '{k}' THEN content END)) AS {k}" for k in K.SECTION_KEYS) + " FROM sections GROUP BY doc_id")
def _(spark, d):
    # The export itself is JSON text; its fields are read back to compare them.
    j = S.section_export(Q.wide_sections(papers(spark, d)))
    back = j.select("doc_id", F.from_json("json", ", ".join(f"{k} string" for k in K.SECTION_KEYS)).alias("j"))
    return back.select("doc_id", *[F.sha2(f"j.{k}", 256).alias(k) for k in K.SECTION_KEYS])


@query("ds23_analysis_input", SECTIONS_WITH + f""", w AS (SELECT doc_id, {_pivot_sql} FROM sections GROUP BY doc_id)
   SELECT doc_id, sha256(substring(concat_ws(concat(chr(10), chr(10)), abstract, introduction, related_work, method), 1, 20000)) AS method_hash, sha256(substring(experiments, 1, 20000)) AS experiment_hash FROM w""")
def _(spark, d):
    a = Q.analysis_input(Q.wide_sections(papers(spark, d)))
    return a.select("doc_id", F.sha2("method_input", 256).alias("method_hash"), F.sha2("experiment_input", 256).alias("experiment_hash"))


# ---- block streams of web pages ----------------------------------------------------------------

BLOCKS_SQL = f"""bare AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)(?:\\s[^>]*)?>.*?</(?:script|style)>|<!--.*?-->', '', 'g') AS h FROM pages),
  blk0 AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<(h[1-6]|p)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p)>', 1)) AS tag, unnest(regexp_extract_all(h, '(?is)<(h[1-6]|p)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p)>', 2)) AS body,
      generate_subscripts(regexp_extract_all(h, '(?is)<(h[1-6]|p)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p)>', 1), 1) - 1 AS pos FROM bare),
  blk AS (SELECT page_id, pos, tag, {sql_collapse("regexp_replace(replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'), '<[^>]+>', ' ', 'g')")} AS text FROM blk0),
  st AS (SELECT page_id AS doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN tag = 'h1' THEN '一、引言' WHEN pos % 5 = 3 THEN '2.1 实验设计' WHEN pos % 11 = 7 THEN '参考文献' ELSE text END AS text FROM blk),
  fl AS (SELECT *, text IN ('一、引言', '2.1 实验设计', '参考文献') AS h, text = '参考文献' AS r FROM st),
  fg AS (SELECT *, h AND NOT coalesce(max(r) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS g FROM fl),
  isl AS (SELECT *, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS ordinal FROM fg),
  seg0 AS (SELECT doc_id, ordinal, coalesce(max(CASE WHEN g THEN text END), '正文') AS title, coalesce({sql_strip("string_agg(CASE WHEN NOT g THEN text END, chr(10) ORDER BY pos)")}, '') AS text FROM isl GROUP BY 1, 2),
  seg AS (SELECT *, CASE WHEN title = '2.1 实验设计' THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS level FROM seg0 WHERE ordinal > 0 OR text <> '')"""


def _stream(spark, d):
    b = M.html_blocks(table(spark, d, "pages"))
    text = F.when(F.col("tag") == "h1", "一、引言").when(F.col("pos") % 5 == 3, "2.1 实验设计").when(F.col("pos") % 11 == 7, "参考文献").otherwise(F.col("text"))
    return b.select(F.col("page_id").alias("doc_id"), "pos", text.alias("text"))


@query("in9_page_blocks", with_views(extra=BLOCKS_SQL) + "SELECT page_id, CAST(pos AS BIGINT) AS pos, tag, sha256(text) AS text_hash FROM blk")
def _(spark, d):
    return M.html_blocks(table(spark, d, "pages")).select("page_id", "pos", "tag", F.sha2("text", 256).alias("text_hash"))


@query("ds17_block_sections", with_views(extra=BLOCKS_SQL) + "SELECT doc_id, ordinal, title, sha256(text) AS text_hash, level FROM seg")
def _(spark, d):
    return B.segment_blocks(_stream(spark, d)).select("doc_id", "ordinal", "title", F.sha2("text", 256).alias("text_hash"), "level")


@query("wn9_heading_islands", with_views(extra=BLOCKS_SQL) + "SELECT doc_id, ordinal, count(*) FILTER (NOT g) AS n_blocks FROM isl GROUP BY 1, 2 HAVING ordinal > 0 OR count(*) FILTER (NOT g AND text <> '') > 0")
def _(spark, d):
    s = B.segment_blocks(_stream(spark, d))
    return s.select("doc_id", "ordinal", F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_blocks"))


# Markup sections of a page: three parts of it with titles, fewer on every fourth page.
@query("ds18_extraction_method", with_views(extra=BLOCKS_SQL) + """, dv AS (SELECT doc_id, ordinal, title, text FROM seg WHERE doc_id % 4 <> 0 AND ordinal > 0),
   a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (title <> '') AS titled, CAST(sum(length(text)) AS BIGINT) AS chars FROM dv GROUP BY 1),
   b AS (SELECT doc_id, sum(length(title) + length(text)) AS bc FROM seg GROUP BY 1)
   SELECT p.page_id AS doc_id, CASE WHEN n >= 3 AND titled >= 2 AND chars > 1000 THEN 'tei_div_head' WHEN coalesce(bc, 0) > 0 THEN 'zh_heading_fallback' WHEN n > 0 THEN 'tei_div_head_unusable' ELSE 'body_text_fallback' END AS method,
     CASE WHEN n >= 3 AND titled >= 2 AND chars > 1000 THEN n WHEN coalesce(bc, 0) > 0 THEN (SELECT count(*) FROM seg s WHERE s.doc_id = p.page_id) ELSE 1 END AS n_sections FROM pages p LEFT JOIN a ON a.doc_id = p.page_id LEFT JOIN b ON b.doc_id = p.page_id""")
def _(spark, d):
    seg = materialize(B.segment_blocks(_stream(spark, d)), "block-sections")
    div = seg.where("doc_id % 4 <> 0 AND ordinal > 0")
    bodies = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("body_text"))
    methods, chosen = B.choose_sections(div, seg, bodies)
    return methods.join(chosen.groupBy("doc_id").agg(F.count("*").alias("n_sections")), "doc_id")


LOCATE_SQL = """, loc AS (SELECT doc_id, ordinal, CASE WHEN text = '' THEN title ELSE concat(title, chr(10), text) END AS block FROM seg),
   loc2 AS (SELECT *, CAST(coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM loc)"""


@query("ds19_located_sections", with_views(extra=BLOCKS_SQL) + LOCATE_SQL + " SELECT doc_id, ordinal, start_char, start_char + length(block) AS end_char FROM loc2")
def _(spark, d):
    return B.locate_sections(B.segment_blocks(_stream(spark, d))).select("doc_id", "ordinal", "start_char", "end_char")


@query("ds19_rebuilt_text", with_views(extra=BLOCKS_SQL) + LOCATE_SQL + " SELECT doc_id, sha256(string_agg(block, concat(chr(10), chr(10)) ORDER BY ordinal)) AS text_hash FROM loc2 GROUP BY doc_id")
def _(spark, d):
    return B.rebuild_text(B.locate_sections(B.segment_blocks(_stream(spark, d)))).select("doc_id", F.sha2("raw_text", 256).alias("text_hash"))


# ---- page layout: the lines of each document laid out on one page ------------------------------

def _layout(spark, d):
    i, p = F.col("doc_id"), F.col("p")
    t = documents(spark, d).select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 12)).alias("p", "text"))
    font = F.when(p <= 1, 18.0 + i % 3).otherwise(10.0 + p % 2)
    y = 60.0 + p * 20
    return t.select("doc_id", p.alias("line_no"), F.left("text", F.lit(70)).alias("text"), (50.0 + p * 4 + i % 40).alias("x0"), y.alias("y0"), (550.0 - p * 4).alias("x1"),
                    (y + font).alias("y1"), font.alias("font_size"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


@query("ds20_title_candidates")
def _(spark, d):
    # The script class is a parameter; the test prose is Latin.
    return L.title_candidates(_layout(spark, d), script="[A-Za-z]").select("doc_id", "text", "score", "lines_merged", "rank")


@query("tk2_best_title")
def _(spark, d):
    return L.title_candidates(_layout(spark, d), script="[A-Za-z]", k=1).select("doc_id", "text", "score")


GEO = """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:12]) AS l, generate_subscripts(string_split(text, chr(10))[1:12], 1) - 1 AS p FROM documents),
   g AS (SELECT doc_id, p, 60.0 + p * 20 AS y0, CASE WHEN p <= 1 THEN 18.0 + doc_id % 3 ELSE 10.0 + p % 2 END AS font, (50.0 + p * 4 + doc_id % 40 + 550.0 - p * 4) / 2 AS cx FROM ln),
   k AS (SELECT doc_id, p, lead(y0) OVER w - (y0 + font) AS gap, lead(font) OVER w AS nf, lead(cx) OVER w AS ncx, font, cx FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY p))"""


@query("wn10_adjacent_lines", GEO + " SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (gap >= -2 AND gap <= greatest(font, nf) * 1.9 AND abs(cx - ncx) <= 120) AS n_close FROM k WHERE nf IS NOT NULL GROUP BY doc_id")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id").orderBy("y0", "line_no")
    s = _layout(spark, d).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    nxt = lambda c: F.lead(c).over(w)
    s = s.select("doc_id", (nxt("y0") - F.col("y1")).alias("gap"), nxt("font_size").alias("nf"), nxt("cx").alias("ncx"), "cx", "font_size").where("nf IS NOT NULL")
    close = (F.col("gap") >= -2) & (F.col("gap") <= F.greatest("font_size", "nf") * 1.9) & (F.abs(F.col("cx") - F.col("ncx")) <= 120)
    return s.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_if(close).alias("n_close"))


@query("ds21_page_authors")
def _(spark, d):
    """Pages whose second line names two people; the name pool is derived from the document id."""
    i = F.col("doc_id")
    names = F.concat(F.element_at(F.array(*[F.lit(x) for x in "张李王赵陈"]), (i % 5 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("三", "小明", "建国")]), (i % 3 + 1).cast("int")))
    lines = F.array(F.left(F.regexp_replace("text", "\\s+", " "), F.lit(60)), F.when(i % 4 == 0, "某某大学 计算机学院").otherwise(F.concat(names, F.lit("，李四"))), F.lit("摘要：正文"), F.left("text", F.lit(80)))
    docs = documents(spark, d)
    l = docs.select("doc_id", F.posexplode(lines).alias("pos", "text"))
    titles = docs.select("doc_id", F.left(F.regexp_replace("text", "\\s+", " "), F.lit(60)).alias("title"))
    return L.first_page_authors(l, titles).select("doc_id", F.array_join("authors", ",").alias("authors"))

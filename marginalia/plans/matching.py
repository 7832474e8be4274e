"""Metadata queries (MD-1 .. MD-11, JN-11, WN-4, TK-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.operators import metadata as M
from marginalia.plans.base import candidates, documents, query, sql_collapse, sql_list, sql_strip, table, with_views
from marginalia.plans.texts import _clear_sql

_s = lambda c: c.cast("string")

# Parser output of each document: every field is sometimes missing, unclear or given by a second source.
INFO_SQL = """info AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS lang2, CASE doc_id % 4 WHEN 0 THEN '未明确提及' WHEN 1 THEN '' ELSE concat('T ', doc_id, ' ', source) END AS title,
    CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['unknown'] ELSE [concat(' A', doc_id % 50, ' '), 'B'] END AS authors, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE text END AS abstract,
    CASE WHEN doc_id % 6 = 0 THEN 'N/A' ELSE CAST(1990 + doc_id % 30 AS VARCHAR) END AS year, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS venue,
    concat('C ', doc_id) AS candidate_title, (doc_id % 10) / 10.0 AS conf, ['Cand'] AS candidate_authors, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'tiny' END AS candidate_abstract FROM documents)"""


def _info(spark, d):
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    return documents(spark, d).select(
        "doc_id", F.when(F.col("lang") == "en", "en").otherwise("zh").alias("paper_language"),
        F.when(i % 4 == 0, "未明确提及").when(i % 4 == 1, "").otherwise(F.concat(F.lit("T "), _s(i), F.lit(" "), "source")).alias("title"),
        F.when(i % 3 == 0, none).when(i % 3 == 1, F.array(F.lit("unknown"))).otherwise(F.array(F.concat(F.lit(" A"), _s(i % 50), F.lit(" ")), F.lit("B"))).alias("authors"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, "short").otherwise(F.col("text")).alias("abstract"), F.when(i % 6 == 0, "N/A").otherwise(_s((1990 + i % 30).cast("int"))).alias("year"),
        F.when(i % 7 == 0, None).otherwise(F.col("source")).alias("venue"), F.concat(F.lit("C "), _s(i)).alias("candidate_title"), ((i % 10) / 10.0).alias("candidate_confidence"),
        F.array(F.lit("Cand")).alias("candidate_authors"), F.when(i % 2 == 0, F.col("text")).otherwise("tiny").alias("candidate_abstract"), F.col("text").alias("raw_text"))


_ok = lambda x, extra="": f"({_clear_sql(x)}{extra})"
_abs = lambda x: _ok(x, f" AND length({sql_strip(x)}) >= 20")
RESOLVED_SQL = INFO_SQL + f""", res AS (SELECT doc_id, lang2, CASE WHEN {_ok('title')} THEN title WHEN lang2 = 'zh' AND conf >= 0.75 THEN candidate_title END AS final_title,
     CASE WHEN {_ok('title')} THEN 'parser' WHEN lang2 = 'zh' AND conf >= 0.75 THEN 'parser_meta' ELSE 'default' END AS title_source,
     CASE WHEN doc_id % 3 = 2 THEN concat('A', doc_id % 50, '|B') WHEN lang2 = 'zh' THEN 'Cand' END AS final_authors, CASE WHEN doc_id % 3 = 2 THEN 'parser' WHEN lang2 = 'zh' THEN 'parser_meta' ELSE 'default' END AS authors_source,
     CASE WHEN {_abs('abstract')} THEN abstract WHEN lang2 = 'zh' AND {_abs('candidate_abstract')} THEN candidate_abstract END AS final_abstract,
     CASE WHEN {_abs('abstract')} THEN 'parser' WHEN lang2 = 'zh' AND {_abs('candidate_abstract')} THEN 'parser_meta' ELSE 'default' END AS abstract_source,
     CASE WHEN {_ok('year')} THEN year END AS final_year, CASE WHEN {_ok('venue')} THEN venue END AS final_venue FROM info)"""


@query("md1_resolved_fields", f"WITH {RESOLVED_SQL} SELECT doc_id, final_title, title_source, final_authors, authors_source, sha256(final_abstract) AS abstract_hash, abstract_source, final_year, final_venue FROM res")
def _(spark, d):
    r = M.resolve_fields(_info(spark, d))
    return r.select("doc_id", "final_title", "title_source", F.when(F.col("final_authors").isNotNull(), F.array_join("final_authors", "|")).alias("final_authors"), "authors_source",
                    F.sha2("final_abstract", 256).alias("abstract_hash"), "abstract_source", "final_year", "final_venue")


MISSING = "concat_ws(',', CASE WHEN final_title IS NULL THEN 'title' END, CASE WHEN final_authors IS NULL THEN 'authors' END, CASE WHEN final_year IS NULL THEN 'year' END, CASE WHEN final_venue IS NULL THEN 'venue' END, CASE WHEN final_abstract IS NULL THEN 'abstract' END)"


@query("md2_missing_fields", f"WITH {RESOLVED_SQL} SELECT doc_id, {MISSING} AS missing, concat_ws(',', CASE WHEN final_authors IS NULL THEN 'authors' END, CASE WHEN final_abstract IS NULL THEN 'abstract' END) AS missing_core FROM res")
def _(spark, d):
    r = M.resolve_fields(_info(spark, d))
    return r.select("doc_id", F.array_join(M.missing_fields(r), ",").alias("missing"), F.array_join(M.missing_fields(r, ["authors", "abstract"]), ",").alias("missing_core"))


DEC = """dec AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '10.1/x' ELSE '' END AS doi, CASE WHEN doc_id % 8 = 1 THEN '2401.01234' END AS arx, CASE WHEN doc_id % 8 = 2 THEN 'https://doi.org/10.5555/abc' ELSE '' END AS url,
    CASE WHEN doc_id % 8 = 3 THEN 'A clear English title' WHEN doc_id % 8 = 4 THEN '中文题目' ELSE 'Short' END AS title, CASE WHEN doc_id % 8 IN (3, 5) THEN source END AS venue, CASE WHEN doc_id % 8 <> 6 THEN '1999' END AS year, text FROM documents)"""


@query("md3_lookup_decision", f"""WITH {DEC}, h AS (SELECT *, concat_ws(chr(10), nullif(doi, ''), arx, nullif(url, ''), title, nullif(substring(text, 1, 3000), '')) AS head FROM dec),
   k AS (SELECT doc_id, CASE WHEN doi <> '' OR regexp_matches(head, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b') THEN 'zh_doi' WHEN arx IS NOT NULL OR regexp_matches(head, '(?i)(?:arXiv[:\\s]*)?\\d{{4}}\\.\\d{{4,5}}') OR regexp_matches(head, '(?i)[a-z-]+(?:\\.[A-Z]{{2}})?/\\d{{7}}') THEN 'zh_arxiv'
     WHEN doc_id % 8 = 3 THEN 'zh_english_title' WHEN venue IS NOT NULL AND year IS NOT NULL THEN 'zh_venue_and_year' END AS r FROM h)
   SELECT doc_id, r IS NOT NULL AS lookup, coalesce(r, 'zh_without_identifier') AS reason FROM k""")
def _(spark, d):
    m = F.col("doc_id") % 8
    docs = documents(spark, d).select(
        "doc_id", F.when(m == 0, "10.1/x").otherwise("").alias("doi"), F.when(m == 1, "2401.01234").alias("arx"), F.when(m == 2, "https://doi.org/10.5555/abc").otherwise("").alias("url"),
        F.when(m == 3, "A clear English title").when(m == 4, "中文题目").otherwise("Short").alias("title"), F.when(m.isin(3, 5), F.col("source")).alias("venue"), F.when(m != 6, "1999").alias("year"), "text")
    use, why = M.lookup_decision(*[F.col(c) for c in ("doi", "arx", "url", "title", "venue", "year", "text")])
    return docs.select("doc_id", use.alias("lookup"), why.alias("reason"))


@query("md4_lookup_worklist", f"""WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['abstract'] ELSE ['year', 'abstract'] END AS missing, CASE WHEN doc_id % 2 = 0 THEN concat('Title of ', doc_id) ELSE '未明确提及' END AS title,
     CASE WHEN doc_id % 3 = 0 THEN '2401.01234v1' ELSE '' END AS arx, text FROM documents),
   g AS (SELECT doc_id, arg_min(l, i) AS guess FROM (SELECT doc_id, {sql_strip('unnest(string_split(substring(text, 1, 2000), chr(10)))')} AS l, generate_subscripts(string_split(substring(text, 1, 2000), chr(10)), 1) AS i FROM documents) WHERE NOT starts_with(l, '--- Page') AND length(l) BETWEEN 8 AND 220 GROUP BY 1),
   a AS (SELECT b.*, CASE WHEN len(missing) = 0 THEN [] WHEN missing = ['abstract'] AND arx <> '' THEN ['arxiv'] WHEN missing = ['abstract'] THEN [] WHEN arx <> '' THEN ['arxiv', 'crossref', 'openalex'] ELSE ['crossref', 'openalex'] END AS ask, coalesce(guess, '') AS guess FROM b LEFT JOIN g USING (doc_id))
   SELECT doc_id, unnest(ask) AS provider, CASE WHEN doc_id % 2 = 0 THEN title ELSE guess END AS hint_title, arx AS hint_arxiv FROM a""")
def _(spark, d):
    i = F.col("doc_id")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    docs = documents(spark, d).select(
        "doc_id", F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, arr("abstract")).otherwise(arr("year", "abstract")).alias("missing"),
        F.when(i % 2 == 0, F.concat(F.lit("Title of "), _s(i))).otherwise("未明确提及").alias("title"), arr(" ", "Ann Lee").alias("authors"), F.lit("").alias("doi"),
        F.when(i % 3 == 0, "2401.01234v1").otherwise("").alias("arxiv_id"), F.col("text").alias("raw_text"))
    return M.lookup_worklist(docs).select("doc_id", "provider", "hint_title", "hint_arxiv")


# ---- matching ------------------------------------------------------------------------------------

def _our(spark, d):
    i = F.col("doc_id")
    return documents(spark, d).select("doc_id", F.left("text", F.lit(60)).alias("our_title"), F.array(F.concat(F.lit("Ann Lee "), _s(i % 10)), F.lit("Bo Li")).alias("our_authors"),
                                      _s((1990 + i % 30).cast("int")).alias("our_year"), F.col("source").alias("our_venue"), F.concat(F.lit("10.1234/ab."), _s(i)).alias("our_doi"), F.lit("").alias("our_arxiv"))


def _cands(spark, d):
    i, p = F.col("doc_id"), F.col("pos")
    authors = F.when(p == 1, F.array(F.concat(F.lit("Ann Lee "), _s(i % 10)), F.lit("Bo Li"))).when(p == 2, F.array(F.lit("Ann Lee"))).otherwise(F.array().cast("array<string>"))
    return candidates(spark, d).select("*", authors.alias("authors"), F.when(p < 3, F.concat(F.lit("src"), _s(i % 20))).otherwise("").alias("venue"), F.lit("").alias("url"), F.col("title").alias("abstract"))


@query("md5_author_scores", with_views("candidates_v") + "SELECT doc_id, CAST(pos AS BIGINT) AS cand_pos, CASE WHEN pos = 1 THEN CAST(1.0 AS DOUBLE) WHEN pos = 3 THEN 0.0 ELSE 0.8 END AS author_score FROM candidates_v")
def _(spark, d):
    j = _cands(spark, d).join(_our(spark, d), "doc_id")
    return j.select("doc_id", F.col("pos").cast("bigint").alias("cand_pos"), M.author_score(F.col("our_authors"), F.col("authors")).alias("author_score"))


@query("md6_venue_scores", """WITH v AS (SELECT doc_id, source AS a, CASE doc_id % 4 WHEN 0 THEN upper(source) WHEN 1 THEN concat('Journal of ', source) WHEN 2 THEN '' ELSE NULL END AS b FROM documents)
   SELECT doc_id, CASE WHEN coalesce(b, '') = '' THEN CAST(0.0 AS DOUBLE) WHEN lower(a) = lower(b) THEN 1.0 ELSE 0.85 END AS venue_score FROM v""")
def _(spark, d):
    i = F.col("doc_id") % 4
    b = F.when(i == 0, F.upper("source")).when(i == 1, F.concat(F.lit("Journal of "), "source")).when(i == 2, "")
    return documents(spark, d).select("doc_id", M.venue_score(F.col("source"), b).alias("venue_score"))


@query("md7_reranked_candidates")
def _(spark, d):
    r = M.rerank(_cands(spark, d), _our(spark, d))
    return r.select("doc_id", "provider", "pos", "local_rank", "local_match_score", "title_similarity", "author_match_score", "year_match", "venue_match_score", "doi_match", "rerank_reason")


@query("md7_identifier_matches", with_views("candidates_v") + "SELECT doc_id, CAST(pos AS BIGINT) AS cand_pos, pos = 1 AND doc_id % 4 = 0 AS doi_match, pos <> 2 AS year_match FROM candidates_v")
def _(spark, d):
    r = M.rerank(_cands(spark, d), _our(spark, d))
    return r.select("doc_id", F.col("pos").cast("bigint").alias("cand_pos"), "doi_match", "year_match")


@query("md8_best_candidates")
def _(spark, d):
    best = M.pick_best(M.simple_score(_cands(spark, d), _our(spark, d).withColumn("our_doi", F.concat(F.lit("https://doi.org/"), "our_doi"))))
    return best.select("doc_id", "provider", "pos", "confidence")


FIELD_SQL = "unnest(['title', 'authors', 'year', 'venue', 'abstract']) AS field, unnest([CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN source ELSE text END, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Ann' END, CAST(1890 + doc_id % 300 AS VARCHAR), source, CASE WHEN doc_id % 6 = 0 THEN lang ELSE text END]) AS value"


def _long(spark, d):
    i = F.col("doc_id")
    f = lambda n, v: F.struct(F.lit(n).alias("field"), v.alias("value"))
    rows = F.array(f("title", F.when(i % 5 == 0, "").when(i % 5 == 1, F.col("source")).otherwise(F.col("text"))), f("authors", F.when(i % 3 == 0, "").otherwise("Ann")), f("year", _s((1890 + i % 300).cast("int"))), f("venue", F.col("source")), f("abstract", F.when(i % 6 == 0, F.col("lang")).otherwise(F.col("text"))))
    return documents(spark, d).select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


_gate = (f"""{_clear_sql('value')} AND CASE field WHEN 'title' THEN length({sql_strip('value')}) >= 8 WHEN 'year' THEN regexp_matches(value, '^(19|20)[0-9][0-9]$') WHEN 'abstract' THEN length({sql_strip('value')}) >= 20 ELSE true END""")


@query("md9_usable_values", f"WITH v AS (SELECT doc_id, {FIELD_SQL} FROM documents) SELECT doc_id, field, doc_id % 4 <> 0 AND {_gate} AND doc_id % 7 <> 1 AS usable FROM v")
def _(spark, d):
    i = F.col("doc_id")
    sim = F.when(i % 7 == 1, 0.3).when(i % 7 == 2, None).otherwise(0.9)
    return _long(spark, d).select("doc_id", "field", M.usable(F.col("field"), F.col("value"), F.when(i % 4 == 0, 0.74).otherwise(0.75), sim).alias("usable"))


@query("md10_filled_fields", f"""WITH v AS (SELECT doc_id, {FIELD_SQL} FROM documents), o AS (SELECT doc_id, field, value, CASE WHEN doc_id % 2 = 0 AND field IN ('title', 'abstract') THEN 'parser' END AS have FROM v),
   k AS (SELECT *, doc_id % 4 <> 1 AND {_gate} AS good FROM o)
   SELECT doc_id, field, CASE WHEN have IS NOT NULL THEN 'an existing clear value' WHEN good THEN value END AS value, CASE WHEN have IS NOT NULL THEN 'parser' WHEN good THEN 'tool' ELSE 'default' END AS source,
     CASE WHEN have IS NOT NULL THEN 'existing_value_is_clear' WHEN NOT good THEN 'missing_or_low_confidence' END AS not_used_reason FROM k""")
def _(spark, d):
    i = F.col("doc_id")
    long = _long(spark, d)
    have = (i % 2 == 0) & F.col("field").isin("title", "abstract")
    fields = long.select("doc_id", "field", F.when(have, "an existing clear value").otherwise("未明确提及").alias("value"), F.lit("parser").alias("source"))
    best = long.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in K.METADATA_FIELDS])
    best = best.select("*", F.lit("crossref").alias("provider"), F.when(i % 4 == 1, 0.5).otherwise(0.8).alias("score"), F.lit(None).cast("double").alias("title_similarity"))
    return M.fill_missing(fields, best).drop("provider")


@query("md11_accepted_picks", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
   p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN string_split(text, chr(10))[1] WHEN 1 THEN 'made up' WHEN 2 THEN string_split(text, chr(10))[2] ELSE string_split(text, chr(10))[1] END AS t, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN 1 ELSE NULL END AS idx, (doc_id % 10) AS c10 FROM documents)
   , q AS (SELECT doc_id, trim(coalesce(t, '')) AS t, idx, c10 FROM p)
   SELECT q.doc_id, CASE WHEN ok THEN q.t END AS title, ok AS accepted FROM (SELECT q.*, coalesce(CASE WHEN q.idx IS NOT NULL AND q.idx < n THEN q.t = (SELECT l.t FROM l WHERE l.doc_id = q.doc_id AND l.idx = q.idx) ELSE EXISTS (SELECT 1 FROM l WHERE l.doc_id = q.doc_id AND l.t = q.t) END, false)
      AND c10 >= 5 AND q.t <> '' AS ok FROM q JOIN n USING (doc_id)) q""")
def _(spark, d):
    i = F.col("doc_id")
    docs = documents(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    cand = docs.select("doc_id", F.posexplode("l").alias("idx", "text"))
    picks = docs.select("doc_id", F.when(i % 4 == 1, "made up").when(i % 4 == 2, F.get("l", F.lit(1))).otherwise(F.get("l", F.lit(0))).alias("pick_title"),
                        F.when(i % 4 == 0, 0).when(i % 4 == 3, 1).cast("int").alias("pick_index"), ((i % 10) / 10.0).alias("pick_confidence"))
    return M.accept_picks(picks, cand)


@query("wn4_arrival_ranks", with_views("candidates_v") + "SELECT doc_id, provider, CAST(pos AS BIGINT) AS cand_pos, row_number() OVER (PARTITION BY doc_id, provider ORDER BY pos) AS provider_rank, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS provider_global_rank FROM candidates_v")
def _(spark, d):
    return M.arrival_ranks(candidates(spark, d)).select("doc_id", "provider", F.col("pos").cast("bigint").alias("cand_pos"), "provider_rank", "provider_global_rank")


@query("tk6_slim_candidates", """WITH c AS (SELECT source, CASE doc_id % 2 WHEN 0 THEN 'crossref' ELSE 'openalex' END AS provider, doc_id AS pos, text AS abstract FROM documents)
   SELECT source AS doc_id, provider, CAST(pos AS BIGINT) AS cand_pos, rn AS slim_rank, CASE WHEN source IN ('src0', 'src7') THEN substring(abstract, 1, 500) END AS abstract FROM (SELECT *, row_number() OVER (PARTITION BY source, provider ORDER BY pos) AS rn FROM c) WHERE rn <= 3""")
def _(spark, d):
    i = F.col("doc_id")
    c = documents(spark, d).select(F.col("source").alias("doc_id"), F.when(i % 2 == 0, "crossref").otherwise("openalex").alias("provider"), i.alias("pos"), F.col("text").alias("abstract"))
    need = c.where(F.col("doc_id").isin("src0", "src7")).select("doc_id")
    return M.slim_candidates(c, need).select("doc_id", "provider", F.col("pos").cast("bigint").alias("cand_pos"), "slim_rank", "abstract")


# A document's own title, and those of its copies, are among the candidates, so the best match is an equal title or an
# equal DOI; near titles come after them and are compared with brute force in the tests.
TITLE_SQL = f"""trim(regexp_replace({sql_strip(r"""rtrim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '：', ':'), '[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+', ' ', 'g'), ' *: *', ': ', 'g'), '["''“”‘’`]+', '', 'g'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(12288), '.,;:，。；：!?？！'))""")}, ' +', ' ', 'g'))"""


@query("jn11_corpus_matches", with_views("candidates_v") + f""", d AS (SELECT doc_id, {TITLE_SQL.format('substring(text, 1, 60)')} AS t FROM documents),
   c AS (SELECT doc_id * 10 + pos AS cand_id, {TITLE_SQL.format('title')} AS t, CASE WHEN doi IS NOT NULL THEN doc_id END AS same_doi FROM candidates_v),
   m AS (SELECT d.doc_id, c.cand_id, 1.0 AS similarity, c.same_doi IS NOT DISTINCT FROM d.doc_id AS by_doi FROM d JOIN c USING (t) WHERE t <> ''
         UNION ALL SELECT d.doc_id, c.cand_id, 0.98, true FROM d JOIN c ON c.same_doi = d.doc_id),
   b AS (SELECT doc_id, cand_id, CAST(max(similarity) AS DOUBLE) AS similarity, bool_or(by_doi) AS by_doi FROM m GROUP BY 1, 2)
   SELECT doc_id, cand_id, similarity, by_doi, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY by_doi DESC, similarity DESC, cand_id) AS rank FROM b) WHERE rank = 1""")
def _(spark, d):
    docs = documents(spark, d).select("doc_id", F.left("text", F.lit(60)).alias("title"), F.concat(F.lit("10.1234/ab."), _s(F.col("doc_id"))).alias("doi"))
    c = candidates(spark, d).select((F.col("doc_id") * 10 + F.col("pos")).alias("cand_id"), "title", "doi")
    return M.match_corpus(docs, c)

"""Retrieval queries (DS-7, RT-*, TK-1)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from marginalia.operators import bundles as B
from marginalia.operators import chunks as C
from marginalia.operators import evidence as E
from marginalia.operators import quality as Q
from marginalia.operators import retrieval as R
from marginalia.operators import token_index
from marginalia.plans.base import documents, papers, query, sql_strip, table, with_views
from marginalia.plans.structure import SECTIONS_SQL
from marginalia.scale import materialize, shared_folder

TOKEN_SQL = "regexp_extract_all(lower({0}), '[a-z0-9_\\x{{131}}\\x{{17f}}]+|[\\x{{4e00}}-\\x{{9fff}}]')"


def chunk_sql(source: str, keys: str) -> str:
    """Recursive definition of ``ch`` over ``src(keys, t)`` (t trimmed)."""
    h = "length(regexp_extract(substring(t, {s} + 601, 600), '(?s)^.*[ \\n]', 0))"
    cut = lambda s: (f"CASE WHEN length(t) - {s} <= 1200 THEN length(t) WHEN {h.format(s=s)} = 0 THEN {s} + 1200 "
                     f"ELSE {s} + 600 + {h.format(s=s)} - 1 END")
    return f"""/*recursive*/ src AS ({source}),
ch AS (SELECT {keys}, t, CAST(0 AS BIGINT) AS st, CAST({cut('0')} AS BIGINT) AS en FROM src WHERE length(t) > 0
  UNION ALL
  SELECT {keys}, t, ns, CAST({cut('ns')} AS BIGINT) FROM (SELECT {keys}, t, greatest(en - 200, st + 1) AS ns FROM ch WHERE en < length(t)) x),
frag AS (SELECT {keys}, st, en, {sql_strip('substring(t, st + 1, en - st)')} AS txt FROM ch),
chunk AS (SELECT {keys}, st, en, txt, row_number() OVER (PARTITION BY {keys} ORDER BY st) - 1 AS idx FROM frag WHERE txt <> '')"""


DOC_CHUNKS = chunk_sql(f"SELECT doc_id, {sql_strip('text')} AS t FROM documents", "doc_id")


@query("ds7_chunks", with_views(extra=DOC_CHUNKS) + "SELECT doc_id, idx, st AS start_char, en AS end_char, sha256(txt) AS text_hash FROM chunk")
def _(spark, d):
    c = C.chunk_documents(documents(spark, d))
    return c.select("doc_id", "idx", "start_char", "end_char", F.sha2("text", 256).alias("text_hash"))


@query("ud3_chunk_function", with_views(extra=DOC_CHUNKS) + "SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(txt)) AS BIGINT) AS n_chars FROM chunk GROUP BY doc_id")
def _(spark, d):
    from marginalia.functions.registry import register_all
    register_all(spark)
    docs = documents(spark, d).select("doc_id", "text")
    docs.createOrReplaceTempView("ud3_documents")
    return spark.sql("""SELECT doc_id, count(*) AS n_chunks, sum(CAST(length(c.text) AS BIGINT)) AS n_chars
                        FROM ud3_documents, LATERAL chunk_text(ud3_documents.text, 1200, 200) c GROUP BY doc_id""")


@query("rt1_token_counts", f"""WITH t AS (SELECT doc_id, unnest({TOKEN_SQL.format('text')}) AS token FROM documents),
  p AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT token, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_total FROM p GROUP BY token""")
def _(spark, d):
    return R.token_counts(documents(spark, d), "doc_id")


@query("sk3_token_index", f"""{with_views(extra=DOC_CHUNKS)}, t AS (SELECT txt, unnest({TOKEN_SQL.format('txt')}) AS token FROM (SELECT DISTINCT txt FROM chunk)),
  p AS (SELECT txt, token, count(*) AS n FROM t GROUP BY 1, 2) SELECT token, count(*) AS n_texts, max(n) AS max_n FROM p GROUP BY token""")
def _(spark, d):
    blocks = _index(spark, d).blocks()
    return blocks.groupBy("token").agg(F.sum("n_texts").alias("n_texts"), F.max("max_n").cast("bigint").alias("max_n"))


RANK_SQL = DOC_CHUNKS + f""",
 ct AS (SELECT doc_id, idx, token, count(*) AS n FROM (SELECT doc_id, idx, unnest({TOKEN_SQL.format('txt')}) AS token FROM chunk) GROUP BY 1, 2, 3),
 q AS (SELECT item_id AS query_id, {sql_strip('text')} AS query FROM benchmark),
 qt AS (SELECT query_id, token, count(*) AS qn FROM (SELECT query_id, unnest({TOKEN_SQL.format('query')}) AS token FROM q) GROUP BY 1, 2),
 tot AS (SELECT query_id, CAST(sum(qn) AS BIGINT) AS total FROM qt GROUP BY 1),
 ov AS (SELECT query_id, doc_id, idx, CAST(sum(least(qn, n)) AS BIGINT) AS overlap FROM qt JOIN ct USING (token) GROUP BY 1, 2, 3),
 sc AS (SELECT ov.*, total, contains(lower(txt), lower(query)) AS phrase, concat(ov.doc_id, ':document:', ov.idx) AS chunk_id
        FROM ov JOIN tot USING (query_id) JOIN q USING (query_id) JOIN chunk USING (doc_id, idx))"""


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark, d):
    """The stored index of a folder's documents; the first query builds it, later ones find it as it is."""
    name = hashlib.sha256(d.rstrip("/").encode()).hexdigest()[:24]
    return token_index.refresh(documents(spark, d).select("doc_id", "text"), f"{shared_folder(spark).rstrip('/')}/marginalia/token-index-{name}", C.chunk_documents)


def _top(k: int, order: str) -> str:
    return f"""{with_views(extra=RANK_SQL)} SELECT query_id, rank, chunk_id, overlap, total{', phrase' if 'phrase' in order else ''} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM sc) WHERE rank <= {k}"""


@query("rt2_overlap_ranking", _top(8, "overlap DESC, chunk_id"))
def _(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d), 8, phrase=False).select("query_id", "rank", "chunk_id", "overlap", "total")


@query("rt3_phrase_matches", with_views(extra=RANK_SQL) + "SELECT query_id, count(*) AS n_chunks FROM sc WHERE phrase GROUP BY query_id")
def _(spark, d):
    index = _index(spark, d)
    hits = R.phrase_matches(_queries(spark, d), index)
    return hits.join(index.owners(), "text_no").groupBy("query_id").agg(F.count("*").alias("n_chunks"))


@query("rt4_top_chunks", _top(3, "phrase DESC, overlap DESC, chunk_id"))
def _(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d), 3).select("query_id", "rank", "chunk_id", "overlap", "total", "phrase")


@query("tk1_top_eight", _top(8, "phrase DESC, overlap DESC, chunk_id"))
def _(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d), 8).select("query_id", "rank", "chunk_id", "overlap", "total", "phrase")


# ---- scoped retrieval, bundles and evidence over sectioned papers -----------------------------

SECTION_SOURCES = f"""named AS (SELECT doc_id, section, content FROM sections WHERE content <> ''
   UNION ALL SELECT doc_id, 'document', raw_text FROM papers_v WHERE doc_id NOT IN (SELECT doc_id FROM sections WHERE content <> ''))"""
PAPER_CHUNKS = SECTIONS_SQL + ", " + SECTION_SOURCES + ", " + chunk_sql(
    f"SELECT doc_id, section, {sql_strip('content')} AS t FROM named", "doc_id, section").replace("/*recursive*/ ", "")
PAPER_WITH = with_views("papers_v", extra="/*recursive*/ " + PAPER_CHUNKS)

VERSIONED = """, ident AS (SELECT p.doc_id, p.raw_text, string_agg(concat(n.section, chr(30), n.content), chr(31) ORDER BY
      CASE n.section WHEN 'abstract' THEN 0 WHEN 'introduction' THEN 1 WHEN 'related_work' THEN 2 WHEN 'method' THEN 3 WHEN 'experiments' THEN 4 WHEN 'conclusion' THEN 5 ELSE 6 END) AS named_text
    FROM papers_v p JOIN named n USING (doc_id) GROUP BY 1, 2),
  ver AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'grobid' ELSE 'pymupdf' END AS parser, concat('sha256:', sha256(concat_ws(chr(31), '1', CAST(doc_id AS VARCHAR),
      CASE WHEN doc_id % 2 = 0 THEN 'grobid' ELSE 'pymupdf' END, raw_text, named_text, '1200', '200'))) AS cache_version FROM ident),
  vchunk AS (SELECT c.doc_id, v.parser, v.cache_version, c.section, c.st, c.en, c.txt,
      concat('c_', sha256(concat_ws(chr(31), c.section, CAST(c.st AS VARCHAR), CAST(c.en AS VARCHAR), c.txt))) AS chunk_id FROM chunk c JOIN ver v USING (doc_id))"""


def _versioned(spark, d):
    wide = Q.wide_sections(papers(spark, d), keep_text=True)
    src = E.section_sources(wide).withColumn("parser", F.when(F.col("doc_id") % 2 == 0, "grobid").otherwise("pymupdf"))
    v = E.with_version(src.select("doc_id", "parser", "raw_text", "sections"))
    return materialize(E.versioned_chunks(v.select("doc_id", "parser", "cache_version", "sections")), "versioned-chunks")


@query("rt7_versioned_chunks", PAPER_WITH + VERSIONED + " SELECT doc_id, parser, cache_version, chunk_id, section, st AS start_char, en AS end_char FROM vchunk")
def _(spark, d):
    return _versioned(spark, d).select("doc_id", "parser", "cache_version", "chunk_id", "section", "start_char", "end_char")


# Each document is asked for the words of its own first 120 characters.
ASK = f""", req AS (SELECT doc_id AS request_id, doc_id, {sql_strip('substring(text, 1, 120)')} AS query FROM documents WHERE {sql_strip('substring(text, 1, 120)')} <> ''),
  rt AS (SELECT request_id, token, count(*) AS qn FROM (SELECT request_id, unnest({TOKEN_SQL.format('query')}) AS token FROM req) GROUP BY 1, 2),
  rtot AS (SELECT request_id, CAST(sum(qn) AS BIGINT) AS total FROM rt GROUP BY 1),
  vt AS (SELECT doc_id, parser, chunk_id, token, count(*) AS n FROM (SELECT doc_id, parser, chunk_id, unnest({TOKEN_SQL.format('txt')}) AS token FROM vchunk) GROUP BY 1, 2, 3, 4),
  rov AS (SELECT r.request_id, v.doc_id, v.parser, v.chunk_id, CAST(sum(least(qn, n)) AS BIGINT) AS overlap FROM req r JOIN vt v USING (doc_id) JOIN rt ON rt.request_id = r.request_id AND rt.token = v.token GROUP BY 1, 2, 3, 4),
  rsc AS (SELECT o.*, total, contains(lower(vc.txt), lower(r.query)) AS phrase, vc.section, vc.txt FROM rov o JOIN rtot USING (request_id) JOIN req r USING (request_id)
          JOIN vchunk vc ON vc.doc_id = o.doc_id AND vc.chunk_id = o.chunk_id),
  rbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, doc_id, parser ORDER BY phrase DESC, overlap DESC, chunk_id) AS rank FROM rsc) WHERE rank <= 3)"""


def _requests(spark, d):
    from marginalia.functions.text import strip
    q = strip(F.left("text", F.lit(120)))
    return documents(spark, d).select(F.col("doc_id").alias("request_id"), "doc_id", q.alias("query")).where("query <> ''")


@query("rt5_scoped_retrieval", PAPER_WITH + VERSIONED + ASK + " SELECT request_id, doc_id, parser, chunk_id, rank, overlap, total, phrase FROM rbest")
def _(spark, d):
    hits = R.retrieve_scoped(_requests(spark, d), _versioned(spark, d), 3)
    return hits.select("request_id", "doc_id", "parser", "chunk_id", "rank", "overlap", "total", "phrase")


# A bundle asks a document, its two followers, itself again, and an id that does not exist, for the words of the first.
BUNDLE_SQL = PAPER_WITH + VERSIONED + ASK + """,
  mreq AS (SELECT request_id, unnest([doc_id, doc_id + 1, doc_id, doc_id + 7, -1 - doc_id]) AS want, unnest([0, 1, 2, 3, 4]) AS p FROM req),
  fm AS (SELECT request_id, want, min(p) AS p FROM mreq GROUP BY 1, 2),
  found AS (SELECT DISTINCT f.request_id, f.want, v.parser, v.chunk_id FROM fm f JOIN vt v ON v.doc_id = f.want JOIN rt ON rt.request_id = f.request_id AND rt.token = v.token),
  nm AS (SELECT request_id, want, CAST(sum(c) AS BIGINT) AS chunks FROM (SELECT request_id, want, parser, least(count(*), 3) AS c FROM found GROUP BY 1, 2, 3) GROUP BY 1, 2),
  jm AS (SELECT f.*, d.doc_id IS NOT NULL AS success, coalesce(n.chunks, 0) AS chunks FROM fm f LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = f.want LEFT JOIN nm n ON n.request_id = f.request_id AND n.want = f.want)
  SELECT request_id, CAST(want AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY request_id ORDER BY p) AS position, success, chunks,
    CASE WHEN bool_and(success) OVER (PARTITION BY request_id) THEN 'success' WHEN bool_or(success) OVER (PARTITION BY request_id) THEN 'partial' ELSE 'error' END AS status FROM jm"""


@query("rt6_multi_document", BUNDLE_SQL)
def _(spark, d):
    i = F.col("doc_id")
    wanted = _requests(spark, d).select("request_id", "query", F.array(i, i + 1, i, i + 7, -1 - i).alias("ids"))
    each = wanted.select("request_id", "query", F.explode(F.array_distinct("ids")).alias("doc_id"))
    hits = R.retrieve_scoped(each, _versioned(spark, d), 3)
    req = wanted.select("request_id", F.transform("ids", lambda x: x.cast("string")).alias("doc_ids"))
    return R.multi_document(req, hits, documents(spark, d).select("doc_id"))


READ_SQL = PAPER_WITH + VERSIONED + """,
  u AS (SELECT DISTINCT doc_id, parser, cache_version, chunk_id, txt, section FROM vchunk),
  rd AS (SELECT concat(doc_id, '/', chunk_id) AS request_id, doc_id, parser, section, txt,
      CASE WHEN doc_id % 10 = 1 THEN concat('sha256:', repeat('0', 64)) ELSE cache_version END AS cache_version,
      CASE WHEN doc_id % 10 = 2 THEN concat('c_', repeat('0', 64)) WHEN doc_id % 10 = 3 THEN 'bad' ELSE chunk_id END AS chunk_id,
      CASE WHEN doc_id % 10 = 4 THEN -1 WHEN doc_id % 10 = 5 THEN 5000 WHEN doc_id % 10 = 6 THEN 0 ELSE 100 END AS off,
      CASE WHEN doc_id % 10 = 7 THEN 9000 ELSE 500 END AS mx FROM u)
  SELECT request_id, CASE WHEN doc_id % 10 = 3 THEN 'invalid_reference' WHEN doc_id % 10 = 7 THEN 'invalid_max_chars' WHEN doc_id % 10 = 4 THEN 'invalid_offset'
      WHEN doc_id % 10 = 1 THEN 'stale_evidence_reference' WHEN doc_id % 10 = 2 THEN 'evidence_not_found' WHEN off >= length(txt) THEN 'offset_outside_chunk' END AS error,
    CASE WHEN doc_id % 10 IN (0, 5, 6, 8, 9) AND off < length(txt) THEN sha256(substring(txt, off + 1, mx)) END AS text_hash,
    CASE WHEN doc_id % 10 IN (0, 5, 6, 8, 9) AND off < length(txt) AND off + mx < length(txt) THEN CAST(off + mx AS BIGINT) END AS next_offset,
    CASE WHEN doc_id % 10 IN (0, 5, 6, 8, 9) AND off < length(txt) THEN length(txt) END AS total_chars FROM rd"""


def _read_requests(c):
    i, zero = F.col("doc_id") % 10, "0" * 64
    return c.select("doc_id", "parser", "cache_version", "chunk_id").distinct().select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), "chunk_id").alias("request_id"), "doc_id", "parser",
        F.when(i == 1, f"sha256:{zero}").otherwise(F.col("cache_version")).alias("cache_version"),
        F.when(i == 2, f"c_{zero}").when(i == 3, "bad").otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(i == 4, -1).when(i == 5, 5000).when(i == 6, 0).otherwise(100).alias("offset"), F.when(i == 7, 9000).otherwise(500).alias("max_chars"))


@query("rt8_read_back", READ_SQL)
def _(spark, d):
    c = _versioned(spark, d)
    r = E.read_back(_read_requests(c), c)
    return r.select("request_id", "error", F.sha2("text", 256).alias("text_hash"), "next_offset", "total_chars")


@query("jn9_referenced_chunks", READ_SQL[:READ_SQL.index("  SELECT request_id")] + """  SELECT request_id, sha256(CASE WHEN doc_id % 10 NOT IN (1, 2, 3) THEN txt END) AS text_hash, CASE WHEN doc_id % 10 NOT IN (1, 2, 3) THEN section END AS section FROM rd""")
def _(spark, d):
    c = _versioned(spark, d)
    r = E.referenced_chunks(_read_requests(c), c)
    return r.select("request_id", F.sha2("chunk.text", 256).alias("text_hash"), "chunk.section")


# Evidence of a source's documents, in order, with copies: equal text counts as equal when unversioned.
@query("rt9_unique_evidence", f"""{with_views(extra=DOC_CHUNKS)}, e AS (SELECT d.source, c.doc_id, c.txt, c.idx, d.doc_id * 1000 + c.idx AS pos FROM chunk c JOIN documents d USING (doc_id))
   SELECT source, min(pos) AS pos, sha256(txt) AS text_hash FROM e GROUP BY source, txt""")
def _(spark, d):
    docs = documents(spark, d)
    c = C.build_chunks(docs.select("doc_id", "source", F.lit("document").alias("section"), "text"), ["doc_id", "source", "section"], "text")
    none = F.lit(None).cast("string")
    rows = c.select("source", F.lit("p").alias("doc_id"), none.alias("parser"), none.alias("cache_version"), none.alias("chunk_id"), "section", "text",
                    (F.col("doc_id") * 1000 + F.col("idx")).alias("pos"))
    return E.unique_evidence(rows, "source").select("source", "pos", F.sha2("text", 256).alias("text_hash"))


def _rungs_sql(cap: int) -> str:
    rows = ", ".join(f"({n + 1}, {i}, {c})" for n, (i, c) in enumerate(E.LADDER))
    return f"""ladder(rung, items, chars) AS (VALUES {rows}),
      sized AS MATERIALIZED (SELECT request_id, l.rung, 400 + 120 * count(DISTINCT doc_id) + sum(CASE WHEN item_no <= l.items THEN 260 + least(length(txt), l.chars) ELSE 0 END) AS size
          FROM items, ladder l GROUP BY 1, 2),
      pick AS (SELECT request_id, coalesce(min(rung) FILTER (size <= {cap}), 0) AS rung FROM sized GROUP BY 1),
      caps AS (SELECT request_id, rung, coalesce(l.items, 0) AS items, coalesce(l.chars, 0) AS chars FROM pick LEFT JOIN ladder l USING (rung))"""


# A bundle per group of six neighbouring documents: all their chunks.
ITEMS = f"""{with_views(extra=DOC_CHUNKS)}, items AS MATERIALIZED (SELECT CAST(floor(doc_id / 6) AS BIGINT) AS request_id, doc_id, idx + 1 AS item_no, txt FROM chunk), """


def _items(spark, d):
    c = C.chunk_documents(documents(spark, d))
    return c.select(F.floor(F.col("doc_id") / 6).cast("bigint").alias("request_id"), "doc_id", (F.col("idx") + 1).alias("item_no"), "text")


@query("rt10_capped_bundles", ITEMS + _rungs_sql(12000) + """ SELECT k.request_id, CAST(k.rung AS BIGINT) AS rung, i.doc_id, CAST(sum(CASE WHEN i.item_no <= k.items THEN 1 ELSE 0 END) AS BIGINT) AS shown,
      count(*) AS chunks, CAST(sum(CASE WHEN i.item_no <= k.items THEN least(length(txt), k.chars) ELSE 0 END) AS BIGINT) AS shown_chars FROM items i JOIN caps k USING (request_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = materialize(_items(spark, d), "bundle-items")
    caps = E.cap_bundles(rows, 12000)
    shown = E.project_bundles(rows, caps)
    chars = shown.groupBy("request_id", "doc_id").agg(F.sum(F.length("text").cast("bigint")).alias("shown_chars"))
    cov = E.coverage(rows, shown)
    zero = F.lit(0).cast("bigint")
    return cov.join(chars, ["request_id", "doc_id"], "left").join(caps.select("request_id", "rung"), "request_id").select(
        "request_id", "rung", "doc_id", "shown", "chunks", F.coalesce("shown_chars", zero).alias("shown_chars"))


# The same bundles as JSON under three caps, with every document of the group and its text as a note.  The oracle builds the whole
# text of every rung and takes the first that fits.
ENCODED_SQL = ITEMS + """
  ask AS (SELECT CAST(floor(doc_id / 6) AS BIGINT) AS request_id, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'error' ELSE 'success' END AS status, text AS note FROM documents),
  ladder(rung, items, chars) AS (VALUES (1, 8, 2000), (2, 8, 1000), (3, 8, 500), (4, 8, 250), (5, 4, 2000), (6, 4, 1000), (7, 4, 500), (8, 4, 250), (9, 2, 2000), (10, 2, 1000), (11, 2, 500), (12, 2, 250),
    (13, 1, 2000), (14, 1, 1000), (15, 1, 500), (16, 1, 250), (17, 1, 100), (18, 1, 32), (19, 0, 2000), (20, 0, 1000), (21, 0, 500), (22, 0, 250), (23, 0, 100), (24, 0, 32)),
  many AS (SELECT doc_id, count(*) AS n FROM items GROUP BY 1),
  cj AS (SELECT doc_id, rung, string_agg(concat('{"chunk_id":"k', item_no, '","text":', CAST(to_json(substring(txt, 1, chars)) AS VARCHAR), CASE WHEN length(txt) > chars THEN concat(',"text_truncated":true,"next_offset":', chars) ELSE '' END, '}'), ',' ORDER BY item_no) AS cs,
      count(*) AS shown, bool_or(length(txt) > chars) AS cut FROM items JOIN ladder ON item_no <= ladder.items GROUP BY 1, 2),
  dj AS (SELECT a.*, rung, coalesce(n, 0) AS n, coalesce(cs, '') AS cs, coalesce(shown, 0) AS shown, coalesce(cut, false) AS cut, least(chars, 500) AS w, coalesce(length(note) > least(chars, 500), false) AS ncut
      FROM ask a CROSS JOIN ladder LEFT JOIN many USING (doc_id) LEFT JOIN cj USING (doc_id, rung)),
  dk AS (SELECT *, (n > shown OR cut OR ncut) AS om FROM dj),
  papers AS (SELECT request_id, rung, bool_or(om) AS om, CASE WHEN bool_and(status = 'success') THEN 'success' WHEN bool_or(status = 'success') THEN 'partial' ELSE 'error' END AS state,
      string_agg(concat('{"paper_id":"', doc_id, '","status":"', status, '","note":', coalesce(CAST(to_json(substring(note, 1, w)) AS VARCHAR), 'null'), ',"note_truncated":', ncut, ',"chunks":[', cs, '],"omitted_chunks":', n - shown,
        ',"omitted_chunk_range":', CASE WHEN n > shown THEN concat('[', shown, ',', n, ']') ELSE 'null' END,
        ',"coverage":"', CASE WHEN shown = 0 THEN 'none' WHEN n > shown OR cut THEN 'partial' ELSE 'complete_returned_chunks' END, '","omitted":', om, '}'), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS body,
      string_agg(concat('{"paper_id":"', doc_id, '","status":"', status, '","omitted":true,"coverage":"none"}'), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS facts FROM dk GROUP BY 1, 2),
  full_text AS (SELECT request_id, rung, concat('{"status":"', state, '","papers":[', body, '],"omitted":', om, ',"readback":{"tool":"read_paper_chunk","arguments":["paper_id","parser","cache_version","chunk_id"],"optional":["offset","max_chars"]}}') AS j FROM papers
    UNION ALL SELECT request_id, 99, concat('{"status":"', state, '","papers":[', facts, '],"omitted":true,"readback":{"tool":"read_paper_chunk","arguments":["paper_id","parser","cache_version","chunk_id"],"optional":["offset","max_chars"]},"note":"Evidence omitted by total result budget; do not claim it was read."}') FROM papers WHERE rung = 1),
  best AS (SELECT CASE request_id % 3 WHEN 0 THEN 12000 WHEN 1 THEN 4096 ELSE 1100 END AS cap, request_id, min(rung) AS rung FROM full_text WHERE length(j) <= cap GROUP BY 1, 2)
  SELECT CAST(cap AS BIGINT) AS cap, request_id, CAST(CASE rung WHEN 99 THEN 0 ELSE rung END AS BIGINT) AS rung, length(j) AS size, sha256(j) AS encoded_hash FROM best JOIN full_text USING (request_id, rung)"""


@query("rt10_encoded_bundles", ENCODED_SQL)
def _(spark, d):
    rows = materialize(_items(spark, d).withColumn("chunk_id", F.concat(F.lit("k"), F.col("item_no").cast("string"))), "bundle-items")
    i = F.col("doc_id")
    asked = documents(spark, d).select(F.floor(i / 6).cast("bigint").alias("request_id"), "doc_id", F.when(i % 10 == 3, "error").otherwise("success").alias("status"), F.col("text").alias("note"))
    cap = F.when(F.col("request_id") % 3 == 0, 12000).when(F.col("request_id") % 3 == 1, 4096).otherwise(1100)
    best = B.encode_bundles(rows, cap, asked).where("rung >= 0")
    return best.select(cap.cast("bigint").alias("cap"), "request_id", "rung", "size", F.sha2("encoded", 256).alias("encoded_hash"))

"""Intake, sources and sinks (IN-1 .. IN-12, SK-2 .. SK-4, JN-1, SE-4, SE-5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marginalia.operators import chunks as C
from marginalia.operators import sessions as S
from marginalia.plans.base import documents, query, sql_collapse, sql_strip, table, with_views
from marginalia.plans.search import DOC_CHUNKS
from marginalia.scale import shared_folder
from marginalia.sources import files as I
from marginalia.sources import markup as M
from marginalia.sources import sinks as K


def _ident(spark, d):
    return I.content_identity(documents(spark, d))


@query("in1_content_hash", "SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM documents")
def _(spark, d):
    return _ident(spark, d)


# Labelled documents were registered before; the whole table arrives.
REG = "reg AS (SELECT sha256(text) AS content_hash, min(doc_id) AS paper_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"


def _registry(spark, d):
    known = _ident(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return known.groupBy("content_hash").agg(F.min("doc_id").alias("paper_id"))


_canon = """SELECT a.doc_id, a.content_hash, coalesce(r.paper_id, min(a.doc_id) OVER (PARTITION BY a.content_hash)) AS paper_id,
   r.paper_id IS NOT NULL OR a.doc_id <> min(a.doc_id) OVER (PARTITION BY a.content_hash) AS reused FROM arr a LEFT JOIN reg r USING (content_hash)"""


@query("in2_canonical_ids", f"WITH {REG}, arr AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) {_canon}")
def _(spark, d):
    return I.canonical_ids(_ident(spark, d), _registry(spark, d))


@query("in3_stale_identities", f"""WITH reg AS (SELECT * FROM (SELECT sha256(text) AS content_hash, min(doc_id) AS paper_id FROM documents GROUP BY 1) WHERE paper_id IN (SELECT doc_id FROM labels)),
   arr AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) {_canon}""")
def _(spark, d):
    """Every text is registered, but only files of labelled documents still exist."""
    ident = _ident(spark, d)
    registry = ident.groupBy("content_hash").agg(F.min("doc_id").alias("paper_id"))
    return I.canonical_ids(ident, I.live_registry(registry, table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))))


@query("jn1_hash_join", f"WITH {REG} SELECT d.doc_id, r.paper_id AS registered_id FROM documents d LEFT JOIN reg r ON r.content_hash = sha256(d.text)")
def _(spark, d):
    known = _registry(spark, d).select("content_hash", F.col("paper_id").alias("registered_id"))
    return _ident(spark, d).join(known, "content_hash", "left").select("doc_id", "registered_id")


@query("in4_import_papers", """WITH l AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS paper_id, concat('/store/', md5(CAST(doc_id AS VARCHAR)), '_', source, '.pdf') AS path, sha256(text) AS h, doc_id, source FROM documents),
   reg AS (SELECT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), rid AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS paper_id FROM labels)
   SELECT arg_min(paper_id, path) AS paper_id, h AS content_hash, arg_min(concat(source, '.pdf'), path) AS filename FROM l WHERE h NOT IN (SELECT h FROM reg) AND paper_id NOT IN (SELECT paper_id FROM rid) GROUP BY h""")
def _(spark, d):
    i = documents(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("h"), F.md5(F.col("doc_id").cast("string")).alias("paper_id"))
    path = F.concat(F.lit("/store/"), "paper_id", F.lit("_"), "source", F.lit(".pdf"))
    # Even documents have their hash in the legacy index, the others must be hashed.
    listing = i.select("paper_id", path.alias("path"), F.when(F.col("doc_id") % 2 == 1, F.col("h")).alias("file_hash"))
    entry = F.create_map("h", F.struct("paper_id", F.concat("source", F.lit(".pdf")).alias("filename")))
    index = i.where("doc_id % 2 = 0").select(F.to_json(F.struct(entry.alias("by_hash"))).alias("json"))
    known = i.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("paper_id", F.col("h").alias("content_hash"))
    return I.import_papers(listing, index, known).select("paper_id", "content_hash", "filename")


def _session_json(spark, d):
    """One chat file per turn of a conversation; the same session appears in several files."""
    c = table(spark, d, "conversations")
    s = lambda x: x.cast("string")
    active = F.array(F.concat(F.lit("p"), s(F.col("turn") % 3)), F.concat(F.lit(" p"), s(F.col("conv_id") % 5), F.lit(" ")), F.lit(""))
    paper = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p"), s(F.col("turn"))))
    j = F.to_json(F.struct(F.concat(F.lit("s"), s(F.col("conv_id"))).alias("session_id"), paper.alias("paper_id"), active.alias("active_paper_ids"), F.lit("2024-01-01").alias("updated_at"),
                           F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    broken = (F.col("conv_id") + F.col("turn")) % 7 == 3
    return c.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(broken, F.left(j, F.length(j) - 2)).otherwise(j).alias("json"))


@query("in5_session_links", """WITH f AS (SELECT * FROM conversations WHERE (conv_id + turn) % 7 <> 3), l AS (SELECT conv_id, concat('p', turn % 3) AS p FROM f UNION ALL SELECT conv_id, concat('p', conv_id % 5) FROM f UNION ALL SELECT conv_id, concat('p', turn) FROM f WHERE turn % 2 = 0)
   SELECT DISTINCT concat('s', conv_id) AS session_id, p AS paper_id FROM l WHERE NOT (conv_id % 4 = 0 AND p = 'p0')""")
def _(spark, d):
    none = table(spark, d, "conversations").where("conv_id % 4 = 0").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("p0").alias("paper_id")).distinct()
    return I.import_sessions(_session_json(spark, d), none.select("session_id").distinct(), none)[1]


@query("in5_session_headers", """WITH f AS (SELECT * FROM conversations WHERE (conv_id + turn) % 7 <> 3 AND conv_id % 4 <> 0)
   SELECT concat('s', conv_id) AS session_id, CASE WHEN min(turn) % 2 = 0 THEN concat('p', min(turn)) END AS current_paper_id FROM f GROUP BY conv_id""")
def _(spark, d):
    have = table(spark, d, "conversations").where("conv_id % 4 = 0").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id")).distinct()
    return I.import_sessions(_session_json(spark, d), have, have.withColumn("paper_id", F.lit("")))[0].select("session_id", "current_paper_id")


@query("in6_tolerant_sessions", """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'corrupt' WHEN conv_id % 6 = 5 THEN 'wrong_session' ELSE 'ok' END AS status FROM conversations""")
def _(spark, d):
    name = F.when(F.col("conv_id") % 6 == 5, F.lit("other")).otherwise(F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    p = I.parse_sessions(_session_json(spark, d).withColumn("file_session", name), expected="file_session")
    return p.select("conv_id", "turn", "status")


@query("in7_requested_pages", f"""WITH h AS (SELECT doc_id, text, CAST(floor(n_chars / 2) AS BIGINT) AS w FROM documents),
   p AS (SELECT doc_id, 1 AS page, CASE WHEN doc_id % 4 = 0 THEN 'again' ELSE {sql_strip('substring(text, 1, w)')} END AS t FROM h UNION ALL SELECT doc_id, 2, {sql_strip('substring(text, w + 1)')} FROM h),
   q AS (SELECT doc_id, unnest([2, 1, 9]) AS page FROM documents)
   SELECT q.doc_id, CAST(q.page AS BIGINT) AS page, sha256(coalesce(t, '')) AS text_hash, t IS NOT NULL AS found FROM q LEFT JOIN p USING (doc_id, page)""")
def _(spark, d):
    w = F.floor(F.col("n_chars") / 2).cast("int")
    raw = F.concat(F.lit("--- Page 1 ---\n"), F.left("text", w), F.lit("\n--- Page 2 ---  \n"), F.substr("text", w + 1), F.when(F.col("doc_id") % 4 == 0, "\n--- Page 1 ---\nagain").otherwise(""))
    docs = documents(spark, d).select("doc_id", raw.alias("raw_text"))
    r = I.requested_pages(docs, F.array(F.lit(2), F.lit(1), F.lit(2), F.lit(9)))
    return r.select("doc_id", "page", F.sha2("text", 256).alias("text_hash"), "found")


def _xml_text(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("in8_tei_headers", f"""SELECT doc_id, {sql_collapse('source')} AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ann B. Lee|Bo Li' ELSE 'Ann B. Lee' END AS authors, concat('kw', doc_id % 5, '|common') AS keywords,
   {sql_collapse('text')} AS abstract, CAST(2 AS BIGINT) AS n_sections, concat('Ref ', doc_id, '/2001') AS reference FROM documents""")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    person = lambda fs, s: "<author><persName>" + "".join(f"<forename>{f}</forename>" for f in fs) + f"<surname>{s}</surname></persName></author>"
    ann, bo = person(["Ann", "B."], "Lee"), person(["Bo"], "Li")
    t = _xml_text(F.col("text"))
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), "source", F.lit(f"</title>{ann}</titleStmt><sourceDesc><biblStruct><analytic>{ann}"),
        F.when(F.col("doc_id") % 3 == 0, bo).otherwise(""), F.lit("</analytic></biblStruct></sourceDesc></fileDesc><profileDesc><textClass><keywords><term>kw"), (F.col("doc_id") % 5).cast("string"),
        F.lit("</term><term>common</term><term> common </term></keywords></textClass><abstract><p>"), t, F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>Intro</head><p>"),
        t, F.lit("</p><p>more</p></div><div><p>untitled</p></div><div></div></body><back><listBibl><biblStruct><analytic><title>Ref "), i,
        F.lit('</title></analytic><monogr><imprint><date when="2001-05"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>'))
    p = M.parse_tei(documents(spark, d).select("doc_id", xml.alias("xml")))
    ref = F.col("references")[0]
    return p.select("doc_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), "abstract",
                    F.size("sections").cast("bigint").alias("n_sections"), F.concat(ref["title"], F.lit("/"), ref["year"]).alias("reference"))


def _payloads(spark, d):
    i = F.col("doc_id")
    docs = documents(spark, d).select("doc_id", F.col("text").alias("title"), F.col("text").alias("body"))
    year = (1990 + i % 30).cast("int")
    parts = lambda y: F.struct(F.array(F.array(y, F.lit(3))).alias("date-parts"))
    cross = F.to_json(F.struct(
        F.array("title").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family")), F.struct(F.lit("").alias("given"), F.lit("Group").alias("family"))).alias("author"),
        F.array(F.lit("Journal &amp; Co")).alias("container-title"), F.concat(F.lit("<jats:p>"), "body", F.lit("</jats:p>")).alias("abstract"), F.concat(F.lit("10.1/"), i.cast("string")).alias("DOI"),
        F.when(i % 3 == 0, parts(year)).alias("published-print"), F.when(i % 3 != 2, parts(year + 1)).alias("published-online"), parts(year + 2).alias("issued")))
    alex = F.to_json(F.struct(
        F.col("title").alias("title"), F.array(F.struct(F.struct(F.lit("Ann Lee").alias("display_name")).alias("author")), F.struct(F.struct(F.lit(None).cast("string").alias("display_name")).alias("author"))).alias("authorships"),
        year.alias("publication_year"), F.when(i % 2 == 0, F.struct(F.struct(F.lit("Venue A").alias("display_name")).alias("source"))).alias("primary_location"),
        F.struct(F.lit("Host B").alias("display_name")).alias("host_venue"), F.col("m").alias("abstract_inverted_index"), F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), F.lit("W1").alias("id")))
    atom = F.concat(F.lit("<entry><id>http://arxiv.org/abs/2401.0"), (1000 + i % 9000).cast("string"), F.lit("</id><published>"), year.cast("string"), F.lit("-01-02T00:00:00Z</published><title>"), _xml_text(F.col("title")),
                    F.lit("</title><summary>"), _xml_text(F.col("body")), F.lit("</summary><author><name>Ann Lee</name></author><author><name>Bo Li</name></author></entry>"))
    pos = lambda n: F.lit(n).alias("pos")
    return (docs.select("doc_id", pos(1), cross.alias("json")), M.word_index(docs, "body").select("doc_id", pos(2), alex.alias("json")), docs.select("doc_id", pos(3), atom.alias("xml")))


_tag = lambda x: sql_collapse(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
CANDS = f"""WITH b AS (SELECT doc_id, text AS t, text AS body, 1990 + doc_id % 30 AS y FROM documents),
   c AS (SELECT doc_id, 'crossref' AS provider, {_tag('t')} AS title, 'Ann Lee|Group' AS authors, CAST(CASE doc_id % 3 WHEN 0 THEN y WHEN 1 THEN y + 1 ELSE y + 2 END AS VARCHAR) AS year, 'Journal & Co' AS venue, {_tag('body')} AS abstract, concat('10.1/', doc_id) AS doi FROM b
     UNION ALL SELECT doc_id, 'openalex', {_tag('t')}, 'Ann Lee', CAST(y AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'Venue A' ELSE 'Host B' END, trim(regexp_replace(body, '\\s+', ' ', 'g')), concat('10.1/', doc_id) FROM b
     UNION ALL SELECT doc_id, 'arxiv', {_tag('t')}, 'Ann Lee|Bo Li', CAST(y AS VARCHAR), 'arXiv', {_tag('body')}, '' FROM b)"""


def _all(spark, d):
    a, b, c = _payloads(spark, d)
    return M.all_candidates(M.crossref(a), M.openalex(b), M.arxiv(c))


@query("in10_provider_candidates", CANDS + " SELECT * FROM c")
def _(spark, d):
    return _all(spark, d).select("doc_id", "provider", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "abstract", "doi")


@query("se5_candidate_union", CANDS + " SELECT provider, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM c GROUP BY provider")
def _(spark, d):
    return _all(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.sum(F.length("title").cast("bigint")).alias("title_chars"))


@query("in11_rebuilt_abstracts", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_hash FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def _(spark, d):
    """Inverted indexes are built from whole texts (one map per document), then turned back."""
    index = M.word_index(documents(spark, d).select("doc_id", "text")).where(F.size("m") > 0)
    return index.select("doc_id", F.sha2(M.abstract_from_index(F.col("m")), 256).alias("text_hash"))


@query("in12_parse_worklist", """WITH w AS (SELECT doc_id, unnest(['grobid', 'pymupdf']) AS parser FROM documents),
   c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'grobid' ELSE 'pymupdf' END AS parser FROM labels WHERE toxic = 0 AND NOT (quality = 0 AND doc_id % 5 = 0))
   SELECT w.doc_id AS paper_id, w.parser FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.parser = w.parser WHERE c.doc_id IS NULL""")
def _(spark, d):
    """Labels stand in for cached parses: the quality tells the parser, toxic marks a broken payload."""
    wanted = documents(spark, d).select(F.col("doc_id").alias("paper_id"), F.explode(F.array(F.lit("grobid"), F.lit("pymupdf"))).alias("parser"))
    parser = F.when(F.col("quality") == 1, "grobid").otherwise("pymupdf")
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), parser.alias("parser"),
                                             F.when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), "grobid").otherwise(parser).alias("payload_parser"), (F.col("toxic") == 0).alias("valid"))
    return I.parse_worklist(wanted, cache)


def _notes(spark, d):
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    lists = F.when(i % 4 == 0, none).otherwise(F.array("source", "lang"))
    rec = documents(spark, d).select(
        "doc_id", F.trim(F.regexp_replace("source", "\\s+", " ")).alias("title"), F.when(i % 2 == 0, F.array(F.lit("Ann Lee"), F.lit("Bo Li"))).otherwise(none).alias("authors"),
        F.when(i % 3 == 0, "").otherwise((1990 + i % 30).cast("string")).alias("year"), F.lit(None).cast("string").alias("venue"), F.col("text").alias("abstract"),
        F.lit("").alias("problem"), F.col("source").alias("motivation"), F.col("lang").alias("method_summary"), F.lit(None).cast("string").alias("experiment_summary"),
        lists.alias("innovation_points"), lists.alias("limitations"), none.alias("inspirations"))
    return K.note(rec)


_known = lambda x: f"CASE WHEN {x} = '' THEN '暂无' ELSE {x} END"
NOTE_SQL = f"""WITH r AS (SELECT doc_id, CASE WHEN {sql_collapse('source')} = '' THEN '未知' ELSE {sql_collapse('source')} END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Ann Lee、Bo Li' ELSE '未知' END AS a,
     CASE WHEN doc_id % 3 = 0 THEN '未知' ELSE CAST(1990 + doc_id % 30 AS VARCHAR) END AS y, {_known('text')} AS text, lang, source,
     CASE WHEN doc_id % 4 = 0 THEN '- 暂无' ELSE concat('- ', source, chr(10), '- ', lang) END AS l FROM documents)
   SELECT doc_id, sha256(replace(concat('# 论文精读笔记~~## 1. 基本信息~~- 标题：', title, '~- 作者：', a, '~- 年份：', y, '~- 会议/期刊：未知~~### 摘要~~', replace(text, '~', chr(1)), '~~## 2. 论文解决的问题~~暂无~~## 3. 背景与动机~~', source,
     '~~## 4. 核心方法~~', lang, '~~## 5. 创新点总结~~', l, '~~## 6. 实验设计与结果~~暂无~~## 7. 方法优点~~', lang, '~~## 8. 方法局限~~', l, '~~## 9. 对我研究的启发~~- 暂无~'), '~', chr(10))) AS note_hash FROM r"""


@query("sk2_notes", NOTE_SQL)
def _(spark, d):
    return _notes(spark, d).select("doc_id", F.sha2("note", 256).alias("note_hash"))


@query("sk3_index_round_trip", with_views(extra=DOC_CHUNKS) + "SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(txt)) AS BIGINT) AS n_chars FROM chunk WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def _(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/marginalia/index-{uuid.uuid4().hex}"
    K.save_index(C.chunk_documents(documents(spark, d)), path)
    back = K.load_index(spark, path, table(spark, d, "labels").select("doc_id"))
    return back.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


@query("sk4_cascade_delete", """WITH dead AS (SELECT doc_id FROM labels WHERE toxic = 1)
   SELECT doc_id, 'documents' AS table_name, count(*) AS deleted_rows FROM documents WHERE doc_id IN (SELECT doc_id FROM dead) GROUP BY 1
   UNION ALL SELECT doc_id, 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM dead) GROUP BY 1
   UNION ALL SELECT -1, 'documents_kept', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dead)""")
def _(spark, d):
    docs, labels = documents(spark, d).select("doc_id"), table(spark, d, "labels")
    kept, counts = K.cascade_delete(labels.where("toxic = 1"), {"documents": docs, "labels": labels})
    left = kept["documents"].agg(F.count("*").alias("deleted_rows")).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit("documents_kept").alias("table_name"), "deleted_rows")
    return counts.select("doc_id", "table_name", "deleted_rows").unionByName(left)


@query("se4_insert_or_ignore", """SELECT source, lang, min(doc_id) AS doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE l.toxic = 1 AND x.source = d.source AND x.lang = d.lang) GROUP BY 1, 2""")
def _(spark, d):
    docs = documents(spark, d).select("doc_id", "source", "lang")
    have = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("source", "lang").distinct()
    return S.insert_or_ignore(have, docs, ["source", "lang"], ["doc_id"])

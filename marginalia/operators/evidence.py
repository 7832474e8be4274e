"""Versioned evidence, exact readback and size-capped bundles (RT-7 .. RT-10, JN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.operators.chunks import build_chunks
from marginalia.scale import first_rows

SEP = "\x1f"

# The ladder of (items, text characters), tried in this order.
LADDER = [(items, chars) for items in (8, 4, 2, 1, 0) for chars in ((2000, 1000, 500, 250) if items > 1 else (2000, 1000, 500, 250, 100, 32))]
DOC_BASE, CHUNK_BASE, ENVELOPE = 120, 260, 400


def section_sources(wide: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """Per document the ordered sections to cut: non-empty rule sections, else the whole text as 'document'."""
    pairs = F.array(*[F.struct(F.lit(k).alias("section"), F.col(k).alias("content")) for k in K.SECTION_KEYS])
    found = F.filter(pairs, lambda p: p["content"] != "")
    whole = F.array(F.struct(F.lit("document").alias("section"), F.col(text_col).alias("content")))
    return wide.withColumn("sections", F.when(F.size(found) > 0, found).otherwise(whole))


def with_version(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """RT-7: cache_version over everything that shapes the chunks, in one canonical form.

    Needs columns parser and sections (from ``section_sources``)."""
    named = F.array_join(F.transform("sections", lambda s: F.concat(s["section"], F.lit("\x1e"), s["content"])), SEP)
    ident = F.concat_ws(SEP, F.lit("1"), F.col(id_col).cast("string"), "parser", text_col, named, F.lit(str(size)), F.lit(str(overlap)))
    return docs.withColumn("cache_version", F.concat(F.lit("sha256:"), F.sha2(ident, 256)))


def versioned_chunks(docs: DataFrame, id_col: str = "doc_id", size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """RT-7: chunks with content-derived ids; ``docs`` comes from ``with_version``."""
    keys = [id_col, "parser", "cache_version", "section"]
    rows = docs.select(id_col, "parser", "cache_version", F.explode("sections").alias("s")).select(*keys[:3], "s.section", "s.content")
    c = build_chunks(rows, keys, "content", size, overlap)
    ident = F.concat_ws(SEP, "section", F.col("start_char").cast("string"), F.col("end_char").cast("string"), "text")
    return c.withColumn("chunk_id", F.concat(F.lit("c_"), F.sha2(ident, 256)))


REFERENCE = ["doc_id", "parser", "cache_version", "chunk_id"]


def referenced_chunks(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN-9: every reference (doc_id, parser, cache_version, chunk_id and further columns) with ``chunk``, the struct
    (section, start_char, end_char, text) it names, or null.

    Chunks nobody refers to leave first, so the texts of the others are exchanged at most once.  Rows of one
    reference in ``chunks`` are equal by construction; the first is taken.
    """
    asked = references.select(*REFERENCE).distinct()
    hit = chunks.join(asked, REFERENCE, "left_semi").groupBy(*REFERENCE).agg(F.min(F.struct("section", "start_char", "end_char", "text")).alias("chunk"))
    return references.join(hit, REFERENCE, "left")


def read_back(requests: DataFrame, chunks: DataFrame, limit: int = K.READ_CAP, versions: DataFrame | None = None) -> DataFrame:
    """RT-8: slice of a referenced chunk, or a distinct error.

    ``requests``: request_id, doc_id, parser, cache_version, chunk_id, offset, max_chars; ``versions``: the current
    (doc_id, parser, cache_version), by default all versions that ``chunks`` stores.
    """
    current = (chunks if versions is None else versions).select(*REFERENCE[:3]).distinct().withColumn("_now", F.lit(True))
    j = referenced_chunks(requests.join(current, REFERENCE[:3], "left"), chunks).withColumnRenamed("chunk", "_c")
    n = F.length("_c.text")
    error = (
        F.when(~T.valid_ref(F.col("doc_id").cast("string"), F.col("parser"), F.col("cache_version"), F.col("chunk_id")), "invalid_reference")
        .when(~F.coalesce(F.col("max_chars").between(1, limit), F.lit(False)), "invalid_max_chars")
        .when(~F.coalesce(F.col("offset") >= 0, F.lit(False)), "invalid_offset")
        .when(F.col("_now").isNull(), "stale_evidence_reference")
        .when(F.col("_c").isNull(), "evidence_not_found").when(F.col("offset") >= n, "offset_outside_chunk")
    )
    j = j.withColumn("error", error)
    good = F.col("error").isNull()
    end = F.least(F.col("offset") + F.col("max_chars"), n).cast("bigint")
    return j.select(
        "request_id", "error", F.when(good, F.col("_c.section")).alias("section"),
        F.when(good, F.substr(F.col("_c.text"), (F.col("offset") + 1).cast("int"), F.col("max_chars").cast("int"))).alias("text"),
        F.when(good & (end < n), end).alias("next_offset"), F.when(good, n.cast("bigint")).alias("total_chars"),
        F.when(good, (end < n) | (F.col("offset") > 0)).alias("omitted"))


def unique_evidence(rows: DataFrame, group: str, pos: str = "pos") -> DataFrame:
    """RT-9: first of equal evidence per group.  Versioned rows are equal by reference, others by their fields."""
    versioned = T.valid_ref(F.col("doc_id").cast("string"), F.col("parser"), F.col("cache_version"), F.col("chunk_id"))
    cols = lambda *cs: F.sha2(F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cs]), 256)
    key = F.when(versioned, F.concat(F.lit("v"), cols("doc_id", "parser", "cache_version", "chunk_id"))) \
        .otherwise(F.concat(F.lit("u"), cols("doc_id", "parser", "chunk_id", "section", "text")))
    keep = [c for c in rows.columns if c != group]
    r = rows.withColumn("_k", key).groupBy(group, "_k").agg(F.min_by(F.struct(*keep), pos).alias("r"))
    return r.select(group, "r.*")


def _rung_size(items: int, chars: int) -> Column:
    """Size formula: envelope + a base per document + a base and the shown text per chunk."""
    shown = F.when(F.col("item_no") <= items, CHUNK_BASE + F.least(F.col("_n"), F.lit(chars))).otherwise(0)
    return F.sum(shown)


def cap_bundles(rows: DataFrame, cap: int = K.RESULT_CAP) -> DataFrame:
    """RT-10: the first rung of the ladder whose size fits the cap, the same for every document of a request.

    ``rows``: request_id, doc_id, item_no (1-based within the document), text.  Sizes of all rungs are sums
    of one aggregation, so nothing is multiplied by the ladder.  Rung 0 means facts only.
    """
    r = rows.withColumn("_n", F.length("text"))
    g = r.groupBy("request_id").agg(F.count_distinct("doc_id").alias("docs"), *[_rung_size(i, c).alias(f"_s{n}") for n, (i, c) in enumerate(LADDER)])
    size = lambda n: F.lit(ENVELOPE) + F.col("docs") * DOC_BASE + F.col(f"_s{n}")
    first = F.coalesce(*[F.when(size(n) <= cap, F.lit(n + 1)) for n in range(len(LADDER))], F.lit(0))
    g = g.withColumn("rung", first)
    pick = lambda values: F.coalesce(*[F.when(F.col("rung") == n + 1, v) for n, v in enumerate(values)])
    zero = F.lit(0)
    return g.select("request_id", F.col("rung").cast("bigint").alias("rung"),
                    F.coalesce(pick([F.lit(i) for i, _ in LADDER]), zero).cast("bigint").alias("items"),
                    F.coalesce(pick([F.lit(c) for _, c in LADDER]), zero).cast("bigint").alias("chars"),
                    F.coalesce(pick([size(n) for n in range(len(LADDER))]), F.lit(ENVELOPE) + F.col("docs") * DOC_BASE).cast("bigint").alias("size"))


def project_bundles(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """RT-10: shown evidence with truncation marks and where to read on."""
    j = rows.join(caps, "request_id").where(F.col("item_no") <= F.col("items"))
    cut = F.length("text") > F.col("chars")
    return j.select("request_id", "doc_id", "item_no", *[c for c in ("chunk_id",) if c in rows.columns],
                    F.left("text", F.col("chars").cast("int")).alias("text"), cut.alias("truncated"), F.when(cut, F.col("chars")).alias("next_offset"))


def coverage(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """RT-10: per document, what the bundle covers and how many chunks it leaves out."""
    all_ = rows.groupBy("request_id", "doc_id").agg(F.count("*").alias("chunks"))
    part = shown.groupBy("request_id", "doc_id").agg(F.count("*").alias("shown"), F.bool_or("truncated").alias("cut"))
    j = all_.join(part, ["request_id", "doc_id"], "left").withColumn("shown", F.coalesce("shown", F.lit(0).cast("bigint")))
    state = F.when(F.col("shown") == 0, "none").when((F.col("shown") < F.col("chunks")) | F.col("cut"), "partial").otherwise("complete_returned_chunks")
    return j.select("request_id", "doc_id", "chunks", "shown", (F.col("chunks") - F.col("shown")).alias("omitted_chunks"), state.alias("coverage"))


def shrink(text: Column, offset: Column, limit: int = 256) -> Column:
    """RT-10, overflow only: text cut to 256 characters, with the offset to read on."""
    cut = F.length(text) > limit
    return F.struct(F.left(text, F.lit(limit)).alias("text"), F.when(cut, offset + limit).alias("next_offset"), cut.alias("truncated"))


def number_items(rows: DataFrame, order: list[Column], k: int = K.MAX_TOP_K) -> DataFrame:
    """item_no within each (request, document), first k."""
    return first_rows(rows, ["request_id", "doc_id"], order, k, "item_no")

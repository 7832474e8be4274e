"""AG-4: one bounded summary per parsed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a preview.
SECTION_PREVIEW, REFERENCE_PREVIEW = 1200, 800


def _with(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The named columns with their types, null where the frame does not have them."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _listed(rows: DataFrame, preview: int, fields: list[Column], name: str) -> DataFrame:
    """Per document its rows in order of pos, each with the head of its text; texts are cut before the exchange."""
    text = F.coalesce("text", F.lit(""))
    entry = F.struct(F.col("pos"), *fields, F.left(text, F.lit(preview)).alias("preview"), (F.length(text) > preview).alias("truncated"))
    return rows.where("doc_id IS NOT NULL").select("doc_id", entry.alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias(name))


def document_summaries(docs: DataFrame, sections: DataFrame, references: DataFrame) -> DataFrame:
    """Summary of every document of ``docs``: counts, section and reference previews, warnings and missing fields.

    ``docs``: doc_id and as far as known parser, cached, title, authors, abstract, page_count, warnings; ``sections``:
    doc_id, pos, text, title, level, page_start, page_end, source; ``references``: doc_id, pos, text, title, authors,
    year.  Columns that are not there are null.  A preview has the first 1,200 characters of a section or 800 of a
    reference and says whether the text goes on.  ``missing_fields`` names title, authors, abstract and sections that
    are null or empty, in this order.  A null level is 1, a null page count 0, null lists are empty.

    The lists of one document are one output value; rows arrive cut to their previews.
    """
    names = "array<string>"
    d = _with(docs, {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "parser": "string", "cached": "boolean", "title": "string", "authors": names, "abstract": "string",
                     "page_count": "bigint", "warnings": names})
    key = docs.schema["doc_id"].dataType.simpleString()
    s = _with(sections, {"doc_id": key, "pos": "bigint", "text": "string", "title": "string", "level": "int", "page_start": "int", "page_end": "int", "source": "string"})
    r = _with(references, {"doc_id": key, "pos": "bigint", "text": "string", "title": "string", "authors": names, "year": "string"})
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    some = lambda c: F.coalesce(c, F.array().cast(names)).alias(c)
    s = _listed(s, SECTION_PREVIEW, [blank("title"), F.coalesce("level", F.lit(1)).alias("level"), F.col("page_start"), F.col("page_end"), blank("source")], "sections")
    r = _listed(r, REFERENCE_PREVIEW, [blank("title"), some("authors"), F.col("year")], "references")
    j = d.join(s, "doc_id", "left").join(r, "doc_id", "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    filled = {"title": F.coalesce("title", F.lit("")) != "", "authors": F.coalesce(F.size("authors"), F.lit(0)) > 0,
              "abstract": F.coalesce("abstract", F.lit("")) != "", "sections": count("sections") > 0}
    missing = F.filter(F.array(*[F.when(~ok, c) for c, ok in filled.items()]), lambda c: c.isNotNull())
    empty = lambda c: F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c)
    return j.select("doc_id", "parser", F.coalesce("cached", F.lit(False)).alias("cached"), blank("title"), some("authors"), blank("abstract"),
                    F.coalesce("page_count", F.lit(0).cast("bigint")).alias("page_count"), empty("sections"), empty("references"), some("warnings"), missing.alias("missing_fields"))

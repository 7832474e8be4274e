"""Ordered block streams and markup sections (DS-17 .. DS-19, WN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.scale import block_of, materialize, running

PREFIX = (
    r"(?U)^(?:\s*(?:第[一二三四五六七八九十百\d]+章\s*|[一二三四五六七八九十]+[、.．]\s*|[（(][一二三四五六七八九十\d]+[)）]\s*"
    r"|\d+(?:\.\d+)*[、.．)）]?\s*))++"
)
BODY_TITLE = "正文"


def bare_heading(text: Column) -> Column:
    """Heading without its numbering and without any white space."""
    t = F.trim(F.regexp_replace(T.strip(text), PREFIX, ""), F.lit(" ：:　"))
    return F.regexp_replace(t, T.WS + "+", "")


def is_block_heading(text: Column) -> Column:
    v = T.strip(text)
    bare = bare_heading(v)
    marks = F.length(v) - F.length(F.regexp_replace(v, "[，,；;。.!！？?]", ""))
    refused = (v == "") | (F.length(v) > 100) | v.rlike("[。；;]\\z") | \
        v.rlike(r"(?iU)^\s*(?:图\s*\d+|表\s*\d+|fig\.\s*\d+|table\s*\d+)") | (marks >= 2) | \
        v.rlike("^(?:本文|实验结果表明|结果表明|研究表明|我们|该研究|为了|通过)")
    numbered = v.rlike(PREFIX) & T.has_cjk(bare) & (F.length(bare) <= 30)
    return ~refused & (bare != "") & (bare.isin(K.ZH_BLOCK_HEADINGS) | numbered)


def heading_level(title: Column) -> Column:
    v = T.strip(title)
    dots = F.length(F.regexp_extract(v, r"(?U)^\d+((?:\.\d+)*)", 1)) - F.length(F.replace(F.regexp_extract(v, r"(?U)^\d+((?:\.\d+)*)", 1), F.lit("."), F.lit("")))
    return F.when(dots > 0, F.least(dots + 1, F.lit(6))).when(v.rlike(r"(?U)^[（(][一二三四五六七八九十\d]+[)）]"), 2).otherwise(1).cast("bigint")


def segment_blocks(blocks: DataFrame, id_col: str = "doc_id", pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """DS-17: sections of a block stream; after a reference heading everything stays there."""
    b = blocks.select(id_col, F.col(pos_col).alias("pos"), F.col(text_col).alias("text"))
    b = b.withColumn("_h", is_block_heading(F.col("text")))
    b = b.withColumn("_ref", F.col("_h") & (bare_heading(F.col("text")) == "参考文献"))
    b = running(b, [id_col], ["pos"], block_of("pos"), {"_refs_before": ("max", F.col("_ref").cast("int"), False)})
    b = materialize(b.withColumn("_h", F.col("_h") & (F.coalesce("_refs_before", F.lit(0)) == 0)), "block-heads")
    b = running(b, [id_col], ["pos"], block_of("pos"), {"island": ("sum", F.col("_h").cast("bigint"), True)})
    # One section of one document is one output value; blocks meet per (document, section).
    s = b.groupBy(id_col, "island").agg(
        F.max(F.when(F.col("_h"), F.col("text"))).alias("_title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("_text"))
    title = F.coalesce(T.strip(F.col("_title")), F.lit(BODY_TITLE))
    text = T.strip(F.col("_text"))
    return s.where((F.col("island") > 0) | (text != "")).select(
        id_col, F.col("island").cast("bigint").alias("ordinal"), title.alias("title"), text.alias("text"),
        F.when(F.col("island") == 0, F.lit(1).cast("bigint")).otherwise(heading_level(title)).alias("level"),
        F.lit("grobid_zh_heading_fallback").alias("source"))


def choose_sections(div_sections: DataFrame, block_sections: DataFrame, bodies: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """DS-18: method per document, and the sections of the chosen method.

    Both section tables have (id, ordinal, title, text, level, source); ``bodies`` has (id, body_text).
    """
    titled = F.count_if(T.strip(F.coalesce("title", F.lit(""))) != "")
    d = div_sections.groupBy(id_col).agg(F.count("*").alias("n"), titled.alias("titled"),
                                         F.sum(F.length(T.strip(F.coalesce("text", F.lit(""))))).alias("chars"))
    b = block_sections.groupBy(id_col).agg(F.sum(F.length("title") + F.length("text")).alias("block_chars"))
    j = bodies.join(d, id_col, "left").join(b, id_col, "left")
    usable = (F.coalesce("n", F.lit(0)) >= 3) & (F.coalesce("titled", F.lit(0)) >= 2) & (F.coalesce("chars", F.lit(0)) > 1000)
    method = F.when(usable, "tei_div_head").when(F.coalesce("block_chars", F.lit(0)) > 0, "zh_heading_fallback") \
        .when(F.coalesce("n", F.lit(0)) > 0, "tei_div_head_unusable") \
        .when(T.collapse(F.coalesce("body_text", F.lit(""))) != "", "body_text_fallback").otherwise("xml_itertext_fallback")
    methods = j.select(id_col, method.alias("method"), "body_text")
    cols = [id_col, "ordinal", "title", "text", "level", "source"]
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    chosen = (
        div_sections.join(methods.where(F.col("method").startswith("tei_div_head")).select(id_col), id_col, "left_semi").select(*cols)
        .unionByName(block_sections.join(methods.where(F.col("method") == "zh_heading_fallback").select(id_col), id_col, "left_semi").select(*cols))
        .unionByName(methods.where(F.col("method") == "body_text_fallback").select(
            id_col, zero.alias("ordinal"), F.lit(BODY_TITLE).alias("title"), T.collapse(F.col("body_text")).alias("text"),
            one.alias("level"), F.lit("grobid_body_text_fallback").alias("source")))
    )
    return methods.drop("body_text"), chosen


def locate_sections(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-19: offsets of each section in the rebuilt raw text.  Blocks are joined by a blank line, so a
    running sum of lengths gives what a forward search would find."""
    title, text = T.strip(F.coalesce("title", F.lit(""))), T.strip(F.coalesce("text", F.lit("")))
    block = T.strip(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(text, F.lit(""))))
    s = sections.withColumn("block", block).withColumn("_n", F.length("block").cast("bigint"))
    s = running(s, [id_col], ["ordinal"], block_of("ordinal"), {
        "_before": ("sum", F.when(F.col("_n") > 0, F.col("_n") + 2).otherwise(F.lit(0).cast("bigint")), False)})
    empty = F.col("_n") == 0
    return s.select(id_col, "ordinal", "title", F.when(~empty, F.col("_before")).alias("start_char"),
                    F.when(~empty, F.col("_before") + F.col("_n")).alias("end_char"), "block")


def rebuild_text(located: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-19: the raw text of each document (its sections meet once, as the output value)."""
    return located.where(F.col("start_char").isNotNull()).groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "block"))), lambda x: x["block"]), "\n\n").alias("raw_text"))

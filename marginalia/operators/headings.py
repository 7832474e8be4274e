"""Section headings, spans and merging (DS-1 .. DS-6).

One document is one row and stays one row: lines are an array inside the row, so the whole
chain from raw text to sections needs no exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.scale import settle

BLANK = "[ \\t　]*"
NUMBER = (
    r"(?:\p{Nd}+(?:[.．]\p{Nd}+)*(?:[.．、])?|[IVXLCDM]+\.?|[一二三四五六七八九十百]+[、.．]"
    r"|第[一二三四五六七八九十百\p{Nd}]+[章节]|[（(][一二三四五六七八九十百\p{Nd}]+[）)]|[一二三四五六七八九十百\p{Nd}]+[）)])"
)
TAIL = BLANK + r"(?:[:：.。．\-])?" + BLANK


def _alternatives(table: dict[str, list[str]]) -> str:
    words = sorted({w for ws in table.values() for w in ws}, key=lambda w: (-len(w), w))
    return "|".join(re.sub(r"\\? ", r"\\s+", re.escape(w)) for w in words)


def _line_pattern(table: dict, flags: str) -> str:
    return rf"(?{flags})^{BLANK}(?:{NUMBER}{BLANK})?({_alternatives(table)}){TAIL}\z"


ZH_LINE = _line_pattern(K.ZH_ALIASES, "U")
EN_LINE = _line_pattern(K.EN_ALIASES, "iU")


def _lookup(table: dict[str, list[str]]) -> Column:
    first: dict[str, str] = {}
    for section, words in table.items():
        for w in words:
            first.setdefault(w, section)
    return F.create_map(*[F.lit(x) for kv in first.items() for x in kv])


def _match(line: Column) -> Column:
    """section and rule of one line (or of two joined lines), NULL when it is no heading."""
    zh = T.collapse(F.regexp_extract(line, ZH_LINE, 1))
    en = T.collapse(F.lower(F.regexp_extract(line, EN_LINE, 1)))
    return (
        F.when(zh != "", F.struct(F.try_element_at(_lookup(K.ZH_ALIASES), zh).alias("section"), F.lit("rule_zh").alias("source")))
        .when(en != "", F.struct(F.try_element_at(_lookup(K.EN_ALIASES), en).alias("section"), F.lit("rule_en").alias("source")))
    )


def plausible(title: Column, source: Column) -> Column:
    """DS-2: a heading line, not a sentence."""
    c = F.regexp_replace(title, T.WS + "+", "")
    commas = F.length(c) - F.length(F.regexp_replace(c, "[，,；;]", ""))
    long = F.when(source == "rule_zh", F.length(c) > 80).otherwise(F.length(c) > 140)
    return (c != "") & ~long & ~(c.rlike("[。！？]") & (F.length(c) > 12)) & (commas < 2)


def confidence(title: Column, section: Column, source: Column) -> Column:
    """DS-2: heading confidence in integer hundredths."""
    n = F.length(F.regexp_replace(title, T.WS + "+", ""))
    score = (
        F.when(source == "rule_zh", 90).otherwise(88)
        + F.when(section.isin(K.PLAIN_TITLE_SECTIONS), 3).otherwise(0)
        + F.when(title.rlike(r"(?U)^\s*(?:\d+|[一二三四五六七八九十百]+|第)"), 4).otherwise(0)
        - F.when((source == "rule_zh") & (n > 60), 25).otherwise(0)
        - F.when((source == "rule_en") & (n > 120), 25).otherwise(0)
        - F.when(T.strip(title).rlike("[。！？.!?]\\z") & ~section.isin("abstract", "keywords"), 8).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint")


def with_headings(docs: DataFrame, text_col: str, name: str = "_heads") -> DataFrame:
    """DS-1: add the ordered array of (start, end, title, section, source, confidence).

    Each step is its own projection, so the optimizer computes it once per row.
    """
    lines = F.col("_lines")
    staged = docs.withColumn("_lines", F.split(F.col(text_col), "\n"))

    # Lines that look like a heading, or like the start of an alias that goes on in the next lines, are kept.
    # Lines of blanks only lie between the words of an alias like any other white space.
    indexed = F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("line")))
    staged = staged.withColumn("_solid", F.filter(indexed, lambda x: F.ltrim(x["line"], F.lit(T.WS_CHARS)) != ""))
    numbered = F.transform("_solid", lambda x, s: F.struct(s.alias("s"), x["i"].alias("i"), x["line"].alias("line")))
    def heads(l: Column) -> Column:
        return F.left(l, F.lit(2 * FRONT)).rlike(FRONT_LINE) & (l.rlike(ZH_LINE) | l.rlike(EN_LINE) | l.rlike(OPEN_LINE))
    likely = F.transform(F.filter(numbered, lambda x: heads(x["line"])), lambda x: F.struct(
        x["s"].alias("s"), x["i"].alias("i"), x["line"].alias("line"), x["line"].rlike(OPEN_LINE).alias("open")))
    staged = staged.withColumn("_likely", likely)

    def spans(x: Column) -> Column:
        def out(t: Column) -> Column:
            return F.struct(x["i"].alias("i"), t.alias("line"), _match(t).alias("m"))
        tails = [F.get("_solid", x["s"] + k)["i"] for k in range(1, MOST_WORDS)]
        joined = [F.when(x["open"] & j.isNotNull(), F.array_join(F.slice(lines, x["i"] + 1, F.coalesce(j, x["i"]) - x["i"] + 1), "\n")) for j in tails]
        return F.array(out(x["line"]), *[out(t) for t in joined])

    hits = F.filter(F.flatten(F.transform("_likely", spans)), lambda h: h["m"].isNotNull())
    staged = staged.withColumn("_hits", hits)

    # Offsets in one walk: hits come by line, and each step adds the lines since the hit before.
    def placed(s: Column, h: Column) -> Column:
        here = F.aggregate(F.slice(lines, s["line"] + 1, h["i"] - s["line"]), s["at"], lambda acc, l: acc + F.length(l) + 1)
        return F.transform(F.array(here), lambda at: F.struct(h["i"].alias("line"), at.alias("at"), F.array_append(s["starts"], at).alias("starts")))[0]

    nowhere = F.struct(F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    staged = staged.withColumn("_starts", F.aggregate("_hits", nowhere, placed, lambda s: s["starts"]))

    def finish(h: Column, no: Column) -> Column:
        start = F.get("_starts", no)
        title = T.strip(h["line"])
        section, source = h["m"]["section"], h["m"]["source"]
        return F.struct(start.alias("start"), (start + F.length(h["line"])).alias("end"), title.alias("title"),
                        section.alias("section"), source.alias("source"), confidence(title, section, source).alias("confidence"))

    heads = F.array_sort(F.filter(F.transform("_hits", finish), lambda h: plausible(h["title"], h["source"])))
    return settle(staged.withColumn(name, heads).drop("_lines", "_solid", "_likely", "_hits", "_starts"))


_spaced = sorted({w for t in (K.ZH_ALIASES, K.EN_ALIASES) for ws in t.values() for w in ws if " " in w})
_starts = sorted({" ".join(w.split(" ")[:i]) for w in _spaced for i in range(1, len(w.split(" ")))})
MOST_WORDS = max(len(w.split(" ")) for w in _spaced)
OPEN_LINE = rf"(?iU)^{BLANK}(?:{NUMBER}{BLANK})?(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in _starts)})\s*\z"

# What a line must begin with to match one of the three: a heading's first characters after its number, or a number and blanks
# that fill the front.  Lines are long as a rule, and only their beginning is turned into a string for this test.
FRONT = 32
_firsts = sorted({re.escape(w[:3] if w.isascii() else w[0]) for t in (K.ZH_ALIASES, K.EN_ALIASES) for ws in t.values() for w in ws})
FRONT_LINE = rf"(?iU)^(?:{BLANK}(?:{NUMBER}{BLANK})?(?:{'|'.join(_firsts)})|[ \t　\p{{Nd}}.．、IVXLCDM一二三四五六七八九十百第章节（(）)]{{{FRONT}}})"


def find_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """DS-1/DS-2: one row per heading, in reading order."""
    h = with_headings(docs.select(id_col, text_col), text_col).select(id_col, F.posexplode("_heads").alias("pos", "h"))
    return h.select(id_col, F.col("pos").cast("bigint").alias("ordinal"), "h.*")


def inline_abstract(raw: Column) -> Column:
    """DS-4: Chinese abstract written on the heading line; struct or NULL."""
    start_re = f"(?md)^{BLANK}(摘\\s*要|内容摘要|中文摘要){BLANK}[:：]?{BLANK}"
    end_re = (
        f"(?md)^{BLANK}(?:关\\s*键\\s*词|关键字|Abstract|ABSTRACT|"
        f"(?:(?:\\p{{Nd}}+(?:[.．]\\p{{Nd}}+)*(?:[.．、])?|[一二三四五六七八九十百]+[、.．]|第[一二三四五六七八九十百\\p{{Nd}}]+[章节])?{BLANK})"
        f"(?:引言|绪论|前言|研究背景|课题背景|问题提出)){BLANK}[:：.。．\\-]?"
    )
    at = F.regexp_instr(raw, F.lit(start_re))
    title = F.regexp_extract(raw, start_re, 1)
    begin = (at - 1 + F.length(F.regexp_extract(raw, start_re, 0))).cast("bigint")
    # A guard character keeps '^' from matching where the search starts.
    rest = F.concat(F.lit("x"), F.substr(raw, begin + 1))
    stop = F.regexp_instr(rest, F.lit(end_re))
    end = F.when(stop > 0, begin + stop - 2).otherwise(F.least(F.length(raw).cast("bigint"), begin + 2000))
    full = T.strip(F.substr(raw, begin + 1, end - begin))
    n = F.length(full)
    warning = F.when(n < 30, "abstract is very short; rule confidence is low").when(
        n > 2000, "abstract is longer than 2000 chars and was truncated").otherwise("")
    found = F.when((at > 0) & (n > 0), F.struct(
        F.left(full, F.lit(2000)).alias("content"), T.strip(title).alias("title"), F.lit("rule_zh").alias("source"),
        begin.alias("start_char"), F.when(n > 2000, begin + 2000).otherwise(end).alias("end_char"),
        F.when(n < 30, 65).otherwise(95).cast("bigint").alias("confidence"), warning.alias("warning")))
    # The patterns above go over the text again and again; without this character none of them can match.
    return F.when(F.contains(raw, F.lit("摘")), found)


def is_short(section: Column, content: Column) -> Column:
    n = F.length(T.strip(content))
    return section.isin(K.SHORT_SECTION_KEYS) & (n > 0) & (n < K.MIN_SECTION_LENGTH)


def with_sections(docs: DataFrame, text_col: str, name: str = "_parts") -> DataFrame:
    """DS-3: add the array of section pieces of one text, in reading order, boundary kinds dropped."""
    raw, heads = F.col(text_col), F.col("_heads")
    staged = with_headings(docs, text_col).withColumn("_inline", inline_abstract(raw))

    def piece(h: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get(heads, i + 1)["start"], F.length(raw).cast("bigint"))
        content = T.strip(F.substr(raw, (h["end"] + 1).cast("int"), F.greatest(nxt - h["end"], F.lit(0)).cast("int")))
        return F.struct(h["section"].alias("section"), content.alias("content"), h["title"].alias("title"), h["source"].alias("source"),
                        h["end"].alias("start_char"), nxt.alias("end_char"), h["confidence"].alias("confidence"))

    staged = staged.withColumn("_pieces", F.transform(heads, piece))
    kept = F.filter("_pieces", lambda p: ~p["section"].isin(K.BOUNDARY_SECTIONS) & (p["content"] != ""))

    def noted(p: Column) -> Column:
        note = F.when(is_short(p["section"], p["content"]), "rule section is very short; LLM correction may be useful").otherwise("")
        return F.struct(*[p[c].alias(c) for c in ("section", "content", "title", "source", "start_char", "end_char", "confidence")],
                        note.alias("warning"))

    inline = F.col("_inline")
    first = F.struct(F.lit("abstract").alias("section"), *[inline[c].alias(c) for c in (
        "content", "title", "source", "start_char", "end_char", "confidence", "warning")])
    pieces = F.transform(kept, noted)
    parts = F.when(inline.isNotNull(), F.concat(F.array(first), pieces)).otherwise(pieces)
    return settle(staged.withColumn(name, parts).drop("_heads", "_inline", "_pieces"))


def extract_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", keep: list[str] = ()) -> DataFrame:
    """DS-3/DS-4: long table, six rows per document; a missing section has empty content."""
    parts = with_sections(docs.select(id_col, text_col, *[k for k in keep if k != text_col]), text_col).select(id_col, *keep, F.col("_parts").alias("parts"))
    return fold_sections(parts, id_col, list(keep))


def fold_sections(parts: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """Six small structs are built inside the row and exploded, so no output row carries the other sections."""
    zero, none = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")

    def one(pos: int, key: str) -> Column:
        mine = F.filter("parts", lambda p: p["section"] == key)
        head, tail = F.get(mine, F.lit(0)), F.try_element_at(mine, F.lit(-1))
        found = F.size(mine) > 0
        return F.struct(
            F.lit(pos).cast("bigint").alias("section_pos"), F.lit(key).alias("section"), F.array_join(F.transform(mine, lambda p: p["content"]), "\n\n").alias("content"),
            F.when(found, head["source"]).otherwise("missing").alias("source"), F.when(found, head["title"]).otherwise("").alias("matched_title"),
            F.when(found, head["start_char"]).otherwise(none).alias("start_char"), F.when(found, tail["end_char"]).otherwise(none).alias("end_char"),
            F.when(found, head["confidence"]).otherwise(zero).alias("confidence"), F.when(found, head["warning"]).otherwise("section not found").alias("warning"))

    rows = parts.select(id_col, *keep, F.inline(F.array(*[one(n, k) for n, k in enumerate(K.SECTION_KEYS)])))
    return rows.select(id_col, *keep, "section_pos", "section", "content", "source", "matched_title", F.length("content").cast("bigint").alias("length"),
                       "start_char", "end_char", "confidence", "warning")


def merge_sections(rule: DataFrame, alternate: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-5: keep a rule section unless it is very short and the alternate is longer; fill gaps.

    ``alternate`` has (id, section, alt_content); ``docs`` has (id, raw_text, existing_abstract).
    """
    j = rule.join(alternate, [id_col, "section"], "full_outer").join(docs, id_col, "left")
    r = T.strip(F.coalesce("content", F.lit("")))
    a = T.strip(F.coalesce("alt_content", F.lit("")))
    e = F.coalesce("existing_abstract", F.lit(""))
    choice = (
        F.when((r != "") & is_short(F.col("section"), r) & (F.length(a) > F.length(r)), "corrected")
        .when(r != "", "rule").when(a != "", "filled")
        .when((F.col("section") == "abstract") & (e != ""), "abstract").otherwise("missing")
    )
    j = j.withColumn("choice", choice)
    text = F.when(F.col("choice") == "rule", r).when(F.col("choice").isin("corrected", "filled"), a) \
        .when(F.col("choice") == "abstract", e).otherwise("")
    j = j.withColumn("merged", text)
    rule_won = F.col("choice") == "rule"
    at = F.when(rule_won | (F.col("choice") == "missing"), F.lit(0)).otherwise(F.expr("locate(merged, raw_text)")).cast("bigint")
    return j.select(
        id_col, "section", F.col("merged").alias("content"), "choice",
        F.when(rule_won, F.col("source")).when(F.col("choice") == "missing", "missing").otherwise("llm").alias("source"),
        F.length("merged").cast("bigint").alias("length"),
        F.when(rule_won, F.col("start_char")).when(at > 0, at - 1).otherwise(F.lit(-1).cast("bigint")).alias("start_char"),
        F.when(rule_won, F.col("end_char")).when(at > 0, at - 1 + F.length("merged")).otherwise(F.lit(-1).cast("bigint")).alias("end_char"),
        F.when(rule_won, F.col("warning")).when(F.col("choice") == "corrected", "rule section was very short and replaced by LLM correction")
        .when(F.col("choice") == "filled", "filled by LLM fallback").when(F.col("choice") == "abstract", "filled from paper_info abstract")
        .otherwise("section not found").alias("warning"),
    )


def needs_fallback(sections: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """DS-6: does a document need the fallback extractor, and the input prefix it would get."""
    empty = F.col("section").isin("method", "experiments") & (F.col("content") == "")
    flags = sections.groupBy(id_col).agg(F.bool_or(empty | is_short(F.col("section"), F.col("content"))).alias("needs_fallback"))
    return docs.select(id_col, F.left(text_col, F.lit(40000)).alias("fallback_input")).join(flags, id_col).select(
        id_col, "needs_fallback", F.when(F.col("needs_fallback"), F.col("fallback_input")).alias("fallback_input"))

"""Titles and authors from page-layout lines (DS-20, DS-21, WN-10, TK-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.scale import first_rows, settle

HAN = "[\\u4e00-\\u9fff]"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def bad_title(text: Column) -> Column:
    return _any(F.lower(text), K.TITLE_BLOCKLIST) | text.rlike(r"(?U)[@:/\\]|第\s*\d+\s*页") | (_count(text, "[，,；;。.!！？?：:]") > 3)


def looks_like_title(text: Column, script: str = HAN) -> Column:
    t = F.regexp_replace(text, T.WS + "+", "")
    return _count(t, script).between(6, 80) & (F.length(t) <= 120) & ~bad_title(t)


def line_score(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, font: Column, body: Column, width: Column, height: Column,
               script: str = HAN) -> Column:
    """Title score of one visual line in integer hundredths; NULL when it can be no title."""
    n, han = F.length(text), _count(text, script)
    yc = (y0 + y1) / 2 / height
    off = F.abs((x0 + x1) / 2 - width / 2) / F.greatest(width / 2, F.lit(1.0))
    on = lambda c, v: F.when(c, v).otherwise(0)
    score = (
        on(bad_title(text), -45) + on(F.contains(text, F.lit("。")) | text.rlike("[，,；;]\\z"), -25) + on(_any(text, K.SENTENCE_WORDS), -25)
        + on(_any(text, K.UNIT_WORDS), -12) + on(_any(text, K.STRONG_UNIT_WORDS) & text.rlike(r"(?U)[()（）]|\d{5,}"), -45)
        + F.when((yc < 0.035) | (yc > 0.55), -25).when(yc <= 0.45, 24).otherwise(0)
        + F.when(font >= body + 2, 28).when(font >= body + 0.8, 16).otherwise(-22)
        + F.when(off <= 0.18, 20).when(off <= 0.32, 10).otherwise(-12)
        + F.when(han.between(10, 45), 18).when(han.between(6, 80), 8).otherwise(0)
        + on(han / F.greatest(n, F.lit(1)) >= 0.55, 14)
        + on((yc < 0.08) & _any(F.lower(text), K.JOURNAL_WORDS), -25)
    )
    usable = (n > 0) & (han >= 6) & (n <= 120) & (han <= 80) & ~text.rlike(r"(?U)^[\d\s.\-—–]+\z")
    return F.when(usable, F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint"))


def title_candidates(lines: DataFrame, id_col: str = "doc_id", script: str = HAN, k: int = 5) -> DataFrame:
    """DS-20: best five candidates per document from (id, text, x0, y0, x1, y1, font_size, page_width, page_height).

    The lines are those of one first page, so a document's window is bounded by a page.
    """
    lines = lines.withColumn("text", T.collapse(F.col("text"))).where(F.col("text") != "")
    body = lines.groupBy(id_col).agg(F.median("font_size").alias("body"))
    s = lines.join(body, id_col)
    w = Window.partitionBy(id_col).orderBy("y0", "x0", "line_no")
    geo = F.struct("text", "x0", "y0", "x1", "y1", "font_size")
    s = s.withColumn("_a", geo).withColumn("_b", F.lead(geo, 1).over(w)).withColumn("_c", F.lead(geo, 2).over(w))
    base = [id_col, "line_no", "body", "page_width", "page_height"]

    def group(parts: list[str], boost: int) -> DataFrame:
        cols = [F.col(p) for p in parts]
        g = s.where(cols[-1].isNotNull())
        text = F.concat(*[c["text"] for c in cols])
        fonts = [c["font_size"] for c in cols]
        top = F.greatest(*fonts) if len(cols) > 1 else fonts[0]
        low = lambda f: F.least(*[c[f] for c in cols]) if len(cols) > 1 else cols[0][f]
        high = lambda f: F.greatest(*[c[f] for c in cols]) if len(cols) > 1 else cols[0][f]
        if len(cols) > 1:
            centers = [(c["x0"] + c["x1"]) / 2 for c in cols]
            gaps = [cols[i + 1]["y0"] - cols[i]["y1"] for i in range(len(cols) - 1)]
            fits = looks_like_title(text, script) & (F.greatest(*centers) - F.least(*centers) <= F.col("page_width") * 0.2) & (top >= F.col("body") + 2)
            for gap in gaps:
                fits = fits & (gap >= -2) & (gap <= top * 1.9)
            g = settle(g.withColumn("_fits", fits)).where("_fits")
        flat = F.regexp_replace(text, T.WS + "+", "")
        g = g.select(*base, flat.alias("text"), low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"),
                     top.alias("font_size"))
        score = line_score(F.col("text"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("font_size"), F.col("body"),
                           F.col("page_width"), F.col("page_height"), script)
        g = settle(g)
        return settle(g.select(id_col, F.left("text", F.lit(120)).alias("text"), F.when(score.isNotNull(), F.least(F.lit(100), score + boost)).cast("bigint").alias("score"),
                        F.lit(len(cols)).cast("bigint").alias("lines_merged"), "line_no")).where(F.col("score").isNotNull())

    scored = group(["_a"], 0).unionByName(group(["_a", "_b"], 8)).unionByName(group(["_a", "_b", "_c"], 14))
    best = scored.groupBy(id_col, "text").agg(
        F.max("score").alias("score"),
        F.min_by("lines_merged", F.struct(-F.col("score"), "lines_merged", "line_no")).alias("lines_merged"),
        F.min_by("line_no", F.struct(-F.col("score"), "lines_merged", "line_no")).alias("line_no"))
    order = [F.col("score").desc(), F.length("text").desc(), F.col("lines_merged"), F.col("line_no")]
    return first_rows(best, [id_col], order, k)


def first_page_authors(lines: DataFrame, titles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-21: names on the first suitable line between the title line and the abstract line.

    ``lines`` has (id, pos, text) of the first page; ``titles`` has (id, title).
    """
    l = lines.withColumn("text", T.collapse(F.col("text"))).where(F.col("text") != "")
    w = Window.partitionBy(id_col)
    l = l.withColumn("pos", F.row_number().over(w.orderBy("pos")) - 1)
    l = l.join(titles, id_col, "left")
    is_abs = F.col("text").rlike(r"(?U)^\s*摘\s*要\s*[:：]?")
    n = F.count("*").over(w)
    l = l.withColumn("_abs", F.coalesce(F.min(F.when(is_abs, F.col("pos"))).over(w), F.least(n, F.lit(30))))
    flat = F.regexp_replace("text", T.WS + "+", "")
    want = F.regexp_replace(F.coalesce("title", F.lit("")), T.WS + "+", "")
    hit = (want != "") & (F.col("pos") < F.col("_abs")) & (F.contains(flat, want) | F.contains(want, flat))
    l = l.withColumn("_title", F.coalesce(F.min(F.when(hit, F.col("pos"))).over(w), F.lit(0)))
    names = T.author_names(F.col("text"))
    ok = (F.col("pos") > F.col("_title")) & (F.col("pos") < F.col("_abs")) & ~_any(F.col("text"), K.UNIT_WORDS) & F.size(names).between(1, 12)
    return l.withColumn("_names", names).groupBy(id_col).agg(F.min_by("_names", F.when(ok, F.col("pos"))).alias("authors"))

"""Metadata resolution, candidate ranking and filling (MD-1 .. MD-11, JN-11, WN-4, TK-6, SE-5)."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.functions.similarity import similarity
from marginalia.operators.title_join import similar_titles
from marginalia.scale import block_of, first_rows, materialize, number_rows, settle

TOOLS = ["arxiv", "crossref", "openalex"]


def resolve_fields(docs: DataFrame, id_col: str = "doc_id", high: float = 0.75) -> DataFrame:
    """MD-1: final value and its source per field; wide, inside the row.

    Columns used: paper_language, title, authors ARRAY, abstract, year, venue, candidate_title,
    candidate_confidence, candidate_authors ARRAY, candidate_abstract.
    """
    zh = F.col("paper_language") == "zh"
    clear = lambda c, f: T.clear_or_null(F.col(c), f)
    arr = lambda c: F.when(T.has_clear(F.col(c)), F.filter(F.transform(c, T.strip), lambda x: x != ""))
    cand = F.when(zh & (F.coalesce("candidate_confidence", F.lit(0.0)) >= high), clear("candidate_title", "title"))
    picks = {
        "title": [("parser", clear("title", "title")), ("parser_meta", cand)],
        "authors": [("parser", arr("authors")), ("parser_meta", F.when(zh, arr("candidate_authors")))],
        "abstract": [("parser", clear("abstract", "abstract")), ("parser_meta", F.when(zh, clear("candidate_abstract", "abstract")))],
        "year": [("parser_meta", clear("year", "year"))],
        "venue": [("parser_meta", clear("venue", "venue"))],
    }
    out = [id_col, "paper_language"]
    for field, sources in picks.items():
        out.append(F.coalesce(*[v for _, v in sources]).alias(f"final_{field}"))
        src = F.lit("default")
        for name, v in reversed(sources):
            src = F.when(v.isNotNull(), name).otherwise(src)
        out.append(src.alias(f"{field}_source"))
    return docs.select(*out)


def missing_fields(resolved: DataFrame, fields: list[str] = K.METADATA_FIELDS) -> Column:
    """MD-2: names of fields that stayed NULL, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(f"final_{f}").isNull(), F.lit(f)) for f in fields]))


def lookup_decision(doi: Column, arxiv: Column, url: Column, title: Column, venue: Column, year: Column, raw: Column) -> tuple[Column, Column]:
    """MD-3: is an outside lookup worth it for a Chinese document, and why."""
    null = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    head = F.concat_ws("\n", null(doi), null(arxiv), null(url), null(title), null(F.left(raw, F.lit(3000))))
    given = lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""
    reason = (
        F.when(given(doi) | (T.extract_doi(head) != ""), "zh_doi")
        .when(given(arxiv) | (T.extract_arxiv(head) != ""), "zh_arxiv")
        .when(F.coalesce(T.looks_english_title(title), F.lit(False)), "zh_english_title")
        .when(T.is_clear(venue) & T.is_clear(year), "zh_venue_and_year")
    )
    return reason.isNotNull(), F.coalesce(reason, F.lit("zh_without_identifier"))


def lookup_worklist(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """MD-4: one row per (document, provider to ask) with the hints.

    Columns used: missing ARRAY, title, authors ARRAY, doi, arxiv_id, raw_text.
    """
    null = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    d = docs.select(id_col, "missing", "title", "authors", "doi", "arxiv_id", F.left("raw_text", F.lit(2000)).alias("_head"))
    ids = F.concat_ws("\n", null(F.col("title")), null(F.col("doi")), null(F.col("arxiv_id")), null(F.col("_head")))
    d = d.withColumn("_ids", ids).select(
        id_col, "missing", F.coalesce(T.clear_or_null(F.col("title"), "title"), T.title_guess(F.col("_head"))).alias("hint_title"),
        F.coalesce(F.get(F.filter(F.transform("authors", T.strip), lambda a: a != ""), F.lit(0)), F.lit("")).alias("hint_author"),
        F.coalesce(null(F.col("doi")), T.extract_doi(F.col("_ids"))).alias("hint_doi"),
        F.coalesce(null(F.col("arxiv_id")), T.extract_arxiv(F.col("_ids"))).alias("hint_arxiv"))
    only_abstract = F.col("missing") == F.array(F.lit("abstract"))
    with_id = F.col("hint_arxiv") != ""
    ask = F.when(F.size("missing") == 0, F.array()).when(only_abstract & with_id, F.array(F.lit("arxiv"))).when(only_abstract, F.array()) \
        .when(with_id, F.array(*[F.lit(t) for t in TOOLS])).otherwise(F.array(*[F.lit(t) for t in TOOLS[1:]]))
    return d.select("*", F.posexplode(ask.cast("array<string>")).alias("_p", "provider")).select(
        id_col, "provider", F.col("_p").cast("bigint").alias("ask_order"), "hint_title", "hint_author", "hint_doi", "hint_arxiv")


# ---- matching -----------------------------------------------------------------------------

def _alike(pair: tuple[str, str]) -> bool:
    """Equal names, or a matcher ratio of at least 0.82; the ratio is at most twice the shorter length over both."""
    short, both = min(map(len, pair)), sum(map(len, pair))
    return short > 0 and 200 * short >= 82 * both and (pair[0] == pair[1] or SequenceMatcher(None, *pair).ratio() >= 0.82)


@pandas_udf(DoubleType())
def author_points(ours: pd.Series, theirs: pd.Series) -> pd.Series:
    """0.6 for alike first names and 0.4 times the share of our names that have a partner; null stays null."""
    out = []
    for a, b in zip(ours, theirs):
        if a is None or b is None:
            out.append(None)
            continue
        partners = {name for name, other in product(set(a), set(b)) if _alike((name, other))}
        share = max(sum(name in partners for name in a) / len(a), len(set(a).intersection(b)) / len(set(a)))
        first = a[0] == b[0] or _alike((a[0], b[0]))
        out.append(round(min(1.0, 0.6 * first + 0.4 * share), 4))
    return pd.Series(out, dtype="float64")


def author_score(ours: Column, theirs: Column) -> Column:
    """MD-5: equal lists score 1 and empty ones 0 in the JVM; only the others go to Python."""
    a, b = (F.transform(F.filter(c, lambda x: T.strip(x) != ""), T.match_text) for c in (ours, theirs))
    empty = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    hard = ~empty & (a != b)
    return F.when(empty, F.lit(0.0)).when(hard, author_points(F.when(hard, a), F.when(hard, b))).otherwise(F.lit(1.0))


def venue_score(ours: Column, theirs: Column) -> Column:
    """MD-6."""
    a, b = T.match_text(ours), T.match_text(theirs)
    inside = F.contains(b, a) | F.contains(a, b)
    hard = (a != "") & (b != "") & ~inside
    sim = similarity(F.when(hard, a), F.when(hard, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(inside, F.lit(0.85)).otherwise(F.round(sim, 4))


def arrival_ranks(candidates: DataFrame, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """WN-4: rank within the provider and over all providers, in arrival order."""
    c = materialize(number_rows(candidates, [id_col, "provider"], [pos], block_of(pos), "provider_rank"), "provider-ranks")
    return number_rows(c, [id_col], [pos], block_of(pos), "provider_global_rank")


def rerank(candidates: DataFrame, docs: DataFrame, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """MD-7: local match score, its parts, the local rank and a reason.

    ``candidates``: id, provider, pos, title, authors ARRAY, year, venue, doi, url;
    ``docs``: id, our_title, our_authors ARRAY, our_year, our_venue, our_doi, our_arxiv.
    """
    c = arrival_ranks(candidates, id_col, pos).join(docs, id_col)
    blank = lambda x: F.coalesce(x, F.lit(""))
    theirs_arxiv = T.normalize_arxiv(F.concat_ws(" ", blank("url"), blank("doi"), blank("title")))
    c = c.select(
        "*",
        F.round(similarity(T.match_text(F.col("our_title")), T.match_text(F.col("title"))), 4).alias("title_similarity"),
        author_score(F.col("our_authors"), F.col("authors")).alias("author_match_score"),
        ((blank("our_year") != "") & (T.strip(blank("year")) == T.strip(blank("our_year")))).alias("year_match"),
        venue_score(F.col("our_venue"), F.col("venue")).alias("venue_match_score"),
        ((T.normalize_doi(F.col("our_doi")) != "") & (T.normalize_doi(F.col("our_doi")) == T.normalize_doi(F.col("doi")))).alias("doi_match"),
        ((T.normalize_arxiv(blank("our_arxiv")) != "") & (T.normalize_arxiv(blank("our_arxiv")) == theirs_arxiv)).alias("arxiv_match"))
    t, a = F.col("title_similarity"), F.col("author_match_score")
    mixed = t * 0.62 + a * 0.23 + F.when(F.col("year_match"), 0.08).otherwise(0.0) + F.least(F.col("venue_match_score"), F.lit(1.0)) * 0.07
    dated = (blank("year") != "") | (blank("venue") != "")
    zero = F.lit(0.0)
    score = F.greatest(
        F.when(F.col("doi_match"), 0.98).otherwise(zero), F.when(F.col("arxiv_match"), 0.97).otherwise(zero), mixed,
        F.when((t >= 0.96) & (a >= 0.5), 0.88).otherwise(zero), F.when((t >= 0.98) & dated, 0.82).otherwise(zero))
    c = c.withColumn("local_match_score", F.round(F.least(F.lit(1.0), score), 4))
    reason = F.concat_ws(", ", F.when(F.col("doi_match"), "doi_match"), F.when(F.col("arxiv_match"), "arxiv_match"),
                         F.when(t >= 0.9, F.concat(F.lit("title_similarity="), t.cast("string"))),
                         F.when(a >= 0.6, F.concat(F.lit("author_match_score="), a.cast("string"))),
                         F.when(F.col("year_match"), "year_match"),
                         F.when(F.col("venue_match_score") >= 0.8, F.concat(F.lit("venue_match_score="), F.col("venue_match_score").cast("string"))))
    c = c.withColumn("rerank_reason", F.when(reason == "", "weak local match").otherwise(reason))
    # Scores have four decimals, so ten-thousandths are exact order keys and blocks.
    key = lambda x: -F.round(F.col(x) * 10000).cast("bigint")
    # Scores cost Python work; they are written before the ranking reads them twice.
    c = c.withColumn("_s", key("local_match_score")).withColumn("_t", key("title_similarity")).withColumn("_a", key("author_match_score"))
    c = materialize(c, "match-scores")
    c = number_rows(c, [id_col], ["_s", "_t", "_a", "provider_rank", "provider_global_rank"], F.col("_s"), "local_rank")
    return c.drop("_s", "_t", "_a", "our_title", "our_authors", "our_year", "our_venue", "our_doi", "our_arxiv")


def simple_score(candidates: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """MD-8: the simpler scorer of the lookup step."""
    c = candidates.join(docs, id_col)
    blank = lambda x: F.lower(F.coalesce(x, F.lit("")))
    first = F.lower(F.coalesce(F.get("our_authors", F.lit(0)), F.lit("")))
    near = F.exists("authors", lambda x: F.contains(F.lower(x), first) | F.contains(first, F.lower(x)))
    doi_hit = (blank("our_doi") != "") & (blank("our_doi") == blank("doi"))
    arxiv_hit = (blank("our_arxiv") != "") & F.contains(blank("url"), blank("our_arxiv"))
    sure = F.coalesce(doi_hit | arxiv_hit, F.lit(False))
    sim = similarity(F.when(~sure, F.col("our_title")), F.when(~sure, F.col("title")))
    soft = sim * 0.75 + F.when((first != "") & F.coalesce(near, F.lit(False)), 0.12).otherwise(0.0) \
        + F.when((blank("our_year") != "") & (blank("year") == blank("our_year")), 0.08).otherwise(0.0) \
        + F.when((F.col("provider") == "arxiv") & (blank("our_arxiv") != ""), 0.1).otherwise(0.0)
    score = F.when(doi_hit, 0.98).when(arxiv_hit, 0.97).otherwise(F.least(soft, F.lit(0.99)))
    return c.withColumn("confidence", F.round(score, 4))


def pick_best(scored: DataFrame, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """MD-8: highest positive confidence, earliest on a tie; combines on the map side."""
    cols = [c for c in scored.columns if c != id_col]
    best = scored.where("confidence > 0").groupBy(id_col).agg(F.min_by(F.struct(*cols), F.struct(-F.col("confidence"), F.col(pos))).alias("b"))
    return best.select(id_col, "b.*")


def usable(field: Column, value: Column, confidence: Column, title_similarity: Column | None = None, threshold: float = 0.75) -> Column:
    """MD-9: may an outside value fill a field?  ``value`` is text; an author list arrives joined."""
    s = T.strip(F.coalesce(value, F.lit("")))
    ok = (confidence >= threshold) & F.when(field == "abstract", T.is_clear(value, "abstract")).otherwise(T.is_clear(value))
    ok = ok & F.when(field == "title", F.length(s) >= 8).when(field == "year", s.rlike("^(19|20)\\p{Nd}{2}\\z")) \
        .when(field == "abstract", F.length(s) >= 20).otherwise(True)
    if title_similarity is not None:
        ok = ok & (title_similarity.isNull() | (title_similarity >= 0.4))
    return F.coalesce(ok, F.lit(False))


def fill_missing(fields: DataFrame, best: DataFrame, id_col: str = "doc_id", threshold: float = 0.75) -> DataFrame:
    """MD-10: long fields (id, field, value, source) with the first-ranked candidate's values where missing.

    ``best``: id, provider, score, title_similarity, and one text column per field.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tool_value")) for f in K.METADATA_FIELDS])
    b = best.select(id_col, "provider", "score", "title_similarity", F.explode(pairs).alias("p")).select(
        id_col, "provider", "score", "title_similarity", "p.*")
    j = fields.join(b, [id_col, "field"], "left")
    clear = F.when(F.col("field") == "abstract", T.is_clear(F.col("value"), "abstract")).otherwise(T.is_clear(F.col("value")))
    good = usable(F.col("field"), F.col("tool_value"), F.coalesce("score", F.lit(0.0)), F.col("title_similarity"), threshold)
    use = ~clear & good
    return j.select(
        id_col, "field", F.when(use, F.col("tool_value")).when(clear, F.col("value")).alias("value"),
        F.when(use, "tool").when(clear, F.col("source")).otherwise("default").alias("source"), F.when(use, F.col("provider")).alias("provider"),
        F.when(clear, "existing_value_is_clear")
        .when(~use, "missing_or_low_confidence").alias("not_used_reason"))


def accept_picks(picks: DataFrame, candidates: DataFrame, id_col: str = "doc_id", threshold: float = 0.45) -> DataFrame:
    """MD-11: an outside pick counts only when it is one of the candidates.

    ``picks``: id, pick_title, pick_index, pick_confidence; ``candidates``: id, idx, text.
    """
    sizes = candidates.groupBy(id_col).agg(F.count("*").alias("_n"))
    at = candidates.select(id_col, F.col("idx").alias("pick_index"), F.col("text").alias("_at"))
    any_ = candidates.select(id_col, F.col("text").alias("pick_title")).distinct().withColumn("_any", F.lit(True))
    j = picks.withColumn("pick_title", T.strip(F.coalesce("pick_title", F.lit("")))).join(sizes, id_col, "left") \
        .join(at, [id_col, "pick_index"], "left").join(any_, [id_col, "pick_title"], "left")
    indexed = F.col("pick_index").isNotNull() & (F.col("pick_index") >= 0) & (F.col("pick_index") < F.coalesce("_n", F.lit(0)))
    kept = F.when(indexed, F.col("pick_title") == F.col("_at")).otherwise(F.coalesce("_any", F.lit(False)))
    ok = F.coalesce(kept, F.lit(False)) & T.is_clear(F.col("pick_title")) & (F.col("pick_confidence") >= threshold)
    return j.select(id_col, F.when(ok, F.col("pick_title")).alias("title"), ok.alias("accepted"))


def slim_candidates(ranked: DataFrame, needs_abstract: DataFrame, id_col: str = "doc_id", k: int = 3) -> DataFrame:
    """TK-6: first three candidates per document and provider; the abstract (500 characters) only where it is missing."""
    top = first_rows(ranked, [id_col, "provider"], [F.col("pos")], k, "slim_rank")
    flag = needs_abstract.select(id_col).distinct().withColumn("_need", F.lit(True))
    return top.join(flag, id_col, "left").withColumn("abstract", F.when(F.col("_need"), F.left("abstract", F.lit(500)))).drop("_need")


def match_corpus(docs: DataFrame, candidates: DataFrame, k: int = 1, permille: int = 900) -> DataFrame:
    """JN-11: best candidates of every document over the whole corpus.

    ``docs``: doc_id, title, doi;  ``candidates``: cand_id, title, doi.
    A candidate counts if its DOI is equal or its title has a ratio of at least ``permille`` thousandths; none of
    these is lost.  Work is done on distinct titles: copies of a title are matched once and join back at the end,
    and of equal candidate titles the k smallest ids stand for all, which is what a top-k can show.
    """
    def titles(df: DataFrame, id_col: str) -> DataFrame:
        return df.select(id_col, T.collapse(T.match_text(F.col("title"))).alias("t"), T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi"))

    d, c = materialize(titles(docs, "doc_id"), "corpus-titles"), materialize(titles(candidates, "cand_id"), "candidate-titles")
    reps = first_rows(c.where("t <> ''"), ["t"], [F.col("cand_id")], k, "_rep").select("t", "cand_id")
    # A title that k candidates carry themselves has its best: nothing is more alike than an equal title.
    full = reps.groupBy("t").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("t")
    equal = d.where("t <> ''").select("t").distinct().join(full, "t", "left_semi").select(F.col("t").alias("our"), F.col("t").alias("their"), F.lit(1.0).alias("similarity"))
    scored = equal.unionByName(similar_titles(d.join(full, "t", "left_anti"), c, permille))
    best = first_rows(scored, ["our"], [F.col("similarity").desc(), F.col("their")], k, "_rk").select("our", "their", "similarity")
    by_title = d.join(best, d["t"] == best["our"]).join(reps, F.col("their") == reps["t"]).select(
        "doc_id", "cand_id", "similarity", F.lit(False).alias("by_doi"))
    # An equal DOI counts 0.98, and as an equal title where the titles are equal too.
    doi_rep = first_rows(c.where("doi <> ''"), ["doi"], [F.col("cand_id")], k, "_rep").select("doi", "cand_id", F.col("t").alias("their"))
    alike = F.when((F.col("t") == F.col("their")) & (F.col("t") != ""), 1.0).otherwise(0.98)
    by_doi = d.where("doi <> ''").join(doi_rep, "doi").select("doc_id", "cand_id", alike.alias("similarity"), F.lit(True).alias("by_doi"))
    both = by_title.unionByName(by_doi).groupBy("doc_id", "cand_id").agg(F.max("similarity").alias("similarity"), F.bool_or("by_doi").alias("by_doi"))
    return first_rows(both, ["doc_id"], [F.col("by_doi").desc(), F.col("similarity").desc(), F.col("cand_id")], k)

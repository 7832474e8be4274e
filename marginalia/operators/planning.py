"""Document typing and analysis plans (DS-12 .. DS-16, first half of DS-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T

LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
CANDIDATE = (
    r"(?iU)^(?:(?:\d+(?:[.．]\d+)*(?:[.．、])?|[IVXLCDM]+\.?|[一二三四五六七八九十百]+[、.．]|第[一二三四五六七八九十百\d]+[章节])\s*)?"
    r"(?:[A-Za-z][A-Za-z \-]{2,80}|[一-鿿][一-鿿A-Za-z0-9、与及和\-—— ]{1,50})\z"
)


def distinct_keep_order(arr: Column) -> Column:
    """Case-insensitive distinct of a short array, first spelling kept."""
    lowered = F.transform(arr, lambda x: F.lower(x))
    return F.filter(arr, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def with_heading_candidates(docs: DataFrame, text_col: str = "raw_text", limit: int = 40, name: str = "titles") -> DataFrame:
    """DS-12: heading-like lines of the first 60,000 characters, first ``limit``, distinct."""
    lines = F.transform(F.split(F.left(text_col, F.lit(60000)), LINE_ENDS), T.collapse)
    keep = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("--- Page")) & (F.length(x) <= 120)
                    & ~x.rlike("[。！？]") & x.rlike(CANDIDATE))
    staged = docs.withColumn("_cand", F.slice(keep, 1, limit))
    return staged.withColumn(name, distinct_keep_order(F.col("_cand"))).drop("_cand")


def with_document_type(docs: DataFrame, titles_col: str = "titles", text_col: str = "raw_text", preview: int = 3000,
                       rules: list[tuple[str, int, str]] = K.TYPE_RULES) -> DataFrame:
    """DS-13: integer score per type, best type (fixed order on ties), total signal and confidence.

    Expects optional columns title, abstract and page_count; ``rules`` may be re-keyed.
    """
    opt = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in docs.columns else F.lit(default)
    body = F.left(F.left(text_col, F.lit(preview)), F.lit(8000))
    combined = F.concat_ws("\n", F.col(titles_col), F.array(body, opt("title", ""), opt("abstract", "")))
    types = list(K.DOC_TYPES)
    staged = docs.withColumn("_all", combined)
    pages = opt("page_count", 0)
    score = {t: F.lit(1 if t == "generic_research" else 0) for t in types}
    for kind, weight, pattern in rules:
        score[kind] = score[kind] + F.when(F.col("_all").rlike(f"(?U){pattern}"), weight).otherwise(0)
    score["thesis_or_report"] = score["thesis_or_report"] + F.when((F.length(text_col) > 120000) | (pages > 50), 2).otherwise(0)
    staged = staged.select("*", *[score[t].cast("bigint").alias(f"score_{t}") for t in types]).drop("_all")
    best = F.greatest(*[F.col(f"score_{t}") for t in types])
    total = F.greatest(sum((F.col(f"score_{t}") for t in types if t != "generic_research"), F.lit(0)), F.lit(1))
    staged = staged.withColumn("best_score", best).withColumn("total_signal", total.cast("bigint"))
    pick = F.coalesce(*[F.when(F.col(f"score_{t}") == F.col("best_score"), F.lit(t)) for t in types])
    staged = staged.withColumn("paper_type", pick)
    conf = F.when(F.col("paper_type") == "generic_research", F.lit(0.45)).otherwise(
        F.least(F.lit(0.95), F.lit(0.55) + F.col("best_score") / (F.col("total_signal") + 4)))
    return staged.withColumn("type_confidence", F.round(conf, 2))


def size_level(length: Column, pages: Column) -> Column:
    """DS-14."""
    return F.when((length >= 120000) | (F.coalesce(pages, F.lit(0)) > 50), "huge").when(length >= 40000, "large").otherwise("normal")


def _config(kind: Column, part: int) -> Column:
    out = None
    for t, conf in K.DOC_TYPES.items():
        value = F.array(*[F.lit(x) for x in conf[part]]) if isinstance(conf[part], list) else F.lit(conf[part])
        out = F.when(kind == t, value) if out is None else out.when(kind == t, value)
    return out


def lookup_policy(language: Column, has_doi: Column, has_arxiv: Column, english: Column, title: Column) -> tuple[Column, Column, Column]:
    """Metadata-lookup policy: use it, which providers, why."""
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    blocked = (language == "zh") & ~(has_doi | has_arxiv | english)
    titled = (language == "en") & (F.coalesce(title, F.lit("")) != "")
    use = F.when(blocked, False).when(titled, True).otherwise(has_doi | has_arxiv)
    tools = F.when(blocked, arr()).when(titled | has_arxiv, arr("arxiv", "crossref", "openalex")).when(has_doi, arr("crossref", "openalex")).otherwise(arr())
    reason = F.when(blocked, "zh_without_identifier") \
        .when(titled, "en_title") \
        .otherwise("only_with_identifier")
    return use, tools, reason


def rule_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", preview: int = 3000,
              rules: list[tuple[str, int, str]] = K.TYPE_RULES) -> DataFrame:
    """DS-15: one plan row per document.  Everything is computed inside the row."""
    d = docs
    for c, v in (("title", ""), ("abstract", ""), ("page_count", None)):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(v).cast("int" if c == "page_count" else "string"))
    d = with_document_type(with_heading_candidates(d, text_col), "titles", text_col, preview, rules)
    doi, arxiv = T.identifier_flags(F.left(text_col, F.lit(preview)))
    d = d.withColumn("has_doi", doi).withColumn("has_arxiv_id", arxiv) \
        .withColumn("has_english_title_signal", F.coalesce(T.english_title_signal(F.col("title")), F.lit(False))) \
        .withColumn("size_level", size_level(F.length(text_col), F.col("page_count")))
    use, tools, reason = lookup_policy(F.col("paper_language"), F.col("has_doi"), F.col("has_arxiv_id"),
                                       F.col("has_english_title_signal"), F.col("title"))
    big = F.col("size_level") != "normal"
    risks = F.array_compact(F.array(F.when(big, "large_document_truncation_risk"), F.when(F.col("type_confidence") < 0.65, "weak_paper_type_signal")))
    kind = F.col("paper_type")
    return d.select(
        id_col, "paper_language", "paper_type", _config(kind, 2).alias("structure_type"), "type_confidence", "best_score", "total_signal",
        _config(kind, 0).alias("required"), _config(kind, 1).alias("optional"), _config(kind, 3).alias("focus"),
        use.alias("use_external_lookup"), tools.alias("allowed_tools"), reason.alias("lookup_reason"),
        "size_level", big.alias("use_chunking"), risks.alias("risks"), "has_doi", "has_arxiv_id", "has_english_title_signal", "titles",
        F.length(text_col).cast("bigint").alias("raw_text_length"), "page_count")


def validate_plan(plan: DataFrame, external: DataFrame, id_col: str = "doc_id", threshold: float = 0.7,
                  repair_allowed: bool = False, max_rounds: int = 1) -> DataFrame:
    """DS-16: accept an outside plan only within the rules; every correction leaves a warning.

    ``external``: id, ext_confidence, ext_type, ext_required, ext_optional, ext_use_lookup, ext_repair, ext_rounds.
    """
    known = F.array(*[F.lit(s) for s in K.PLAN_SECTIONS])
    j = plan.join(external, id_col, "left")
    given = F.col("ext_confidence").isNotNull()
    ok = given & (F.col("ext_confidence") >= threshold)
    valid_type = F.col("ext_type").isin(list(K.DOC_TYPES))
    j = j.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn(
        "_type", F.when(F.col("accepted") & F.coalesce(valid_type, F.lit(False)), F.col("ext_type")).otherwise(F.col("paper_type")))
    clean = lambda c: F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), known)
    j = j.withColumn("_req", clean("ext_required"))
    j = j.withColumn("_required", F.when(F.size("_req") > 0, F.col("_req")).otherwise(_config(F.col("_type"), 0)))
    j = j.withColumn("_opt", F.array_except(clean("ext_optional"), F.col("_required")))
    j = j.withColumn("_optional", F.when(F.size("_opt") > 0, F.col("_opt")).otherwise(F.array_except(_config(F.col("_type"), 1), F.col("_required"))))
    forced = (F.col("paper_language") == "zh") & ~F.col("has_doi") & ~F.col("has_arxiv_id") & ~F.col("has_english_title_signal")
    acc = F.col("accepted")
    repair = F.coalesce("ext_repair", F.lit(False))
    rounds = F.least(F.coalesce(F.nullif("ext_rounds", F.lit(0)), F.lit(max_rounds)), F.lit(max_rounds))
    warn = F.array_compact(F.array(
        F.when(given & ~acc, "low_confidence"),
        F.when(acc & ~F.coalesce(valid_type, F.lit(False)), "invalid_paper_type"),
        F.when(acc & (F.size("_req") == 0), "required_sections_defaulted"),
        F.when(acc & forced, "lookup_forced_off"),
        F.when(acc & repair & F.lit(not repair_allowed), "repair_not_enabled")))
    keep = lambda c, o: F.when(acc, c).otherwise(o)
    return j.select(
        id_col, "accepted", F.col("_type").alias("paper_type"), keep(F.col("_required"), F.col("required")).alias("required"),
        keep(F.col("_optional"), F.col("optional")).alias("optional"),
        keep(F.when(forced, False).otherwise(F.coalesce("ext_use_lookup", "use_external_lookup")), F.col("use_external_lookup")).alias("use_external_lookup"),
        keep(repair & F.lit(repair_allowed), F.lit(repair_allowed)).alias("repair_enabled"),
        keep(rounds, F.lit(max_rounds)).cast("bigint").alias("repair_rounds"), warn.alias("warnings"))


def plan_decisions(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-22: decision rows of the planning step."""
    shown = F.array_join(F.slice("titles", 1, 8), ", ")
    why = F.when(F.size("titles") > 0, F.concat(F.lit("Detected section titles: "), shown)) \
        .otherwise("No strong section titles detected; used bounded text keyword signals")
    first = F.struct(F.concat(F.lit("classified_as_"), F.col("paper_type")).alias("decision"), why.alias("reason"), F.col("type_confidence").alias("confidence"))
    big = F.struct(F.lit("enable_large_pdf_strategy").alias("decision"),
                   F.concat(F.lit("raw_text_length="), F.col("raw_text_length").cast("string"), F.lit(", page_count="),
                            F.coalesce(F.col("page_count").cast("string"), F.lit("None"))).alias("reason"), F.lit(1.0).alias("confidence"))
    rows = F.when(F.col("size_level") != "normal", F.array(first, big)).otherwise(F.array(first))
    return plan.select(id_col, F.explode(rows).alias("d")).select(id_col, "d.*")

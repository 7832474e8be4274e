"""Section quality, repair and their reports (DS-8 .. DS-11, DS-22 second half, DS-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.functions.similarity import similarity
from marginalia.operators import headings as H
from marginalia.scale import settle

REFERENCE_CUT = T.java(T.ahead(r"参考文献|\bReferences\b|\bBibliography\b"))
REFERENCE_MARK = T.java(T.ahead("|".join(K.REFERENCE_PATTERNS)))


def _count(text: Column, pattern: str, flags: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?{flags}){pattern}"))


def references_polluted(text: Column) -> Column:
    """Two kinds of reference marks, or two bracket numbers, in the second half."""
    n = F.length(text)
    half = F.substr(text, (F.floor(n / 2) + 1).cast("int"))
    kinds = sum((F.when(half.rlike(T.java(p)), 1).otherwise(0) for p in K.REFERENCE_PATTERNS), F.lit(0))
    return (n >= 80) & half.rlike(REFERENCE_MARK) & ((kinds >= 2) | (_count(half, K.REFERENCE_PATTERNS[3], "U") >= 2))


def score_sections(sections: DataFrame, id_col: str = "doc_id", language_col: str = "paper_language",
                   text_col: str = "content", source_col: str = "source") -> DataFrame:
    """DS-8: score in integer hundredths, sorted issues and warnings."""
    s = sections.withColumn("_c", T.strip(F.coalesce(text_col, F.lit(""))))
    c, name = F.col("_c"), F.col("section")
    minimum = lambda table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), F.lit(100))
    s = s.withColumn("_short", F.length(c) < F.when(F.col(language_col) == "zh", minimum(K.ZH_MIN_LENGTHS)).otherwise(minimum(K.EN_MIN_LENGTHS)))
    major = name.isin("method", "experiments", "conclusion")
    headings = sum((_count(c, p, "imdU") for p in K.HEADING_COUNT_PATTERNS), F.lit(0))
    tests = {
        "_missing": c.isin(K.UNCLEAR_SECTION_VALUES),
        "_refs": major & references_polluted(c),
        "_kw": (name == "abstract") & c.rlike(T.java(T.ahead(K.KEYWORD_MARKERS))),
        "_intro": (name == "abstract") & (F.length(c) >= 300) & c.rlike(T.java(T.ahead(K.INTRO_MARKERS))),
        "_tail": (name == "conclusion") & c.rlike(T.java(T.ahead(K.CONCLUSION_MARKERS))),
        "_result": name.isin("method", "experiments") & c.rlike(T.java(T.ahead(K.RESULT_TERMS))),
        "_method": (name == "experiments") & c.rlike(T.java(T.ahead(K.METHOD_TERMS))),
        "_multi": headings >= 2,
        "_nosource": major & F.coalesce(source_col, F.lit("")).isin("", "missing"),
    }
    s = s.select("*", *[v.alias(k) for k, v in tests.items()])
    flag = lambda k, points: F.when(F.col(k), points).otherwise(0)
    mixed_m = (name == "method") & F.col("_result")
    mixed_e = (name == "experiments") & F.col("_method") & ~F.col("_result")
    raw = (
        F.when(F.col("_missing"), 0).when(F.col("_short"), 55).otherwise(100)
        - flag("_refs", 35) - flag("_kw", 25) - flag("_intro", 35) - flag("_tail", 35)
        - F.when(mixed_m, 10).otherwise(0) - F.when(mixed_e, 15).otherwise(0) - flag("_multi", 10)
    )
    capped = F.when(F.col("_nosource"), F.least(raw, F.lit(40))).otherwise(raw)
    word = lambda cond, w: F.when(cond, F.lit(w))
    issues = F.array_sort(F.array_compact(F.array(
        word(F.col("_missing"), "missing"), word(~F.col("_missing") & F.col("_short"), "missing_or_too_short"),
        word(F.col("_refs"), "references_pollution"), word(F.col("_kw") | F.col("_intro"), "abstract_boundary_issue"),
        word(F.col("_tail"), "conclusion_pollution"), word(F.col("_nosource"), "meta_source_missing"))))
    warnings = F.array_sort(F.array_compact(F.array(
        word(mixed_m, "possible_experiment_content"), word(mixed_e, "possible_method_content"),
        word(F.col("_multi"), "contains_multiple_section_headings"))))
    return settle(s.select(
        *[x for x in sections.columns],
        F.greatest(F.lit(0), F.least(F.lit(100), capped)).cast("bigint").alias("score"),
        F.length("_c").cast("bigint").alias("clean_length"), issues.alias("issues"), warnings.alias("warnings")))


def evaluate(scored: DataFrame, plan: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """DS-9: status, blocking issues and optional warnings per section.

    ``plan`` has (id, required ARRAY, optional ARRAY); documents without a plan use the defaults.
    """
    known = F.array(*[F.lit(k) for k in K.SECTION_KEYS])
    default_required = F.array(*[F.lit(k) for k in K.DEFAULT_REQUIRED])
    default_optional = F.array(*[F.lit(k) for k in K.DEFAULT_OPTIONAL])
    if plan is None:
        s = scored.withColumn("_req", default_required).withColumn("_opt", default_optional)
    else:
        req = F.array_intersect("required", known)
        opt = F.array_intersect("optional", known)
        p = plan.select(id_col, F.when(F.size(req) > 0, req).otherwise(default_required).alias("_req"),
                        F.when(F.size(opt) > 0, opt).otherwise(default_optional).alias("_opt"))
        s = scored.join(p, id_col, "left").withColumn("_req", F.coalesce("_req", default_required)) \
            .withColumn("_opt", F.coalesce("_opt", default_optional))
    name, issues = F.col("section"), F.col("issues")
    status = F.when(F.array_contains("_req", name), "required").when(F.array_contains("_opt", name), "optional").otherwise("ignored")
    has = lambda i: F.array_contains(issues, i)
    blocking = F.array_sort(F.array_compact(F.array(
        F.when(F.col("score") < F.when(name == "conclusion", 40).otherwise(45), "low_quality"),
        F.when(has("missing") | has("missing_or_too_short"), "missing_or_too_short"),
        F.when(has("meta_source_missing"), "meta_source_missing"),
        F.when(has("references_pollution"), "references_pollution"),
        F.when((name == "abstract") & has("abstract_boundary_issue"), "abstract_boundary_issue"),
        F.when((name == "conclusion") & has("conclusion_pollution"), "conclusion_pollution"))))
    s = s.withColumn("status", status)
    s = s.withColumn("blocking", F.when(F.col("status") == "required", blocking).otherwise(F.array().cast("array<string>")))
    note = F.when((F.col("status") == "optional") & has("missing"), F.concat(name, F.lit(" optional_missing"))) \
        .when((F.col("status") == "optional") & (F.size(issues) > 0), F.concat(name, F.lit(" optional_quality_issue")))
    return s.withColumn("optional_warning", note).drop("_req", "_opt")


def repair_reasons(evaluated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-9: per document, sorted repair reasons and optional warnings.  At most six rows per document meet."""
    reasons = F.transform("blocking", lambda b: F.concat(F.col("section"), F.lit(" "), b))
    return evaluated.select(id_col, reasons.alias("r"), "optional_warning").groupBy(id_col).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("reasons"),
        F.array_sort(F.collect_set("optional_warning")).alias("optional_warnings")) \
        .withColumn("needs_repair", F.size("reasons") > 0)


def duplicate_sections(wide: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-10: method and experiments whose first 500 characters are alike (>= 0.88).

    ``wide`` is the SK-1 pivot, so both texts are already in one row and no join is needed.
    """
    both = wide.where((F.col("method") != "") & (F.col("experiments") != ""))
    sim = similarity(F.left("method", F.lit(500)), F.left("experiments", F.lit(500)))
    return both.select(id_col, sim.alias("similarity")).withColumn("duplicate", F.col("similarity") >= 0.88)


def abstract_from_raw(raw: Column) -> Column:
    """DS-11: abstract re-bounded from the raw text; struct or NULL."""
    b = H.BLANK
    start_re = f"(?imd)^{b}(摘\\s*要|内容摘要|中文摘要|Abstract){b}[:：]?{b}"
    end_re = f"(?imd)^{b}(?:关\\s*键\\s*词|关键字|Keywords|Index Terms|引言|绪论|Introduction){b}[:：.。．\\-]?"
    at = F.regexp_instr(raw, F.lit(start_re))
    begin = (at - 1 + F.length(F.regexp_extract(raw, start_re, 0))).cast("bigint")
    stop = F.regexp_instr(F.concat(F.lit("x"), F.substr(raw, begin + 1)), F.lit(end_re))
    end = F.when(stop > 0, begin + stop - 2).otherwise(F.least(F.length(raw).cast("bigint"), begin + 2000))
    full = T.strip(F.substr(raw, begin + 1, end - begin))
    return F.when((at > 0) & (F.length(full) >= 20), F.struct(
        F.left(full, F.lit(2000)).alias("content"), T.strip(F.regexp_extract(raw, start_re, 1)).alias("title"),
        begin.alias("start_char"), F.when(F.length(full) > 2000, begin + 2000).otherwise(end).alias("end_char")))


def fresh_abstract(scored: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Scored sections that carry the raw text -> the same with the re-bounded abstract, where its bounds are in doubt, in its place."""
    doubt = (F.col("section") == "abstract") & F.array_contains("issues", "abstract_boundary_issue")
    return scored.withColumn("fresh", F.when(doubt, abstract_from_raw(F.col(text_col)))).drop(text_col)


def repair(evaluated: DataFrame, rules: DataFrame | None = None, docs: DataFrame | None = None, id_col: str = "doc_id",
           text_col: str = "raw_text", kept_texts: bool = True) -> DataFrame:
    """DS-11: one repair pass over documents that need it; action is kept, truncated, recopied or rebounded.

    Without ``rules`` the sections are the rule's own, and without ``docs`` they have the column fresh of ``fresh_abstract``; then no
    text needs a partner, and what a document's other sections say arrives as one narrow row.  ``evaluated`` is read more than once:
    store it first.  With ``kept_texts`` off, only changed sections have a content.
    """
    needed = repair_reasons(evaluated, id_col).select(id_col, "needs_repair")
    if rules is None:
        j = evaluated.withColumn("rule_text", F.col("content"))
    else:
        j = evaluated.join(rules.select(id_col, "section", F.col("content").alias("rule_text")), [id_col, "section"], "left")
    if docs is not None:
        # The raw text travels only for documents whose abstract must be re-bounded.
        suspects = evaluated.where((F.col("section") == "abstract") & F.array_contains("issues", "abstract_boundary_issue")).select(id_col)
        fresh = docs.select(id_col, text_col).join(suspects, id_col, "left_semi").select(
            id_col, F.lit("abstract").alias("section"), abstract_from_raw(F.col(text_col)).alias("fresh"))
        j = j.join(fresh, [id_col, "section"], "left")
    name, issues, text = F.col("section"), F.col("issues"), F.coalesce("content", F.lit(""))
    has = lambda *xs: F.arrays_overlap(issues, F.array(*[F.lit(x) for x in xs]))
    # The text is searched for a cut only where one may be made.
    cuttable = name.isin("method", "experiments", "conclusion") & has("references_pollution", "conclusion_pollution")
    at = F.when(cuttable, F.regexp_instr(text, F.lit(REFERENCE_CUT)))
    j = j.withColumn("_at", at).withColumn("_cut", F.when(F.col("_at") > 0, T.strip(F.left(text, F.col("_at") - 1))))
    can_cut = cuttable & (F.length("_cut") > 0) & (F.length("_cut") < F.length(T.strip(text)))
    bad = F.when(name.isin("method", "experiments"), (F.col("score") < 45) | has("missing", "missing_or_too_short", "meta_source_missing")) \
        .when(name == "conclusion", (F.col("score") < 40) | has("missing", "missing_or_too_short", "meta_source_missing",
                                                             "references_pollution", "conclusion_pollution")).otherwise(False)
    copied = T.strip(F.coalesce("rule_text", F.lit("")))
    # What would be done is settled before documents meet, so a row travels with the text that it keeps and the one it may get, if any.
    change = (
        F.when(F.coalesce(can_cut, F.lit(False)), F.struct(F.lit("truncated").alias("action"), F.col("_cut").alias("content")))
        .when(bad & (copied != ""), F.struct(F.lit("recopied").alias("action"), copied.alias("content")))
        .when((name == "abstract") & F.col("fresh").isNotNull(), F.struct(F.lit("rebounded").alias("action"), F.col("fresh.content").alias("content")))
    )
    kept = text if kept_texts else F.lit(None).cast("string")
    j = settle(j.select(id_col, "section", "paper_language", F.col("score").alias("score_before"), kept.alias("content"), "source", change.alias("_change")))
    j = j.join(needed, id_col)
    done = F.col("needs_repair") & F.col("_change").isNotNull()
    return j.select(
        id_col, "section", "paper_language", F.when(done, F.col("_change.action")).otherwise("kept").alias("action"), "score_before",
        F.when(done, F.col("_change.content")).otherwise(F.col("content")).alias("content"),
        F.when(done, F.lit("rule_repair")).otherwise(F.col("source")).alias("source"))


def rescored(repaired: DataFrame) -> DataFrame:
    """DS-11: the score after repair; what was kept keeps its score, so its text is not read again."""
    kept = F.col("action") == "kept"
    work = repaired.withColumn("content", F.when(~kept, F.col("content")))
    scored = score_sections(work).drop("content", "issues", "warnings", "clean_length")
    return scored.withColumn("score", F.when(kept, F.col("score_before")).otherwise(F.col("score")))


def unresolved(rescored: DataFrame) -> DataFrame:
    """DS-11: sections still below their threshold after repair."""
    limit = F.when(F.col("section") == "conclusion", 40).otherwise(45)
    return rescored.where(F.col("section").isin("method", "experiments", "conclusion") & (F.col("score") < limit))


def verify_decisions(evaluated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-22: one row per verification decision."""
    optional = F.when((F.col("status") == "optional") & F.array_contains("issues", "missing"), F.array(F.struct(
        F.concat("section", F.lit("_missing_but_optional")).alias("decision"), F.col("section").alias("reason"), F.lit(90).alias("confidence"))))
    repairs = F.transform("blocking", lambda b: F.struct(F.lit("needs_section_repair").alias("decision"),
                          F.concat(F.lit("required section issue: "), F.col("section"), F.lit(" "), b).alias("reason"), F.lit(85).alias("confidence")))
    rows = F.concat(F.coalesce(optional, F.array().cast("array<struct<decision:string,reason:string,confidence:int>>")), repairs)
    return evaluated.select(id_col, F.explode(rows).alias("d")).select(
        id_col, "d.decision", "d.reason", F.col("d.confidence").cast("bigint").alias("confidence"))


def section_report(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """DS-22: one readable line per section."""
    line = F.concat(F.lit("- "), "section", F.lit(": source="), "source", F.lit(", matched_title='"), "matched_title",
                    F.lit("', length="), F.col("length").cast("string"), F.lit(", confidence="),
                    F.col("confidence").cast("string"), F.lit(", warning="), "warning")
    return sections.select(id_col, "section", line.alias("line"))


def pivot_sections(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SK-1: one row per document, one column per section (six rows meet per document)."""
    picks = [F.max(F.when(F.col("section") == k, F.col("content"))).alias(k) for k in K.SECTION_KEYS]
    return sections.groupBy(id_col).agg(*picks)


def wide_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", keep: list[str] = (), keep_text: bool = False) -> DataFrame:
    """SK-1 without an exchange: the pivot is taken inside the row before any explode."""
    parts = H.with_sections(docs.select(id_col, text_col, *keep), text_col)
    col = lambda k: F.array_join(F.transform(F.filter("_parts", lambda p: p["section"] == k), lambda p: p["content"]), "\n\n").alias(k)
    return settle(parts.select(id_col, *keep, *([text_col] if keep_text else []), *[col(k) for k in K.SECTION_KEYS]))


def analysis_input(wide: DataFrame, id_col: str = "doc_id", cap: int = 20000) -> DataFrame:
    """DS-23: text handed to the method and experiment analyses."""
    blank = lambda k: F.coalesce(k, F.lit(""))
    method = F.concat_ws("\n\n", *[blank(k) for k in ("abstract", "introduction", "related_work", "method")])
    return wide.select(id_col, F.left(method, F.lit(cap)).alias("method_input"), F.left(blank("experiments"), F.lit(cap)).alias("experiment_input"))

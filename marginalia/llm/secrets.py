"""Secret scans over an incremental ledger of blobs.

Every version of every file is named by the SHA-256 of its content.  A ledger holds the findings of each pair of
blob and rule version that was ever scanned; a run scans only pairs it does not hold, one text per distinct blob,
and joins the findings back to all paths with that content.

Built from DataFrame functions only.  Positions come from the pieces between the matches: the running lengths of
pieces and matches give each start, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.scale import materialize

# Rule kinds in report order, pattern, and least length of the part that counts (group 2 for assign).
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]+", 16),
]
RULE_VERSION = "1"

FINDING = "array<struct<start:int,kind_no:int,kind:string,end:int,match:string>>"


def _pattern(kind: str, pattern: str, least: int) -> str:
    """A form that skips short runs at once.

    Where the whole match is one run of a class, matches that fail the length lie in runs too short for any
    match, so asking for the length inside the pattern gives the same spans.  An assignment that fails still
    consumes its text, so its pattern stays as it is and short values are dropped afterwards.
    """
    if kind == "access":
        return pattern[:-1] + "{%d,}" % (least - 4)
    return pattern[:-1] + "{%d,}" % least if kind == "hex" else pattern


def _kind_spans(text: Column, no: int, kind: str, pattern: str, least: int) -> Column:
    used = _pattern(kind, pattern, least)
    matches = F.regexp_extract_all(text, F.lit(used), F.lit(0))
    zipped = F.arrays_zip(F.split(text, used, -1).alias("gap"), matches.alias("match"))  # one gap more than matches
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        counted = F.regexp_extract(x["match"], used, 2) if kind == "assign" else x["match"]
        found = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(F.char_length(counted) >= least, F.array_append(s["out"], found)).otherwise(s["out"]).alias("out"))

    # The cheap test spares texts without a match the splitting.
    return F.when(text.rlike(used), F.aggregate(zipped, begin, step, lambda s: s["out"])).otherwise(F.array().cast(FINDING))


def findings(text: Column) -> Column:
    """All spans of one text, ordered by start and then kind."""
    return F.array_sort(F.concat(*[_kind_spans(text, no, *rule) for no, rule in enumerate(RULES)]))


def blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``blob_id``, the SHA-256 of the content; a null content is empty."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str, text_col: str = "text") -> DataFrame:
    """blob_id and content of each distinct blob that the ledger does not hold under this rule version."""
    content = blobs(versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("content")), "content")
    if ledger is not None:
        held = ledger.where(F.col("rule_version") == rule_version).select("blob_id")
        content = content.join(held, "blob_id", "left_anti")
    return content.groupBy("blob_id").agg(F.first("content").alias("content"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob_id, rule_version, findings) for the pairs not yet in the ledger.

    Blobs without findings get a row too, so they are not read again.
    """
    fresh = unseen(versions, ledger, rule_version, text_col)
    return fresh.select("blob_id", F.lit(rule_version).alias("rule_version"), findings(F.col("content")).alias("findings"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, path_cols: list[str], rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """One row per version: its path columns, ``blob_id`` and ``findings`` (empty where there are none).

    Only ledger rows with findings are joined; a content that a third of all paths share meets one narrow row.
    """
    keyed = blobs(versions.select(*[F.col(c) for c in path_cols], F.col(text_col).alias("_content")), "_content").select(*path_cols, F.col("blob_id"))
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob_id").alias("_blob"), F.col("findings").alias("_found"))
    return keyed.join(hits, keyed["blob_id"] == hits["_blob"], "left").select(*path_cols, "blob_id", F.coalesce("_found", F.array().cast(FINDING)).alias("findings"))


def document_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row per document with counts and spans; documents are the paths, their texts the blobs.

    Null texts count as empty, repeated rows each give a row, other columns are ignored, an empty table gives an
    empty result.
    """
    rows = docs.select("doc_id", "text")
    fresh = materialize(scan(rows, ledger), "secret-ledger")
    known = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    out = findings_by_path(rows, known, ["doc_id"])
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k, _, _ in RULES], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))

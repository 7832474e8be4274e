"""JSON values: leaves as rows (PR-10, UD-4), bounded walks (PR-9, PR-11)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType

from marginalia import constants as K
from marginalia.functions import text as T

LEAF_TYPE = StructType([StructField("path", StringType()), StructField("value", StringType())])


def _children(v: Column, path: Column) -> tuple[Column, Column]:
    """Children of one value as (path, v) structs, NULL for a leaf or an empty container; and whether there are any."""
    kind = F.schema_of_variant(v)
    name = lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))
    obj = F.map_entries(v.try_cast("map<string,variant>"))
    arr = v.try_cast("array<variant>")
    kids = (
        F.when(F.startswith(kind, F.lit("OBJECT")) & (F.size(obj) > 0), F.transform(obj, lambda e: F.struct(name(e["key"]).alias("path"), e["value"].alias("v"))))
        .when(F.startswith(kind, F.lit("ARRAY")) & (F.size(arr) > 0), F.transform(arr, lambda x, i: F.struct(name(i.cast("string")).alias("path"), x.alias("v"))))
    )
    return kids, kids.isNotNull()


def _opened(df: DataFrame, keys: list[str], json_col: str, depth: int) -> DataFrame:
    root = F.struct(F.lit("").alias("path"), F.try_parse_json(json_col).alias("v"))
    rows = df.select(*keys, root.alias("n"))
    for _ in range(depth):
        path, v = F.col("n.path"), F.col("n.v")
        kids, _some = _children(v, path)
        rows = rows.select(*keys, F.explode(F.coalesce(kids, F.array(F.struct(path.alias("path"), v.alias("v"))))).alias("n"))
    return rows.where("n.v IS NOT NULL")


def json_leaves(df: DataFrame, keys: list[str], json_col: str, depth: int = 4) -> DataFrame:
    """keys + (path, value) of all leaves, in the JVM; empty containers stay as rows.

    Every level is one explode inside the row, so there is no exchange.  ``depth`` is where to begin: as long as
    some value is still open there, twice as many levels are opened.
    """
    rows = _opened(df, keys, json_col, depth)
    while rows.where(_children(F.col("n.v"), F.col("n.path"))[1]).limit(1).count():
        depth *= 2
        rows = _opened(df, keys, json_col, depth)
    return rows.select(*keys, "n.path", F.expr("coalesce(try_cast(n.v AS string), to_json(n.v))").alias("value"))


def json_text(text: Column) -> Column:
    """A string as JSON, with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _members(v: Column, kind: Column, items: int) -> Column:
    """First entries of a container as (key, v), with null keys in a list; null for other values."""
    obj, arr = F.slice(F.map_entries(v.try_cast("map<string,variant>")), 1, items), F.slice(v.try_cast("array<variant>"), 1, items)
    return (
        F.when(F.startswith(kind, F.lit("OBJECT")), F.transform(obj, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"))))
        .when(F.startswith(kind, F.lit("ARRAY")), F.transform(arr, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("v"))))
    )


def _reference(v: Column) -> tuple[Column, Column]:
    """Is an object an evidence reference, and what of it stays: its names and its ranges."""
    at = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    names = [at(n, "string") for n in K.EVIDENCE_NAMES]
    whole = lambda n: (F.schema_of_variant(at(n, "variant")) == "BIGINT") & (at(n, "bigint") >= 0)
    parts = [F.concat(F.lit(f'"{n}":'), json_text(c)) for n, c in zip(K.EVIDENCE_NAMES, names)]
    parts += [F.when(whole(n), F.concat(F.lit(f'"{n}":'), at(n, "string"))) for n in ("offset", "shown_chars", "max_chars")]
    return T.valid_ref(*names), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _clean(text: Column, limit: int) -> Column:
    return T.let(T.redact(text), lambda t: json_text(T.bounded(t, limit)))


def _masked(v: Column, depth: int, text_limit: int, items: int, most: int, references: bool) -> Column:
    if depth >= most:
        return F.lit('"[truncated]"')

    def by_kind(kind: Column) -> Column:
        def member(e: Column) -> Column:
            hidden = F.coalesce(F.lower(e["key"]).rlike("|".join(K.SENSITIVE_KEY_PARTS)), F.lit(False))
            name = F.when(e["key"].isNull(), "").otherwise(F.concat(json_text(e["key"]), F.lit(":")))
            return F.concat(name, F.when(hidden, '"[redacted]"').otherwise(_masked(e["v"], depth + 1, text_limit, items, most, references)))

        # The members stand here once: named twice, eight levels would be an expression of 256 copies.
        is_object, members = F.startswith(kind, F.lit("OBJECT")), _members(v, kind, items)
        inner = F.array_join(F.transform(members, member), ",")
        value = F.concat(F.when(is_object, "{").otherwise("["), inner, F.when(is_object, "}").otherwise("]"))
        text = _clean(v.try_cast("string"), text_limit)
        out = F.when(kind == "STRING", text).when(is_object | F.startswith(kind, F.lit("ARRAY")), value).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
        if not references:
            return out
        is_ref, kept = _reference(v)
        return F.when(is_object & is_ref, kept).otherwise(out)

    return T.let(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), by_kind)


def safe_json(text: Column, text_limit: int = 2000, items: int = 100, most: int = 8, references: bool = False) -> Column:
    """PR-9: JSON with secrets hidden at every level, texts redacted and bounded, ``items`` entries per container.

    Values deeper than ``most`` levels read "[truncated]"; keys come in order of name, and the first ``items`` of that
    order stay.  With ``references``, an evidence reference keeps its names and ranges whole, and nothing else.  What is
    no JSON (or has a key twice in one object) is treated as one string; null stays null.  Depth is bounded, so the walk
    is one SQL expression: it needs no Python worker and runs on streams.
    """
    plain = _clean(text, text_limit)
    walked = T.let(F.try_parse_json(text), lambda v: F.when(v.isNull(), plain).otherwise(_masked(v, 0, text_limit, items, most, references)))
    return F.when(text.isNotNull(), walked)


COUNTERS = "array<struct<key:string,value:double>>"


def _counters(entries: Column, path: Column, depth: int, items: int, most: int) -> Column:
    """Counters among the entries (key, value) of an object and below it."""
    def member(e: Column) -> Column:
        name = F.concat(path, e["key"])
        number = F.array(F.struct(name.alias("key"), e["value"].try_cast("double").alias("value")))
        # The schema of a value is asked for single values only: of an object it would be made for all that is below.
        number = F.when(F.schema_of_variant(e["value"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number).otherwise(F.array().cast(COUNTERS))
        below = F.array().cast(COUNTERS) if depth + 1 >= most else None
        counted = T.let(_entries(e["value"], items), lambda inner: F.when(
            inner.isNotNull(), below if below is not None else _counters(inner, F.concat(name, F.lit(".")), depth + 1, items, most)).otherwise(number))
        return F.when(e["key"].rlike("^[a-z_]*tokens(_details)?\\z"), counted).otherwise(F.array().cast(COUNTERS))

    return F.flatten(F.transform(entries, member))


def _entries(v: Column, items: int) -> Column:
    """First entries of an object; null for any other value."""
    return F.slice(F.map_entries(v.try_cast("map<string,variant>")), 1, items)


def usage_counts(text: Column, items: int = 50, most: int = 4) -> Column:
    """PR-11: numeric '*tokens' and '*tokens_details' counters down to ``most`` levels, nested names joined by dots.

    Numbers in quotes and truth values are no counters; ``items`` entries of a level, in order of name, are looked at.
    What is no JSON has no counters; null stays null.
    """
    found = T.let(_entries(F.try_parse_json(text), items), lambda top: F.map_from_entries(F.coalesce(_counters(top, F.lit(""), 0, items, most), F.array().cast(COUNTERS))))
    return F.when(text.isNotNull(), found)


@udtf(returnType=LEAF_TYPE)
class JsonLeaves:
    """UD-4: lateral table function for JSON of any depth."""

    def eval(self, text: str):
        try:
            root = json.loads(text or "")
        except ValueError:
            return
        stack = [("", root)]
        while stack:
            path, value = stack.pop()
            if isinstance(value, (dict, list)) and value:
                pairs = value.items() if isinstance(value, dict) else enumerate(value)
                stack.extend(reversed([(f"{path}.{k}" if path else str(k), v) for k, v in pairs]))
            else:
                yield path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

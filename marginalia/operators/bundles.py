"""RT-10: results over several documents as JSON whose encoded length keeps to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions.json_tables import json_text
from marginalia.operators.evidence import LADDER
from marginalia.scale import materialize

# Notes of a bundle.
READBACK = '{"tool":"read_paper_chunk","arguments":["paper_id","parser","cache_version","chunk_id"],"optional":["offset","max_chars"]}'
FACTS_NOTE = "Evidence omitted by total result budget; do not claim it was read."

NAMES = ["parser", "cache_version", "chunk_id", "section"]
MOST_ITEMS = max(items for items, _ in LADDER)
WIDTHS = sorted({chars for _, chars in LADDER}, reverse=True)


def _pairs(*pairs: tuple[str, Column]) -> Column:
    """JSON object of names and encoded values."""
    out = []
    for n, (name, value) in enumerate(pairs):
        out += [F.lit(f'{"," if n else "{"}"{name}":'), value]
    return F.concat(*out, F.lit("}"))


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _chunk(columns: list[str], chars: Column) -> Column:
    text, at = F.col("text"), F.col("offset") if "offset" in columns else F.lit(0)
    plain = _pairs(*[(c, json_text(F.col(c))) for c in NAMES if c in columns], ("text", json_text(F.left(text, chars))))
    more = F.concat(F.lit(',"text_truncated":true,"next_offset":'), (at + chars).cast("string"), F.lit("}"))
    return F.when(F.length(text) > chars, F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), more)).otherwise(plain)


def _document(items: Column, chars: Column, longest: Column, chunks: Column) -> tuple[Column, Column]:
    """Encoded document with the given encoded chunks, and whether anything of it is left out."""
    width = F.least(chars, F.lit(500))
    shown = F.least(F.col("n"), items)
    less, cut = F.col("n") > shown, F.coalesce(longest > chars, F.lit(False))
    note_cut = F.coalesce(F.length("note") > width, F.lit(False))
    covered = F.when(shown == 0, "none").when(less | cut, "partial").otherwise("complete_returned_chunks")
    omitted = less | cut | note_cut
    span = F.when(less, F.concat(F.lit("["), shown.cast("string"), F.lit(","), F.col("n").cast("string"), F.lit("]"))).otherwise("null")
    return _pairs(
        ("paper_id", json_text(F.col("doc_id"))), ("status", json_text(F.col("status"))), ("note", json_text(F.left("note", width))), ("note_truncated", _flag(note_cut)),
        ("chunks", F.concat(F.lit("["), chunks, F.lit("]"))), ("omitted_chunks", (F.col("n") - shown).cast("string")), ("omitted_chunk_range", span),
        ("coverage", json_text(covered)), ("omitted", _flag(omitted))), omitted


def _facts() -> Column:
    return _pairs(("paper_id", json_text(F.col("doc_id"))), ("status", json_text(F.col("status"))), ("omitted", F.lit("true")), ("coverage", F.lit('"none"')))


def _envelope(papers: Column, omitted: Column, facts: bool) -> Column:
    pairs = [("status", json_text(F.col("state"))), ("papers", F.concat(F.lit("["), papers, F.lit("]"))), ("omitted", _flag(omitted)), ("readback", F.lit(READBACK))]
    return _pairs(*pairs, *([("note", json_text(F.lit(FACTS_NOTE)))] if facts else []))


def encode_bundles(rows: DataFrame, cap: int | Column = K.RESULT_CAP, docs: DataFrame | None = None) -> DataFrame:
    """One JSON result per request: the first rung of the ladder (items a document, characters a text), the same for
    all its documents, whose encoded form has at most ``cap`` characters (a number, or an expression over request_id); else its facts alone.

    ``rows``: request_id, doc_id, item_no (1-based within the document), text, and as far as known parser,
    cache_version, chunk_id, section and offset (of the text in its chunk), which are never cut.  ``docs``: the asked
    documents (request_id, doc_id, status, note), so that those without rows are in the result too; by default all
    of ``rows``, as successes.  A null text counts as empty.

    Returns request_id, rung (0: facts; -1: even these do not fit, ``encoded`` is null), items, chars, size (characters
    of what is encoded), encoded.  The lengths that decide are those of the encoded values, escapes included: they
    add up over documents, so that only chunks of the chosen rung are put together, and only results that fit.
    """
    keys, zero = ["request_id", "doc_id"], F.lit(0).cast("bigint")
    r = rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("text", F.coalesce("text", F.lit("")))
    near = F.col("item_no") <= MOST_ITEMS
    sized = r.select(*keys, "item_no", F.length("text").alias("_len"),
                     *[F.when(near, F.length(_chunk(r.columns, F.lit(c)))).cast("bigint").alias(f"_e{c}") for c in WIDTHS])
    upto = lambda i, c: F.when(F.col("item_no") <= i, F.col(c))
    per = sized.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.max(upto(i, "_len")).alias(f"_m{i}") for i in sorted({i for i, _ in LADDER})],
        *[F.sum(upto(i, f"_e{c}")).alias(f"_s{k}") for k, (i, c) in enumerate(LADDER)])
    if docs is None:
        per = per.withColumn("status", F.lit("success")).withColumn("note", F.lit(None).cast("string"))
    else:
        # No rung shows more than 500 characters of a note; one more tells that it is cut.
        asked = docs.select("request_id", F.col("doc_id").cast("string").alias("doc_id"), "status", F.left("note", F.lit(501)).alias("note")).groupBy(*keys).agg(
            F.min(F.struct("status", "note")).alias("_d")).select(*keys, "_d.status", "_d.note")
        per = asked.join(per, keys, "left").withColumn("n", F.coalesce("n", zero))
    # One expression for all rungs: its text is long, and 24 copies of it would not be compiled.
    ladder = F.array(*[F.struct(F.lit(i).alias("items"), F.lit(c).alias("chars"), F.col(f"_m{i}").alias("longest"), F.coalesce(f"_s{k}", zero).alias("chunks"))
                       for k, (i, c) in enumerate(LADDER)])

    def rung_size(x: Column) -> Column:
        body, omitted = _document(x["items"], x["chars"], x["longest"], F.lit(""))
        commas = F.greatest(F.least(F.col("n"), x["items"]) - 1, zero)
        return F.struct((F.length(body) + x["chunks"] + commas).alias("size"), omitted.alias("omitted"))

    count = len(LADDER)
    good = F.col("status") == "success"
    each = per.select("request_id", good.alias("_good"), F.length(_facts()).cast("bigint").alias("_facts"), F.transform(ladder, rung_size).alias("_r"))
    whole = each.groupBy("request_id").agg(
        F.count("*").alias("_docs"), F.when(F.every("_good"), "success").when(F.bool_or("_good"), "partial").otherwise("error").alias("state"), F.sum("_facts").alias("_facts"),
        F.array(*[F.struct(F.sum(F.get("_r", F.lit(k))["size"]).alias("size"), F.bool_or(F.get("_r", F.lit(k))["omitted"]).alias("omitted")) for k in range(count)]).alias("_r"))
    total = lambda inner, omitted, facts: inner + F.col("_docs") - 1 + F.length(_envelope(F.lit(""), omitted, facts))
    sizes = F.transform("_r", lambda x: total(x["size"], x["omitted"], False))
    ladder = F.array(*[F.struct(F.lit(i).alias("items"), F.lit(c).alias("chars")) for i, c in LADDER])
    cap = F.lit(cap) if isinstance(cap, int) else cap
    whole = whole.select("request_id", "state", sizes.alias("_sizes"), total(F.col("_facts"), F.lit(True), True).alias("_facts"), cap.alias("_cap"))
    fits = F.filter(F.transform("_sizes", lambda s, k: F.when(s <= F.col("_cap"), k + 1)), lambda k: k.isNotNull())
    whole = whole.withColumn("rung", F.coalesce(F.get(fits, F.lit(0)), F.when(F.col("_facts") <= F.col("_cap"), 0).otherwise(-1)).cast("int"))
    at = F.greatest(F.col("rung"), F.lit(1)) - 1
    on = F.col("rung") > 0
    chosen = whole.select("request_id", "state", "rung", F.when(on, F.get(ladder, at)["items"]).otherwise(0).alias("items"), F.when(on, F.get(ladder, at)["chars"]).otherwise(0).alias("chars"),
                          F.when(on, F.get("_sizes", at)).otherwise(F.col("_facts")).alias("size"))
    chosen = materialize(chosen, "bundle-rungs")  # read three times; the sizes of all rungs are added up once
    # A document has at most eight chunks here, and a request no more documents than fit the cap.
    narrow = chosen.where("rung >= 0").select("request_id", "rung", "items", "chars")
    part = r.join(narrow, "request_id").where("item_no <= items").withColumn("_c", _chunk(r.columns, F.col("chars")))
    part = part.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "_c"))), lambda x: x["_c"]), ",").alias("_chunks"),
                                   F.max(F.length("text")).alias("_longest"))
    body, omitted = _document(F.col("items"), F.col("chars"), F.col("_longest"), F.coalesce("_chunks", F.lit("")))
    d = per.select(*keys, "n", "status", "note").join(narrow, "request_id").join(part, keys, "left")
    d = d.select("request_id", "doc_id", F.when(F.col("rung") > 0, body).otherwise(_facts()).alias("_body"), ((F.col("rung") == 0) | omitted).alias("_less"))
    d = d.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "_body"))), lambda x: x["_body"]), ",").alias("_papers"), F.bool_or("_less").alias("_less"))
    papers, less = F.col("_papers"), F.col("_less")
    encoded = F.when(F.col("rung") > 0, _envelope(papers, less, False)).when(F.col("rung") == 0, _envelope(papers, less, True))
    return chosen.join(d, "request_id", "left").select("request_id", F.col("rung").cast("bigint").alias("rung"), F.col("items").cast("bigint").alias("items"),
                                                       F.col("chars").cast("bigint").alias("chars"), F.col("size").cast("bigint").alias("size"), encoded.alias("encoded"))

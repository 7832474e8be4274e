"""Benchmark decontamination: token windows of the test items looked up in the training texts.

The windows of the benchmark form a hash set, each filed under its longest word as an anchor.  Each text is cut into
words, every word is looked up, and where an anchor stands, the windows around it are verified: first word, last word,
then all words.  Verified hits give the covered words, from which documents are judged or spans removed.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, UPPER, fresh

WINDOW = 13
# ASCII characters that are not part of words: all but digits and letters.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BROADCAST_WINDOWS = 500_000  # about 120 bytes each


def _words(text: str, fold: bool = True) -> Column:
    """Words of a text, A to Z as a to z if ``fold``.  Splitting at one character needs no regular expression."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), BREAKS + UPPER * fold, " " * len(BREAKS) + LOWER * fold)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: hash of the anchor (the longest word, the first of several) and its offset, length, hashes
    of the first and last word, phrase, and the ids (as strings) of the items that hold it.

    An item shorter than the window is one window; an item without words has none.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), _words(text_col).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    at = sized.select("item", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    cut = at.select("item", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("cut"))
    phrases = cut.groupBy("length", "cut").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("cut", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("back"))))
    anchored = phrases.withColumn("offset", -longest["back"])
    word = lambda i: F.xxhash64(F.get("cut", i))
    return anchored.select(word(F.col("offset")).alias("hash"), "offset", "length", word(F.lit(0)).alias("first"), word(F.col("length") - 1).alias("last"),
                           _phrase(F.col("cut")).alias("phrase"), "items")


def hits(docs: DataFrame, items: DataFrame, key: str, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Verified hits: key of the text, word position, length, items.

    While the benchmark has at most BROADCAST_WINDOWS windows they are broadcast, and the words are probed where
    they are cut: no text moves.  Beyond that, words are joined by exchange, and the texts that meet an anchor are
    joined again for the check.
    """
    bench = benchmark_windows(items, item_col, window=window)
    worded = docs.select(F.col(key), _words(text_col).alias("words")).withColumn("hashes", _hashes(F.col("words")))
    start = F.col("at") - F.col("offset")
    # In this order, so that phrases are built for few.
    check = ((start >= 0) & (start + F.col("length") <= F.size("hashes")) & (F.get("hashes", start) == F.col("first"))
             & (F.get("hashes", start + F.col("length") - 1) == F.col("last")) & (_phrase(F.slice("words", start + 1, F.col("length"))) == F.col("phrase")))
    if bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        met = worded.select(key, "words", "hashes", F.posexplode("hashes").alias("at", "hash")).join(F.broadcast(bench), "hash")
    else:
        places = worded.select(key, F.posexplode("hashes").alias("at", "hash")).join(bench, "hash")
        met = places.join(worded, key)
    return met.where(check).select(key, start.alias("at"), "length", "items")


def covered(spans: Column) -> Column:
    """Number of words in the union of (at, length) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["at"] + x["length"]
        new = F.greatest(F.lit(0), end - F.greatest(s["end"], x["at"]))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def by_document(docs: DataFrame, items: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` with hits: key, spans (position and length of hit windows), items (sorted ids)."""
    found = hits(docs, items, key, text_col, window=window)
    return found.groupBy(key).agg(
        F.collect_set(F.struct("at", "length")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a key that holds the id (null or not) and names the content."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words.  Documents with the same id are taken apart by their content, so repeated rows each
    get their own row.  Without benchmark items nothing is hit.  Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    hit = by_document(rows, items, "key", "text", window)
    sizes = rows.select("doc_id", "key", F.size(_words("text")).cast("bigint").alias("n_words"))
    out = sizes.join(hit, "key", "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("bigint")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id and the words (in their own case) that no hit window covers; the other way to act on a hit."""
    rows = keyed(docs, id_col, text_col)
    out = rows.join(by_document(rows, items, "key", "text", window), "key", "left")
    hit = lambda i: F.exists(F.coalesce("spans", F.array().cast("array<struct<at:int,length:int>>")), lambda s: (i >= s["at"]) & (i < s["at"] + s["length"]))
    return out.select("doc_id", F.filter(_words("text", fold=False), lambda _w, i: ~hit(i)).alias("words"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns.

    Only contaminated keys are joined back, so that clean texts move only if Spark finds the keys too many to broadcast.
    """
    rows = keyed(docs, id_col, text_col)
    hit = by_document(rows, items, "key", "text", window)
    sizes = rows.select("key", F.size(_words("text")).alias("n_words")).join(hit, "key")
    bad = sizes.where(20 * covered(F.col("spans")) >= F.col("n_words")).select(F.col("key").alias("_bad")).distinct()
    name = fresh(docs, "_key")
    own = docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return own.join(bad, own[name] == bad["_bad"], "left_anti").drop(name)

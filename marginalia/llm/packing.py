"""Best-fit decreasing packing of token sequences.

Longest pieces come first; each goes into the open bin with the least room that still holds it.  A segment tree
over the possible remaining capacities (0 to the sequence length) counts the open bins of each capacity, so the
tightest bin is found by one descent, in time logarithmic in the capacity.

Best fit decreasing depends on lengths only, and there are no more lengths than tokens in a sequence.  So Spark
counts the pieces per length, the tree packs runs of equal pieces (the same bins as one at a time, since a bin
that just took a piece is the tightest for the next equal one), and the resulting plan, bounded by the sequence
length and not by the corpus, is joined back: each piece finds its place from its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.scale import materialize

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 300_000


class CapacityTree:
    """Counts of open bins by remaining capacity, with the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Least room of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces per bin, offset) that pack ``counts`` by best fit decreasing."""
    tree, bins = CapacityTree(capacity), 0
    open_bins: dict[int, list[list[int]]] = {}  # room -> runs of bins [first, number]
    runs = []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, take = capacity, -(-left // (capacity // length))
                open_bins.setdefault(room, []).append([bins, take])
                tree.add(room, take)
                bins += take
            first, number = open_bins[room][-1]
            each = room // length
            full = min(number, left // each)
            used, placed = (full, full * each) if full else (1, left)
            per = each if full else left
            runs.append((length, rank, placed, first, per, capacity - room))
            if used == number:
                open_bins[room].pop()
            else:
                open_bins[room][-1] = [first + used, number - used]
            tree.add(room, -used)
            rest = room - per * length
            open_bins.setdefault(rest, []).append([first, used])
            tree.add(rest, used)
            left, rank = left - placed, rank + placed
    return runs


class _Words(dict):
    """Token ids (as little-endian bytes) of text parts; the rules never merge across a single space."""

    def __init__(self, encode, added: dict[str, int]):
        super().__init__()
        self.encode = encode
        self.added = {text: number.to_bytes(4, "little") for text, number in added.items()}
        # Longest first, as one token's text may begin another's.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.encode(word), dtype="<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


_MADE: dict[str, _Words] = {}


def _added(path: str) -> dict[str, int]:
    """Tokens that the vocabulary file takes out of a text before its rules, wherever their text stands."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what surrounds them are not known here")
    return {t["content"]: t["id"] for t in tokens}


def _words_of(vocabulary: str) -> _Words:
    if vocabulary not in _MADE:
        import public_tokenizers
        import tiktoken
        path = public_tokenizers.path(vocabulary)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _MADE[vocabulary] = _Words(encoding.encode_ordinary, _added(public_tokenizers.path(vocabulary.rpartition(".")[0] + ".json")))
    return _MADE[vocabulary]


def token_bytes(text: str, words: _Words, blanks) -> bytes:
    """Ids of a text as little-endian 32-bit numbers.

    Added tokens are cut out first.  A space between two characters that are not blank always starts a new part for the
    tokenizer, so a text without neighbouring blanks is looked up word by word.  Any other text is encoded whole.
    """
    if words.split and any(token in text for token in words.added):
        return b"".join(words.added[part] if at % 2 else _plain_bytes(part, words, blanks) for at, part in enumerate(words.split(text)))
    return _plain_bytes(text, words, blanks)


def _plain_bytes(text: str, words: _Words, blanks) -> bytes:
    if blanks(text):
        return np.asarray(words.encode(text), dtype="<u4").tobytes()
    first, *rest = text.split(" ")
    return words[first] + b"".join([words[" " + w] for w in rest])


def _pieces(vocabulary: str, capacity: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def rows(batches):
        blanks = re.compile(r"\s\s").search
        task, ranks = TaskContext.get().partitionId(), {}
        words = _words_of(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = token_bytes(text.as_py() or "", words, blanks) + tail
                whole, start, piece = len(ids) // 4, 0, 0
                while start < whole:
                    # The remainder comes first, all later pieces are full.
                    length = (whole % capacity if start == 0 else 0) or min(capacity, whole)
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((doc.as_py(), piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), task, rank))
                    start, piece = start + length, piece + 1
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)
    return rows


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, local_rank bigint"


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                     vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their lengths and checksums, written once.

    ``local_rank`` counts the pieces of a length inside one task of the scan.
    """
    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(raw.mapInArrow(_pieces(vocabulary, capacity, end_id), _SCHEMA), "pack-pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that carry (task, length, local_rank)."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("pieces"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("from_rank"))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("pieces")).collect()}  # one row per length
    runs: dict[int, list[tuple]] = {}
    for length, *run in plan(counts, capacity):
        runs.setdefault(length, []).append(tuple(run))
    kind = "length bigint, runs array<struct<rank:bigint,pieces:bigint,bin:bigint,per:bigint,offset:bigint>>"
    table = spark.createDataFrame([(n, r) for n, r in runs.items()], kind)
    ranked = pieces.join(starts, ["length", "task"]).withColumn("_rank", F.col("from_rank") + F.col("local_rank"))
    # One row per length at most: bounded by the capacity.
    met = ranked.join(F.broadcast(table), "length").withColumn(
        "_run", F.filter("runs", lambda r: (r["rank"] <= F.col("_rank")) & (F.col("_rank") < r["rank"] + r["pieces"]))[0])
    at = F.col("_rank") - F.col("_run.rank")
    return met.withColumn("sequence_id", F.col("_run.bin") + F.floor(at / F.col("_run.per"))).withColumn(
        "offset", F.col("_run.offset") + at % F.col("_run.per") * F.col("length")).select(
        *[c for c in pieces.columns if c not in ("task", "local_rank")], "sequence_id", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone.  Documents longer than a sequence are cut from the end, so only
    their first piece is short; nothing is dropped.  Ties in length keep the order of the scan.  Repeated rows are
    packed each.  An empty table gives an empty result.  Other columns are ignored.
    """
    return place(tokenised_pieces(docs, id_col, text_col, capacity, vocabulary, end_id), capacity)

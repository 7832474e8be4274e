"""Periodic runs of words, caught online.

The text is fed in pieces of any size.  Level k watches the periods from ``2L - 1`` to ``4L - 2`` with ``L = 2**k``.
Each completed block of L words, starting at a multiple of L, opens a catcher that compares the block with the
windows of L words which are one period behind it, by prefix hashes.  A stretch in which words p apart are equal
holds complete blocks, since p >= 2L - 1, so a run with four or more periods shows as neighbouring catchers that
report the same period; their squares merge, the two ends are moved word by word, and the words decide.  A hash can
report too much, never too little.

A level advances over as many words as its blocks are long, or over ``STEP`` words if that is more, so the work per
appended word is a few array operations per level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import slices

LEAST_WORDS, LEAST_PERIODS = 6, 4
STEP = 4096
REMEMBERED = 16
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class Grown:
    """An array that is appended to."""

    def __init__(self, dtype, first=()):
        self.size, self._room = len(first), np.empty(max(64, len(first)), dtype)
        self._room[:len(first)] = first

    @property
    def all(self) -> np.ndarray:
        return self._room[:self.size]

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._room):
            wider = np.empty(max(need, 2 * len(self._room)), self._room.dtype)
            wider[:self.size] = self.all
            self._room = wider
        self._room[self.size:need] = values
        self.size = need


class Level:
    """Catchers of one block length: the first block not yet compared, and the stretches still open by period."""

    def __init__(self, length: int):
        self.length, self.next_block, self.open = length, 0, {}


class RunCatcher:
    """Feed word numbers with ``append``; ``finish`` gives the runs (start, length, smallest period)."""

    def __init__(self, step: int = STEP, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
        if least_periods < 3:
            raise ValueError("runs of fewer than three periods need not hold complete blocks")
        self.step, self.least_words, self.least_periods = step, least_words, least_periods
        self.words, self.sums, self.powers, self.inverses = Grown(np.int64), Grown(np.uint64, [0]), Grown(np.uint64), Grown(np.uint64)
        self.levels: list[Level] = []
        self.found: dict[tuple[int, int], int] = {}
        self.longest: list[tuple[int, int, int, int]] = []  # only spares work, so a few are enough

    def append(self, numbers: np.ndarray) -> None:
        at, count = self.words.size, len(numbers)
        if not count:
            return
        self.words.extend(numbers)
        with np.errstate(over="ignore"):
            for grown, factor in ((self.powers, _FACTOR), (self.inverses, _INVERSE)):
                row = np.full(count, factor, np.uint64)
                row[0] = grown.all[-1] * np.uint64(factor) if at else 1
                grown.extend(np.multiply.accumulate(row))
            # Numbers are spread over 64 bits first; small ones would make sums alike.
            mixed = (np.asarray(numbers).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            row = mixed * self.powers.all[at:]
            row[0] += self.sums.all[-1]
            self.sums.extend(np.add.accumulate(row))
        self._open_levels()
        for level in self.levels:
            ready = (self.words.size - (5 * level.length - 2)) // level.length + 1
            if (ready - level.next_block) * level.length >= max(level.length, self.step):
                self._advance(level, ready)

    def finish(self) -> list[tuple[int, int, int]]:
        for level in self.levels:
            self._advance(level, max(level.next_block, (self.words.size - (3 * level.length - 1)) // level.length + 1))
            for period, first in level.open.items():
                self._extend(level.length, period, first, level.next_block)
            level.open = {}
        return sorted((start, end - start, period) for (start, end), period in self.found.items())

    def _open_levels(self) -> None:
        while self.least_periods * (2 * (length := 1 << len(self.levels)) - 1) <= self.words.size:
            self.levels.append(Level(length))

    def _names(self, start: int, stop: int, length: int) -> np.ndarray:
        """Hash names of the windows of ``length`` words that start in [start, stop)."""
        with np.errstate(over="ignore"):
            sums = self.sums.all
            return (sums[start + length:stop + length] - sums[start:stop]) * self.inverses.all[start:stop]

    def _advance(self, level: Level, stop: int) -> None:
        """Compare the blocks [next_block, stop) with the windows behind them and merge neighbours."""
        L, first, n = level.length, level.next_block, self.words.size
        count = stop - first
        if count <= 0:
            return
        level.next_block = stop
        low = first * L
        names = self._names(low, min(n - L + 1, (stop - 1) * L + 4 * L - 1), L)
        heads = names[:(count - 1) * L + 1:L]
        width = (count - 1) * L + 4 * L - 1
        short = width - len(names)
        if short > 0:
            names = np.concatenate([names, np.zeros(short, np.uint64)])
        same = np.lib.stride_tricks.sliding_window_view(names[2 * L - 1:], 2 * L)[::L] == heads[:, None]
        if short > 0:  # windows past the end are no windows
            for row in range(max(0, count - 5), count):
                same[row, max(0, n - L - (first + row) * L - (2 * L - 1) + 1):] = False
        if not same.any():
            closed, level.open = level.open, {}
            for period, begin in closed.items():
                self._extend(L, period, begin, first)
            return
        offsets, blocks = np.nonzero(same.T)
        cut = np.flatnonzero((np.diff(offsets) != 0) | (np.diff(blocks) != 1)) + 1
        begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(offsets)]])
        period_of, from_, to = offsets[begins] + 2 * L - 1, blocks[begins] + first, blocks[ends - 1] + first + 1
        # Stretches too short to be a run end here, unless they touch the border of what was compared.
        least = np.maximum(1, (np.maximum(self.least_words - period_of, (self.least_periods - 1) * period_of) - (L - 1)) // L)
        hold = (to - from_ >= least) | (from_ == first) | (to == stop)
        still: dict[int, int] = {}
        joined = set()
        for period, a, b in zip(period_of[hold].tolist(), from_[hold].tolist(), to[hold].tolist()):
            if a == first and period in level.open:
                a = level.open[period]
                joined.add(period)
            if b == stop:
                still[period] = a
            else:
                self._extend(L, period, a, b)
        for period, a in level.open.items():
            if period not in joined:
                self._extend(L, period, a, first)
        level.open = still

    def _extend(self, L: int, period: int, first: int, stop: int) -> None:
        """Move both ends of merged blocks [first, stop) to where words differ, and keep what is long enough."""
        least = max(self.least_words, self.least_periods * period) - period  # equal pairs that a run has
        if (stop - first + 2) * L < least:
            return
        words = self.words.all
        low, high = max(0, (first - 1) * L), min(len(words) - period, (stop + 1) * L)
        for _, start, end, q in self.longest:
            if period > q and period % q == 0 and start <= first * L and stop * L + period <= end:
                return  # the same run, seen at a multiple of its period
        unlike = np.flatnonzero(words[low:high] != words[low + period:high + period]) + low
        edges = np.concatenate([[low - 1], unlike, [high]])
        for i in np.flatnonzero(np.diff(edges) > least).tolist():
            key = (int(edges[i]) + 1, int(edges[i + 1]) + period)
            if key not in self.found:
                self.longest = sorted([*self.longest, (key[0] - key[1], *key, period)])[:REMEMBERED]
            self.found[key] = min(period, self.found.get(key, period))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text as (start, length, smallest period), ordered by start and period."""
    if len(words) < LEAST_WORDS:
        return []
    catcher = RunCatcher()
    catcher.append(numbered(words))
    return catcher.finish()


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what a run repeats after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words as the contract of the query changes them, by the id of the document."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[:n - a]


_REPORT = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_REPORT_DDL = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _report(words: list[bytes]) -> tuple:
    found = runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())


def texts_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``runs`` (start, length, period in words) and the ``collapsed`` text.

    A null text has no words, no runs and an empty collapsed text; repeated rows each give a row; other columns are
    ignored; an empty table gives an empty result.  A text is one value in one task, whole, however long.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))

    def catch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, "text"):
            found, left = [], []
            for text in batch["text"].to_pylist():
                words = (text or b"").split()
                r = runs(words)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in r])
                left.append(b" ".join(collapsed(words, r)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, kind), pa.array(left, pa.string())], [id_col, "runs", "collapsed"])

    ddl = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(catch, ddl)


def document_runs(docs: DataFrame) -> DataFrame:
    """One row per document with the count, the longest run and digests of all runs and of the collapsed text.

    Words are separated by the ASCII white space bytes.  A null or empty text has no words: no runs, four nulls and
    the digest of nothing twice.  A null id counts as the text of nothing.  Repeated rows each give a row, other
    columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("text"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [_report(planted((text or b"").split(), d)) for d, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            columns = zip(*out) if out else [()] * len(_REPORT)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, _REPORT))], ["doc_id", *(name for name, _ in _REPORT)])

    return rows.mapInArrow(report, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_REPORT_DDL}")

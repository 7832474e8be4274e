"""Quality classifier: a factorisation machine over hashed words, structure statistics and size facts of a text.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so all pairwise interactions cost one pass over the features of a text.  Training averages the weights that
several tasks reach on their parts of a bounded sample of labelled texts; scoring runs where the texts are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import crc_text, fold_remainder, slices
from marginalia.llm.vectors import runs, sums_by_text, word_hashes
from marginalia.scale import materialize

SAMPLE_ROWS = 20_000  # labelled texts for training, by hash order of their ids
PARTS = 6             # tasks that train side by side
ROUNDS = 4            # averages of the parts' weights
EPOCHS = 3            # passes of a part in a round
WORD_BITS = 12
FACTORS = 6
STEP = 0.1
DECAY = 1e-5
LEVELS = 16           # cells per statistic

STATS = ["bytes", "words", "lines", "word_length", "line_length", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "top_line",
         "capitals", "digits", "signs", "sign_words", "stops", "non_ascii"]
FEATURES = (1 << WORD_BITS) + len(STATS) * LEVELS

_KIND = np.zeros(256, np.int8)  # 1 capital, 2 small, 3 digit, 4 sign, 5 stop or comma, 6 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 5 if chr(_c) in ".,;:?'-" else 4


def _statistics(raw: list[bytes], hashes: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row per text, every column scaled into 0 to 1."""
    n = len(raw)
    out = np.zeros((n, len(STATS)))
    size = np.array([len(t) for t in raw], float)
    data = _KIND[np.frombuffer(b"".join(raw), np.uint8)] if size.sum() else np.zeros(0, np.int8)
    sizes = size.astype(np.int64)
    kind = {k: sums_by_text((data == k).astype(np.int64), sizes) / np.maximum(size, 1) for k in range(1, 7)}
    words = np.maximum(counts, 1)
    owner = np.repeat(np.arange(n), counts)
    keys, number = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1, return_counts=True) if len(hashes) else (np.zeros((2, 0), np.uint64), np.zeros(0, int))
    distinct = np.bincount(keys[0].astype(np.int64), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, keys[0].astype(np.int64), number)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    signs = np.zeros(n)
    lines, again, most, mean = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, t in enumerate(raw):
        own = [x for x in t.split(b"\n") if x]
        lines[i] = len(own)
        if own:
            seen: dict[bytes, int] = {}
            for x in own:
                seen[x] = seen.get(x, 0) + 1
            again[i], most[i], mean[i] = 1 - len(seen) / len(own), max(seen.values()) / len(own) * (len(own) > 1), len(t) / len(own)
        signs[i] = sum(t.count(c) for c in (b"!!", b"##", b"$$", b"%%", b"&&", b"**", b"@@", b"~~")) / words[i]
    log = lambda x, top: np.log1p(x) / np.log(top)
    columns = [log(size, 1e6), log(counts, 2e5), log(lines, 1e4), sums_by_text(lengths, counts) / words / 20, log(mean, 1e5), distinct / words, top / words,
               sums_by_text(same, counts) / words, again, most, np.sqrt(kind[1]), np.sqrt(kind[3]), np.sqrt(kind[4]), signs, np.sqrt(kind[5]), np.sqrt(kind[6])]
    for j, c in enumerate(columns):
        out[:, j] = c
    return np.clip(out, 0, 1)


def featurise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values, and how many each text has.

    Words are hashed and weigh by the square root of their count, scaled to length one per text; each statistic
    is the cell it falls into.  An empty text has its statistics only.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, counts, lengths = word_hashes(raw)
    n = len(raw)
    stats = _statistics(raw, hashes, counts, lengths)
    owner = np.repeat(np.arange(n), counts)
    keys, number = np.unique((owner << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    word_owner, weight = keys >> WORD_BITS, np.sqrt(number.astype(float))
    norm = np.sqrt(np.bincount(word_owner, weights=weight**2, minlength=n))
    cell = np.minimum((stats * LEVELS).astype(np.int64), LEVELS - 1) + np.arange(len(STATS)) * LEVELS + (1 << WORD_BITS)
    index = np.concatenate([keys & ((1 << WORD_BITS) - 1), cell.ravel()])
    value = np.concatenate([weight / norm[word_owner], np.full(cell.size, 0.5)])
    order = np.argsort(np.concatenate([word_owner, np.repeat(np.arange(n), len(STATS))]), kind="stable")
    return index[order], value[order], np.bincount(word_owner, minlength=n) + len(STATS)


def linear_time_score(w0: float, w: np.ndarray, v: np.ndarray, index: np.ndarray, value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Machine output per text, and the factor sums that the gradient needs again.  Every text has a feature."""
    at = runs(counts)
    vx = v[index] * value[:, None]
    s = np.add.reduceat(vx, at)
    pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, at)).sum(axis=1)
    return w0 + np.add.reduceat(w[index] * value, at) + pairs, s


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_part(weights: tuple, rows: list[tuple], epochs: int, seed: int) -> tuple:
    """Mini-batch descent with per-weight step sizes on one part of the sample."""
    w0, w, v = weights[0], weights[1].copy(), weights[2].copy()
    g0, gw, gv = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            part = [rows[i] for i in order[start:start + 64]]
            y = np.array([r[0] for r in part], float)
            index, value = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            counts = np.array([len(r[1]) for r in part])
            z, s = linear_time_score(w0, w, v, index, value, counts)
            error = (_sigmoid(z) - y) / len(part)
            each = np.repeat(error, counts)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, weights=each * value) + DECAY * w[used]
            dv = np.zeros((len(used), v.shape[1]))
            raw = (each * value)[:, None] * (np.repeat(s, counts, axis=0) - v[index] * value[:, None])
            for f in range(v.shape[1]):
                dv[:, f] = np.bincount(back, weights=raw[:, f])
            dv += DECAY * v[used]
            g0 += error.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= STEP * error.sum() / np.sqrt(g0)
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= STEP * dv / np.sqrt(gv[used])
    return w0, w, v


def _part_trainer(sent, seed: int):
    def one_part(table):
        index, value = table["idx"].combine_chunks(), table["val"].combine_chunks()
        ends, iv, vv = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
        # An order that depends on the rows only, so that a repeated run trains alike.
        data = sorted(((y, iv[a:b], vv[a:b].astype(float)) for y, a, b in zip(table["label"].to_pylist(), ends[:-1], ends[1:], strict=True)),
                      key=lambda r: (r[0], zlib.crc32(r[1].tobytes())))
        w0, w, v = train_part(sent.value, data, EPOCHS, seed)
        return pa.table({"rows": [len(data)], "w0": [float(w0)], "w": pa.array([w], pa.list_(pa.float64())), "v": pa.array([v.ravel()], pa.list_(pa.float64()))})
    return one_part


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, parts: int = PARTS) -> tuple:
    """Weights (w0, w, v) from at most ``sample_rows`` labelled texts.

    Rows without label, and ids with two different labels, are not used.  Without any labelled text all weights
    are zero, so each score is one half.
    """
    spark = docs.sparkSession
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("low").cast("int").alias("label")))

    def featured(batches):
        for batch in slices(batches, "text", 1_000_000):
            index, value, counts = featurise(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))], names=["part", "label", "idx", "val"])

    rows = materialize(
        docs.join(F.broadcast(chosen), "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "text", "label")
        .mapInArrow(featured, "part int, label int, idx array<int>, val array<float>"), "quality-sample")
    start = np.random.default_rng(7)
    weights = (0.0, np.zeros(FEATURES), start.normal(0, 0.01, (FEATURES, FACTORS)))
    size = rows.count()
    if not size:
        return 0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS))
    for step in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        # One row per part: bounded by parts times the number of weights.
        got = rows.groupBy("part").applyInArrow(_part_trainer(sent, step), "rows bigint, w0 double, w array<double>, v array<double>").collect()
        share = np.array([r["rows"] for r in got], float) / sum(r["rows"] for r in got)
        weights = (float(sum(a * r["w0"] for a, r in zip(share, got, strict=True))), sum(a * np.array(r["w"]) for a, r in zip(share, got, strict=True)),
                   sum(a * np.array(r["v"]) for a, r in zip(share, got, strict=True)).reshape(FEATURES, FACTORS))
        sent.unpersist()
    return weights


def score(docs: DataFrame, weights: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts are scored by their statistics.

    Repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        w0, w, v = sent.value
        for batch in slices(batches, "text", 1_000_000):
            index, value, counts = featurise(batch.column(1).to_pylist())
            result = _sigmoid(linear_time_score(w0, w, v, index, value, counts)[0])
            held = [crc_text(i) % 3 == 1 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(result), pa.array((result >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(rows, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: tuple, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score one half or more, with their own columns; texts are judged where they lie."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def judged(texts):
        import pandas as pd
        w0, w, v = sent.value
        out, start, held = [], 0, 0
        values = texts.tolist()
        for i, t in enumerate(values + [None]):
            if i == len(values) or (held and held + len(t or "") > 1_000_000):
                if i > start:
                    out.append(_sigmoid(linear_time_score(w0, w, v, *featurise(values[start:i]))[0]))
                start, held = i, 0
            held += len(t or "")
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(judged(F.col(text_col)) >= 0.5)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple:
    """Weights from the labels outside the held-out third."""
    return learn(docs, labels.where(fold_remainder("doc_id", 3) != 1))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fitted(docs, labels))

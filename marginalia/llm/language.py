"""Language identification by bit-sliced Bloom filters of character n-grams.

Row ``r`` of the filter table is a bit mask with one bit per language: bit l is set if some n-gram of language l
hashes to r.  Looking up an n-gram is the AND of a few rows, and gives at once all languages that contain it.
The bits are counted per language over a text, the count expected from false positives is taken off, and the
highest corrected count decides.

There are two such tables.  The wide one holds every n-gram that was seen in a language, so no language and no rare
alphabet is lost; the narrow one holds a language's frequent n-grams once more, since in a large corpus almost every
n-gram turns up somewhere in every language.  Corrected counts of both are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import crc_text, fold_remainder, slices
from marginalia.llm.vectors import GOLDEN, mix, sequence_hash, sums_by_text
from marginalia.scale import materialize

WIDTHS = (3, 4)
FREQUENT_SHARE = 1e-4  # of a language's n-grams of one width, for the narrow table
BITS, MOST_BITS = 18, 22  # rows of the narrow table, and at most of the wide one, as powers of two
HASHES = 3
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased letters, runs of other characters being one gap, and their number per text."""
    # U+0000 is not a letter, so it is safe between texts; n-grams across it are left out below.
    points = np.frombuffer("\0".join([t.lower() for t in texts] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    owner_all = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter stands for the whole gap
    first = np.cumsum(sizes) - sizes
    keep[first] = True       # every text opens with a letter or a gap
    ends = np.cumsum(sizes) - 1
    keep[ends] = True
    codes, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner_all[keep]
    hashed = sequence_hash(mix(codes + np.uint64(width << 32)), width)
    inside = owner[:len(hashed)] == owner[width - 1:]
    return hashed[inside], np.bincount(owner[:len(hashed)][inside], minlength=len(texts)).astype(np.int64)


def _gram_counts(batches):
    held: dict[str, list] = {}

    def merged(parts):
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            for (width, keys, counts) in ((w, *merged(p)) for w, p in parts.items()):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([width], pa.int32()), pa.array([keys.view(np.int64)], pa.list_(pa.int64())),
                                                  pa.array([counts], pa.list_(pa.int64()))], names=["lang", "width", "keys", "counts"])
        held.clear()

    for batch in slices(batches, "text", 1_000_000):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in by.items():
            for width in WIDTHS:
                hashed, _ = grams(texts, width)
                parts = held.setdefault(lang, {}).setdefault(width, [])
                parts.append(np.unique(hashed, return_counts=True))
                if len(parts) > 8:
                    parts[:] = [merged(parts)]
        if sum(len(p[0]) for w in held.values() for parts in w.values() for p in parts) > 4_000_000:
            yield from flush()
    yield from flush()


class Model:
    """Filter table, languages by bit, and each language's share of false positives."""

    def __init__(self, grams_of: dict[str, np.ndarray], bits: int = BITS, hashes: int = HASHES):
        self.languages, self.bits, self.hashes = sorted(grams_of), bits, hashes
        words = max(1, -(-len(self.languages) // 64))
        # One byte a row is enough for eight languages.
        self.table = np.zeros((words, 1 << bits), np.uint8 if len(self.languages) <= 8 else np.uint64)
        for i, lang in enumerate(self.languages):
            for at in self._places(grams_of[lang]):
                self.table[i // 64][at] |= self.table.dtype.type(1 << (i % 64))
        fill = [(self.table[i // 64] >> self.table.dtype.type(i % 64) & self.table.dtype.type(1)).mean() for i in range(len(self.languages))]
        self.false = np.array(fill, float) ** hashes

    @classmethod
    def of(cls, parts: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(parts)
        return model

    def _places(self, keys: np.ndarray):
        for k in range(self.hashes):
            yield (mix(keys + np.uint64(k * GOLDEN & (2**64 - 1))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def contains(self, keys: np.ndarray, word: int = 0) -> np.ndarray:
        """Bit mask of the languages (of one word of 64) that hold each n-gram."""
        out = None
        for at in self._places(keys):
            out = self.table[word][at] if out is None else out & self.table[word][at]
        return out

    @classmethod
    def of_words(cls, languages: list[str], bits: int, words: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """A table from each language's filter, given as numbers of 64-bit words and their bits."""
        model = cls({lang: np.zeros(0, np.uint64) for lang in languages}, bits)
        for i, lang in enumerate(model.languages):
            if lang in words:
                packed = np.zeros((1 << bits) // 64, np.uint64)
                packed[words[lang][0]] = words[lang][1]
                plane = np.unpackbits(packed.view(np.uint8), bitorder="little")
                model.table[i // 64] |= plane.astype(model.table.dtype) << model.table.dtype.type(i % 64)
                model.false[i] = plane.mean() ** model.hashes
        return model

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a filter that n-grams touch, and the bits they set there."""
        places = np.unique(np.concatenate(list(self._places(keys))))
        word, start = np.unique(places >> 6, return_index=True)
        return word, np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), start)

    def corrected(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of known n-grams per text and language, less the expected false positives."""
        out = np.zeros((len(sizes), len(self.languages)))
        for word in range(len(self.table)):
            masks = self.contains(keys, word)
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits = sums_by_text((masks >> masks.dtype.type(i % 64) & masks.dtype.type(1)).astype(np.int64), sizes)
                out[:, i] = (hits - sizes * self.false[i]) / (1 - self.false[i]) if self.false[i] < 1 else 0
        return out


class Tables:
    """The wide and the narrow table of the same languages."""

    def __init__(self, tables: list[Model]):
        self.tables, self.languages = tables, tables[0].languages

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for width in WIDTHS:
            keys, sizes = grams(texts, width)
            for table in self.tables:
                out += np.maximum(table.corrected(keys, sizes), 0)
        return out


def _filter_words(bits: int):
    def rows(batches):
        table = Model({}, bits)
        for batch in batches:
            langs, grams_ = np.asarray(batch["lang"].to_pylist(), object), batch["gram"].to_numpy().view(np.uint64)
            for lang in dict.fromkeys(langs):
                word, mask = table.words(grams_[langs == lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), pa.array(word, pa.int64()), pa.array(mask.view(np.int64))], ["lang", "word", "mask"])
    return rows


def _table(kept: DataFrame, languages: list[str], bits: int) -> Model:
    """Tasks set bits for their n-grams, words of 64 bits are OR-ed by exchange, and finished filters reach the driver."""
    words = kept.select("lang", "gram").mapInArrow(_filter_words(bits), "lang string, word bigint, mask bigint")
    rows = words.groupBy("lang", "word").agg(F.bit_or("mask").alias("mask")).toArrow().to_pandas()
    return Model.of_words(languages, bits, {lang: (part["word"].to_numpy(), part["mask"].to_numpy(np.int64).view(np.uint64)) for lang, part in rows.groupby("lang")})


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Tables:
    """Tables from all rows with a language; every n-gram that was seen is in them.

    N-grams are counted in the tasks and summed by exchange.  The driver gets the filters only: at most
    2 ** MOST_BITS bits for each language, whatever the size of the corpus.  A filter that would need more gives more
    false positives, which the correction takes off.  A language is learned if any of its texts has an n-gram.
    """
    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        _gram_counts, "lang string, width int, keys array<bigint>, counts array<bigint>")
    grams_ = (counted.select("lang", "width", F.inline(F.arrays_zip(F.col("keys").alias("gram"), F.col("counts").alias("n"))))
              .toDF("lang", "width", "gram", "n").groupBy("lang", "width", "gram").agg(F.sum("n").alias("n")))
    grams_ = materialize(grams_, "language-grams")
    totals = grams_.groupBy("lang", "width").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    sizes = totals.groupBy("lang").agg(F.sum("distinct").alias("distinct")).collect()  # one row for each language
    languages = [r["lang"] for r in sizes]
    # Half of the bits set, where the largest language has the room.
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(1 + HASHES * max((r["distinct"] for r in sizes), default=1) / np.log(2))))))
    frequent = grams_.join(F.broadcast(totals), ["lang", "width"]).where(F.col("n") >= FREQUENT_SHARE * F.col("total"))
    return Tables([_table(grams_, languages, bits), _table(frequent, languages, BITS)])


def predict(docs: DataFrame, model: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row.

    The score is the winner's part of all corrected counts.  A null text, one without a letter, or any text when
    no language was learned, gives ``und`` and 0.  When no n-gram is known, the first learned language is given
    with score 0; ties go to the smaller name.  Repeated rows each get a row; other columns are ignored.
    """
    # Plain arrays, bounded by the number of languages and MOST_BITS.
    shared = docs.sparkSession.sparkContext.broadcast([vars(t) for t in model.tables])

    def rows(batches):
        known = Tables([Model.of(parts) for parts in shared.value])
        for batch in slices(batches, "text", 1_000_000):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            letters = [any(map(str.isalpha, t)) for t in texts]
            if known.languages:
                counts = known.counts(texts)
                best, total = counts.argmax(axis=1), counts.sum(axis=1)
                score = np.where(total > 0, counts[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
                langs = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, score, 0.0)
            else:
                langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            held = [crc_text(i) % 5 == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(rows, "doc_id bigint, held_out boolean, lang_pred string, score double")


def document_languages(docs: DataFrame) -> DataFrame:
    """Learn from four fifths of the labelled documents, by the checksum of the id, and predict all."""
    return predict(docs, learn(docs.where(fold_remainder("doc_id", 5) != 0)))

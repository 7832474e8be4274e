"""Quality and language models: identities by brute force, held-out accuracy, odd inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language, quality, vectors
from marginalia.llm.common import crc_text, fold_remainder

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "12 34!!", "q" * 100_000, "a", "😀", "\x00", "wörter übér", "x " * 50_000]


def test_words_equal_split():
    texts = [(t or "").encode() for t in ODD] + [b" A b\x0bC\tAB ", b"\x85\xa0 z"]
    hashes, counts, lengths = vectors.word_hashes(texts)
    want = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want] and lengths.tolist() == [len(x) for w in want for x in w]
    named = dict(zip([x for w in want for x in w], hashes.tolist()))
    assert len(set(named.values())) == len(named)
    assert [named[x] for w in want for x in w] == hashes.tolist()


def test_grams_equal_brute_force():
    for width in language.WIDTHS:
        texts = ["Ab1c  dé", "", "..", "abc", "xabc abcx", "a"]
        hashes, counts = language.grams(texts, width)
        want = []
        for t in texts:
            s = "".join(c if c.isalpha() else " " for c in t.lower() + "\0")
            s = "".join(c for i, c in enumerate(s) if c != " " or i == 0 or s[i - 1] != " " or i == len(s) - 1)
            want.append([s[i:i + width] for i in range(len(s) - width + 1)])
        assert counts.tolist() == [len(w) for w in want]
        pairs = set(zip([x for w in want for x in w], hashes.tolist()))
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_bit_slices_hold_all_languages():
    rng = np.random.default_rng(1)
    sets = {f"l{i:03}": rng.integers(0, 2**63, 300).astype(np.uint64) for i in range(70)}
    sets["l001"] = sets["l000"]
    model = language.Model(sets, bits=14)
    for i, lang in enumerate(model.languages):
        masks = model.contains(sets[lang], i // 64)
        assert ((masks >> np.uint64(i % 64)) & np.uint64(1)).all()
    absent = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    seen = ((model.contains(absent) >> np.uint64(5)) & np.uint64(1)).mean()
    assert abs(seen - model.false[5]) < 2e-3


def test_language_held_out_and_odd_inputs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    both = language.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in both]) > 0.99
    model = language.learn(docs.limit(200))
    odd = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ODD)] + [(None, "the", 1.0), (3, "12", 1.0)], "doc_id long, text string, score double")
    out = language.predict(odd, model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in out if r["doc_id"] is not None} == {i: not any(c.isalpha() for c in t or "") for i, t in enumerate(ODD)}
    none = language.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(odd.where("false"), model).count() == 0


def test_languages_of_rare_characters_are_learned(spark):
    rng = np.random.default_rng(4)
    han = lambda: "".join(map(chr, rng.integers(0x4E00, 0x9F00, 30)))
    latin = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in"], 20))
    rows = [(i, "zh" if i % 2 else "en", han() if i % 2 else latin()) for i in range(800)] + [(900, "xx", "q"), (901, "ga", "agus")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    model = language.learn(docs)
    assert model.languages == ["en", "ga", "zh"]  # one letter has no n-gram
    for text, lang, word in ((r[2], r[1], 0) for r in rows[:40]):
        for width in language.WIDTHS:
            keys, _ = language.grams([text], width)
            bits = model.tables[0].contains(keys, word)
            assert (bits >> model.languages.index(lang) & 1).all()
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert all(out[d] == lang for d, lang, _ in rows if d != 900)
    # Half of the characters of a new text are enough.
    new = [(i, "".join(map(chr, rng.integers(0x4E00, 0x9F00, 3))) + rows[2 * i + 1][2][:9]) for i in range(100)]
    assert {r["lang_pred"] for r in language.predict(spark.createDataFrame(new, "doc_id long, text string"), model).collect()} == {"zh"}


def test_fold_is_the_checksum_of_the_text(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("m", fold_remainder("doc_id", 5)).collect()
    assert all(r["m"] == crc_text(r["doc_id"]) % 5 for r in rows)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    index, value, counts = quality.featurise(["one two two THREE!! 4\none", "", None, "a b"])
    w0, w, v = 0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3))
    got, _ = quality.linear_time_score(w0, w, v, index, value, counts)
    at = 0
    for z, n in zip(got, counts):
        x = list(zip(index[at:at + n], value[at:at + n]))
        want = w0 + sum(w[i] * a for i, a in x) + sum((v[i] @ v[j]) * a * b for (i, a), (j, b) in itertools.combinations(x, 2))
        assert z == pytest.approx(want)
        at += n


def test_quality_held_out_and_odd_inputs(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    weights = quality.fitted(docs, labels)
    out = quality.score(docs, weights)
    both = out.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in both]) > 0.95
    # Labels, language, source and id are no inputs.
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all(abs(a[r["doc_id"] - 10**6] - r["score"]) < 1e-9 for r in quality.score(other, weights).collect())
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 1), (1, "", 1)], "doc_id long, text string, predicted int")
    scored = quality.score(odd, weights).collect()
    assert len(scored) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in scored)
    kept = quality.keep_good(odd, weights)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in scored)
    nothing = quality.learn(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(odd, nothing).collect()} == {0.5}
    assert quality.score(odd.where("false"), weights).count() == 0

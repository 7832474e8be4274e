import hashlib
import random
import re

from marginalia.llm import decontaminate as dc

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(dc.UPPER, dc.LOWER)


def words(t):
    return RX.findall((t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k:k + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit |= set(range(k, k + m))
                    its |= wins[tuple(w[k:k + m])]
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    r = random.Random(1)
    pool = ["the", "Of", "é", "É", "a1", "ß", "Kelvin", "Kelvin", "x", "naïve"]
    text = lambda n: " ".join(r.choice(pool) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, text(r.choice([0, 3, 12, 13, 14, 30]))) for i in range(10)] + [(100, None), (7, "the of É")]
    docs = [(i, " ".join([text(r.randint(0, 40)), (r.choice(items)[1] or "").upper() if i % 2 else r.choice(items)[1] or "", text(r.randint(0, 300))])) for i in range(120)]
    return docs + [(200, None), (201, ""), (202, "!!"), (None, items[5][1]), (203, text(20_000))], items


def run(spark, docs, items):
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    return sorted([tuple(x) for x in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=str)


def test_equals_brute_force_both_ways(spark, monkeypatch):
    docs, items = tables()
    want = brute(docs, items)
    assert any(x[5] for x in want) and not all(x[5] for x in want)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert run(spark, docs, items) == want


def test_empty_repeats_and_clashes(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    assert run(spark, [], [(1, item)]) == []
    assert [x[2] for x in run(spark, [(1, item), (1, item), (1, "clean")], [])] == [0, 0, 0]
    docs = spark.createDataFrame([(1, item, "k", 1), (1, item, "k", 1), (1, "clean", "k", 1), (2, None, None, None)], "doc_id long, text string, key string, at int")
    items = spark.createDataFrame([(1, item, 5)], "item_id long, text string, hash int")
    assert sorted(x["n_hit"] for x in dc.contamination(docs, items).collect()) == [0, 0, 13, 13]
    kept = dc.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean"]
    left = dc.remove_spans(spark.createDataFrame([(1, f"Start {item.upper()} end")], "doc_id long, text string"), items).first()
    assert left["words"] == ["Start", "end"]

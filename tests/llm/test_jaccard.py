import random
import re

import numpy as np
import pytest

from marginalia.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for t in s:
            lists.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        met = {}
        for t in s:
            for j in lists[t]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, o in met.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o) and None not in (rows[i][0], rows[j][0]):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]


def corpus(seed, groups=12, size=14, n=(1, 60)):
    """Groups around a base text at many distances, passages shared by half of all, small sets, copies."""
    r = random.Random(seed)
    words = lambda k: [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 30)) for _ in range(k)]
    shared = words(20)
    texts = []
    for _ in range(groups):
        base = words(r.randint(*n))
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(own) + 1)
                own[at:at + r.choice([0, 1])] = words(r.choice([0, 1, 2]))
            if r.random() < 0.3:
                own += shared
            texts.append((r.choice([" ", "\n", "\t "])).join(x.upper() if r.random() < 0.1 else x for x in own))
    texts += [None, "", "  ", "one", "ONE", "one two three four", "one two three four five", " ".join(words(6000))]
    r.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def run(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return [tuple(x) for x in jaccard.near_components(docs).select("doc_id", "n_shingles", "component_id").collect()]


@pytest.mark.parametrize("seed,groups,size,n", [(1, 12, 14, (1, 60)), (2, 3, 60, (25, 40)), (3, 40, 4, (1, 12))])
def test_components_equal_brute_force(spark, seed, groups, size, n):
    rows = corpus(seed, groups, size, n)
    want = sorted(brute(rows))
    assert len({c for _, _, c in want}) < len(want) - 10
    assert sorted(run(spark, rows)) == want


def test_without_frequent_shingles_the_links_are_the_same(spark, monkeypatch):
    rows = corpus(4, 6, 20, (20, 50))
    monkeypatch.setattr(jaccard, "HEAVY_TOKENS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_prefix_covers_the_threshold():
    for n in range(1, 300):
        least = min(o for o in range(1, n + 1) if 100 * o >= 75 * n)
        assert jaccard.prefix_length(n) == n - least + 1


def test_sets_equal_brute_force():
    texts = [t for _, t in corpus(5)]
    own, token = jaccard.shingle_sets(texts)
    assert np.bincount(own, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(token)) == len(set().union(*map(shingles, texts)))


def test_odd_rows(spark):
    same = "a b c d e f g h"
    rows = [(None, same), (5, same), (5, same), (7, "x y z"), (7, "p q r s t"), (9, "p q r s t"), (11, "X y  z"), (None, "lonely words"), (None, None), (13, None)]
    out = sorted(run(spark, rows), key=str)
    assert out == sorted([(None, 4, 5), (5, 4, 5), (5, 4, 5), (7, 1, 7), (7, 1, 7), (9, 1, 7), (11, 1, 7), (None, 1, None), (None, 0, None), (13, 0, 13)], key=str)
    assert run(spark, [], 1) == []
    docs = spark.createDataFrame([(1, same, 1, "t"), (2, same, 1, "t"), (None, same, 1, "t"), (3, None, 1, "t")], "doc_id long, text string, n int, token string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "u long, v long")
    labels = {r["u"]: r["label"] for r in jaccard.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(201)}, 500: 400, 400: 400}

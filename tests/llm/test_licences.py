import random
from collections import Counter

import numpy as np

from marginalia.llm import licences
from marginalia.llm.vectors import sequence_hash, word_hashes


def brute(words, templates, least):
    """All windows of a template's size, and the whole text, by plain bags."""
    found = []
    grams = list(zip(words, words[1:]))
    for name, text in templates.items():
        t = licences.normalised(text).split()
        want = list(zip(t, t[1:]))
        if not want or not grams:
            continue
        for width in {min(len(want), len(grams)), len(grams)}:
            for i in range(len(grams) - width + 1):
                part, left = grams[i:i + width], list(want)
                shared = 0
                for g in part:
                    if g in left:
                        left.remove(g)
                        shared += 1
                d = 2 * shared / (width + len(want))
                if d >= least:
                    found.append((d, width, i, name))
    kept = []
    for d, width, i, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if all(i + width + 1 <= s or e <= i for _, s, e, _ in kept):
            kept.append((name, i, i + width + 1, d))
    return sorted(kept, key=lambda k: k[1])


def test_matches_equal_brute_force():
    r = random.Random(6)
    templates = {n: t for n, t in licences.TEMPLATES.items() if len(t) < 400} | {"again": "a b a b a b c", "one": "word", "none": ""}
    known = licences.Templates(templates, 0.8)
    for _ in range(150):
        words = []
        for _ in range(r.randint(0, 4)):
            own = licences.normalised(r.choice(list(templates.values()))).split()
            if own and r.random() < 0.5:
                own[r.randrange(len(own))] = b"zzz"
            words += own + [r.choice([b"a", b"b", b"the", b"license", b"x"]) for _ in range(r.randint(0, 12))]
        hashes, _, _ = word_hashes([b" ".join(words)])
        assert known.matches(hashes) == brute(words, templates, 0.8)


def brute_all(words, templates, least):
    """Windows of all widths, by plain bags."""
    found, grams = [], list(zip(words, words[1:]))
    for name, text in templates.items():
        t = licences.normalised(text).split()
        want = Counter(zip(t, t[1:]))
        for i in range(len(grams)):
            part, shared = Counter(), 0
            for j in range(i, len(grams)):
                part[grams[j]] += 1
                shared += part[grams[j]] <= want[grams[j]]
                d = 2 * shared / (j - i + 1 + want.total())
                if want and d >= least:
                    found.append((d, j - i + 1, i, name))
    kept = []
    for d, width, i, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if all(i + width + 1 <= s or e <= i for _, s, e, _ in kept):
            kept.append((name, i, i + width + 1, d))
    return sorted(kept, key=lambda k: k[1])


def test_all_widths_equal_brute_force():
    r = random.Random(7)
    templates = {n: t for n, t in licences.TEMPLATES.items() if len(t) < 400} | {"again": "a b a b a b c", "same": "a a a a", "one": "word", "none": ""}
    known = licences.Templates(templates, 0.8)
    for _ in range(150):
        words = []
        for _ in range(r.randint(0, 4)):
            own = licences.normalised(r.choice(list(templates.values()))).split()
            for _ in range(r.choice([0, 1, 1, 2])):
                own.insert(r.randint(0, len(own)), b"zzz")
            words += own[r.choice([0, 0, 1]):len(own) - r.choice([0, 0, 1, 2])] + [r.choice([b"a", b"b", b"the", b"license", b"x"]) for _ in range(r.randint(0, 12))]
        hashes, _, _ = word_hashes([b" ".join(words)])
        assert known.matches(hashes, True) == brute_all(words, templates, 0.8)


def test_scan_finds_altered_and_shortened_notices_inside_texts(spark):
    noise = " ".join(f"thwhing{k} onwh{k}" for k in range(150))
    t = licences.TEMPLATES["GPL-2.0-or-later"].split()
    longer = [x for k, w in enumerate(t) for x in ([w, f"put{k}"] if k % 7 == 6 else [w])]
    shorter = t[:round(0.7 * len(t))]
    rows = [(k, f"{noise} {' '.join(part)} {noise}") for k, part in enumerate((longer, shorter))]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x in out:
        assert x["license"] == "GPL-2.0-or-later" and x["dice"] >= 0.8 and x["n_matches"] == 1, x
    old = licences.Templates(licences.TEMPLATES, 0.8)
    assert not any(old.matches(word_hashes([licences.normalised(text)])[0]) for _, text in rows)


def test_scan_finds_lines_and_full_texts(spark):
    noise = "Thwhing onwh haheble ofone, the thon. "
    rows = [(i, noise + t + " " + noise) for i, t in enumerate(licences.TEMPLATES.values())]
    names = list(licences.TEMPLATES)
    odd = [(100, None), (101, ""), (102, "license"), (None, noise), (103, "Released under the MIT License.\n" * 3), (103, "Released under the MIT License.\n" * 3), (104, "the license " * 40_000)]
    docs = spark.createDataFrame([(*x, "c") for x in rows + odd], "doc_id long, text string, license string").repartition(3)
    out = licences.scan(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    for i, n in enumerate(names):
        assert by[i]["license"] == n and by[i]["dice"] == 1.0, (n, by[i])
    assert [by[d]["n_matches"] for d in (100, 101, 102, None, 103, 104)] == [0, 0, 0, 0, 3, 0]
    assert licences.scan(docs.where("false")).count() == 0
    assert licences.scan(docs, templates={}).where("n_matches > 0").count() == 0


def test_dice():
    assert licences.dice([1, 1, 2], [1, 2, 3]) == 4 / 6
    assert len(sequence_hash(np.zeros(1, np.uint64), 2)) == 0

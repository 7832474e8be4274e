import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from marginalia.llm import periodic


def brute(words):
    """Runs by comparing all words p apart for every period, smallest period of each stretch first."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 4 + 1):
        start = 0
        while start < n - p:
            if words[start] != words[start + p]:
                start += 1
                continue
            end = start
            while end < n - p and words[end] == words[end + p]:
                end += 1
            length = end - start + p
            if length >= max(6, 4 * p) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, p))
            start = end
    return sorted(out)


def fed(words, piece, step):
    catcher = periodic.RunCatcher(step=step)
    numbers = np.array([ord(c) for c in words], np.int64)
    for at in range(0, len(words), piece):
        catcher.append(numbers[at:at + piece])
    return catcher.finish()


repeated = st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=6).map(lambda parts: "".join(t * k for t, k in parts))


@settings(max_examples=300, deadline=None)
@given(repeated | st.text("ab", max_size=80), st.sampled_from([1, 3, 7, 1000]), st.sampled_from([1, 8, 4096]))
def test_runs_equal_brute_force_for_any_feeding(words, piece, step):
    assert fed(words, piece, step) == brute(words)


def test_long_texts():
    r = random.Random(3)
    for n, letters in ((700, "ab"), (900, "abcde")):
        for _ in range(6):
            words = [r.choice(letters) for _ in range(n)]
            at, p = r.randrange(n // 2), r.randrange(1, 90)
            words[at:] = [words[at + i % p] for i in range(n - at)]
            words = "".join(words)
            assert fed(words, 50, 16) == fed(words, n, 4096) == brute(words)
    for words, count, top in (("a" * 30_000, 1, (0, 30_000, 1)), ("ab" * 15_000, 1, (0, 30_000, 2)), ("aaaaaaab" * 4_000, 4001, (0, 32_000, 8)),
                              ("ab" * 200 + "abc" * 200 + "ab" * 100, 3, (400, 602, 3))):
        began = time.time()
        got = fed(words, 5000, 4096)
        assert time.time() - began < 10
        assert len(got) == count and max(got, key=lambda r: r[1]) == top
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert fed(fibonacci[-1], 13, 1) == brute(fibonacci[-1])


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["é", "la", "x\x1fy", "b c"]) for _ in range(r.randint(0, 70))).replace(" la", r.choice([" la", "\n\nla"])), "k", 1) for i in range(250)]
    rows += [(None, None, "k", 1), (7, "", "k", 1), (7, "", "k", 1), (8, " \t\x0b ", "k", 1), (9, "a " * 3000, None, 1), (30, None, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = sorted((tuple(x) for x in periodic.document_runs(docs).collect()), key=str)
    assert got == sorted(((d, *expected(d, t)) for d, t, *_ in rows), key=str)
    assert periodic.document_runs(docs.where("false")).collect() == []


def test_general_interface(spark):
    docs = spark.createDataFrame([("x", "go on " + "la " * 8 + "end"), ("y", None)], "name string, body string")
    out = {x["name"]: x for x in periodic.texts_runs(docs, "name", "body").collect()}
    assert [tuple(x) for x in out["x"]["runs"]] == [(2, 8, 1)] and out["x"]["collapsed"] == "go on la end"
    assert out["y"]["runs"] == [] and out["y"]["collapsed"] == ""

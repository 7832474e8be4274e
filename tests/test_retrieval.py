"""Retrieval against a plain scan, and evidence round trips."""

import json
import random
import re

import pytest
from collections import Counter
from pyspark.sql import functions as F

from marginalia.operators import bundles as BU
from marginalia.operators import evidence as E
from marginalia.operators import retrieval as R

WORDS = ["the", "of", "and", "net", "graph", "deep", "loss", "data", "rare1", "rare2", "bathe", "cat", "模", "型"]


def tokens(t):
    return re.findall(r"[a-z0-9_]+|[一-鿿]", t.lower())


def scan(queries, chunks, k):
    out = {}
    for qid, q in queries:
        q = q.strip()
        bag = {t: tokens(q).count(t) for t in tokens(q)}
        ranked = []
        for _, cid, text in chunks:
            ts = tokens(text)
            n = sum(min(c, ts.count(t)) for t, c in bag.items())
            if n:
                ranked.append((-(n / sum(bag.values()) + (q.lower() in text.lower())), cid))
        out[qid] = [c for _, c in sorted(ranked)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_a_full_scan(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choices(WORDS, weights=[30, 25, 20] + [5] * 8 + [2] * 3, k=n))
    hot = text(30)
    # A third of all chunks are copies of one text.
    chunks = [(i, f"{i}:document:0", hot if i % 3 == 0 else text(rnd.randrange(3, 40))) for i in range(150)]
    queries = [(i, text(rnd.randrange(1, 12))) for i in range(12)] + [(20, hot[:40]), (21, "the cat"), (22, " cat "), (23, "absent words"), (24, "he ca")]
    got = R.retrieve(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(chunks, "doc_id int, chunk_id string, text string"), 5)
    ours = {}
    for r in got.orderBy("query_id", "rank").collect():
        ours.setdefault(r.query_id, []).append(r.chunk_id)
    want = {q: c for q, c in scan(queries, chunks, 5).items() if c}
    assert ours == want


def test_phrase_bonus_needs_a_shared_token(spark):
    chunks = [(1, "a", "bathe cats"), (2, "b", "bathe cat")]
    got = R.retrieve(spark.createDataFrame([(1, "the cat")], "query_id int, query string"), spark.createDataFrame(chunks, "doc_id int, chunk_id string, text string"), 3).collect()
    assert [(r.chunk_id, r.phrase, r.score) for r in got] == [("b", True, 1.5)]


def test_k_is_validated(spark):
    with pytest.raises(ValueError):
        R.retrieve(None, None, 9)


def test_multi_document_status(spark):
    req = spark.createDataFrame([(1, ["p1", "p2", "p1"]), (2, ["missing"]), (3, ["p1", "missing"])], "request_id int, doc_ids array<string>")
    hits = spark.createDataFrame([(1, "p1"), (1, "p1")], "request_id int, doc_id string")
    have = spark.createDataFrame([("p1",), ("p2",)], "doc_id string")
    got = {(r.request_id, r.position): (r.doc_id, r.success, r.chunks, r.status) for r in R.multi_document(req, hits, have).collect()}
    assert got == {(1, 1): ("p1", True, 2, "success"), (1, 2): ("p2", True, 0, "success"), (2, 1): ("missing", False, 0, "error"),
                   (3, 1): ("p1", True, 0, "partial"), (3, 2): ("missing", False, 0, "partial")}


def versioned(spark, text, size=1200):
    d = spark.createDataFrame([(1, "grobid", text, [("document", text)])], "doc_id int, parser string, raw_text string, sections array<struct<section:string,content:string>>")
    return E.versioned_chunks(E.with_version(d, size=size), size=size)


def test_versions_change_with_content_and_settings(spark):
    v = lambda *a, **k: versioned(spark, *a, **k).first().cache_version
    assert v("abc") == v("abc") and v("abc") != v("abd") and v("abc") != v("abc", size=600)


def test_read_back_in_slices(spark):
    text = " ".join(f"w{i}" for i in range(200))
    c = versioned(spark, text)
    ref = c.first()
    parts, at = [], 0
    while at is not None:
        req = spark.createDataFrame([(1, 1, "grobid", ref.cache_version, ref.chunk_id, at, 300)], "request_id int, doc_id int, parser string, cache_version string, chunk_id string, offset int, max_chars int")
        r = E.read_back(req, c).first()
        assert r.error is None
        parts.append(r.text)
        at = r.next_offset
    assert "".join(parts) == text
    bad = [("sha256:" + "0" * 64, ref.chunk_id, 0, 10), (ref.cache_version, "c_" + "0" * 64, 0, 10), (ref.cache_version, "x", 0, 10), (ref.cache_version, ref.chunk_id, -1, 10), (ref.cache_version, ref.chunk_id, 0, 9999), (ref.cache_version, ref.chunk_id, 99999, 10)]
    req = spark.createDataFrame([(i, 1, "grobid", *b) for i, b in enumerate(bad)], "request_id int, doc_id int, parser string, cache_version string, chunk_id string, offset int, max_chars int")
    assert [r.error for r in E.read_back(req, c).orderBy("request_id").collect()] == [
        "stale_evidence_reference", "evidence_not_found", "invalid_reference", "invalid_offset", "invalid_max_chars", "offset_outside_chunk"]


def test_bundles_fit_the_cap_and_treat_documents_alike(spark):
    rows = [(1, f"p{d}", n, "evidence \"quoted\" \\ " * 60) for d in range(7) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "request_id int, doc_id string, item_no int, text string")
    for cap in (12000, 4096):
        caps = E.cap_bundles(df, cap)
        c = caps.first()
        shown = E.project_bundles(df, caps)
        per = {r.doc_id: r["count"] for r in shown.groupBy("doc_id").count().collect()}
        assert c.size <= cap and len(set(per.values())) <= 1
        assert shown.where("truncated AND next_offset IS NULL").count() == 0
    s = spark.createDataFrame([("x" * 300, 5)], "t string, o int").select(E.shrink(F.col("t"), F.col("o")).alias("s")).first().s
    assert len(s.text) == 256 and s.next_offset == 261 and s.truncated


def test_encoded_bundles_take_the_first_rung_that_fits(spark):
    import random
    rnd = random.Random(4)
    texts = lambda: "".join(rnd.choice('ab "\\\n\u00e9\u4e2d\U0001f600\x01') for _ in range(rnd.choice([0, 5, 40, 300, 1500, 2600])))
    rows, asked = [], []
    for request in range(12):
        for doc in range(1 + request % 5 * 3):
            asked.append((request, f"p{doc}", "error" if (request + doc) % 4 == 0 else "success", rnd.choice([None, "", texts()])))
            rows += [(request, f"p{doc}", n, rnd.choice([texts(), None]), "grobid", f"c{n}") for n in range(1, 1 + rnd.choice([0, 1, 2, 5, 11]))]
    asked += [(99, f"p{doc}", "success", None) for doc in range(300)]
    df = spark.createDataFrame(rows, "request_id int, doc_id string, item_no int, text string, parser string, chunk_id string")
    docs = spark.createDataFrame(asked, "request_id int, doc_id string, status string, note string")
    cap = F.when(F.col("request_id") % 3 == 0, 12000).when(F.col("request_id") % 3 == 1, 4096).otherwise(1500)
    got = {r.request_id: r for r in BU.encode_bundles(df, cap, docs).collect()}

    def plain(request, items, chars, facts=False):
        papers = []
        for _, doc, status, note in sorted(a for a in asked if a[0] == request):
            mine = sorted(r for r in rows if r[:2] == (request, doc))
            if facts:
                papers.append({"paper_id": doc, "status": status, "omitted": True, "coverage": "none"})
                continue
            shown = []
            for r in mine[:items]:
                text = r[3] or ""
                shown.append({"parser": r[4], "chunk_id": r[5], "text": text[:chars], **({"text_truncated": True, "next_offset": chars} if len(text) > chars else {})})
            less, cut, width = len(mine) > len(shown), any("next_offset" in c for c in shown), min(chars, 500)
            note_cut = note is not None and len(note) > width
            papers.append({"paper_id": doc, "status": status, "note": note if note is None else note[:width], "note_truncated": note_cut, "chunks": shown, "omitted_chunks": len(mine) - len(shown),
                           "omitted_chunk_range": [len(shown), len(mine)] if less else None,
                           "coverage": "none" if not shown else "partial" if less or cut else "complete_returned_chunks", "omitted": less or cut or note_cut})
        good = [p["status"] == "success" for p in papers]
        out = {"status": "success" if all(good) else "partial" if any(good) else "error", "papers": papers, "omitted": facts or any(p["omitted"] for p in papers), "readback": json.loads(BU.READBACK)}
        return json.dumps(out | ({"note": BU.FACTS_NOTE} if facts else {}), ensure_ascii=False, separators=(",", ":"))

    rungs = set()
    for request in {a[0] for a in asked}:
        most = [12000, 4096, 1500][request % 3]
        tries = [(n + 1, plain(request, i, c)) for n, (i, c) in enumerate(E.LADDER)] + [(0, plain(request, 0, 0, True)), (-1, None)]
        rung, text = next((n, t) for n, t in tries if t is None or len(t) <= most)
        r = got[request]
        rungs.add(r.rung)
        assert r.rung == rung and (r.encoded is None) == (rung == -1), request
        if text is not None:
            assert json.loads(r.encoded) == json.loads(text) and len(r.encoded) == r.size <= most
    assert 0 in rungs or -1 in rungs
    assert len(got) == 13 and got[99].rung == -1
    assert BU.encode_bundles(df.limit(0), 4096).count() == 0


def test_scoped_overlap_is_counted_without_exchanging_words(spark):
    """bags of words are made inside the row; words that a query repeats count as often as both have them."""
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(n))
    asked = [(i, i % 3, line(rng.randint(1, 9))) for i in range(20)] + [(98, 0, " ?! "), (99, 7, "aa")]
    texts = [(d, p, f"c{n}", line(rng.randint(1, 12))) for d in range(3) for p in ("x", "y") for n in range(4)]
    got = R.retrieve_scoped(spark.createDataFrame(asked, "request_id int, doc_id int, query string"), spark.createDataFrame(texts, "doc_id int, parser string, chunk_id string, text string"), 3)
    want = []
    for r, d, query in asked:
        for p in ("x", "y"):
            bag = Counter(re.findall("[a-z]+", query))
            hits = sorted((query.strip() not in t, -sum((bag & Counter(t.split())).values()), c) for e, q, c, t in texts if (e, q) == (d, p) and set(bag) & set(t.split()))
            want += [(r, p, c, -n, sum(bag.values()), not f) for f, n, c in hits[:3]]
    assert sorted((x.request_id, x.parser, x.chunk_id, x.overlap, x.total, x.phrase) for x in got.collect()) == sorted(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bundle_sizes_are_added_up_once_and_notes_travel_cut(spark, monkeypatch):
    """the chosen rungs are stored before they are read three times, and no whole note is exchanged."""
    named, store = [], getattr(BU, "materialize", None)
    monkeypatch.setattr(BU, "materialize", lambda df, name: (named.append((name, df._jdf.queryExecution().optimizedPlan().toString())), store(df, name))[1], raising=False)
    rows = spark.createDataFrame([(1, 1, 1, "some text")], "request_id int, doc_id int, item_no int, text string")
    docs = spark.createDataFrame([(1, 1, "success", "n" * 500), (1, 2, "success", "m" * 501)], "request_id int, doc_id int, status string, note string")
    papers = json.loads(BU.encode_bundles(rows, 12000, docs).first()["encoded"])["papers"]
    assert [(p["note"], p["note_truncated"]) for p in papers] == [("n" * 500, False), ("m" * 500, True)]
    assert [n for n, _ in named] == ["bundle-rungs"] and "501" in named[0][1]

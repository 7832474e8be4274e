import random

import corpus_pipeline as cp
import test_decontaminate as bench
import test_dedup as copies
import test_jaccard as near
from marginalia.llm import decontaminate

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_each_stage_equals_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(1)
    more = [(10_000 + i, r.choice(items)[1], "en", "s", 1) for i in range(5)] + [(None, None, None, None, None), (20_000, "", "en", "s", 0), (0, docs.first()["text"], "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3).cache()
    good = cp.quality_filter(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()

    kept = rows_of(cp.exact_dedup(spark, docs, SF))
    first = {}
    for row in rows_of(docs):
        key = copies.dedup.normalised(row[1])
        if key not in first or (row[0] is None, row[0]) < (first[key][0] is None, first[key][0]):
            first[key] = row
    assert sorted((str(x[0]), str(x[1])) for x in kept) == sorted((str(x[0]), str(x[1])) for x in first.values())

    comp = near.brute([x[:2] for x in rows_of(docs)])
    stay = sorted(str(d) for d, n, c in comp if n == 0 or d is None or d == c)
    assert sorted(str(x[0]) for x in rows_of(cp.near_dedup(spark, docs, SF))) == stay

    bad = {str(x[0]) for x in bench.brute([x[:2] for x in rows_of(docs)], items) if x[5]}
    clean = cp.decontamination(spark, docs, SF)
    assert bad and clean.columns == docs.columns
    assert {str(x[0]) for x in rows_of(docs)} - {str(x[0]) for x in rows_of(clean)} == bad
    assert decontaminate.WINDOW == 13


def test_pipeline_runs_whole(spark):
    out = cp.run(spark, SF).collect()
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out) > 0
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert sum(n for _, n in parts) <= 1024 and sorted(parts)[0][0] == 0
    assert [n for n, _ in cp.STAGES][0] == "quality_classifier" and len(cp.STAGES) == 5

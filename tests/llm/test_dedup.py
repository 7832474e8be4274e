import collections
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import dedup


@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1cab\x85é", max_size=12))
@settings(deadline=None)
def test_fast_form_equals_the_rule(text):
    assert dedup._fast_normalised(text) == dedup.normalised(text)


def brute(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[dedup.normalised(t)].append(d)
    return groups


def test_groups_equal_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ab \n") for _ in range(r.choice([0, 1, 7, 8, 9, 40, 200]))) for _ in range(40)]
    rows = [(i, r.choice(base + [None, "", "  "])) for i in range(300)] + [(5000, "q" * 3000), (4999, "q" * 3000), (5001, "q" * 2999 + "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = {x["doc_id"]: x for x in dedup.name_documents(docs, block_bytes=8).collect()}
    assert len(out) == len(rows)
    for ids in brute(rows).values():
        for d in ids:
            assert out[d]["keep_id"] == min(ids) and out[d]["group_size"] == len(ids) and out[d]["kept"] == (d == min(ids))


def test_a_block_shared_by_different_texts_goes_to_the_naming_once_per_batch(spark):
    rows = [(i, "the head " + str(i % 250)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sent = dedup.cut_blocks(docs, 8).where("block = CAST('the head' AS BINARY)").count()
    assert sent == 1
    out = dedup.name_documents(docs, block_bytes=8).collect()
    assert len(out) == 500 and all(x["keep_id"] == x["doc_id"] % 250 and x["group_size"] == 2 for x in out)


def test_nulls_repeats_clashes_and_empty(spark):
    schema = "doc_id long, text string, name string, level int, kept string, _sha long"
    rows = [(None, "a", "n", 1, "k", 1), (2, "a", "n", 1, "k", 1), (2, "a", "n", 1, "k", 1), (None, None, None, None, None, None), (3, "b  c", "", 0, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    out = dedup.name_documents(docs).collect()
    assert len(out) == 5 and sum(x["kept"] for x in out) == 3
    assert {(x["keep_id"], x["group_size"]) for x in out} == {(2, 3), (None, 1), (3, 1)}
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns and {x["_sha"] for x in kept.collect()} == {1, None, 0} and sorted(str(x["text"]) for x in kept.collect()) == ["None", "a", "b  c"]
    assert dedup.name_documents(spark.createDataFrame([], schema)).count() == 0
    assert dedup.keep_first(spark.createDataFrame([], schema)).count() == 0

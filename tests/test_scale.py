"""Two-level running aggregates against plain loops, with one key that holds a third of the rows."""

import random

from pyspark.sql import functions as F

from marginalia import scale


def rows_with_hot_key(n=900, seed=3):
    rnd = random.Random(seed)
    keys = ["hot" if i % 3 == 0 else f"k{rnd.randrange(40)}" for i in range(n)]
    at: dict[str, int] = {}
    rows = []
    for k in keys:
        at[k] = at.get(k, 0) + rnd.randrange(1, 4)
        rows.append((k, at[k], rnd.randrange(-5, 6), rnd.choice([None, "a", "b", "c"])))
    rnd.shuffle(rows)
    return rows


def expected(rows, descending, inclusive):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for k, rs in groups.items():
        rs.sort(key=lambda r: r[1], reverse=descending)
        for i, r in enumerate(rs):
            seen = rs[: i + 1] if inclusive else rs[:i]
            vals = [x[2] for x in seen]
            labels = [x[3] for x in seen if x[3] is not None]
            out[(k, r[1])] = (sum(vals), min(vals, default=None), max(vals, default=None), labels[-1] if labels else None)
    return out


def test_running_matches_plain_loop(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, s string")
    for descending in (False, True):
        for inclusive in (False, True):
            got = scale.running(df, ["k"], ["o"], scale.block_of("o", 16), {
                "sum_": ("sum", "v", inclusive), "min_": ("min", "v", inclusive), "max_": ("max", "v", inclusive), "last_": ("last", "s", inclusive)}, descending)
            got = {(r.k, r.o): (r.sum_, r.min_, r.max_, r.last_) for r in got.collect()}
            assert got == expected(rows, descending, inclusive)


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.range(20000).select(F.concat(F.lit("hot"), (F.col("id") % 1).cast("string")).alias("k"), F.col("id").alias("o"))
    plan = scale.number_rows(df, ["k"], ["o"], scale.block_of("o", 256))._jdf.queryExecution().toString()
    assert "hashpartitioning(k#" in plan and "_blk#" in plan
    rn = scale.number_rows(df, ["k"], ["o"], scale.block_of("o", 256))
    assert rn.where("rn <> o + 1").count() == 0


def test_first_rows_cuts_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = scale.first_rows(df, ["k"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_materialize_needs_a_shared_folder(spark):
    assert scale.shared_folder(spark)
    assert scale.materialize(spark.range(5), "t").count() == 5

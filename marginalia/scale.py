"""Building blocks that keep plans balanced when one key holds much of the data.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  ``running``
computes the same running aggregates in two levels: inside (key, block) groups whose
size is bounded by the block width, and over one narrow total row per block.  The wide
rows are exchanged once, on (key, block), so a hot key spreads over many tasks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def session(app: str = "marginalia", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Used where one frame feeds several branches: later stages start from files, so a
    lost executor never forces the branches to be recomputed from the source.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_of(col: Column | str, width: int = BLOCK_ROWS) -> Column:
    """Block number of an integer order column (bounded rows when it is unique per key)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("bigint")


def time_block(col: str, seconds: int = 60) -> Column:
    """Block number of a timestamp order column."""
    return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, aggs: dict[str, tuple],
            descending: bool = False) -> DataFrame:
    """Add running aggregates per key, ordered by ``order``.

    ``aggs`` maps a new column to (kind, column, inclusive) with kind in sum, min, max,
    last (last non-null).  ``block`` must be monotone in ``order``.
    """
    blocked = df.withColumn("_blk", block)
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    local_w = Window.partitionBy(*keys, "_blk").orderBy(*ordering)
    blk_order = F.col("_blk").desc() if descending else F.col("_blk").asc()
    prefix_w = Window.partitionBy(*keys).orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)

    totals, prefixes, locals_ = [], [], []
    for name, (kind, col, inclusive) in aggs.items():
        c = F.col(col) if isinstance(col, str) else col
        frame = local_w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        t, p, l = f"_t_{name}", f"_p_{name}", f"_l_{name}"
        if kind == "last":
            pick = F.min_by if descending else F.max_by
            totals.append(pick(c, F.when(c.isNotNull(), F.struct(*order))).alias(t))
            prefixes.append(F.last(t, ignorenulls=True).over(prefix_w).alias(p))
            locals_.append(F.last(c, ignorenulls=True).over(frame).alias(l))
        else:
            fn = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            totals.append(fn(c).alias(t))
            prefixes.append(fn(t).over(prefix_w).alias(p))
            locals_.append(fn(c).over(frame).alias(l))
    per_block = blocked.groupBy(*keys, "_blk").agg(*totals)
    prefix = per_block.select(*keys, "_blk", *prefixes)
    # Window functions first, then the join: both need (keys, block), so one exchange serves both.
    out = blocked.select("*", *locals_).join(prefix, [*keys, "_blk"], "left")
    for name, (kind, _c, _i) in aggs.items():
        p, l = F.col(f"_p_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            value = F.when(p.isNull() & l.isNull(), F.lit(0)).otherwise(F.coalesce(p, F.lit(0)) + F.coalesce(l, F.lit(0)))
        elif kind == "min":
            value = F.least(p, l)
        elif kind == "max":
            value = F.greatest(p, l)
        else:
            value = F.coalesce(l, p)
        out = out.withColumn(name, value)
    drop = ["_blk"] + [f"_{x}_{n}" for n in aggs for x in ("p", "l")]
    return out.drop(*drop)


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "rn") -> DataFrame:
    """Dense 1-based row number per key that does not gather a key in one task."""
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"), True)})


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key.  The bound on the row number lets Spark keep k rows per key in every
    map task before the exchange (WindowGroupLimit), so hot keys arrive already cut."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(k)).withColumn(name, F.col(name).cast("bigint"))


def settle(df: DataFrame) -> DataFrame:
    """Compute all columns here, once per row.

    Filters on computed columns are normally moved below the projection by repeating its expressions; for
    chains of costly array expressions that multiplies the work.  Columns that come out of a generator are
    not repeated, so one single-row generator keeps the chain in place.  No exchange, no Python.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))

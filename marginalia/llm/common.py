"""Helpers shared by the corpus operators: table access, ranks over all rows, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.scale import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def fold_remainder(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids count as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def crc_text(value) -> int:
    """Python twin of the id text used by ``fold_remainder``."""
    import zlib
    return zlib.crc32(b"" if value is None else str(value).encode())


def ranked(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> tuple[DataFrame, DataFrame]:
    """Running totals over the whole table in a total order, with no task that sees all rows.

    Rows are dealt into ranges of the order and sorted inside them; the ranges are written once, each range's
    sums are added up over the (few) ranges before it, and meet their rows again.  ``sums`` maps a new column
    (the sum over all rows before this one) to a column.  Returns the rows and a one-row frame of the totals.
    """
    staged = materialize(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), name)
    # The upper bits of the generated number name the range, the lower ones the place in it.
    ranges = staged.groupBy(F.shiftrightunsigned("_at", 33).alias("_range")).agg(*[F.sum(c).cast("bigint").alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn("_range", F.shiftrightunsigned("_at", 33)).select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("bigint").alias(f"_l_{n}") for n, c in sums.items()])
    out = local.join(starts, "_range").select(
        *[c for c in df.columns], *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])
    return out, ranges.agg(*[F.coalesce(F.sum(f"_s_{n}"), F.lit(0)).alias(n) for n in sums])


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most_bytes`` of text, or one longer row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        lengths = [0 if n is None else n for n in pa.compute.binary_length(col).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)

"""Exports, notes, index storage and cascade deletes (SK-1 .. SK-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T


def section_export(wide: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SK-1: one JSON object per document with its six section texts."""
    return wide.select(id_col, F.to_json(F.struct(F.col(id_col).cast("string").alias("paper_id"), *K.SECTION_KEYS)).alias("json"))


def write_section_export(wide: DataFrame, path: str, id_col: str = "doc_id") -> None:
    section_export(wide, id_col).select("json").write.mode("overwrite").text(path)


def bullets(items: Column) -> Column:
    some = F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, some).otherwise("- 暂无")


def note(record: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SK-2: Markdown reading note; columns title, authors, year, venue, abstract, problem, motivation, method_summary,
    experiment_summary and the lists innovation_points, limitations, inspirations."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("未知"))
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("暂无"))
    names = F.coalesce(F.nullif(F.array_join("authors", "、"), F.lit("")), F.lit("未知"))
    # Fixed text of the note template.
    parts = [
        F.lit("# 论文精读笔记\n\n## 1. 基本信息\n\n- 标题："), known("title"), F.lit("\n- 作者："), names, F.lit("\n- 年份："), known("year"),
        F.lit("\n- 会议/期刊："), known("venue"), F.lit("\n\n### 摘要\n\n"), some("abstract"), F.lit("\n\n## 2. 论文解决的问题\n\n"), some("problem"),
        F.lit("\n\n## 3. 背景与动机\n\n"), some("motivation"), F.lit("\n\n## 4. 核心方法\n\n"), some("method_summary"),
        F.lit("\n\n## 5. 创新点总结\n\n"), bullets(F.col("innovation_points")), F.lit("\n\n## 6. 实验设计与结果\n\n"), some("experiment_summary"),
        F.lit("\n\n## 7. 方法优点\n\n"), some("method_summary"), F.lit("\n\n## 8. 方法局限\n\n"), bullets(F.col("limitations")),
        F.lit("\n\n## 9. 对我研究的启发\n\n"), bullets(F.col("inspirations")), F.lit("\n"),
    ]
    return record.select(id_col, F.concat(*parts).alias("note"))


def save_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """SK-3: chunk index, partitioned by a hash bucket of the document so that a document's chunks lie together."""
    bucketed = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id", "section", "idx") \
        .write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_index(spark: SparkSession, path: str, wanted: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """SK-3: the index, or the part of some documents (``wanted``: doc_id).  The join on the bucket lets Spark
    prune partitions at run time."""
    df = spark.read.parquet(path)
    if wanted is not None:
        ids = wanted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
        df = df.join(ids, ["bucket", "doc_id"], "left_semi")
    return df.drop("bucket")


def cascade_delete(tombstones: DataFrame, tables: dict[str, DataFrame], key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """SK-4: every dependent table without the deleted keys, and how many rows of each key went where."""
    dead = tombstones.select(key).distinct()
    kept = {name: df.join(dead, key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        c = df.join(dead, key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted_rows")).withColumn("table_name", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    return kept, counts

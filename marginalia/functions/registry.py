"""UD-2: named SQL functions with their input and output columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marginalia.functions.json_tables import JsonLeaves
from marginalia.functions.similarity import matcher_ratio
from marginalia.operators.chunks import ChunkText

# name -> (kind, required input columns, produced columns)
CONTRACTS = {
    "text_similarity": ("scalar", ["left", "right"], ["double"]),
    "chunk_text": ("table", ["text", "size", "overlap"], ["idx", "start_char", "end_char", "text"]),
    "json_leaves": ("table", ["json"], ["path", "value"]),
}


def register_all(spark: SparkSession) -> dict[str, tuple]:
    """Register every function of this package for use in SQL text."""
    spark.udf.register("text_similarity", matcher_ratio)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("json_leaves", JsonLeaves)
    return CONTRACTS

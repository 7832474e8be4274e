"""Files to tables: content identity, legacy imports, page text, parse caches (IN-1 .. IN-7, IN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.sessions import insert_or_ignore
from marginalia.scale import settle


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One test table.  ``spread`` re-balances an input that has fewer splits than cores (one small file);
    on a cluster, where splits outnumber cores, it leaves the scan alone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def read_binary(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """IN-1: file path, base name, size and SHA-256 of every file; the bytes leave the plan right after the hash."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(max_bytes))
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", T.base_name(F.col("path")).alias("file_name"), F.col("length").alias("size_bytes"),
                    F.sha2("content", 256).alias("content_hash"), "modificationTime")


def content_identity(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """IN-1 on a text table."""
    return texts.select(id_col, F.sha2(text_col, 256).alias("content_hash"), F.octet_length(text_col).cast("bigint").alias("size_bytes"))


def canonical_ids(arriving: DataFrame, registry: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """IN-2 / JN-1: the identity each arrival gets; a known hash is reused, in the batch the smallest id wins.

    ``arriving``: id, content_hash; ``registry``: paper_id, content_hash.  Only ids and hashes are exchanged,
    the winners combine on the map side, and a hot hash joins one row.
    """
    known = registry.groupBy("content_hash").agg(F.min("paper_id").alias("_known"))
    winner = arriving.groupBy("content_hash").agg(F.min(id_col).alias("_first"))
    who = winner.join(known, "content_hash", "left")
    j = arriving.select(id_col, "content_hash").join(who, "content_hash")
    return j.select(id_col, "content_hash", F.coalesce("_known", "_first").alias("paper_id"),
                    (F.col("_known").isNotNull() | (F.col(id_col) != F.col("_first"))).alias("reused"))


def live_registry(registry: DataFrame, available: DataFrame) -> DataFrame:
    """IN-3: registry rows whose file still exists; stale ones give way to the next arrival."""
    return registry.join(available.select("paper_id").distinct(), "paper_id", "left_semi")


def import_papers(listing: DataFrame, index_json: DataFrame, registry: DataFrame) -> DataFrame:
    """IN-4: rows to add from a legacy hash index and a file listing; running it twice adds nothing.

    ``listing``: paper_id, path, file_hash; ``index_json``: json (one index document per row);
    ``registry``: paper_id, content_hash.
    """
    entry = "map<string,struct<paper_id:string,filename:string>>"
    idx = index_json.select(F.explode(F.map_entries(F.from_json("json", f"by_hash {entry}")["by_hash"])).alias("e")) \
        .select(F.col("e.value.paper_id").alias("paper_id"), F.col("e.key").alias("_hash")).where("paper_id IS NOT NULL") \
        .groupBy("paper_id").agg(F.max("_hash").alias("_hash"))
    rows = listing.join(idx, "paper_id", "left").select(
        "paper_id", "path", F.coalesce("_hash", "file_hash").alias("content_hash"), T.original_name(F.col("path"), F.col("paper_id")).alias("filename"))
    fresh = rows.join(registry.select("content_hash"), "content_hash", "left_anti").join(registry.select("paper_id"), "paper_id", "left_anti")
    one = fresh.groupBy("content_hash").agg(F.min_by(F.struct("paper_id", "filename", "path"), "path").alias("r"))
    return one.select("r.paper_id", "content_hash", "r.filename", "r.path")


SESSION_JSON = "session_id string, paper_id string, active_paper_ids array<string>, updated_at string, messages array<struct<role:string,content:string>>"


def parse_sessions(payloads: DataFrame, json_col: str = "json", expected: str | None = None) -> DataFrame:
    """IN-6: legacy chat files; broken JSON is an empty record, a record under another session's name is dropped."""
    p = payloads.withColumn("_s", F.from_json(json_col, SESSION_JSON + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    corrupt = F.col("_s").isNull() | F.col("_s._corrupt_record").isNotNull()
    status = F.when(corrupt, "corrupt")
    if expected:
        status = status.when(F.col("_s.session_id").isNull() | (F.col("_s.session_id") != T.strip(F.col(expected))), "wrong_session")
    return p.withColumn("status", status.otherwise("ok"))


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """IN-6 on files: one JSON document per file."""
    return parse_sessions(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def import_sessions(payloads: DataFrame, sessions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IN-5: session headers and session-document links to add, insert-or-ignore.

    ``payloads``: ord, json; ``sessions``: session_id; ``links``: session_id, paper_id.
    """
    ok = parse_sessions(payloads).where("status = 'ok'").select(
        "ord", T.strip(F.col("_s.session_id")).alias("session_id"), T.strip(F.coalesce("_s.paper_id", F.lit(""))).alias("current"),
        F.coalesce("_s.active_paper_ids", F.array().cast("array<string>")).alias("active"), F.col("_s.updated_at").alias("updated_at"))
    ok = ok.where("session_id <> ''")
    heads = insert_or_ignore(sessions, ok.select("session_id", "ord", F.nullif("current", F.lit("")).alias("current_paper_id"), "updated_at"),
                             ["session_id"], ["ord"]).drop("ord")
    ids = F.filter(F.transform(F.concat("active", F.array("current")), T.strip), lambda x: x != "")
    rel = ok.select("session_id", "ord", F.posexplode(ids).alias("p", "paper_id"))
    return heads, insert_or_ignore(links, rel, ["session_id", "paper_id"], ["ord", "p"]).select("session_id", "paper_id")


PAGE_MARK = "(?md)^--- Page (\\p{Nd}+) ---\\s*$"


def requested_pages(docs: DataFrame, pages: Column, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """IN-7: requested pages of page-marked text with found flags; of repeated markers the last wins.

    Everything happens inside the row: no exchange.
    """
    nums = F.regexp_extract_all(text_col, F.lit(PAGE_MARK), F.lit(1))
    parts = F.split(text_col, PAGE_MARK, -1)
    d = settle(docs.select(id_col, F.array_distinct(pages).alias("_want"), nums.alias("_nums"), parts.alias("_parts")))
    d = d.withColumn("_pages", F.transform("_nums", lambda n, i: F.struct(n.cast("int").alias("page"), T.strip(F.get("_parts", i + 1)).alias("text"))))
    d = settle(d.select(id_col, "_pages", "_want")).select(id_col, "_pages", F.explode("_want").alias("page"))
    hit = F.try_element_at(F.filter("_pages", lambda p: p["page"] == F.col("page")), F.lit(-1))
    d = d.withColumn("_hit", hit)
    return d.select(id_col, F.col("page").cast("bigint").alias("page"), F.coalesce("_hit.text", F.lit("")).alias("text"),
                    F.col("_hit").isNotNull().alias("found"))


def parse_worklist(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """IN-12: (paper_id, parser) pairs without a valid cached result of the same parser.

    ``cache``: paper_id, parser, payload_parser, valid.
    """
    good = cache.where("valid AND payload_parser = parser").select("paper_id", "parser")
    return wanted.join(good, ["paper_id", "parser"], "left_anti")


def store_parses(parses: DataFrame, path: str) -> None:
    """IN-12: replace only the partitions of the parsers that ran."""
    parses.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parser").parquet(path)

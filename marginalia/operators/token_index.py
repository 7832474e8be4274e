"""A stored token index over chunk texts (RT-1, SK-3).

The index is a folder.  Every run that finds new document versions adds one segment; a run that finds none writes
nothing.  A segment holds

* ``texts``: each distinct chunk text once, numbered so that texts with alike words are neighbours,
* ``owners``: which document and chunk has which text,
* ``blocks``: for every token and block of ``BLOCK_TEXTS`` neighbouring texts the texts that have it, how often, and
  the largest of these counts; a table in buckets of text ranges, sorted by token,
* ``docs``: the document versions that it covers.

A bucket holds all tokens of its texts, so overlaps are summed without an exchange, and a token that every text has
is spread over all buckets.  ``state`` names the segments that count; it is written last, so a broken run leaves files
that nobody reads.  Documents that are gone or changed are masked by a snapshot of the living versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.scale import shared_folder

FORMAT = 2  # of the stored tables; an index of another format is not read
PLACE_BITS = 6
BLOCK_TEXTS = 1 << PLACE_BITS
SEGMENT_BITS = 52  # text numbers of a segment: up to 2 ** 19 tasks of 2 ** 33 texts each
RANGE_BLOCKS = 64   # blocks of one text range, which is never parted
BUCKETS = 64
_BLOCK_DDL = "token string, range bigint, block bigint, n_texts int, max_n int, entries array<int>"


@dataclass(frozen=True)
class TokenIndex:
    spark: SparkSession
    path: str
    segments: tuple[str, ...]
    live: str | None = None

    def _all(self, part: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/segments/{s}/{part}") for s in self.segments])

    def texts(self) -> DataFrame:
        """text_no, text."""
        return self._all("texts").select("text_no", "text")

    def docs(self) -> DataFrame:
        """doc_id, version of all segments, living or not."""
        return self._all("docs")

    def owners(self) -> DataFrame:
        """text_no, doc_id, chunk_id of living documents."""
        owners = self._all("owners")
        if self.live:
            owners = owners.join(self.spark.read.parquet(f"{self.path}/live/{self.live}"), ["doc_id", "version"], "left_semi")
        return owners.drop("version")

    def living_texts(self) -> DataFrame | None:
        """text_no of texts that a living document has; None if all are."""
        return self.owners().select("text_no").distinct() if self.live else None

    def blocks(self) -> DataFrame:
        """token, range, block, n_texts, max_n, entries; ``entry`` reads an entry."""
        return reduce(DataFrame.unionByName, self.block_tables())

    def block_tables(self) -> list[DataFrame]:
        """The blocks of each segment, in buckets of ranges; a text is in one segment only."""
        def table(segment: str) -> DataFrame:
            name = _table_name(segment)
            if not self.spark.catalog.tableExists(name):
                self.spark.sql(f"CREATE TABLE {name} ({_BLOCK_DDL}) USING parquet CLUSTERED BY (range) SORTED BY (token) INTO {BUCKETS} BUCKETS "
                               f"LOCATION '{self.path}/segments/{segment}/blocks'")
            return self.spark.table(name)
        return [table(s) for s in self.segments]


def entry(block: str = "block", col: str = "entry") -> tuple[Column, Column]:
    """text_no and count that an entry of a block stands for: place in the block and count share one number."""
    e = F.col(col)
    return F.col(block) * BLOCK_TEXTS + e.bitwiseAND(BLOCK_TEXTS - 1), F.shiftright(e, PLACE_BITS)


def store_by_range(df: DataFrame, name: str) -> DataFrame:
    """Write a frame in the buckets of the blocks and read it back: a join on ``range`` then moves neither side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(BUCKETS, "range").write.bucketBy(BUCKETS, "range").option("path", f"{shared_folder(spark).rstrip('/')}/marginalia/{table}").saveAsTable(table)
    return spark.table(table)


def _table_name(segment: str) -> str:
    return f"token_blocks_{segment}"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is finished in a folder; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    return [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def open_index(spark: SparkSession, path: str) -> TokenIndex | None:
    """The index as its last finished run left it."""
    states = _names(spark, f"{path}/state")
    if not states:
        return None
    state = json.loads(spark.read.text(f"{path}/state/{max(states)}").first()[0])
    return TokenIndex(spark, path, tuple(state["segments"]), state["live"])


def _commit(index: TokenIndex) -> TokenIndex:
    number = len(_names(index.spark, f"{index.path}/state"))
    row = json.dumps({"segments": index.segments, "live": index.live})
    index.spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{index.path}/state/{number:09d}")
    return index


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, version: one digest of all texts that an id has."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return hashed.groupBy("doc_id").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("h"))), 256).alias("version"))


def refresh(docs: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame]) -> TokenIndex:
    """Bring the index at ``path`` to the given documents (doc_id, text) and open it.

    ``chunk`` cuts documents to rows doc_id, chunk_id, text; it sees new or changed documents only.  Null texts count
    as empty.  A second run over the same documents reads their texts for the digests and writes nothing.
    """
    spark, path = docs.sparkSession, f"{path}/format={FORMAT}"
    now, index = versions(docs), open_index(spark, path)
    if index is None:
        return _commit(TokenIndex(spark, path, (_write_segment(spark, path, 0, docs, now, chunk),)))
    known = index.docs()
    held = spark.read.parquet(f"{path}/live/{index.live}") if index.live else known
    pair = lambda df, mark: df.select(F.struct("doc_id", "version").alias("pair"), F.lit(True).alias(mark)).distinct()
    seen = pair(now, "now").join(pair(held, "held"), "pair", "full").join(pair(known, "known"), "pair", "full")
    new, changed, gone = seen.agg(*[F.count_if(c) for c in (
        F.col("now").isNotNull() & F.col("known").isNull(), F.col("now").isNull() != F.col("held").isNull(), F.col("now").isNull())]).first()
    if not changed:
        return index
    segments = index.segments
    if new:
        fresh = now.join(known, ["doc_id", "version"], "left_anti")
        segments += (_write_segment(spark, path, len(segments), docs.join(fresh.select("doc_id"), "doc_id", "left_semi"), fresh, chunk),)
    live = None
    if gone:
        live = uuid.uuid4().hex
        now.write.parquet(f"{path}/live/{live}")
    return _commit(TokenIndex(spark, path, segments, live))


def of_chunks(chunks: DataFrame, path: str) -> TokenIndex:
    """An index of given chunks (doc_id, chunk_id, text) at a new path."""
    spark = chunks.sparkSession
    none = chunks.select("doc_id", F.lit("").alias("version")).distinct()
    return _commit(TokenIndex(spark, path, (_write_segment(spark, path, 0, chunks, none, lambda df: df),)))


def _write_segment(spark: SparkSession, path: str, number: int, docs: DataFrame, fresh: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> str:
    segment = uuid.uuid4().hex
    base = f"{path}/segments/{segment}"
    chunk(docs).select("doc_id", "chunk_id", F.sha2("text", 256).alias("text_id"), "text").write.parquet(f"{base}/chunks")
    chunks = spark.read.parquet(f"{base}/chunks")
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Neighbours by the smallest token hash: texts that share words tend to share it.  Texts of one frequent word may be many, so
    # they are dealt out by their own names too.  Copies have the same place, so one exchange brings them together and orders them.
    # Words between blanks serve for that, and cost less than tokens; only texts with CJK characters have few of them.
    words = F.when(F.col("text").rlike(r"[\u4e00-\u9fff]"), T.tokens(F.col("text"))).otherwise(F.split(F.lower("text"), " "))
    near = F.array_min(F.transform(words, lambda t: F.xxhash64(t)))
    dealt = chunks.select("text_id", "text", near.alias("near"), F.pmod(F.xxhash64("text_id"), F.lit(8)).alias("deal")).repartition(tasks, "near", "deal")
    texts = dealt.groupBy("near", "deal", "text_id").agg(F.first("text").alias("text"))
    placed = texts.sortWithinPartitions("near", "text_id").select(
        (F.monotonically_increasing_id() + (number << SEGMENT_BITS)).alias("text_no"), "text_id", "text")
    placed.write.parquet(f"{base}/texts")  # the numbers count as they are stored
    numbered = spark.read.parquet(f"{base}/texts")
    chunks.join(numbered.select("text_no", "text_id"), "text_id").join(fresh, "doc_id", "left").select(
        "text_no", "doc_id", "version", "chunk_id").write.parquet(f"{base}/owners")
    blocks = numbered.select("text_no", T.tokens(F.col("text")).alias("tokens")).mapInArrow(_blocks, _BLOCK_DDL)
    blocks.repartition(BUCKETS, "range").sortWithinPartitions("token", "block").write.bucketBy(BUCKETS, "range").sortBy("token") \
        .option("path", f"{base}/blocks").saveAsTable(_table_name(segment))
    fresh.write.parquet(f"{base}/docs")
    return segment


def _blocks(batches):
    """Rows of numbered texts, which come in order, to (token, block) rows; a block cut by two readers gives two."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        block = table["text_no"].to_numpy() // BLOCK_TEXTS
        whole = int(np.searchsorted(block, block[-1])) if len(block) else 0
        yield from _block_rows(table.slice(0, whole))
        rest = table.slice(whole)  # the last block may go on in the next batch
    if rest is not None:
        yield from _block_rows(rest)


def _block_rows(texts: pa.Table):
    """The rows of whole blocks: tokens count by (block, token, place), which one sorted number names."""
    if not texts.num_rows:
        return
    texts = texts.combine_chunks()
    numbers, lists = texts["text_no"].to_numpy(), texts["tokens"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    words = lists.flatten().dictionary_encode()
    width = len(words.dictionary)
    if not width:
        return
    owner = np.repeat(numbers, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    first = numbers[0] // BLOCK_TEXTS
    name = ((owner // BLOCK_TEXTS - first) * width + words.indices.to_numpy()) * BLOCK_TEXTS + owner % BLOCK_TEXTS
    name, count = np.unique(name, return_counts=True)
    row = name // BLOCK_TEXTS
    start = np.flatnonzero(np.diff(row, prepend=-1))
    block, ends = row[start] // width + first, np.append(start, len(row))
    entries = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(count << PLACE_BITS | name % BLOCK_TEXTS, pa.int32()))
    yield pa.RecordBatch.from_arrays([
        words.dictionary.take(pa.array(row[start] % width)), pa.array(block // RANGE_BLOCKS, pa.int64()), pa.array(block, pa.int64()),
        pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(count, start), pa.int32()), entries],
        names=["token", "range", "block", "n_texts", "max_n", "entries"])

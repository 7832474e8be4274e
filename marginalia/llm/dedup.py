"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes.  Equal blocks are brought together and sorted,
and each distinct block gets an integer name.  Adjacent names are then paired and the pairs named again, until
every text has one name.  A name stands for exactly one content at its level, so two texts share (level, name)
if and only if they are identical: no hash decides.

Copies that meet in one batch of the scan travel as one group, so a text held by a third of all rows brings one
row per batch to the naming, not one per copy.  A block that different texts of one batch share goes to the naming
once; its name comes back to them by the number that the block has in its batch.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import fresh
from marginalia.scale import materialize

BLOCK_BYTES = 2048
BLANKS = rb"[\x20\x09-\x0D]+"
BLANKS_SQL = r"[\x20\x09-\x0D]+"


def normalised(text: str | None) -> bytes:
    return re.sub(BLANKS, b" ", (text or "").encode())


def _fast_normalised(text: str | None) -> bytes:
    raw = (text or "").encode()
    words = raw.split()  # splits at exactly the blanks above
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def _block_rows(block_bytes: int):
    def rows(batches):
        made = bids = TaskContext.get().partitionId() << 40
        for batch in batches:
            groups: dict[bytes, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(_fast_normalised(text), []).append(doc)
            out: dict[str, list] = {k: [] for k in _BLOCKS.names}
            held, numbers = 0, {}
            for text, ids in groups.items():
                n = max(1, -(-len(text) // block_bytes))
                ids.sort(key=lambda d: (d is None, d))
                for i in range(n):
                    block = text[i * block_bytes:(i + 1) * block_bytes]
                    out["block"].append(None if block in numbers else block)
                    if block not in numbers:
                        numbers[block], bids = bids, bids + 1
                    out["bid"].append(numbers[block])
                    out["gid"].append(made)
                    out["idx"].append(i)
                    out["n"].append(n)
                    out["ids"].append(ids if i == 0 else None)
                    out["sha"].append(hashlib.sha256(text).hexdigest() if i == 0 else None)
                    held += block_bytes
                made += 1
                if held > 8_000_000:
                    yield _arrow(out)
                    out, held, numbers = {k: [] for k in out}, 0, {}
            yield _arrow(out)
    return rows


_BLOCKS = pa.schema([("block", pa.binary()), ("bid", pa.int64()), ("gid", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("sha", pa.string())])
_NAMED = pa.schema([("bid", pa.int64()), ("name", pa.int64())])


def _arrow(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(out, schema=_BLOCKS)


def _name_sorted(batches):
    """Integer names for blocks that arrive sorted, equal ones in one task."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        names = []
        for block in batch.column(0):
            block = block.as_py()
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.int64())], schema=_NAMED)


def cut_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of all texts of (doc_id, text); ``block`` is null where the batch has brought this block before, under the same ``bid``."""
    return docs.mapInArrow(_block_rows(block_bytes), "block binary, bid bigint, gid bigint, idx bigint, n bigint, ids array<bigint>, sha string")


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of blanks became one space; null counts as empty, and all empty texts are
    one group.  Of a group the smallest id stays (a null id is larger than any other); of repeated rows with that
    id exactly one has ``kept``.  An empty table gives an empty result.  Other columns are ignored, so their names
    cannot clash.
    """
    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(cut_blocks(raw, block_bytes), "blocks")
    names = (blocks.where("block IS NOT NULL").select("block", "bid").repartition("block").sortWithinPartitions("block")
             .mapInArrow(_name_sorted, "bid bigint, name bigint"))
    named = materialize(blocks.drop("block").join(names, "bid").drop("bid"), "block-names")
    groups = named.where("idx = 0").select("gid", "ids", "sha")
    done = [named.where("n = 1").select("gid", F.lit(0).alias("level"), "name")]
    current, level = named.where("n > 1").select("gid", "idx", "n", "name"), 0
    longest = named.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = materialize(
            current.groupBy("gid", F.shiftright("idx", 1).alias("idx"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "block-pairs")
        names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        current = materialize(pairs.join(names, ["a", "b"]).select("gid", "idx", "n", "name"), "pair-names")
        done.append(current.where("n = 1").select("gid", F.lit(level).alias("level"), "name"))
        current = current.where("n > 1")
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    member = identity.join(groups, "gid")
    first = F.struct(F.col("ids")[0].isNull().alias("no_id"), F.col("ids")[0].alias("id"), F.col("gid").alias("gid"))
    classes = member.groupBy("level", "name").agg(F.min(first).alias("first"), F.sum(F.size("ids")).alias("group_size"))
    return (member.join(classes, ["level", "name"])
            .select("gid", "first", "group_size", "sha", F.posexplode("ids").alias("pos", "doc_id"))
            .select("doc_id", F.col("first.id").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
                    ((F.col("gid") == F.col("first.gid")) & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns and types; one row of each group of equal texts."""
    kept = name_documents(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_kept_sha"))
    sha, again = fresh(docs, "_sha"), fresh(docs, "_again")
    keyed = docs.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS_SQL, " ").cast("binary"), 256))
    met = keyed.join(kept, keyed[sha].eqNullSafe(kept["_kept_sha"]) & keyed[id_col].cast("bigint").eqNullSafe(kept["_keep"]), "left_semi")
    # Repeated rows share id and text; one of them stays.
    same = Window.partitionBy(id_col, sha).orderBy(F.lit(1))
    return met.withColumn(again, F.row_number().over(same)).where(F.col(again) == 1).select(*docs.columns)

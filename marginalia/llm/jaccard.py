"""Exact Jaccard join of shingle sets with skipping by set relations.

Every text is the set of its hashed word shingles; equal sets are one class.  Shingles have one global order (the
frequent ones last), and two sets that link must share a shingle among the first quarter of each set, its prefix.

* Block skipping: the list of a shingle is cut into blocks of sets of similar size.  A set that holds the shingle
  at position i cannot link with sets beyond a size that i determines, so it visits only the blocks below.
* Counting in prefixes: prefixes are longer than one common shingle needs, so two sets that link share many there;
  pairs that share too few are dropped before the sets are read.
* Answers from a similar set: each block has a leader, the set with most frequent shingles.  A set is compared
  with one leader first.  Sets that link with it are done among themselves; for the rest, the known overlaps with
  a common leader bound the overlap of two sets from above and below, so most pairs are decided without reading
  the sets: |A and B| <= |A and L| + |B| - |B and L|, and >= |A and L| + |B and L| - |L|.

What is asked for is which sets are connected, so pairs inside a component are never formed.  All remaining pairs
of different components that share a prefix shingle and pass the bounds are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices
from marginalia.llm.vectors import mix, sequence_hash, word_hashes
from marginalia.scale import materialize

WIDTH = 5
HEAVY_IN_RUN = 3            # a shingle in so many sets of one run of the scan counts as frequent
RUN_TOKENS = 4_000_000      # shingles of a run
HEAVY_TOKENS = 1_000_000    # frequent shingles put last; any order gives the same links, this bounds the broadcast
BROADCAST_IDS = 2_000_000   # rows of one or a few numbers that may be broadcast; beyond that, tables are joined by exchange
CLASS_BASE = 1.1            # size ratio of neighbouring blocks

# The threshold 3/4 in integers: sets of a and b shingles link from ceil(3 (a + b) / 7) common ones.


def prefix_length(n):
    """How many of the first shingles must hold a common one: n - ceil(3n/4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def shingle_sets(texts: list[str | None], seed: int = 0, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of many texts, by owner and hash."""
    hashes, counts, _ = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    full = sequence_hash(hashes, width)
    same = owner[:len(full)] == owner[width - 1:] if len(full) else np.zeros(0, bool)
    tokens, of = [full[same]], [owner[:len(full)][same]]
    for short in range(1, width):
        for i in np.flatnonzero(counts == short):
            end = int(counts[:i + 1].sum())
            tokens.append(sequence_hash(hashes[end - short:end], short))
            of.append(np.array([i]))
    token, own = np.concatenate(tokens), np.concatenate(of)
    if seed:
        token = mix(token + np.uint64(seed))
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return own[new], token[new]


def _names(own: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit name (two sums of mixed hashes) of each set."""
    size = np.bincount(own, minlength=n).astype(np.int64)
    at = np.cumsum(size) - size
    some = size > 0
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(token):
        high[some] = np.add.reduceat(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[some])
        low[some] = mix(np.add.reduceat(mix(token + np.uint64(0x1234567)), at[some]))
    return size, high, low


_SET_SCHEMA = "doc_id bigint, n bigint, high bigint, sid bigint, token bigint, seen bigint"


def _scan_sets(seed: int):
    names = ["doc_id", "n", "high", "sid", "token", "seen"]

    def often(held):
        keys, seen = np.unique(np.concatenate(held), return_counts=True)
        more = seen >= HEAVY_IN_RUN
        none = pa.nulls(int(more.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys[more].view(np.int64)), pa.array(seen[more].astype(np.int64))], names=names)

    def rows(batches):
        held: list[np.ndarray] = []
        for batch in slices(batches, "text", 1_500_000):
            texts = batch.column(1).to_pylist()
            own, token = shingle_sets(texts, seed)
            size, high, low = _names(own, token, len(texts))
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), none, none], names=names)
            held.append(token)
            if sum(map(len, held)) > RUN_TOKENS:
                yield often(held)
                held = []
        if held:
            yield often(held)
    return rows


_ENTRY_SCHEMA = "token bigint, sid bigint, n int, pos int, core int"


def _scan_prefixes(seed: int, heavy):
    """Prefix entries of every set.  ``heavy`` holds the frequent shingles, sorted, and their ranks in the order."""
    def rows(batches):
        tokens, ranks = heavy.value
        for batch in slices(batches, "text", 1_500_000):
            texts = batch.column(1).to_pylist()
            own, token = shingle_sets(texts, seed)
            size, _, low = _names(own, token, len(texts))
            at = np.minimum(np.searchsorted(tokens, token), max(len(tokens) - 1, 0))
            often = tokens[at] == token if len(tokens) else np.zeros(len(token), bool)
            key = np.where(often, np.uint64(1 << 63) + ranks[at], token >> np.uint64(1)) if len(tokens) else token
            order = np.lexsort((token, key, own))
            own, token = own[order], token[order]
            pos = np.arange(len(own)) - (np.cumsum(size) - size)[own]
            core = np.bincount(own[often[order]], minlength=len(texts))
            keep = pos < prefix_length(size[own])
            own = own[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[keep].view(np.int64)), pa.array(low[own].view(np.int64)), pa.array(size[own], pa.int32()), pa.array(pos[keep], pa.int32()),
                 pa.array(core[own], pa.int32())], names=["token", "sid", "n", "pos", "core"])
    return rows


def _scan_arrays(seed: int, names: list[str]):
    """Rows of (doc_id, text, wanted, names...) to (names..., tokens), where the text's set is the wanted one."""
    def rows(batches):
        for batch in slices(batches, "text", 1_500_000):
            texts = batch.column(1).to_pylist()
            own, token = shingle_sets(texts, seed)
            size, _, low = _names(own, token, len(texts))
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            tokens = pa.ListArray.from_arrays(ends, pa.array(token.view(np.int64)))
            right = pa.array(low.view(np.int64) == batch.column(2).to_numpy(zero_copy_only=False))
            out = pa.RecordBatch.from_arrays([*(batch.column(3 + i) for i in range(len(names))), tokens], names=[*names, "tokens"])
            yield out.filter(right)
    return rows


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(CLASS_BASE)))).cast("int")


def _need(a: str, b: str) -> Column:
    """Least number of common shingles of two sets that link."""
    return F.expr(f"({a} + {b}) * 3 div 7 + CASE WHEN ({a} + {b}) * 3 % 7 = 0 THEN 0 ELSE 1 END")


def _probes(entries: DataFrame) -> DataFrame:
    """Entries with the blocks they must visit: sizes within 3/4, and below what their position allows."""
    low = F.expr("greatest(1, (3 * n + 3) div 4)")
    high = F.expr("least(4 * n div 3, 7 * (n - pos) div 3 - n)")
    return entries.where(high >= low).withColumn("cls", F.explode(F.sequence(_class(low), _class(high))))


_SIZES_AND_POSITIONS = "4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n) AND 7 * least(a_n - a_pos, b_n - b_pos) >= 3 * (a_n + b_n)"


# With so many common tokens up to these positions, and all tokens behind them common too.
_CAN_REACH = "7 * (hits + least(a_n - a_pos, b_n - b_pos) - 1) >= 3 * (a_n + b_n)"


def by_prefixes(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs whose prefixes have enough in common.

    Take the set whose prefix ends first in the global order.  What two sets share up to there lies in both
    prefixes, and behind it are no more than the other shingles of that set.
    """
    left = prefixes.select(F.col("sid").alias("a"), F.col("prefix").alias("_pa"))
    right = prefixes.select(F.col("sid").alias("b"), F.col("prefix").alias("_pb"))
    behind = "greatest((3 * a_n + 3) div 4, (3 * b_n + 3) div 4) - 1"
    met = pairs.join(left, "a").join(right, "b")
    return met.where(7 * (F.size(F.array_intersect("_pa", "_pb")) + F.expr(behind)) >= 3 * (F.col("a_n") + F.col("b_n"))).drop("_pa", "_pb")


def overlaps(pairs: DataFrame, texts: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b, a_n, b_n) with ``common``, the number of shingles both sets hold.

    The sets are cut again from one text of each class, where the texts lie; then the sets of all ``a`` meet that
    of their ``b``.  Many pairs with one ``b`` are split by Spark's skew join, since both sides come by exchange.
    """
    rep = lambda c: classes.select(F.col("sid").alias(c), F.col("rep").alias("doc_id"))
    left = materialize(pairs.join(rep("a"), "a").select("doc_id", F.col("a").alias("wanted"), "a", "b", "a_n", "b_n"), "near-left")
    right = materialize(pairs.select("b").distinct().join(rep("b"), "b").select("doc_id", F.col("b").alias("wanted"), "b"), "near-right")

    def sets(asked: DataFrame, names: list[str], kinds: str) -> DataFrame:
        few = asked.count() <= BROADCAST_IDS
        met = texts.join(F.broadcast(asked) if few else asked, "doc_id").select("doc_id", "text", "wanted", *names)
        return met.mapInArrow(_scan_arrays(seed, names), f"{kinds}, tokens array<bigint>")

    first = sets(left, ["a", "b", "a_n", "b_n"], "a bigint, b bigint, a_n int, b_n int").withColumnRenamed("tokens", "_ta")
    second = sets(right, ["b"], "b bigint").withColumnRenamed("tokens", "_tb")
    shared = first.join(second, "b").select("a", "b", "a_n", "b_n", F.size(F.array_intersect("_ta", "_tb")).alias("common"))
    return shared.groupBy("a", "b", "a_n", "b_n").agg(F.max("common").alias("common"))  # repeated rows give a pair again


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """Node and the smallest node it is connected with, for all nodes of ``edges`` (u, v).

    Every node takes the smallest label around it, then the label of its label, until nothing changes; each step
    is written, so no step depends on an executor that is gone.
    """
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), f"{name}-labels")
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        hooked = labels.join(around, "u").select("u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        step = materialize(hooked.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("next", "label")).alias("label")), f"{name}-labels")
        labels = step.select("u", "label")
        if step.where("old <> label").limit(1).count() == 0:
            return labels


def _sets(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows with their set, classes of equal sets, frequent shingles, and the seed that keeps set ids apart."""
    seed = 0
    while True:
        scanned = materialize(raw.mapInArrow(_scan_sets(seed), _SET_SCHEMA), "near-sets")
        rows = scanned.where("token IS NULL").select("doc_id", "n", "high", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
        classes = materialize(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid", "high", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
        if classes.groupBy("sid").count().where("count > 1").limit(1).count() == 0:
            return rows, classes, scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")), seed
        seed += 1  # two different sets got the same 64-bit id


def link_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with set size and set id; classes (sid, rep); links (a, b) between set ids that connect all linked sets."""
    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows, classes, often, seed = _sets(raw)
    spark, named = docs.sparkSession, raw.where("doc_id IS NOT NULL")
    top = often.orderBy(F.col("seen").desc(), "token").limit(HEAVY_TOKENS).select("token").toArrow()
    tokens = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    ranks = np.arange(len(tokens), 0, -1).astype(np.uint64)  # most frequent last
    order = np.argsort(tokens)
    heavy = spark.sparkContext.broadcast((tokens[order], ranks[order]))
    # One text of each class gives the entries; the copies are taken out by their ids.
    copies = materialize(rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("sid", "rep"), "sid").where("doc_id <> rep").select("doc_id").distinct(), "near-copies")
    single = named.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    ties = rows.where("n > 0").join(copies, "doc_id").join(classes.select("sid", "rep"), "sid").where("doc_id = rep").select("doc_id").distinct()
    again = named.join(F.broadcast(ties) if copies.count() <= BROADCAST_IDS else ties, "doc_id")  # ids that are a copy in one row and stand for a class in another
    all_entries = materialize(single.unionByName(again).mapInArrow(_scan_prefixes(seed, heavy), _ENTRY_SCHEMA), "near-prefixes")
    shared = materialize(all_entries.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token"), "near-shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared
    entries = materialize(all_entries.join(shared, "token").distinct(), "near-entries")

    # The shared part of each prefix, for counting what two prefixes have in common.
    prefixes = materialize(entries.groupBy("sid").agg(F.collect_list("token").alias("prefix")), "near-prefix-sets")

    # Each set against one leader, if it can be near: this only spares work below, so a miss loses nothing.
    leaders = materialize(entries.groupBy("token", _class(F.col("n")).alias("cls")).agg(F.max(F.struct("core", "n", "sid", "pos")).alias("lead")), "near-leaders")
    met = (_probes(entries).join(leaders, ["token", "cls"])
           .select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("lead.sid").alias("b"), F.col("lead.n").alias("b_n"), F.col("lead.pos").alias("b_pos"))
           .where(f"a <> b AND {_SIZES_AND_POSITIONS}"))
    best = (met.groupBy("a", "a_n", "b", "b_n").agg(F.count("*").alias("hits"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos")).where(_CAN_REACH)
            .groupBy("a", "a_n").agg(F.max(F.struct("hits", "b_n", "b")).alias("to")).select("a", "a_n", F.col("to.b").alias("b"), F.col("to.b_n").alias("b_n")))
    best = materialize(by_prefixes(best, prefixes), "near-best")
    known = materialize(overlaps(best, named, classes, seed), "near-known")
    first = known.where(F.col("common") >= _need("a_n", "b_n")).select("a", "b")
    comp = components(first.toDF("u", "v"), "near-first")

    # What is left: pairs of different components.
    told = known.select(F.col("a").alias("sid"), F.col("b").alias("lead"), F.col("b_n").alias("lead_n"), F.col("common").alias("lead_common")).unionByName(
        # A leader without a leader of its own stands at distance nothing from itself.
        known.select(F.col("b").alias("sid"), F.col("b_n").alias("n")).distinct().join(known.select(F.col("a").alias("sid")), "sid", "left_anti")
        .select("sid", F.col("sid").alias("lead"), F.col("n").alias("lead_n"), F.col("n").alias("lead_common")))
    facts = materialize(entries.select("sid").distinct().join(comp.select(F.col("u").alias("sid"), F.col("label").alias("comp")), "sid", "left").join(told, "sid", "left")
                        .withColumn("comp", F.coalesce("comp", "sid")), "near-facts")
    placed = materialize(entries.drop("core").join(facts, "sid"), "near-placed")
    major = (placed.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token")
             .agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("m.comp").alias("major")))
    mixed = materialize(placed.join(materialize(major, "near-major"), "token"), "near-mixed")
    shown = ["sid", "n", "pos", "comp", "lead", "lead_n", "lead_common"]
    probe = _probes(mixed.where("comp <> major")).select("token", "cls", *[F.col(c).alias(f"a_{c}") for c in shown])
    index = mixed.withColumn("cls", _class(F.col("n"))).select("token", "cls", (F.col("comp") == F.col("major")).alias("b_major"), *[F.col(c).alias(f"b_{c}") for c in shown])
    upper = "(a_lead IS NULL OR b_lead IS NULL OR a_lead <> b_lead OR 7 * least(a_lead_common + b_n - b_lead_common, b_lead_common + a_n - a_lead_common) >= 3 * (a_n + b_n))"
    pairs = (probe.join(index, ["token", "cls"]).where(f"a_comp <> b_comp AND (b_major OR a_sid < b_sid) AND {_SIZES_AND_POSITIONS} AND {upper}")
             .withColumn("flip", F.expr("a_sid > b_sid")))
    side = lambda x, y, c: F.expr(f"IF(flip, {y}_{c}, {x}_{c})")
    pairs = pairs.select(side("a", "b", "sid").alias("a"), side("b", "a", "sid").alias("b"), side("a", "b", "n").alias("a_n"), side("b", "a", "n").alias("b_n"),
                         side("a", "b", "pos").alias("a_pos"), side("b", "a", "pos").alias("b_pos"),
                         F.expr("IF(a_lead = b_lead, a_lead_common + b_lead_common - a_lead_n, 0)").alias("at_least"))
    counted = (pairs.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("hits"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"), F.max("at_least").alias("at_least"))
               .where(_CAN_REACH))
    counted = materialize(by_prefixes(counted, prefixes), "near-pairs")
    sure = counted.where(F.coalesce("at_least", F.lit(0)) >= _need("a_n", "b_n")).select("a", "b")
    asked = counted.where(F.coalesce("at_least", F.lit(0)) < _need("a_n", "b_n")).select("a", "b", "a_n", "b_n")
    second = overlaps(asked, named, classes, seed).where(F.col("common") >= _need("a_n", "b_n")).select("a", "b")
    return rows, classes, materialize(first.unionByName(sure).unionByName(second), "near-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A set with fewer words than a shingle is its whole word sequence; a text without words, or null, has the empty
    set and links with nothing.  Rows with one id are one document: each reports its own set size, and the links
    of all its texts count.  A null id takes no part in links and has a null component unless its set equals that
    of a document with an id.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows, classes, links = link_sets(docs, id_col, text_col)
    name = lambda c: classes.select(F.col("sid").alias(c), F.col("rep").alias(f"{c}_rep"))
    edges = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"))
    # Rows of one id with different sets tie these sets together.
    ties = rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("sid", "rep"), "sid").where("doc_id <> rep").select("doc_id", "rep")
    several = ties.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v")
    spread = ties.join(several.select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v")).where("u <> v")
    comp = components(edges.unionByName(spread), "near-all")
    reps = classes.join(comp.select(F.col("u").alias("rep"), "label"), "rep", "left").select("sid", F.coalesce("label", "rep").alias("component"))
    return rows.join(reps, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document with its smallest id.

    Rows with a null id and texts without words stay.
    """
    gone = near_components(docs, id_col, text_col).where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")

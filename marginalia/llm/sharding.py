"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, every row gets the index of its cell on the Hilbert
curve through the grid, rows are ordered by that index, and the order is cut into runs of equal row counts.  Near
cells are near on the curve, so each shard covers small ranges of every dimension and a reader can skip shards by
the minima and maxima of any of them.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ranked, whole_text

BITS = 5


def bounds(df: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list]:
    """Cut points of every dimension: at most 2^bits - 1 values each, at equal shares of the rows.

    Numbers use approximate percentiles.  Strings use exact counts of their distinct values; the running share
    over distinct values is taken in ranges of the values, so many distinct values do not meet in one task.
    Nulls have no part in the cuts.  Only the cut points reach the driver.
    """
    cuts: dict[str, list] = {}
    parts = 1 << bits
    numeric = [c for c in dims if dict(df.dtypes)[c] != "string"]
    if numeric:
        shares = [i / parts for i in range(1, parts)]
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10_000).alias(f"c{i}") for i, c in enumerate(numeric)]).first()
        cuts |= {c: sorted(set(row[i] or [])) for i, c in enumerate(numeric)}
    for c in dims:
        if c not in cuts:
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("value")).agg(F.count("*").alias("rows"))
            order, total = ranked(counts, ["value"], {"before": "rows"}, "shard-values")
            whole = total.first()[0]
            code = F.floor(F.col("before") * parts / F.lit(max(whole, 1)))
            cuts[c] = sorted(r[0] for r in order.groupBy(code).agg(F.min("value")).select("min(value)").collect())
    return cuts


def quantised(col: str, cuts: list, bits: int = BITS) -> Column:
    """Cell number of a value: how many cut points are at or below it; null is 0."""
    if not cuts:
        return F.lit(0)
    value = F.col(f"`{col}`")
    value = value if isinstance(cuts[0], str) else value.cast("double")
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut <= value))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.least(below, F.lit((1 << bits) - 1)))


def hilbert(codes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve through a grid of len(codes) dimensions with 2^bits cells each.

    One bit plane after another, from the top: the plane's corner number is turned into the orientation of the
    current sub-cube, its rank in Gray order is the next digit, and entry corner and direction are updated.  The
    small tables below come from the rule of the Gray code.
    """
    n = len(codes)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(i) for i in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    ones = [((i + 1) & -(i + 1)).bit_length() - 1 for i in range(1 << n)]  # how many low bits are set
    turn = [0 if w == 0 else (ones[w - 1] if w % 2 == 0 else ones[w]) % n for w in range(1 << n)]
    right = [[((v >> s) | (v << (n - s))) & full for v in range(1 << n)] for s in range(n + 1)]
    left = [[((v << s) | (v >> (n - s))) & full for v in range(1 << n)] for s in range(n + 1)]

    def table(values: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    t_rank, t_entry, t_turn = table(rank), table(entry), table(turn)
    t_right, t_left = table([x for r in right for x in r]), table([x for r in left for x in r])
    corners = [sum((F.shiftright(c.cast("int"), p).bitwiseAND(1) * (1 << d) for d, c in enumerate(codes)), F.lit(0)) for p in range(bits - 1, -1, -1)]
    digit = lambda s, x: F.element_at(t_rank, F.element_at(t_right, (s["d"] + 1) * (1 << n) + x.bitwiseXOR(s["e"]) + 1) + 1)

    def step(s: Column, x: Column) -> Column:
        w = digit(s, x)
        return F.struct(
            s["e"].bitwiseXOR(F.element_at(t_left, (s["d"] + 1) * (1 << n) + F.element_at(t_entry, w + 1) + 1)).alias("e"),
            F.pmod(s["d"] + F.element_at(t_turn, w + 1) + 1, F.lit(n)).cast("int").alias("d"),
            (F.shiftleft(s["h"], n) + w.cast("bigint")).alias("h"))

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("h"))
    return F.aggregate(F.array(*[c.cast("int") for c in corners]), start, step, lambda s: s["h"])


def assign_shards(df: DataFrame, dims: list[str], shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """All rows with ``curve`` (cell on the curve), ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Shards differ by one row at most.  Ties on the curve follow ``tie``; rows equal there too take neighbouring
    slots in either order.  Null dimensions fall into cell 0.  An empty table gives an empty result.  Columns of
    ``df`` named curve, shard or slot are replaced, all others stay, whatever their names: a row travels as one value.
    """
    df = df.drop("curve", "shard", "slot")
    cuts = bounds(df, dims, bits)
    curve = hilbert([quantised(c, cuts[c], bits) for c in dims], bits)
    ties = [F.col(f"`{c}`").alias(f"tie{n}") for n, c in enumerate(tie)]
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), curve.alias("curve"), F.lit(1).alias("one"), *ties)
    out, totals = ranked(placed, ["curve", *[f"tie{n}" for n in range(len(tie))]], {"rank": "one"}, "shard-order")
    rows = max(1, totals.first()[0])
    # Long division stays exact: rank * shards / rows in integers.
    shard = F.expr(f"(rank * {shards}L) div {rows}L")
    start = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return out.withColumn("shard", shard).withColumn("slot", (F.col("rank") - start).cast("bigint")).select("row.*", "curve", F.col("shard").cast("int").alias("shard"), "slot")


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """One row per shard: rows and the least and greatest value of every dimension, for skipping shards."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(f"`{c}`").alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str, parts: int = 1) -> None:
    """Write one folder per shard; ``parts`` files each, rows in curve order inside a file."""
    (sharded.withColumn("_file", F.pmod(F.col("slot"), F.lit(parts))).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
     .drop("_file").write.partitionBy("shard").parquet(path))


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents ordered along language, source and log2 size; the digest columns of the shard query."""
    size = F.octet_length(whole_text()) + F.lit(1)
    narrow = docs.select(
        F.col("doc_id"), F.col("lang"), F.col("source"), size.cast("bigint").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"))
    placed = assign_shards(narrow.withColumn("log_size", F.log2("size")), ["lang", "source", "log_size"], shards, ["text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")

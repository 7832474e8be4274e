"""Similarity join of titles by the matcher ratio, complete for a stated threshold (JN-11).

The ratio of two strings is 2M / S, with M matched characters and S characters in all.  At a ratio of at least t no more
than U = (1 - t) S characters are unmatched.  Matched blocks lie apart by at least one of them, so there are at most
1 + U blocks, and the strings share at least (S - U) / 2 - (q - 1)(1 + U) q-grams, counted with repeats.

* Where that number is positive, both strings have a shared q-gram among the first ``G - need + 1`` of their G q-grams
  in one order, rarest first: a join on these prefixes loses no pair.
* Shorter pairs leave U <= 2 or so characters unmatched: deleting them from both strings gives one string, so a join
  on all strings with up to U deletions loses no pair.

Pairs are then bounded by length and by common letters, in SQL expressions; only pairs that can still reach the
threshold go to the matcher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.similarity import similarity
from marginalia.scale import materialize, settle

Q = 4
LETTERS = "abcdefghijklmnopqrstuvwxyz "


def unmatched(total: int, permille: int) -> int:
    return (1000 - permille) * total // 1000


def shared_grams(total: int, permille: int) -> int:
    """Least number of shared q-grams of two strings of ``total`` characters at the threshold."""
    u = unmatched(total, permille)
    return -(-(total - u) // 2) - (Q - 1) * (1 + u)


def short_total(permille: int) -> int:
    """Largest S for which the q-gram bound says nothing."""
    if permille // 2 <= (Q - 1) * (1000 - permille):
        raise ValueError(f"a threshold of {permille} thousandths is too low for {Q}-grams")
    return max(s for s in range(1, 4000) if shared_grams(s, permille) < 1)


def length_bound(a: Column, b: Column) -> Column:
    """No ratio of the two strings is larger: twice the shorter over both lengths."""
    x, y = F.char_length(a), F.char_length(b)
    return 2.0 * F.least(x, y) / F.greatest(x + y, F.lit(1))


def letter_counts(t: Column) -> Column:
    """How often each common letter occurs, and how many other characters there are."""
    n = F.char_length(t)
    counts = [n - F.char_length(F.replace(t, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*counts, F.char_length(F.translate(t, LETTERS, "")))


def common_letters(counts_a: Column, counts_b: Column) -> Column:
    """How many characters both can have in common, by their letter counts."""
    return sum((F.least(F.get(counts_a, F.lit(i)), F.get(counts_b, F.lit(i))) for i in range(1, len(LETTERS) + 1)), F.least(F.get(counts_a, F.lit(0)), F.get(counts_b, F.lit(0))))


def letter_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No ratio is larger: letters that both strings have, over both lengths."""
    return 2.0 * common_letters(counts_a, counts_b) / F.greatest(F.char_length(a) + F.char_length(b), F.lit(1))


def _prefix_size(n: Column, permille: int) -> Column:
    """How many of a title's q-grams must be looked up, by its length; 0 if short partners are all it can have."""
    low = F.greatest(F.lit(short_total(permille) + 1), n + F.ceil(n * permille / F.lit(2000 - permille)).cast("int"))
    high = n + F.floor(n * (2000 - permille) / F.lit(permille)).cast("int")

    def need(s: Column) -> Column:
        u = F.floor((1000 - permille) * s / 1000).cast("int")
        return F.ceil((s - u) / 2).cast("int") - (Q - 1) * (1 + u)

    least = F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(low, high), need)))
    return F.when((low <= high) & (n >= Q), n - Q + 1 - least + 1).otherwise(0)


def _deletions(t: Column, most: int) -> Column:
    """(deleted, string) for all strings that up to ``most`` deletions give."""
    def once(s: Column) -> Column:
        n = F.char_length(s)
        cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))

    def told(level: Column, k: int) -> Column:
        return F.transform(level, lambda s: F.struct(F.lit(k).alias("deleted"), s.alias("string")))

    levels = [F.array(t)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], once))))
    return F.flatten(F.array(*[told(level, k) for k, level in enumerate(levels)]))


def plausible_pairs(ours: DataFrame, theirs: DataFrame, permille: int) -> DataFrame:
    """our, their: pairs of different titles (column t, distinct) that the bounds do not refuse.

    Titles travel as numbers; each carries its letter counts, so a pair that cannot reach the threshold is refused
    where it is met, before any exchange of pairs.
    """
    sides = ours.select("t", F.lit(1).alias("o"), F.lit(0).alias("h")).unionByName(theirs.select("t", F.lit(0).alias("o"), F.lit(1).alias("h")))
    titles = sides.where("t <> ''").groupBy("t").agg(F.max("o").alias("o"), F.max("h").alias("h"))
    titles = titles.withColumn("n", F.char_length("t")).withColumn("counts", letter_counts(F.col("t"))).withColumn("take", _prefix_size(F.char_length("t"), permille)).withColumn("id", F.monotonically_increasing_id())
    titles = materialize(titles, "titles")

    at = F.explode(F.sequence(F.lit(1), F.col("n") - Q + 1))
    grams = titles.where(F.col("n") >= Q).select("id", "o", "h", "take", "t", at.alias("p")).select("id", "o", "h", "take", F.substring("t", F.col("p"), F.lit(Q)).alias("gram"))
    counted = grams.groupBy("id", "o", "h", "take", "gram").agg(F.count("*").cast("int").alias("c"))
    numbered = materialize(counted.select("id", "o", "h", "take", "gram", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("no")), "title-grams")
    # Grams that one side alone has make no pair, and stand first in the order.
    df = numbered.groupBy("gram", "no").agg((F.sum("o") * F.sum("h")).alias("df"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram", "no"))
    prefix = numbered.join(df, ["gram", "no"]).withColumn("rk", order).where("rk <= take AND df > 0")
    prefix = materialize(prefix.select("id", "o", "h", "gram", "no").join(titles.select("id", "n", "counts"), "id"), "title-prefixes")

    def fits(a: str, b: str) -> Column:
        total = F.col(a) + F.col(b)
        return 2000 * F.least(a, b) >= permille * total

    def likely() -> Column:
        return common_letters(F.col("c1"), F.col("c2")) * 2000 >= permille * (F.col("n1") + F.col("n2"))

    o = prefix.where("o = 1").select(F.col("id").alias("our"), F.col("n").alias("n1"), F.col("counts").alias("c1"), "gram", "no")
    h = prefix.where("h = 1").select(F.col("id").alias("their"), F.col("n").alias("n2"), F.col("counts").alias("c2"), "gram", "no")
    long = o.join(h, ["gram", "no"]).where((F.col("our") != F.col("their")) & fits("n1", "n2") & likely()).select("our", "their")

    most = short_total(permille)
    cut = titles.where(F.col("n") <= most * (2000 - permille) // 2000 + 1).select("id", "o", "h", F.inline(_deletions(F.col("t"), unmatched(most, permille)))).where("string <> ''")
    a = cut.where("o = 1").select(F.col("id").alias("our"), F.col("deleted").alias("d1"), "string")
    b = cut.where("h = 1").select(F.col("id").alias("their"), F.col("deleted").alias("d2"), "string")
    short = a.join(b, "string").where((F.col("our") != F.col("their")) & (F.col("d1") + F.col("d2") <= unmatched(most, permille))).select("our", "their")

    pairs = materialize(long.unionByName(short).distinct(), "title-pair-ids")
    left = titles.select(F.col("id").alias("our"), F.col("t").alias("our_t"), F.col("n").alias("n1"), F.col("counts").alias("c1"))
    right = titles.select(F.col("id").alias("their"), F.col("t").alias("their_t"), F.col("n").alias("n2"), F.col("counts").alias("c2"))
    return pairs.join(left, "our").join(right, "their").where(likely()).select(F.col("our_t").alias("our"), F.col("their_t").alias("their"))


def similar_titles(ours: DataFrame, theirs: DataFrame, permille: int) -> DataFrame:
    """our, their, similarity: all pairs of titles (column t) with a ratio of at least ``permille`` thousandths.

    Titles are compared as they are and should be lower case with single blanks.  Null and empty titles match nothing.
    """
    ours, theirs = ours.select("t").distinct(), theirs.select("t").distinct()
    same = ours.where("t <> ''").join(theirs, "t", "left_semi").select(F.col("t").alias("our"), F.col("t").alias("their"), F.lit(1.0).alias("similarity"))
    pairs = materialize(plausible_pairs(ours, theirs, permille), "title-pairs")
    scored = settle(pairs.withColumn("similarity", similarity(F.col("our"), F.col("their")))).where(F.col("similarity") >= permille / 1000 - 1e-12)
    return same.unionByName(scored)

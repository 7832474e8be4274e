"""Context budgets over every prefix of every conversation (CB-1 .. CB-8, AG-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.operators.sessions import compressible_prefix, recent_turns
from marginalia.scale import block_of, materialize, running

ENVELOPE_BYTES, ITEM_OVERHEAD = 29, 16


def message_bytes(role: Column, content: Column) -> Column:
    """Bytes of one serialized message, with the blanks after ',' and ':' that the envelope writes."""
    doc = F.to_json(F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(content, F.lit("")).alias("content")))
    return (F.octet_length(doc) + 3).cast("bigint")


def input_size(byte_sum: Column, n: Column) -> Column:
    """CB-1: bytes of the envelope around n messages, plus 16 for each message and the request."""
    return (byte_sum + F.greatest(2 * (n - 1), F.lit(0)) + ENVELOPE_BYTES + ITEM_OVERHEAD * (n + 1)).cast("bigint")


def measure(messages: DataFrame, keys: list[str], role: str = "role", content: str = "text") -> DataFrame:
    """CB-1 per group; sums combine on the map side."""
    m = messages.select(*keys, message_bytes(F.col(role), F.col(content)).alias("b"))
    g = m.groupBy(*keys).agg(F.sum("b").alias("bytes"), F.count("*").alias("n_messages"))
    return g.withColumn("input_size", input_size(F.col("bytes"), F.col("n_messages")))


def with_budget(df: DataFrame, size: str = "input_size", window: int = K.WINDOW, output: int = K.MAX_OUTPUT, safety: int = K.SAFETY,
                input_limit: int | None = None, trigger: int = 80, target: int = 60, target_budget: int = 80) -> DataFrame:
    """CB-2: budget, trigger and target; ratios in percent, so the arithmetic stays exact.

    The trigger and the hard limit are reached at equality.
    """
    b = window - output - safety
    t100, g100 = min(trigger * window, 100 * b), min(target * window, target_budget * b)
    i = F.col(size)
    over = F.lit(False) if input_limit is None else i + safety > input_limit
    return df.select("*", F.lit(b).cast("bigint").alias("budget"), F.lit(t100).cast("bigint").alias("trigger_x100"),
                     F.lit(g100).cast("bigint").alias("target_x100"), (i * 100 >= t100).alias("trigger_reached"),
                     (i >= b).alias("hard_exceeded"), over.alias("input_limit_exceeded"))


def prefix_budgets(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text", **limits) -> DataFrame:
    """CB-3: the budget after every message of every conversation."""
    m = messages.select(key, order, message_bytes(F.col(role), F.col(content)).alias("_b"))
    m = running(m, [key], [order], block_of(order), {"bytes": ("sum", "_b", True), "n_messages": ("sum", F.lit(1).cast("bigint"), True)})
    m = m.withColumn("input_size", input_size(F.col("bytes"), F.col("n_messages"))).drop("_b")
    return with_budget(m, **limits)


def config_reason(df: DataFrame) -> Column:
    """CB-4: why a capacity configuration is refused, or 'ok'.

    Columns: window, max_output, safety, input_limit, output_limit (may be NULL), trigger_pct, target_pct, target_budget_pct.
    """
    c = F.col
    positive = (c("window") > 0) & (c("max_output") > 0) & (c("safety") > 0) & \
        (c("input_limit").isNull() | (c("input_limit") > 0)) & (c("output_limit").isNull() | (c("output_limit") > 0))
    ratios = (c("target_pct") > 0) & (c("target_pct") < c("trigger_pct")) & (c("trigger_pct") < 100) & (c("target_budget_pct") > 0) & (c("target_budget_pct") < 100)
    return (
        F.when(~F.coalesce(positive, F.lit(False)), "not_positive").when(c("window") - c("max_output") - c("safety") <= 0, "no_input_budget")
        .when(c("max_output") > c("output_limit"), "output_above_limit").when(c("input_limit") <= c("safety"), "input_limit_below_safety")
        .when(~ratios, "bad_ratios").otherwise("ok")
    )


def compaction_config_reason(recent: Column, target: Column, output: Column) -> Column:
    """CB-4 for the summary settings; ``recent`` in percent."""
    return F.when(~F.coalesce((recent >= 0) & (recent < 100), F.lit(False)), "bad_recent_ratio") \
        .when(~F.coalesce((target > 0) & (output > 0), F.lit(False)), "not_positive").when(target >= output, "target_not_below_output").otherwise("ok")


def turns_to_fold(turns: DataFrame, keep: Column) -> DataFrame:
    """CB-5: eligible turns minus the retained newest ones, but at least the oldest eligible turn.

    ``turns``: session_id, ord (1-based), size, compressible.
    """
    t = materialize(compressible_prefix(turns).where("eligible"), "eligible-turns")
    t = materialize(recent_turns(t, keep), "retained-turns")
    oldest = t.groupBy("session_id").agg(F.min("ord").alias("_oldest"))
    t = t.join(oldest, "session_id")
    return t.withColumn("fold", ~F.col("retained") | (F.col("ord") == F.col("_oldest"))).drop("_oldest", "eligible")


def fitting_prefix(folding: DataFrame, base: int, budget: int) -> DataFrame:
    """CB-6: longest prefix of the turns to fold whose request (base + sizes) stays below the budget."""
    t = running(folding.where("fold"), ["session_id"], ["ord"], block_of("ord"), {"_sum": ("sum", "size", True)})
    fit = base + F.col("_sum") < budget
    return t.groupBy("session_id").agg(F.count_if(fit).alias("chosen"), F.max(F.when(fit, F.col("ord"))).alias("boundary_ord"),
                                       F.max(F.when(fit, F.col("_sum"))).alias("chosen_size")) \
        .withColumn("reason", F.when(F.col("chosen") == 0, "summary_input_budget_no_complete_prefix").otherwise("ok"))


def audit_attempts(attempts: DataFrame, quota: int = 2) -> DataFrame:
    """CB-7: verdict on each summary attempt of a turn.

    ``attempts``: session_id, turn_id, number, boundary, before, after, trigger (boolean).
    A turn makes at most a few attempts; the previous boundary is a two-level running value all the same.
    """
    a = running(attempts, ["session_id", "turn_id"], ["number"], block_of("number"), {"_prev": ("max", "boundary", False)})
    reason = (
        F.when(F.col("number") > quota, "quota_exhausted").when(~F.col("trigger"), "not_triggered").when(F.col("boundary").isNull(), "no_compressible_old_turns")
        .when(F.col("boundary") <= F.coalesce("_prev", F.lit(0)), "cannot_expand_summary_scope")
        .when(F.col("after") >= F.col("before"), "summary_did_not_shorten").otherwise("committed")
    )
    return a.withColumn("verdict", reason).drop("_prev")


def audit_retries(attempts: DataFrame, quota: int = 1) -> DataFrame:
    """CB-8: was a retry after a failed request in order?

    ``attempts``: session_id, turn_id, number, overflow, partial_output, before, after, hard_exceeded.
    """
    a = running(attempts, ["session_id", "turn_id"], ["number"], block_of("number"), {
        "_used": ("sum", (F.col("overflow") & ~F.col("partial_output") & (F.col("after") < F.col("before")) & ~F.col("hard_exceeded")).cast("bigint"), False)})
    used = F.coalesce("_used", F.lit(0))
    verdict = (
        F.when(F.col("partial_output"), "partial_output").when(~F.col("overflow"), "not_an_overflow").when(used >= quota, "retry_quota_exhausted")
        .when(F.col("hard_exceeded"), "hard_budget_exceeded").when(F.col("after") >= F.col("before"), "no_input_reduction").otherwise("retry")
    )
    return a.withColumn("verdict", verdict).drop("_used")


def size_by_origin(messages: DataFrame, keys: list[str], origin: str = "origin", role: str = "role", content: str = "text") -> DataFrame:
    """AG-9: input size of each origin on its own."""
    return measure(messages, [*keys, origin], role, content)

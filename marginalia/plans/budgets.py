"""Context budget queries (CB-1 .. CB-8, AG-9, WN-6, WN-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import budget as B
from marginalia.operators import sessions as S
from marginalia.plans.base import query, session_events, table, with_views
from marginalia.plans.logs import ORIG, SAFE, _origins
from marginalia.scale import block_of, materialize, number_rows

MB = "strlen(CAST(to_json({'role': role, 'content': text}) AS VARCHAR)) + 3"
SIZE = lambda b, n: f"CAST({b} + greatest(2 * ({n} - 1), 0) + 29 + 16 * ({n} + 1) AS BIGINT)"
# Small limits, so that the test conversations reach every state.
W, O, SF = 4000, 600, 100
LIMITS = dict(window=W, output=O, safety=SF)


@query("cb1_input_size", f"SELECT conv_id, count(*) AS n_messages, {SIZE(f'sum({MB})', 'count(*)')} AS input_size FROM conversations GROUP BY conv_id")
def _(spark, d):
    return B.measure(table(spark, d, "conversations"), ["conv_id"]).select("conv_id", "n_messages", "input_size")


def _flags(i: str) -> str:
    b = W - O - SF
    return f"{i} * 100 >= {min(80 * W, 100 * b)} AS trigger_reached, {i} >= {b} AS hard_exceeded, {i} + {SF} > 3000 AS input_limit_exceeded"


@query("cb2_budgets", f"SELECT conv_id, input_size, CAST({W - O - SF} AS BIGINT) AS budget, {_flags('input_size')} FROM (SELECT conv_id, {SIZE(f'sum({MB})', 'count(*)')} AS input_size FROM conversations GROUP BY conv_id)")
def _(spark, d):
    m = B.measure(table(spark, d, "conversations"), ["conv_id"])
    return B.with_budget(m, input_limit=3000, **LIMITS).select("conv_id", "input_size", "budget", "trigger_reached", "hard_exceeded", "input_limit_exceeded")


@query("cb3_prefix_budgets", f"""SELECT conv_id, turn, input_size, {_flags('input_size')} FROM (SELECT conv_id, turn, {SIZE(f'sum({MB}) OVER (PARTITION BY conv_id ORDER BY turn)', 'count(*) OVER (PARTITION BY conv_id ORDER BY turn)')} AS input_size FROM conversations)""")
def _(spark, d):
    p = B.prefix_budgets(table(spark, d, "conversations"), input_limit=3000, **LIMITS)
    return p.select("conv_id", "turn", "input_size", "trigger_reached", "hard_exceeded", "input_limit_exceeded")


@query("cb4_config_reasons", """WITH c AS (SELECT event_id, event_id % 5 * 1000 AS w, event_id % 7 * 500 AS o, event_id % 3 * 400 AS s, CASE WHEN event_id % 4 = 0 THEN 700 END AS il, CASE WHEN event_id % 6 = 0 THEN 1200 END AS ol, 70 + event_id % 40 AS tp, 60 + event_id % 25 AS gp, 80 AS bp FROM events)
   SELECT event_id, CASE WHEN NOT (w > 0 AND o > 0 AND s > 0) THEN 'not_positive' WHEN w - o - s <= 0 THEN 'no_input_budget' WHEN o > ol THEN 'output_above_limit' WHEN il <= s THEN 'input_limit_below_safety' WHEN NOT (gp < tp AND tp < 100) THEN 'bad_ratios' ELSE 'ok' END AS reason,
     CASE WHEN event_id % 120 >= 100 THEN 'bad_recent_ratio' WHEN o = 0 OR s = 0 THEN 'not_positive' WHEN s >= o THEN 'target_not_below_output' ELSE 'ok' END AS summary_reason FROM c""")
def _(spark, d):
    i = F.col("event_id")
    c = table(spark, d, "events").select(
        "event_id", (i % 5 * 1000).alias("window"), (i % 7 * 500).alias("max_output"), (i % 3 * 400).alias("safety"), F.when(i % 4 == 0, 700).alias("input_limit"), F.when(i % 6 == 0, 1200).alias("output_limit"),
        (70 + i % 40).alias("trigger_pct"), (60 + i % 25).alias("target_pct"), F.lit(80).alias("target_budget_pct"))
    return c.select("event_id", B.config_reason(c).alias("reason"), B.compaction_config_reason(i % 120, F.col("safety"), F.col("max_output")).alias("summary_reason"))


# Ended turns of each session with their sizes; a turn is compressible when it ends at a safe boundary and
# its number is not 5 (so that the prefix rule matters).
TURNS = SAFE + """, cl AS (SELECT session_id, turn_id, min(seq) AS start_seq, min(CASE WHEN event_type = 'turn/end' THEN seq END) AS end_seq, CAST(sum(length(coalesce(content, ''))) AS BIGINT) + 100 AS size FROM session_events_v GROUP BY 1, 2 HAVING end_seq IS NOT NULL),
  turns AS (SELECT c.session_id, row_number() OVER (PARTITION BY c.session_id ORDER BY start_seq) AS ord, size, s.safe AND c.turn_id <> 't4' AS compressible FROM cl c JOIN safe s ON s.session_id = c.session_id AND s.seq = c.end_seq),
  el AS (SELECT *, bool_and(compressible) OVER (PARTITION BY session_id ORDER BY ord) AS eligible FROM turns),
  sf AS (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY ord DESC) AS suffix_size, min(ord) OVER (PARTITION BY session_id) AS oldest FROM el WHERE eligible)"""


def _turns(spark, d):
    e = session_events(spark, d)
    safe = S.safe_boundaries(e).select("session_id", F.col("seq").alias("end_seq"), "safe")
    end = F.when(F.col("event_type") == "turn/end", F.col("seq"))
    t = e.groupBy(*S.TURN).agg(F.min("seq").alias("start_seq"), F.min(end).alias("end_seq"), (F.sum(F.length(F.coalesce("content", F.lit(""))).cast("bigint")) + 100).alias("size"))
    t = t.join(safe, ["session_id", "end_seq"])
    t = number_rows(t, ["session_id"], ["start_seq"], block_of("start_seq"), "ord")
    t = t.select("session_id", "ord", "size", (F.col("safe") & (F.col("turn_id") != "t4")).alias("compressible"))
    return materialize(t, "turns")


TW = with_views("session_events_v", extra=TURNS)


@query("wn6_compressible_prefix", TW + "SELECT session_id, ord, eligible FROM el")
def _(spark, d):
    return S.compressible_prefix(_turns(spark, d)).select("session_id", "ord", "eligible")


@query("wn7_recent_turns", TW + "SELECT session_id, ord, CAST(suffix_size AS BIGINT) AS suffix_size, suffix_size <= 900 AS retained FROM sf")
def _(spark, d):
    t = S.compressible_prefix(_turns(spark, d)).where("eligible")
    return S.recent_turns(t, F.lit(900)).select("session_id", "ord", "suffix_size", "retained")


@query("cb5_turns_to_fold", TW + "SELECT session_id, ord, suffix_size > 900 OR ord = oldest AS fold FROM sf")
def _(spark, d):
    return B.turns_to_fold(_turns(spark, d), F.lit(900)).select("session_id", "ord", "fold")


@query("cb6_fitting_prefix", TW + """, f AS (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY ord) AS ps FROM sf WHERE suffix_size > 300 OR ord = oldest)
   SELECT session_id, count(*) FILTER (200 + ps < 1500) AS chosen, max(ord) FILTER (200 + ps < 1500) AS boundary_ord, CASE WHEN count(*) FILTER (200 + ps < 1500) = 0 THEN 'summary_input_budget_no_complete_prefix' ELSE 'ok' END AS reason FROM f GROUP BY 1""")
def _(spark, d):
    folding = B.turns_to_fold(_turns(spark, d), F.lit(300))
    return B.fitting_prefix(folding, 200, 1500).select("session_id", "chosen", "boundary_ord", "reason")


ATT = """att AS (SELECT user_id AS session_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS turn_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS number, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 40 END AS boundary,
    CAST(floor(value) AS BIGINT) AS before, CAST(json_extract(props, '$.k') AS BIGINT) AS after, event_type FROM events)"""


def _attempts(spark, d):
    from marginalia.plans.base import trace_events
    k = F.get_json_object("props", "$.k").cast("bigint")
    t = trace_events(spark, d)
    return t.select("session_id", "turn_id", F.col("trace_seq").alias("number"), F.when(F.col("event_type") != "llm/error", k % 40).alias("boundary"), F.floor(F.col("size_chars") / 100).cast("bigint").alias("before"), k.alias("after"), "event_type")


@query("cb7_attempt_audit", f"""WITH {ATT}, p AS (SELECT *, max(boundary) OVER (PARTITION BY session_id, turn_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM att)
   SELECT session_id, turn_id, number, CASE WHEN number > 2 THEN 'quota_exhausted' WHEN event_type = 'view' THEN 'not_triggered' WHEN boundary IS NULL THEN 'no_compressible_old_turns' WHEN boundary <= coalesce(pv, 0) THEN 'cannot_expand_summary_scope' WHEN after >= before THEN 'summary_did_not_shorten' ELSE 'committed' END AS verdict FROM p""")
def _(spark, d):
    a = _attempts(spark, d).withColumn("trigger", F.col("event_type") != "llm/input")
    return B.audit_attempts(a).select("session_id", "turn_id", "number", "verdict")


@query("cb8_retry_audit", f"""WITH {ATT}, o AS (SELECT *, event_type <> 'view' AS overflow, event_type = 'click' AS part, boundary % 9 = 0 IS TRUE AS hard FROM att),
   u AS (SELECT *, coalesce(sum(CASE WHEN overflow AND NOT part AND after < before AND NOT hard THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o)
   SELECT session_id, turn_id, number, CASE WHEN part THEN 'partial_output' WHEN NOT overflow THEN 'not_an_overflow' WHEN used >= 1 THEN 'retry_quota_exhausted' WHEN hard THEN 'hard_budget_exceeded' WHEN after >= before THEN 'no_input_reduction' ELSE 'retry' END AS verdict FROM u""")
def _(spark, d):
    a = _attempts(spark, d).withColumn("overflow", F.col("event_type") != "llm/input").withColumn("partial_output", F.col("event_type") == "llm/output") \
        .withColumn("hard_exceeded", F.coalesce(F.col("boundary") % 9 == 0, F.lit(False)))
    return B.audit_retries(a).select("session_id", "turn_id", "number", "verdict")


@query("ag9_size_by_origin", f"SELECT conv_id, origin, {SIZE(f'sum({MB})', 'count(*)')} AS input_size FROM (SELECT *, {ORIG} AS origin FROM conversations) GROUP BY 1, 2")
def _(spark, d):
    return B.size_by_origin(_origins(spark, d), ["conv_id"]).select("conv_id", "origin", "input_size")

"""Streaming queries (ST-1 .. ST-7): each drains the given tables as a stream and reads the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from marginalia.functions.json_tables import json_text
from marginalia.plans.base import query, table
from marginalia.plans.texts import REDACT_SQL
from marginalia.streaming import jobs as J

EVENTS = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()), StructField("event_type", StringType()),
                     StructField("value", DoubleType()), StructField("props", StringType())])
DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def _events(spark, d):
    # Event time needs a zoned timestamp; the tables hold wall-clock UTC.
    return J.read_stream(spark, f"{d}/events*.parquet", EVENTS).withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))


def _wall(c: str):
    """Back to a wall-clock UTC text, whatever the session's zone is."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS")


# Rows that the watermark has not passed are not numbered yet.
@query("st1_numbered_stream", """SELECT session_id, seq, event_id FROM (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts FROM events)
   WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 300000""")
def _(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("session_id"), "event_id", "ts")
    return J.run_to_table(J.number_stream(e), "numbered")


@query("st2_folded_turns")
def _(spark, d):
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    kind = F.when(t == "view", "final_delta").when(t == "click", "tool_call").when(t == "signup", "tool_result").when(t == "purchase", "step_end").otherwise("final_end")
    call = F.when(t.isin("click", "signup"), F.concat(F.lit("c"), (k.cast("bigint") % 3).cast("string")))
    e = _events(spark, d).select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("turn_id"), F.col("event_id").alias("pos"), kind.alias("kind"), call.alias("tool_call_id"), k.alias("content"), "ts")
    return J.run_to_table(J.fold_stream(e), "folded")


def _fragments(events):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k")
    return events.select(
        "user_id", F.substring(_wall("ts"), 1, 10).alias("call_day"), F.col("event_id").alias("pos"), (k.cast("bigint") % 3).alias("idx"),
        F.when(t == "view", F.concat(F.lit("id"), F.col("event_id").cast("string"))).otherwise("").alias("id"), F.when(t == "click", F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string"))).otherwise("").alias("name"),
        F.when(t != "error", k).alias("args"), "ts")


@query("st3_merged_calls", """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS call_day, event_id AS pos, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS idx, CASE WHEN event_type = 'view' THEN concat('id', event_id) ELSE '' END AS id, CASE WHEN event_type = 'click' THEN concat('f', user_id % 4) ELSE '' END AS name,
     CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS args FROM events)
   SELECT user_id, call_day, idx, coalesce(arg_max(id, pos) FILTER (id <> ''), concat('call_', idx + 1)) AS call_id, arg_max(name, pos) FILTER (name <> '') AS name, coalesce(nullif(string_agg(coalesce(args, ''), '' ORDER BY pos), ''), '{}') AS arguments FROM d GROUP BY 1, 2, 3 HAVING count(*) FILTER (name <> '') > 0""")
def _(spark, d):
    return J.merge_call_fragments(_fragments(table(spark, d, "events")), ["user_id", "call_day"])


# A day's calls are put out when the watermark is a day behind their last fragment.
@query("st3_call_stream", """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS call_day, event_id AS pos, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS idx, CASE WHEN event_type = 'view' THEN concat('id', event_id) ELSE '' END AS id, CASE WHEN event_type = 'click' THEN concat('f', user_id % 4) ELSE '' END AS name,
     CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS args, ts FROM events)
   SELECT user_id, call_day, idx, coalesce(arg_max(id, pos) FILTER (id <> ''), concat('call_', idx + 1)) AS call_id, arg_max(name, pos) FILTER (name <> '') AS name, coalesce(nullif(string_agg(coalesce(args, ''), '' ORDER BY pos), ''), '{}') AS arguments FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, call_day) AS last FROM d) GROUP BY 1, 2, 3 HAVING count(*) FILTER (name <> '') > 0
     AND bool_and(epoch_ms(last) + 86400000 <= (SELECT max(epoch_ms(ts)) FROM events) - 300000)""")
def _(spark, d):
    return J.run_to_table(J.merge_fragment_stream(_fragments(_events(spark, d)), ["user_id", "call_day"], "1 day"), "calls")


SESS = lambda keys, gap: f"""o AS (SELECT {keys}, ts, event_type, ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) > INTERVAL '{gap}' AS brk FROM e),
   g AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
   w AS (SELECT {keys}, min(ts) AS st, max(ts) + INTERVAL '{gap}' AS en, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ended FROM g GROUP BY {keys}, s)"""


@query("st4_silent_turns", f"""WITH e AS (SELECT user_id AS session_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS turn_id, ts, event_type FROM events), {SESS('session_id, turn_id', '6 hours')}
   SELECT session_id, turn_id, strftime(en, '%Y-%m-%d %H:%M:%S.%f') AS silent_at, n AS n_events FROM w WHERE ended = 0 AND en <= (SELECT max(ts) FROM events) - INTERVAL '5 minutes'""")
def _(spark, d):
    e = _events(spark, d)
    e = e.select(F.col("user_id").alias("session_id"), F.substring(_wall("ts"), 1, 10).alias("turn_id"), "ts", F.when(F.col("event_type") == "purchase", "turn/end").otherwise("x").alias("event_type"))
    r = J.run_to_table(J.silent_turns(e, "6 hours"), "silent")
    return r.select("session_id", "turn_id", _wall("silent_at").alias("silent_at"), "n_events")


@query("st5_tumbling_counts", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_x100 FROM events
   WHERE date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2""")
def _(spark, d):
    r = J.run_to_table(J.tumbling_counts(_events(spark, d)), "tumbling")
    return r.select(_wall("window_start").alias("window_start"), "event_type", "n", "value_x100")


@query("st5_session_windows", f"""WITH e AS (SELECT user_id, ts, event_type FROM events), {SESS('user_id', '30 minutes')} SELECT user_id, strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS session_start, n FROM w WHERE en <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def _(spark, d):
    r = J.run_to_table(J.session_windows(_events(spark, d)), "user-sessions")
    return r.select("user_id", _wall("session_start").alias("session_start"), "n")


@query("st6_redelivered_events", "SELECT event_id, user_id, event_type FROM events")
def _(spark, d):
    """Every event is delivered twice."""
    twice = _events(spark, d).select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    return J.run_to_table(J.drop_redelivered(twice, keys=["event_id"]), "deduplicated").select("event_id", "user_id", "event_type")


@query("st7_redacted_stream", f"SELECT doc_id, sha256(CASE WHEN length({REDACT_SQL}) > 2000 THEN concat(substring({REDACT_SQL}, 1, 2000), '…') ELSE {REDACT_SQL} END) AS text_hash FROM documents")
def _(spark, d):
    s = J.read_stream(spark, f"{d}/documents*.parquet", DOCUMENTS)
    return J.run_to_table(J.redacted(s, "text"), "redacted").select("doc_id", F.sha2("text", 256).alias("text_hash"))


# Values nested in the stream: the text stands open, under a hidden key, in a list and beside a reference; one value is too deep.
BOUNDED_SQL = f"coalesce(CAST(to_json(CASE WHEN length({REDACT_SQL}) > 2000 THEN concat(substring({REDACT_SQL}, 1, 2000), '…') ELSE {REDACT_SQL} END) AS VARCHAR), 'null')"
HEX = "c0ffee00" * 8


@query("st7_redacted_values", f"""WITH b AS (SELECT doc_id, {BOUNDED_SQL} AS t FROM documents)
  SELECT doc_id, sha256(concat('{{"flag":true,"n":', doc_id, ',"none":null,"note":', t, ',"ref":{{"paper_id":"p', doc_id, '","parser":"grobid","cache_version":"sha256:{HEX}","chunk_id":"c_{HEX}","offset":3}},',
    '"user":{{"API_Token":"[redacted]","list":[', t, ',{{"deep":{{"deeper":{{"deepest":"[truncated]"}}}}}}]}}}}')) AS data_hash FROM b""")
def _(spark, d):
    s = J.read_stream(spark, f"{d}/documents*.parquet", DOCUMENTS)
    i, t = F.col("doc_id").cast("string"), json_text(F.col("text"))
    ref = F.concat(F.lit('{"text":'), t, F.lit(',"paper_id":"p'), i, F.lit(f'","parser":"grobid","cache_version":"sha256:{HEX}","chunk_id":"c_{HEX}","offset":3,"max_chars":"x"}}'))
    data = F.concat(F.lit('{"note":'), t, F.lit(',"user":{"list":['), t, F.lit(',{"deep":{"deeper":{"deepest":{"x":1}}}}],"API_Token":'), t, F.lit('},"ref":'), ref,
                    F.lit(',"n":'), i, F.lit(',"none":null,"flag":true}'))
    kept = J.redacted_values(s.select("doc_id", data.alias("data")))
    return J.run_to_table(kept, "redacted-values").select("doc_id", F.sha2("data", 256).alias("data_hash"))

"""Structured Streaming jobs (ST-1 .. ST-7).  Each has a batch twin with the same result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from marginalia.functions import text as T
from marginalia.functions.json_tables import safe_json
from marginalia.operators.sessions import TURN
from marginalia.scale import settle, shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is available now into a table in the shared folder and read it back (exactly-once file sink)."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if spark.sparkContext.master.startswith("local"):
        # One state store per core; a cluster keeps its own partition count.
        settings["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


# ---- ST-1 -----------------------------------------------------------------------------------

SEQ_TYPE = StructType([StructField("session_id", LongType()), StructField("seq", LongType()), StructField("event_id", LongType())])


BUCKETS = 4096  # groups of sessions or turns; more of them make each state smaller
SEQ_STATE = StructType([StructField("json", StringType())])


def _number_bucket(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers in event-time order, whatever order the events arrive in, for the sessions of one bucket.

    Rows wait in the state until the watermark has passed them, since an earlier row may still come before; then they
    are numbered by (ts, event_id).  State: the last number of each session, and the rows of the lateness allowed.
    A call to Python and to the state store costs far more than the rows of a session, so sessions share both.
    """
    last, waiting = json.loads(state.get[0]) if state.exists else ([], [])
    last = dict(last)
    for batch in () if state.hasTimedOut else rows:
        sessions = [None if s is None else int(s) for s in batch["session"].tolist()]
        waiting += zip(batch["ts_us"].tolist(), batch["event_id"].tolist(), sessions)
    passed, ready, rest = state.getCurrentWatermarkMs(), [], []
    for row in waiting:
        (ready if row[0] // 1000 < passed else rest).append(row)
    out = []
    for _, event_id, session in sorted(ready, key=lambda r: r[:2]):
        last[session] = last.get(session, 0) + 1
        out.append((session, last[session], event_id))
    state.update((json.dumps([[*last.items()], rest]),))
    if rest:
        state.setTimeoutTimestamp(min(r[0] for r in rest) // 1000 + 1)
    if out:
        yield pd.DataFrame({f.name: pd.array(c, dtype="Int64") for f, c in zip(SEQ_TYPE, zip(*out))})


def number_stream(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """ST-1: events (session_id, event_id, ts) -> session_id, seq, event_id, for events that the watermark has passed."""
    timed = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket"), F.col("session_id").cast("string").alias("session"), "event_id", "ts",
        F.unix_micros("ts").alias("ts_us"))
    return timed.groupBy("bucket").applyInPandasWithState(_number_bucket, SEQ_TYPE, SEQ_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- ST-2 -----------------------------------------------------------------------------------

FOLD_TYPE = StructType([
    StructField("session_id", LongType()), StructField("turn_id", StringType()), StructField("position", IntegerType()),
    StructField("event_type", StringType()), StructField("tool_call_id", StringType()), StructField("content", StringType())])


FOLD_STATE = StructType([StructField("json", StringType())])
IDLE_MS = 600_000


def _fold_turn(turn: tuple, s: dict, events: list[tuple]) -> Iterator[tuple]:
    """Runtime events of one turn to log events: text deltas become one message, tool results wait for the
    end of their step and leave in call order, the turn closes once.  An error or the end of the turn lets the
    results of all steps out, step by step."""
    def emit(kind: str, call: str | None = None, content: str | None = None) -> tuple:
        s["n"] += 1
        return (*turn, s["n"], kind, call, content)

    def flush(steps: list[str]) -> Iterator[tuple]:
        for step in steps:
            results = s["results"].pop(step, {})
            for call in dict.fromkeys([*s["order"].pop(step, []), *results]):
                if call in results:
                    yield emit("tool/result", call, results[call])

    for _, step_no, kind, call, content, ts_ms in sorted(events, key=lambda e: e[0]):
        if s["closed"]:
            return
        step = str(step_no)
        s["last"] = max(s["last"], ts_ms)
        if kind == "final_delta":
            s["text"].append(content or "")
        elif kind == "final_end" and not s["said"]:
            s["said"] = True
            yield emit("assistant/message", None, "".join(s["text"]))
            s["text"] = []
        elif kind == "tool_call":
            s["order"].setdefault(step, []).append(call)
            yield emit("tool/call", call)
        elif kind == "tool_result":
            s["results"].setdefault(step, {})[call] = content
        elif kind == "step_end":
            yield from flush([step])
            yield emit("step/end", None, content)
        elif kind == "error":
            yield from flush(sorted({*s["order"], *s["results"]}, key=int))
            yield emit("error", None, content)
        elif kind == "done":
            yield from flush(sorted({*s["order"], *s["results"]}, key=int))
            yield emit("turn/end", None, content)
            s["closed"] = True


def _fold_bucket(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds the turns of one bucket.  A turn that stays silent for IDLE_MS of event time is closed by a timeout, and
    IDLE_MS after its last event a closed turn leaves the state; until then its late events are dropped.

    A call to Python and to the state store costs far more than the events of a turn, so turns share both.
    """
    turns = {(session, turn): s for session, turn, s in json.loads(state.get[0])} if state.exists else {}
    met: dict[tuple, list[tuple]] = {}
    for batch in () if state.hasTimedOut else rows:
        for session, turn, *event in zip(*(batch[c].tolist() for c in ("session", "turn_id", "pos", "step", "kind", "tool_call_id", "content", "ts_ms"))):
            met.setdefault((None if session is None else int(session), turn), []).append(event)
    out: list[tuple] = []
    for turn, events in met.items():
        s = turns.setdefault(turn, {"n": 0, "text": [], "said": False, "order": {}, "results": {}, "closed": False, "last": 0})
        out += _fold_turn(turn, s, events)
    passed = state.getCurrentWatermarkMs()
    for turn, s in [*turns.items()]:
        if not s["closed"] and s["last"] + IDLE_MS <= passed:
            s |= {"closed": True, "last": s["last"] + IDLE_MS}
            out.append((*turn, s["n"] + 1, "turn/end", None, "error"))
        if s["closed"] and s["last"] + IDLE_MS <= passed:
            del turns[turn]
    if turns:
        state.update((json.dumps([[*turn, s] for turn, s in turns.items()]),))
        state.setTimeoutTimestamp(min(s["last"] for s in turns.values()) + IDLE_MS)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=FOLD_TYPE.names)


def fold_stream(runtime: DataFrame, late: str = "5 minutes") -> DataFrame:
    """ST-2: runtime events (session_id, turn_id, pos, kind, tool_call_id, content, ts, and the number of the model
    step, 0 where that column is missing) -> log events."""
    step = F.coalesce(F.col("step").cast("int"), F.lit(0)) if "step" in runtime.columns else F.lit(0)
    timed = runtime.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("session_id", "turn_id"), F.lit(BUCKETS)).alias("bucket"), F.col("session_id").cast("string").alias("session"), "turn_id",
        "pos", step.alias("step"), "kind", "tool_call_id", "content", "ts", F.unix_millis("ts").alias("ts_ms"))
    return timed.groupBy("bucket").applyInPandasWithState(_fold_bucket, FOLD_TYPE, FOLD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- ST-3 -----------------------------------------------------------------------------------

def merge_call_fragments(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """ST-3 (batch): fragments (keys, pos, idx, id, name, args) of tool calls to whole calls.

    The last non-empty id and name win, argument pieces join in order, nameless calls are dropped.
    The pieces of one call are one output value.
    """
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    g = deltas.groupBy(*keys, "idx").agg(
        F.max_by("id", F.when(full("id").isNotNull(), F.col("pos"))).alias("call_id"),
        F.max_by("name", F.when(full("name").isNotNull(), F.col("pos"))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "args"))), lambda x: F.coalesce(x["args"], F.lit(""))), "").alias("arguments"))
    return g.where("name IS NOT NULL").select(
        *keys, "idx", F.coalesce("call_id", F.concat(F.lit("call_"), (F.col("idx") + 1).cast("string"))).alias("call_id"), "name",
        F.coalesce(F.nullif("arguments", F.lit("")), F.lit("{}")).alias("arguments"))


def merge_fragment_stream(deltas: DataFrame, keys: list[str], idle: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """ST-3 (stream): as ``merge_call_fragments``, for fragments with an event time ``ts``.

    A response is put out once it has been silent for ``idle``; what comes after that silence is another response.
    A session window holds the fragments of a response; they are cut into calls when it leaves the state.  No Python
    worker and no call per response.
    """
    # Watermarks count milliseconds.
    timed = deltas.withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    fragment = F.struct("idx", "pos", F.coalesce("args", F.lit("")).alias("args"), "id", "name")
    whole = timed.groupBy(*keys, F.session_window("ts", idle).alias("_w")).agg(F.sort_array(F.collect_list(fragment)).alias("_f"))
    f, none = F.col("_f"), F.lit(None).cast("string")
    # Places where another call begins; each call is a slice of the sorted fragments.
    first = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: (i == 0) | ~F.get(f, i)["idx"].eqNullSafe(F.get(f, i - 1)["idx"]))
    whole = settle(whole.select(*keys, "_f", first.alias("_at")))
    at = F.col("_at")
    cut = F.transform(at, lambda i, k: F.slice(f, i + 1, F.coalesce(F.get(at, k + 1), F.size(f)) - i))
    last = lambda c: F.aggregate("_c", none, lambda s, x: F.coalesce(F.nullif(x[c], F.lit("")), s))
    calls = whole.select(*keys, F.explode(cut).alias("_c")).select(
        *keys, F.get("_c", F.lit(0))["idx"].alias("idx"), last("id").alias("call_id"), last("name").alias("name"), F.array_join(F.col("_c.args"), "").alias("arguments"))
    return settle(calls).where("name IS NOT NULL").select(
        *keys, "idx", F.coalesce("call_id", F.concat(F.lit("call_"), (F.col("idx") + 1).cast("string"))).alias("call_id"), "name",
        F.coalesce(F.nullif("arguments", F.lit("")), F.lit("{}")).alias("arguments"))


# ---- ST-4 .. ST-7 ----------------------------------------------------------------------------

def silent_turns(events: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """ST-4: turns that fell silent for ``gap`` without an end.  Aggregates combine before the exchange."""
    e = events.withWatermark("ts", late)
    g = e.groupBy(*TURN, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n_events"), F.max(F.when(F.col("event_type") == "turn/end", 1).otherwise(0)).alias("ended"))
    return g.where("ended = 0").select(*TURN, F.col("w.start").alias("first_seen"), F.col("w.end").alias("silent_at"), "n_events")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ST-5: events per type and hour; windows leave when the watermark has passed them."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_x100")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "value_x100")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """ST-5: activity sessions per user."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drop_redelivered(events: DataFrame, late: str = "10 minutes", keys: list[str] = ("session_id", "seq")) -> DataFrame:
    """ST-6: one copy of each (session, seq) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def redacted(events: DataFrame, text_col: str = "content", limit: int = 2000) -> DataFrame:
    """ST-7: stateless redaction and bounding before an append sink; works on streams and tables."""
    return events.withColumn(text_col, T.bounded(T.redact(F.col(text_col)), limit))


def redacted_values(events: DataFrame, json_col: str = "data", limit: int = 2000, items: int = 50, most: int = 6) -> DataFrame:
    """ST-7: stateless redaction of nested JSON values by key and by text, with depth, item and text limits; evidence
    references stay whole.  Works on streams and tables, without a Python worker."""
    return events.withColumn(json_col, safe_json(F.col(json_col), limit, items, most, references=True))

"""Reconstruction of turns, steps and calls from append-only logs (JN-2 .. JN-8, JN-10, JN-12, AG-*, WN-*, TK-*, SE-*).

``events``: session_id, seq, turn_id, event_type, tool_call_id, status, content (seq is dense per session).
``trace``: session_id, turn_id, trace_seq, event_type, and payload columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.scale import BLOCK_ROWS, block_of, first_rows, materialize, number_rows, running

TURN = ["session_id", "turn_id"]


# ---- sequence numbers ---------------------------------------------------------------

def append_numbered(log: DataFrame, arriving: DataFrame, keys: list[str], order: list[str], block: Column, seq: str = "seq") -> DataFrame:
    """WN-1 / WN-2: dense numbers for arriving rows, going on from the largest number in the log."""
    last = log.groupBy(*keys).agg(F.max(seq).alias("_last"))
    return number_rows(arriving, keys, order, block, "_rn").join(last, keys, "left") \
        .withColumn(seq, (F.col("_rn") + F.coalesce("_last", F.lit(0))).cast("bigint")).drop("_rn", "_last")


# ---- calls and results ----------------------------------------------------------------

def pair_calls(events: DataFrame) -> DataFrame:
    """JN-2: each tool call with its result; a call without one is unconfirmed."""
    key = [*TURN, "tool_call_id"]
    calls = events.where("event_type = 'tool/call'").select(*key, F.col("seq").alias("call_seq"))
    results = events.where("event_type = 'tool/result'").groupBy(*key).agg(F.max("seq").alias("result_seq"))
    return calls.join(results, key, "left").withColumn("confirmed", F.col("result_seq").isNotNull())


def link_trace_calls(trace: DataFrame) -> DataFrame:
    """JN-3: calls and results of a trace linked both ways; a result belongs to the latest call before it."""
    key = [*TURN, "tool_call_id"]
    t = trace.where(F.col("event_type").isin("tool/call_debug", "tool/result_debug")).select(*key, "trace_seq", "event_type")
    call = F.when(F.col("event_type") == "tool/call_debug", F.col("trace_seq"))
    t = running(t, key, ["trace_seq"], block_of("trace_seq"), {"_call": ("last", call, False)})
    calls = t.where("event_type = 'tool/call_debug'").select(*key, F.col("trace_seq").alias("call_seq"))
    results = t.where("event_type = 'tool/result_debug'").select(*key, F.col("_call").alias("call_seq"), F.col("trace_seq").alias("result_seq"))
    linked = results.where("call_seq IS NOT NULL").groupBy(*key, "call_seq").agg(F.max("result_seq").alias("last_result_seq"))
    both = calls.join(linked, [*key, "call_seq"], "left").select(
        *key, F.lit("call").alias("side"), F.col("call_seq").alias("trace_seq"), F.col("last_result_seq").alias("other_seq"))
    return both.unionByName(results.select(*key, F.lit("result").alias("side"), F.col("result_seq").alias("trace_seq"), F.col("call_seq").alias("other_seq")))


def pair_model_calls(trace: DataFrame, keys: list[str]) -> DataFrame:
    """JN-4: first-in-first-out pairing of inputs with outputs or errors inside a step, without a key.

    With +1 for an input and -1 for an end, an end finds an empty queue exactly when the running sum
    reaches a new minimum below zero.  Ends that do find an input take them in order, so the pairing is
    a join of two dense ordinals.
    """
    kinds = ["llm/input", "llm/output", "llm/error"]
    t = trace.where(F.col("event_type").isin(kinds)).select(*keys, "trace_seq", "event_type")
    is_in = F.col("event_type") == "llm/input"
    blk = block_of("trace_seq")
    t = running(t, keys, ["trace_seq"], blk, {
        "inputs": ("sum", is_in.cast("bigint"), True), "ends": ("sum", (~is_in).cast("bigint"), True)})
    t = materialize(t.withColumn("_walk", F.col("inputs") - F.col("ends")), "call-walk")
    t = running(t, keys, ["trace_seq"], blk, {"_low": ("min", "_walk", False)})
    orphans_before = F.greatest(F.lit(0), -F.coalesce("_low", F.lit(0)))
    orphan = ~is_in & (F.col("_walk") < -orphans_before)
    t = t.withColumn("orphan", orphan).withColumn("ordinal", F.when(is_in, F.col("inputs")).when(
        ~orphan, F.col("ends") - orphans_before))
    t = materialize(t.drop("_walk", "_low"), "call-ordinals")
    ins = t.where(is_in).select(*keys, "ordinal", F.col("trace_seq").alias("input_seq"))
    ends = t.where(~is_in & ~F.col("orphan")).select(*keys, "ordinal", F.col("trace_seq").alias("end_seq"), F.col("event_type").alias("end_type"))
    lost = t.where(F.col("orphan")).select(*keys, F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("input_seq"),
                                           F.col("trace_seq").alias("end_seq"), F.col("event_type").alias("end_type"))
    return ins.join(ends, [*keys, "ordinal"], "left").unionByName(lost)


def join_logs(events: DataFrame, trace: DataFrame) -> DataFrame:
    """JN-5: steps seen in the semantic log, the trace log, or both."""
    key = [*TURN, "step"]
    side = lambda df, seq, n: df.where("step IS NOT NULL").groupBy(*key).agg(
        F.count("*").alias(f"{n}_events"), F.min(seq).alias(f"{n}_first"), F.max(seq).alias(f"{n}_last"))
    j = side(events, "seq", "semantic").join(side(trace, "trace_seq", "trace"), key, "full_outer")
    where = F.when(F.col("trace_events").isNull(), "semantic").when(F.col("semantic_events").isNull(), "trace").otherwise("both")
    return j.withColumn("found_in", where)


def covered_events(refs: DataFrame, events: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """JN-6: events under each (session_id, ref_id, start_seq, end_seq) range.

    The range becomes a list of seq blocks and the join is an equi-join on (session, block).
    """
    spans = refs.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("start_seq") / width), F.floor(F.col("end_seq") / width))))
    e = events.withColumn("_blk", F.floor(F.col("seq") / width))
    return spans.join(e, ["session_id", "_blk"]).where(F.col("seq").between(F.col("start_seq"), F.col("end_seq"))).drop("_blk")


def range_coverage(refs: DataFrame, events: DataFrame) -> DataFrame:
    """JN-6: a reference is complete when as many events lie in its range as the range is wide."""
    hits = covered_events(refs, events.select("session_id", "seq")).groupBy("session_id", "ref_id").agg(F.count("*").alias("n"))
    return refs.join(hits, ["session_id", "ref_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))) \
        .withColumn("complete", F.col("n") == F.col("end_seq") - F.col("start_seq") + 1)


def incomplete_turns(events: DataFrame) -> DataFrame:
    """JN-7 / SE-2: turns started but not ended."""
    kind = lambda k: events.where((F.col("event_type") == k) & F.col("turn_id").isNotNull()).select(*TURN).distinct()
    return kind("turn/start").join(kind("turn/end"), TURN, "left_anti")


def restore_view(sessions: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """JN-8: every event of every known session with its header; one row per event, in seq order.

    ``sessions``: session_id, title; ``links``: session_id, doc_id.
    """
    open_turns = incomplete_turns(events).groupBy("session_id").agg(F.count("*").alias("incomplete_turns"))
    docs = links.groupBy("session_id").agg(F.count_distinct("doc_id").alias("active_docs"))
    zero = F.lit(0).cast("bigint")
    head = sessions.join(docs, "session_id", "left").join(open_turns, "session_id", "left").select(
        "session_id", F.coalesce("title", F.lit(K.NEW_SESSION_TITLE)).alias("title"), F.coalesce("active_docs", zero).alias("active_docs"),
        F.coalesce("incomplete_turns", zero).alias("incomplete_turns"))
    return head.join(events, "session_id", "left")


def scoped_refs(refs: DataFrame, links: DataFrame) -> DataFrame:
    """JN-10: mark which (session_id, doc_id) references point to a document of the session."""
    allowed = links.select("session_id", "doc_id").distinct()
    ok = refs.join(allowed, ["session_id", "doc_id"], "left_semi").withColumn("allowed", F.lit(True))
    return ok.unionByName(refs.join(allowed, ["session_id", "doc_id"], "left_anti").withColumn("allowed", F.lit(False)))


def admit_checkpoints(proposals: DataFrame, sessions: DataFrame, events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """JN-12: reason a proposed checkpoint is refused, or 'ok'.

    ``proposals``: session_id, turn_id, previous_seq, covered_seq; ``checkpoints``: session_id, seq, covered.
    """
    log = events.where("event_type <> 'context/checkpoint' AND turn_id IS NOT NULL")
    last = checkpoints.groupBy("session_id").agg(F.max("seq").alias("_prev"), F.max_by("covered", "seq").alias("_prev_covered"))
    now = log.groupBy(*TURN).agg(F.min("seq").alias("_first"), F.bool_or(F.col("event_type") == "turn/end").alias("_ended"))
    bounds = events.where("event_type = 'turn/end'").select("session_id", F.col("seq").alias("covered_seq"), F.lit(True).alias("_end"))
    p = proposals.join(sessions.select("session_id", F.lit(True).alias("_known")), "session_id", "left") \
        .join(last, "session_id", "left").join(now, TURN, "left").join(bounds, ["session_id", "covered_seq"], "left")
    # Turns open at a boundary: starts minus ends up to it, a running sum in which proposals are marks.
    spans = log.groupBy(*TURN).agg(F.min("seq").alias("s"), F.min(F.when(F.col("event_type") == "turn/end", F.col("seq"))).alias("e"))
    step = lambda df, at, delta: df.select("session_id", at.alias("_o"), F.lit(delta).cast("bigint").alias("_d"))
    marks = step(spans, F.col("s") * 2, 1).unionByName(step(spans.where("e IS NOT NULL"), F.col("e") * 2, -1)) \
        .unionByName(step(proposals.distinct(), F.col("covered_seq") * 2 + 1, 0))
    marks = running(marks, ["session_id"], ["_o"], block_of("_o"), {"_open": ("sum", "_d", True)})
    open_ = marks.where("_d = 0").select("session_id", F.floor(F.col("_o") / 2).cast("bigint").alias("covered_seq"), "_open").distinct()
    p = p.join(open_, ["session_id", "covered_seq"], "left")
    reason = (
        F.when(F.col("_known").isNull(), "checkpoint_session_deleted")
        .when(~F.col("_prev").eqNullSafe(F.col("previous_seq")), "checkpoint_conflict")
        .when(F.col("_first").isNull() | F.col("_ended"), "checkpoint_current_turn_not_active")
        .when((F.col("covered_seq") < F.coalesce("_prev_covered", F.lit(0))) | (F.col("covered_seq") >= F.col("_first")), "checkpoint_invalid_boundary")
        .when(F.col("_end").isNull(), "checkpoint_boundary_must_end_old_turn")
        .when(F.coalesce("_open", F.lit(0)) > 0, "checkpoint_would_cover_incomplete_turn").otherwise("ok")
    )
    return p.select("session_id", "turn_id", "previous_seq", "covered_seq", reason.alias("reason"))


# ---- rollups --------------------------------------------------------------------------

def turn_rollup(events: DataFrame) -> DataFrame:
    """AG-1 / AG-2: one row per turn.  All aggregates combine on the map side."""
    kind = lambda k: F.col("event_type") == k
    end_bad = kind("turn/end") & (F.coalesce("status", F.lit("error")) != "success")
    g = events.where("turn_id IS NOT NULL").groupBy(*TURN).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"),
        F.min_by("content", F.when(kind("user/message"), F.col("seq"))).alias("user_input"),
        F.max_by("content", F.when(kind("assistant/message"), F.col("seq"))).alias("final_answer"),
        F.bool_or(kind("error")).alias("has_error"),
        F.coalesce(F.max_by(end_bad, F.when(kind("turn/end"), F.col("seq"))), F.lit(False)).alias("_bad"),
        F.bool_or(kind("turn/end")).alias("_ended"))
    status = F.when(F.col("_bad") | F.col("has_error"), "error").when(F.col("_ended"), "success").otherwise("incomplete")
    return g.withColumn("status", status).drop("_bad", "_ended")


def step_rollup(trace: DataFrame, keys: list[str]) -> DataFrame:
    """AG-3: counts and span of each step."""
    kind = lambda *ks: F.count_if(F.col("event_type").isin(*ks))
    return trace.groupBy(*keys).agg(
        F.min("trace_seq").alias("first_seq"), F.max("trace_seq").alias("last_seq"), kind("llm/input").alias("model_calls"),
        kind("tool/call_debug").alias("tool_calls"), kind("tool/result_debug").alias("tool_results"),
        kind("llm/context_budget", "context/compaction", "context/recovery").alias("context_events"))


def step_timeline(trace: DataFrame, keys: list[str]) -> DataFrame:
    """AG-3: the timeline as rows, each with its ordinal among events of its kind."""
    return number_rows(trace, [*keys, "event_type"], ["trace_seq"], block_of("trace_seq"), "kind_ordinal")


def compression(results: DataFrame, keys: list[str]) -> DataFrame:
    """AG-6: history size over model size."""
    g = results.groupBy(*keys).agg(F.sum("model_size").alias("model_size"), F.sum("history_size").alias("history_size"))
    return g.withColumn("ratio", F.coalesce(F.try_divide("history_size", "model_size"), F.lit(0.0)))


def first_user_message(events: DataFrame) -> DataFrame:
    """AG-7."""
    return events.where("event_type = 'user/message'").groupBy("session_id").agg(F.min_by("content", "seq").alias("first_message"))


def cited_sections(evidence: DataFrame, key: str, pos: str = "pos", cap: int = 20) -> DataFrame:
    """AG-8: distinct sections in first-seen order, at most 20 kept per result by rule."""
    firsts = evidence.where("section IS NOT NULL AND section <> ''").groupBy(key, "section").agg(F.min(pos).alias("first_pos"))
    return first_rows(firsts, [key], [F.col("first_pos"), F.col("section")], cap, "ordinal")


def message_origin(role: Column, has_calls: Column, is_current: Column, is_checkpoint: Column) -> Column:
    """AG-10."""
    return F.when(is_checkpoint, "context_checkpoint").when(role == "system", "system").when(is_current, "current_turn") \
        .when(role == "tool", "history_tool_result").when(has_calls, "history_tool_call").otherwise(F.concat(F.lit("session_"), role))


def usage_totals(deltas: DataFrame, call_keys: list[str], out_keys: list[str]) -> DataFrame:
    """AG-11: in one call the latest value of each counter wins; calls are then summed.

    ``deltas``: call keys, pos, counter, value.
    """
    latest = deltas.where("value IS NOT NULL").groupBy(*call_keys, "counter").agg(F.max_by("value", "pos").alias("value"))
    return latest.groupBy(*out_keys, "counter").agg(F.sum("value").alias("total"), F.count("*").alias("n_calls"))


def lookup_profile(calls: DataFrame) -> DataFrame:
    """AG-12: per batch, wall time when run side by side, and the sum of individual times."""
    return calls.groupBy("batch_id").agg(F.count("*").alias("tool_count"), F.max("duration_ms").alias("parallel_ms"),
                                         F.sum("duration_ms").alias("sum_ms"), F.count_if("has_error").alias("errors"))


# ---- windows ----------------------------------------------------------------------------

def safe_boundaries(events: DataFrame) -> DataFrame:
    """WN-5: turn ends at which no other turn is open.

    A turn opens at its first event, or at an event that follows its own end.
    """
    e = events.where("turn_id IS NOT NULL AND event_type <> 'context/checkpoint'").select("session_id", "turn_id", "seq", "event_type")
    e = running(e, TURN, ["seq"], block_of("seq"), {"_prev": ("last", F.col("event_type"), False)})
    is_end = F.col("event_type") == "turn/end"
    opens = F.col("_prev").isNull() | (F.col("_prev") == "turn/end")
    e = materialize(e.withColumn("_step", opens.cast("bigint") - is_end.cast("bigint")), "turn-steps")
    e = running(e, ["session_id"], ["seq"], block_of("seq"), {"open_turns": ("sum", "_step", True)})
    return e.where(is_end).select("session_id", "turn_id", "seq", (F.col("open_turns") == 0).alias("safe"))


def compressible_prefix(turns: DataFrame, order: str = "ord") -> DataFrame:
    """WN-6: turns before the first one that may not be folded."""
    t = running(turns, ["session_id"], [order], block_of(order), {"_wall": ("max", (~F.col("compressible")).cast("int"), True)})
    return t.withColumn("eligible", F.coalesce("_wall", F.lit(0)) == 0).drop("_wall")


def recent_turns(eligible: DataFrame, keep: Column, order: str = "ord", size: str = "size") -> DataFrame:
    """WN-7: turns kept because everything from them to the newest eligible turn fits the allowance."""
    t = running(eligible, ["session_id"], [order], block_of(order), {"suffix_size": ("sum", size, True)}, descending=True)
    return t.withColumn("retained", F.col("suffix_size") <= keep)


def accepted_checkpoints(checkpoints: DataFrame, boundaries: DataFrame) -> DataFrame:
    """WN-8: the last accepted checkpoint of each session and how many were accepted.

    ``checkpoints``: session_id, seq, previous_seq, covered (well-formed ones); ``boundaries``: session_id, seq.
    A checkpoint is accepted when it names the last accepted one, so each one has at most one successor: the
    earliest later one that names it, ends at a boundary and does not move back.  The chain is followed from
    its root by doubling jumps, so its length costs a logarithm of joins and no session is gathered.
    """
    ok = boundaries.select("session_id", F.col("seq").alias("covered")).distinct()
    c = materialize(checkpoints.join(ok, ["session_id", "covered"], "left_semi").select("session_id", "seq", "previous_seq", "covered"), "checkpoints")
    before = c.select("session_id", F.col("seq").alias("previous_seq"), F.col("covered").alias("_covered"))
    step = c.join(before, ["session_id", "previous_seq"]).where("covered >= _covered AND seq > previous_seq")
    jump = step.groupBy("session_id", F.col("previous_seq").alias("seq")).agg(F.min("seq").alias("next"))
    jump = materialize(jump.withColumn("hops", F.lit(1).cast("bigint")), "jumps")
    at = c.where("previous_seq IS NULL").groupBy("session_id").agg(F.min("seq").alias("seq")).withColumn("accepted", F.lit(1).cast("bigint"))
    at = materialize(at, "chain")
    while True:
        on = ["session_id", "seq"]
        moved = at.join(jump, on, "left")
        # Only the number of sessions that still moved reaches the driver.
        at = materialize(moved.select("session_id", F.coalesce("next", "seq").alias("seq"), (F.col("accepted") + F.coalesce("hops", F.lit(0))).alias("accepted"),
                                      F.col("next").isNotNull().alias("_moved")), "chain")
        if at.where("_moved").isEmpty():
            break
        at = at.drop("_moved")
        far = jump.select("session_id", F.col("seq").alias("next"), F.col("next").alias("_n"), F.col("hops").alias("_h"))
        jump = materialize(jump.join(far, ["session_id", "next"], "left").select(
            "session_id", "seq", F.coalesce("_n", "next").alias("next"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")), "jumps")
    return at.drop("_moved").join(c.select("session_id", "seq", "covered"), ["session_id", "seq"])


# ---- ordering, limits and sets -----------------------------------------------------------

def newest_sessions(sessions: DataFrame) -> DataFrame:
    """TK-3."""
    return sessions.orderBy(F.col("updated_at").desc(), F.col("session_id").desc())


def recent_messages(messages: DataFrame, n: int = K.HISTORY_MESSAGES, keys: list[str] = ("session_id",), order: str = "turn") -> DataFrame:
    """TK-4: last n non-blank user and assistant messages of each session, original order number kept."""
    m = messages.where(F.col("role").isin("user", "assistant") & (T.strip(F.col("text")) != ""))
    return first_rows(m, list(keys), [F.col(order).desc()], n, "from_end")


def active_documents(links: DataFrame) -> DataFrame:
    """TK-5: documents of each session by (added_at, id); positions as rows, nothing gathered.

    ``added_at`` is a number, a timestamp or ISO text.  Text is ordered by the time it names, then as text; text
    that names no time comes first.
    """
    kind = dict(links.dtypes)["added_at"]
    if kind in ("string", "timestamp", "timestamp_ntz", "date"):
        at = F.try_to_timestamp("added_at") if kind == "string" else F.col("added_at").cast("timestamp")
        timed = links.withColumn("_at", F.coalesce(F.unix_micros(at), F.lit(0).cast("bigint")))
        return number_rows(timed, ["session_id"], ["_at", "added_at", "doc_id"], block_of("_at", 60_000_000), "position").drop("_at")
    return number_rows(links, ["session_id"], ["added_at", "doc_id"], block_of("added_at"), "position")


def ordered_distinct(values: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """SE-1: distinct non-blank values in first-seen order."""
    v = values.withColumn(value, T.strip(F.col(value))).where(F.col(value) != "")
    firsts = v.groupBy(key, value).agg(F.min(ordinal).alias("first_ordinal"))
    return number_rows(firsts, [key], ["first_ordinal", value], block_of("first_ordinal"), "position")


def source_catalog(previous: DataFrame, new: DataFrame) -> DataFrame:
    """SE-3: ids R1..Rn; earlier references first, then new ones, equal content once.

    ``previous``: session_id, ord, content; ``new``: the same, ordered among themselves.
    """
    both = previous.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    firsts = both.groupBy("session_id", "content").agg(F.min(F.struct("_part", "ord")).alias("o"))
    firsts = firsts.select("session_id", "content", F.col("o._part").alias("part"), F.col("o.ord").alias("ord"))
    firsts = firsts.withColumn("_o", F.col("part") * F.lit(1 << 40).cast("bigint") + F.col("ord"))
    n = number_rows(firsts, ["session_id"], ["_o", "content"], block_of("_o"), "n")
    return n.select("session_id", F.concat(F.lit("R"), F.col("n").cast("string")).alias("ref_id"), "content")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SE-4: the rows to append; the first of equal keys, none that the table has."""
    cols = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return one.join(table.select(*keys), keys, "left_anti")


def single_source(docs: DataFrame, parses: DataFrame) -> DataFrame:
    """AG-13: a document's title shows only when exactly one parser result exists; the parsers present always do.

    ``parses``: doc_id, parser, title; there are two parsers, so a group holds two rows.
    """
    g = parses.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("title").alias("_t"), F.array_join(F.array_sort(F.collect_set("parser")), ",").alias("parsers"))
    j = docs.join(g, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return j.select("doc_id", "n", F.when(F.col("n") == 1, F.col("_t")).alias("title"), F.coalesce("parsers", F.lit("")).alias("parsers"),
                    F.when(F.col("n") == 0, "No cached parser result; call a parser Tool first.").otherwise("").alias("warning"))

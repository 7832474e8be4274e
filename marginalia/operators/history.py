"""Chat history from logs (HP-1 .. HP-7) and memory tables (ME-1, ME-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.functions.json_tables import json_text
from marginalia.operators.sessions import TURN, first_user_message
from marginalia.scale import block_of, materialize, number_rows, running

def closed_turns(events: DataFrame) -> DataFrame:
    """Turns with an end: first seq, end seq (the first end) and its status."""
    end = F.when(F.col("event_type") == "turn/end", F.col("seq"))
    return events.where("turn_id IS NOT NULL AND event_type <> 'context/checkpoint'").groupBy(*TURN).agg(
        F.min("seq").alias("start_seq"), F.min(end).alias("end_seq"), F.min_by(F.coalesce("status", F.lit("error")), end).alias("turn_status")) \
        .where("end_seq IS NOT NULL")


CALLS = "array<struct<id:string,name:string,arguments:string>>"
PAYLOAD = ["name", "arguments", "history_result", "summary", "error"]


def history_messages(events: DataFrame) -> DataFrame:
    """HP-1: ordered chat messages of ended turns with all that they carry.

    ``events``: session_id, seq, turn_id, event_type, tool_call_id, status, content, and as far as the log has them
    name and arguments (JSON) of a call, history_result (JSON) or summary of a result, error (JSON) of an error event.

    Rows: session_id, turn_id, ord_seq, ord_kind, ord_call (the order inside the turn), role, content, tool_calls
    ARRAY<STRUCT<id, name, arguments>> of an assistant row that calls, tool_call_id, name and status of a tool row.

    Calls wait until the next message, step end or result; then the confirmed ones become one assistant row and one
    tool row each, the names of the others one note.  A tool row holds the stored result, else a short record of tool,
    status and summary.  A failed turn is labelled and closed by a note with its errors.  Calls without id or name are
    left out; in a log without a name column a call has its id as name.
    """
    e = events.where("event_type <> 'context/checkpoint'")
    for c in PAYLOAD:
        if c not in e.columns:
            e = e.withColumn(c, F.col("tool_call_id") if c == "name" else F.lit(None).cast("string"))
    e = e.join(closed_turns(events), TURN).where("seq <= end_seq")
    flush = F.col("event_type").isin("user/message", "assistant/message", "step/end", "tool/result")
    last, zero = F.lit(1 << 60).cast("bigint"), F.lit(0).cast("bigint")
    e = running(e, TURN, ["seq"], block_of("seq"), {"_flush": ("last", F.when(flush, F.col("seq")), False)}, descending=True)
    # Five kinds of rows are made from these events.
    e = materialize(e, "turn-events")

    def rows(df, seq, kind, call, role, content, **more):
        given = {"tool_calls": F.lit(None).cast(CALLS), "tool_call_id": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), **more}
        return df.select(*TURN, seq.alias("ord_seq"), F.lit(kind).alias("ord_kind"), call.alias("ord_call"), role.alias("role"), content.alias("content"),
                         *[c.alias(n) for n, c in given.items()])

    user = F.col("event_type") == "user/message"
    failed = (F.col("event_type") == "assistant/message") & (F.col("turn_status") != "success")
    said = rows(e.where(F.col("event_type").isin("user/message", "assistant/message") & F.col("content").isNotNull()), F.col("seq"), 9, zero,
                F.when(user, "user").otherwise("assistant"), F.when(failed, F.concat(F.lit(K.FAILED_PREFIX), "content")).otherwise(F.col("content")))
    calls = e.where("event_type = 'tool/call' AND tool_call_id <> '' AND name <> ''").select(
        *TURN, "tool_call_id", "name", F.coalesce("arguments", F.lit("{}")).alias("arguments"), F.col("seq").alias("call_seq"), F.coalesce("_flush", last).alias("flush_seq"))
    results = e.where("event_type = 'tool/result'").groupBy(*TURN, "tool_call_id").agg(F.max_by(F.struct("status", "history_result", "summary"), "seq").alias("r"))
    c = calls.join(results, [*TURN, "tool_call_id"], "left")
    done = F.col("r").isNotNull()
    # One flush holds the calls of one model step, which the runtime bounds (10 side by side).
    call = F.struct("call_seq", F.col("tool_call_id").alias("id"), "name", "arguments")
    g = c.groupBy(*TURN, "flush_seq").agg(F.array_sort(F.collect_list(F.when(done, call))).alias("paired"), F.array_sort(F.collect_list(F.when(~done, call))).alias("open"))
    at, one = F.col("flush_seq"), F.lit("assistant")
    heads = rows(g.where(F.size("paired") > 0), at, 0, zero, one, F.lit(""), tool_calls=F.transform("paired", lambda x: F.struct(x["id"], x["name"], x["arguments"])).cast(CALLS))
    record = F.concat(F.lit('{"tool": '), json_text(F.col("name")), F.lit(', "status": '), json_text(F.coalesce("r.status", F.lit("error"))),
                      F.lit(', "summary": '), json_text(F.coalesce("r.summary", F.lit(""))), F.lit("}"))
    tools = rows(c.where(done), at, 1, F.col("call_seq"), F.lit("tool"), F.coalesce("r.history_result", record),
                 tool_call_id=F.col("tool_call_id"), name=F.col("name"), status=F.col("r.status"))
    open_calls = F.transform("open", lambda x: F.struct(x["id"], x["name"], x["arguments"])).cast(CALLS)
    names = F.array_join(F.transform("open", lambda x: json_text(x["name"])), ", ")
    # The open calls stay with the note, since their names alone do not say which they were.
    notes = rows(g.where(F.size("open") > 0), at, 2, zero, one, F.concat(F.lit(K.UNCONFIRMED_PREFIX + "["), names, F.lit("]")), tool_calls=open_calls)
    error = F.when(F.col("event_type") == "error", F.struct("seq", F.coalesce("error", F.lit("{}")).alias("error")))
    errors = e.where("turn_status <> 'success'").groupBy(*TURN).agg(F.array_sort(F.collect_list(error)).alias("errors"))
    listed = F.array_join(F.transform("errors", lambda x: x["error"]), ", ")
    closing = rows(errors, last, 10, zero, one, F.concat(F.lit(K.CLOSING_PREFIX + "["), listed, F.lit("]")), status=F.size("errors").cast("string"))
    return said.unionByName(heads).unionByName(tools).unionByName(notes).unionByName(closing)


def turn_messages(events: DataFrame) -> DataFrame:
    """HP-1, short form: ``history_messages`` with ids and states in place of the payload (session_id, turn_id, ord_seq,
    ord_kind, ord_call, role, content)."""
    kind = F.col("ord_kind")
    ids = F.array_join(F.transform("tool_calls", lambda x: x["id"]), ",")
    short = (
        F.when(kind == 0, F.concat(F.lit("calls:"), ids)).when(kind == 1, F.concat("tool_call_id", F.lit(":"), F.coalesce("status", F.lit("success"))))
        .when(kind == 2, F.concat(F.lit(K.UNCONFIRMED_PREFIX), ids)).when(kind == 10, F.concat(F.lit(K.CLOSED_SHORT), "status")).otherwise(F.col("content"))
    )
    return history_messages(events).select(*TURN, "ord_seq", "ord_kind", "ord_call", "role", short.alias("content"))


def history_before(turns: DataFrame, cutoffs: DataFrame, accepted: DataFrame) -> DataFrame:
    """HP-2: ended turns that lie before the cutoff turn and after the accepted checkpoint.

    ``cutoffs``: session_id, cutoff_seq; ``accepted``: session_id, covered.
    """
    j = turns.join(cutoffs, "session_id", "left").join(accepted, "session_id", "left")
    return j.where((F.col("cutoff_seq").isNull() | (F.col("end_seq") < F.col("cutoff_seq"))) & (F.col("end_seq") > F.coalesce("covered", F.lit(0)))) \
        .drop("cutoff_seq", "covered")


def checkpoint_reason(version: Column, summary: Column, covered: Column, refs: Column) -> Column:
    """HP-3: 'ok' or why a checkpoint is invalid.

    ``refs``: ARRAY<STRUCT<id, kind, start_seq, end_seq, doc_id, parser, cache_version, chunk_id>>.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), summary), "\n## "), 2, 1 << 20)
    names = F.transform(parts, lambda p: F.substring_index(p, "\n", 1))
    bodies = F.transform(parts, lambda p: T.strip(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, "^[^\\n]*\\n", "")).otherwise("")))
    ids = F.transform(refs, lambda r: r["id"])
    want = F.transform(refs, lambda r, i: F.concat(F.lit("R"), (i + 1).cast("string")))
    good_ref = lambda r: F.coalesce(
        F.when(r["kind"] == "events", (r["start_seq"] >= 1) & (r["start_seq"] <= r["end_seq"]) & (r["end_seq"] <= covered))
        .when(r["kind"] == "paper", (r["doc_id"] != "") & (r["parser"] != "") & r["cache_version"].rlike("^sha256:[0-9a-f]{64}\\z")
              & r["chunk_id"].rlike("^c_[0-9a-f]{64}\\z")).otherwise(False), F.lit(False))
    cited = F.regexp_extract_all(summary, F.lit("\\[(R[0-9]+)\\]"), F.lit(1))
    return (
        F.when(version.isNull() | (version != 1), "version")
        .when(summary.isNull() | (names != F.array(*[F.lit(h) for h in K.SUMMARY_HEADINGS])), "sections")
        .when(F.exists(bodies, lambda b: b == ""), "empty_section")
        .when(covered.isNull() | (covered <= 0), "covered")
        .when(refs.isNull() | ~F.forall(refs, good_ref), "reference")
        .when(ids != want, "reference_order")
        .when(F.size(F.array_except(cited, ids)) > 0, "unknown_citation").otherwise("ok")
    )


def page_fields(requests: DataFrame, fields: DataFrame, completed: DataFrame | None = None, overhead: int = 32, most_events: int = 100,
                limits: tuple[int, int] = (512, 4000)) -> DataFrame:
    """HP-4: leaf fields of a requested event range, packed in order until the cap; the first field that
    does not fit whole is cut, and is where the next page starts.

    ``requests``: request_id, session_id, start_seq, end_seq, max_chars, and the cursor field_index and offset (0
    where they are missing) inside the first event; ``fields``: session_id, seq, field_index, path, value;
    ``completed``: session_id, seq of the events of ended turns, all events where it is missing.

    Every request answers: with its fields, or with one row whose ``error`` says why it is refused (a range of more
    than ``most_events`` events or out of order, limits outside ``limits``, events that are not all there, a cursor
    beyond the fields).  Names of evidence are never cut.  A field takes its value, path and ``overhead`` characters.
    """
    zero = F.lit(0).cast("bigint")
    r = requests
    for c in ("field_index", "offset"):
        r = r.withColumn(c, F.coalesce(F.col(c).cast("bigint"), zero) if c in r.columns else zero)
    wide = (F.col("start_seq") >= 1) & (F.col("end_seq") >= F.col("start_seq")) & (F.col("end_seq") - F.col("start_seq") < most_events)
    good = F.coalesce(wide & (F.col("field_index") >= 0) & (F.col("offset") >= 0) & F.col("max_chars").between(*limits), F.lit(False))
    r = r.withColumn("error", F.when(~good, "history_read_invalid_range_or_limit"))
    asked = r.where("error IS NULL").withColumn("seq", F.explode(F.sequence("start_seq", "end_seq")))
    known = (fields if completed is None else completed).select("session_id", "seq").distinct()
    there = asked.join(known, ["session_id", "seq"]).groupBy("request_id").agg(F.count("*").alias("_there"))
    j = asked.join(fields.withColumnRenamed("field_index", "_f"), ["session_id", "seq"])
    first = F.col("seq") == F.col("start_seq")
    j = j.where(~first | (F.col("_f") >= F.col("field_index")))
    begin = first & (F.col("_f") == F.col("field_index"))
    named = F.substring_index("path", ".", -1).isin(K.EVIDENCE_NAMES)
    j = j.withColumn("_from", F.when(begin, F.col("offset")).otherwise(zero))
    has = j.groupBy("request_id").agg(F.max(F.when(first, 1)).alias("_begun"), F.max(F.when(begin & (F.col("offset") > 0) & (named | (F.col("offset") > F.length("value"))), 1)).alias("_beyond"))
    r = r.join(there, "request_id", "left").join(has, "request_id", "left")
    r = r.withColumn("error", F.coalesce("error", F.when(F.coalesce("_there", zero) < F.col("end_seq") - F.col("start_seq") + 1, "history_reference_unavailable")
                                         .when(F.col("_begun").isNull(), "history_read_invalid_field_index").when(F.col("_beyond").isNotNull(), "history_read_invalid_offset")))
    refused = r.where("error IS NOT NULL").select("request_id", "session_id", "error")
    j = j.join(r.where("error IS NULL").select("request_id"), "request_id", "left_semi")
    left = F.greatest(F.length("value") - F.col("_from"), zero)
    j = j.withColumn("_cost", (left + F.length("path") + F.lit(overhead)).cast("bigint"))
    # One event's fields are one block, so the order needs no packed key.
    j = running(j, ["request_id"], ["seq", "_f"], F.col("seq"), {"_before": ("sum", "_cost", False)})
    room = F.col("max_chars") - F.col("_before")
    fits = F.col("_cost") <= room
    shown = F.when(fits, left).when(named, zero).otherwise(F.greatest(zero, room - F.length("path") - F.lit(overhead)))
    j = materialize(j.withColumn("whole", fits).withColumn("shown_chars", shown.cast("bigint")), "field-pages")
    j = running(j, ["request_id"], ["seq", "_f"], F.col("seq"), {"_cut_before": ("max", (~F.col("whole")).cast("int"), False)})
    page = j.where(F.coalesce("_cut_before", F.lit(0)) == 0).select(
        "request_id", "session_id", F.lit(None).cast("string").alias("error"), "seq", F.col("_f").alias("field_index"), "path", "whole", F.col("_from").alias("offset"), "shown_chars",
        F.when(~F.col("whole"), F.col("_from") + F.col("shown_chars")).alias("next_offset"))
    return page.unionByName(refused, allowMissingColumns=True)


def result_order(events: DataFrame) -> DataFrame:
    """HP-5: tool results of a turn in the order of their calls, whatever order they came in."""
    calls = events.where("event_type = 'tool/call'").groupBy(*TURN, "tool_call_id").agg(F.min("seq").alias("call_seq"))
    results = events.where("event_type = 'tool/result'").select(*TURN, "tool_call_id", F.col("seq").alias("arrived_seq"))
    j = results.join(calls, [*TURN, "tool_call_id"], "left").withColumn(
        "_o", F.coalesce("call_seq", F.col("arrived_seq") + F.lit(1 << 40)))
    return number_rows(j, TURN, ["_o", "arrived_seq"], block_of("_o"), "emit_position").drop("_o")


def backfill_titles(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """HP-6: titles only where they are null, from the first user message; times untouched."""
    j = sessions.join(first_user_message(events), "session_id", "left")
    made = F.coalesce(T.session_title(F.col("first_message")), F.lit(K.NEW_SESSION_TITLE))
    return j.withColumn("backfilled", F.col("title").isNull()).withColumn("title", F.coalesce("title", made)).drop("first_message")


def history_record(results: DataFrame, cap: int = 64) -> DataFrame:
    """HP-7: bounded record of a tool result; the tool decides which facts stay.

    ``results``: call_id, tool, ok, doc_id, parser, query, title, n_chunks, sections ARRAY, refs ARRAY, cached, saved, error.
    """
    tool, cut = F.col("tool"), lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(300))
    failed = ~F.col("ok")
    refs = F.filter("refs", lambda r: T.valid_ref(r["doc_id"], r["parser"], r["cache_version"], r["chunk_id"]))
    facts = (
        F.when(failed, F.concat(F.lit("error="), cut("error")))
        .when(tool.startswith("parse_"), F.concat(F.lit("doc="), "doc_id", F.lit(";cache_created="), (~F.col("cached")).cast("string")))
        .when(tool == "get_info", F.concat(F.lit("doc="), "doc_id", F.lit(";title="), cut("title")))
        .when(tool == "extract_sections", F.concat(F.lit("doc="), "doc_id", F.lit(";sections="), F.array_join(F.slice("sections", 1, 20), ","),
                                                   F.lit(";count="), F.size("sections").cast("string")))
        .when(tool.startswith("retrieve"), F.concat(F.lit("doc="), "doc_id", F.lit(";query="), cut("query"), F.lit(";chunks="),
                                                    F.col("n_chunks").cast("string"), F.lit(";sections="),
                                                    F.array_join(F.slice(F.array_distinct("sections"), 1, 20), ",")))
        .when(tool.startswith("save_"), F.concat(F.lit("saved="), F.col("saved").cast("string")))
        .otherwise(F.concat(tool, F.lit(" completed")))
    )
    r = results.withColumn("_refs", refs)
    return r.select("call_id", "tool", F.when(failed, "error").otherwise("success").alias("status"), facts.alias("facts"),
                    F.slice("_refs", 1, cap).alias("evidence_refs"),
                    F.greatest(F.size("refs") - F.least(F.size("_refs"), F.lit(cap)), F.lit(0)).cast("bigint").alias("refs_omitted"))


# ---- memory --------------------------------------------------------------------------------

def fold_case(c: Column) -> Column:
    """Key for case-blind comparison: lower case of upper case, so that sharp s equals ss."""
    return F.lower(F.upper(c))


def append_memory(store: DataFrame, entries: DataFrame) -> DataFrame:
    """ME-1: outcome of each proposed entry: added, duplicate, unknown_category or bad_length.

    ``store``: category, entry; ``entries``: ord, category, entry.  A duplicate in any category counts.
    """
    e = entries.withColumn("entry", T.collapse(F.coalesce("entry", F.lit("")))).withColumn("_k", fold_case(F.col("entry")))
    valid = F.col("category").isin(K.MEMORY_CATEGORIES) & F.length("entry").between(1, 500)
    first = e.where(valid).groupBy("_k").agg(F.min("ord").alias("_first"))
    known = store.select(fold_case(T.collapse(F.col("entry"))).alias("_k")).distinct().withColumn("_known", F.lit(True))
    j = e.join(first, "_k", "left").join(known, "_k", "left")
    outcome = F.when(~F.col("category").isin(K.MEMORY_CATEGORIES), "unknown_category").when(~F.length("entry").between(1, 500), "bad_length") \
        .when(F.col("_known") | (F.col("ord") > F.col("_first")), "duplicate").otherwise("added")
    return j.select("ord", "category", "entry", outcome.alias("outcome"))


def upsert_profile(store: DataFrame, updates: DataFrame) -> DataFrame:
    """ME-2: profile after updates, with changed flags.

    ``store``: user_id, field, value (lists joined in order by a newline); ``updates``: user_id, ord, field,
    ``vals`` ARRAY.  The last non-empty value of a field wins; lists are replaced whole and de-duplicated.
    """
    vals = F.filter(F.transform("vals", T.collapse), lambda v: v != "")
    u = updates.where(F.col("field").isin(K.PROFILE_SCALARS + K.PROFILE_LISTS)).withColumn("_v", vals).where(F.size("_v") > 0)
    keys = F.transform("_v", fold_case)
    u = u.withColumn("_k", keys)
    distinct = F.filter("_v", lambda v, i: F.array_position(F.col("_k"), fold_case(v)) == i + 1)
    value = F.when(F.col("field").isin(K.PROFILE_SCALARS), F.get("_v", F.lit(0))).otherwise(F.array_join(distinct, "\n"))
    last = u.groupBy("user_id", "field").agg(F.max_by(value, "ord").alias("new_value"))
    j = store.join(last, ["user_id", "field"], "full_outer")
    return j.select("user_id", "field", F.coalesce("new_value", "value").alias("value"),
                    (F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("value"))).alias("changed"))

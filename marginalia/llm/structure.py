"""Repair of conversation structure by iterative-deepening A*.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  Rows are kept, given another role or deleted,
and empty turns are inserted; the cheapest list of edits is searched depth first in ASCII order of the edits' initials
(Delete, Insert, Keep, Rerole) under a rising bound on the cost.  A table holds for each failed state (next row, roles
so far) the least cost it may still need; a state that needs more than is left is not entered again, and the start's
entry is the next bound.  It begins with an admissible estimate: what neighbouring pairs of rows need at least.  The
first path that ends well is the answer, so ties go to the ASCII-least list.

Rows of a conversation are cut into blocks of ``BLOCK_TURNS`` turns.  A conversation of one block is searched directly.
In longer ones every block is searched once for each pair of states at its two ends, in tasks of their own, and the
blocks' answers are joined from left to right; no block's list of edits is the beginning of another's (each ends with a
row's edit), so the least lists of the blocks make the least list of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.scale import materialize

BLOCK_TURNS = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Roles so far: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (NOTHING, ASSISTANT)
NEVER = 1 << 60
_INK = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


# ---- search on codes: one letter per row; d must go, x has no known role, upper case is truncated ----

@lru_cache(maxsize=None)
def _moves(letter: str, state: int, insert: bool) -> tuple[tuple[str, int, int, int], ...]:
    """(initial, cost, rows taken, next state) in ASCII order; ``letter`` is empty after the last row."""
    expected = ASSISTANT if state == USER else USER
    out = [("D", DELETE, 1, state)] if letter else []
    if insert:
        out.append(("I", INSERT, 0, expected))
    if letter and letter != "d":
        role, more = letter.lower(), TRUNCATED if letter.isupper() else 0
        if role == "s" and state == NOTHING:
            out.append(("K", more, 1, SYSTEM))
        elif role == ("a" if expected == ASSISTANT else "u"):
            out.append(("K", more, 1, expected))
        out.append(("R", REROLE + more, 1, expected))
    return tuple(out)


@lru_cache(maxsize=None)
def _one(letter: str) -> int:
    return min(cost for state in range(4) for _, cost, taken, _ in _moves(letter, state, False) if taken)


@lru_cache(maxsize=None)
def _pair(two: str) -> int:
    """The least cost of two neighbouring rows, inserted turns before them included, from any state to any state."""
    return min(_deepen(two, state, range(4), False, [_one(two[0]) + _one(two[1]), _one(two[1]), 0])[0] for state in range(4))


def _estimates(code: str) -> list[int]:
    out = [0] * (len(code) + 1)
    for i in range(len(code) - 1, -1, -1):
        out[i] = _one(code[i]) + out[i + 1]
        if i + 2 <= len(code):
            out[i] = max(out[i], _pair(code[i:i + 2]) + out[i + 2])
    return out


def _deepen(code: str, entry: int, goals, closing: bool, estimate: list[int]) -> tuple[int, str] | None:
    """Least cost and edits from ``entry`` over all rows to one of ``goals``; turns after the last row if ``closing``."""
    n = len(code)
    need: dict[tuple[int, int], int] = {}  # the table of failed states
    bound = estimate[0]
    while bound < NEVER:
        frames, path = [[0, entry, bound, 0, NEVER]], []
        while frames:
            frame = frames[-1]
            i, state, rest, turn, least = frame
            if i == n and state in goals:
                return bound - rest, "".join(path)
            moves = _moves(code[i] if i < n else "", state, closing or i < n)
            if turn < len(moves):
                frame[3] = turn + 1
                initial, cost, taken, after = moves[turn]
                wants = cost + need.get((i + taken, after), estimate[i + taken])
                if wants <= rest:
                    frames.append([i + taken, after, rest - cost, 0, NEVER])
                    path.append(initial)
                elif wants < least:
                    frame[4] = wants
                continue
            need[i, state] = least = max(least, need.get((i, state), 0))
            frames.pop()
            if frames:
                path.pop()
                above = frames[-1]
                above[4] = min(above[4], least + _moves(code[above[0]] if above[0] < n else "", above[1], closing or above[0] < n)[above[3] - 1][1])
        bound = need[0, entry]
    return None


@lru_cache(maxsize=1 << 16)
def cheapest(code: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return _deepen(code, NOTHING, ACCEPTING, True, _estimates(code))


@lru_cache(maxsize=1 << 12)
def crossings(code: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, edits) of a block, for all pairs of states that it can connect."""
    out, n, estimate = [], len(code), _estimates(code)
    for entry in range(4):
        for exit_ in range(4):
            if exit_ == entry and exit_ in (NOTHING, SYSTEM) or not n:
                # Nothing can be put out without leaving these states for good.
                found = (DELETE * n, "D" * n) if exit_ == entry else None
            elif exit_ == NOTHING or exit_ == SYSTEM and (entry != NOTHING or "s" not in code.lower()):
                found = None
            elif exit_ == SYSTEM:
                # The one kept system row is as good as any other; ASCII order wants it late, its price decides.
                kept = max(i for i, c in enumerate(code) if c == ("s" if "s" in code else "S"))
                found = (DELETE * (n - 1) + (TRUNCATED if code[kept] == "S" else 0), "D" * kept + "K" + "D" * (n - 1 - kept))
            else:
                found = _deepen(code, entry, (exit_,), False, estimate)
            if found:
                out.append((entry, exit_, *found))
    return out


def joined(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]], str]:
    """Total cost, (entry, edits) for each block, and the edits after the last row."""
    best = {NOTHING: (0, 0, None)}  # state: cost, rank of the edits so far, chain of (entry, edits, chain)
    for options in blocks:
        found = {}
        for entry, exit_, cost, edits in options:
            if entry in best:
                key = (best[entry][0] + cost, best[entry][1], edits)
                if exit_ not in found or key < found[exit_][0]:
                    found[exit_] = (key, (entry, edits, best[entry][2]))
        order = {k: rank for rank, k in enumerate(sorted({key[1:] for key, _ in found.values()}))}
        best = {state: (key[0], order[key[1:]], chain) for state, (key, chain) in found.items()}
    closing = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, _, end, state = min((cost + INSERT * len(closing[state]), rank, closing[state], state) for state, (cost, rank, _) in best.items())
    chain, chosen = best[state][2], []
    while chain:
        chosen.append(chain[:2])
        chain = chain[2]
    return cost, chosen[::-1], end


def edited(rows: list[tuple[str, str]], edits: str, state: int) -> list[tuple[str, str]]:
    """The rows after the edits, from a state on."""
    out, at = [], 0
    for edit in edits:
        role = ("user", USER) if state != USER else ("assistant", ASSISTANT)
        if edit == "I":
            out.append((role[0], ""))
            state = role[1]
            continue
        if edit == "R":
            out.append((role[0], rows[at][1]))
            state = role[1]
        elif edit == "K":
            out.append(rows[at])
            state = SYSTEM if rows[at][0][:1] == "s" else role[1]
        at += 1
    return out


# ---- rows of a block ----

def _read_block(listed: list[dict], seen: list[str] | None) -> dict:
    """Rows in order, their code, and the facts of a block."""
    rows = sorted(((r["turn"], r["role"], r["text"]) for r in listed for _ in range(r["times"])),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    before, known, code, counts = set(), set(seen or ()), [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for turn, role, text in rows:
        last, letter = _INK.search(text), role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = None
        if not last:
            fault = "blank"
        elif (role, text) in before or known and _name(role, text) in known:
            fault = "duplicate"
        elif last[0] not in ".!?":
            fault = "truncated"
        before.add((role, text))
        if fault:
            counts[fault] += 1
        code.append("d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
    initials = [r[1][:1] for r in rows]
    counts["illegal"] = sum(_illegal(a, b) for a, b in zip(initials, initials[1:]))
    turns = {r[0] for r in rows} - {None}
    return {"rows": [r[1:] for r in rows], "code": "".join(code), **counts, "distinct": len(turns), "low": min(turns, default=None), "high": max(turns, default=None),
            "head": initials[0] if initials else None, "tail": initials[-1] if initials else None}


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _name(role: str, text: str) -> str:
    import hashlib
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_OPTIONS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
_FACTS = [("code", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")), ("head", pa.string()), ("tail", pa.string())]
_FACTS_DDL = "code string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, low bigint, high bigint, head string, tail string"
_RESULT_DDL = ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string"


def _dicts(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def _columns(out: list[dict], names: list[str], kinds: list) -> list[pa.Array]:
    return [pa.array([x[n] for x in out], kind) for n, kind in zip(names, kinds)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of one block."""
    for batch in batches:
        out = []
        for listed in batch["rows"].to_pylist():
            block = _read_block(listed, None)
            cost, audit = cheapest(block["code"])
            out.append(block | {"gaps": _gaps(block["low"], block["high"], block["distinct"]), "cost": cost, "audit": audit, "repaired": _dicts(edited(block["rows"], audit, NOTHING))})
        names, kinds = [*_COUNTS, "audit", "repaired"], [pa.int64()] * 6 + [pa.string(), _REPAIRED]
        yield pa.RecordBatch.from_arrays([batch["k"], *_columns(out, names, kinds)], ["k", *names])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts and crossings of blocks of longer conversations."""
    for batch in batches:
        out = []
        for listed, seen in zip(batch["rows"].to_pylist(), batch["seen"].to_pylist()):
            block = _read_block(listed, seen)
            out.append(block | {"options": [dict(zip(("entry", "exit", "cost", "edits"), o)) for o in crossings(block["code"])]})
        names, kinds = [n for n, _ in _FACTS] + ["options"], [k for _, k in _FACTS] + [_OPTIONS]
        yield pa.RecordBatch.from_arrays([batch["k"], batch["blk"], *_columns(out, names, kinds)], ["k", "blk", *names])


_CHOSEN = pa.list_(pa.struct([("blk", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), ("closing", pa.string())]))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per longer conversation: its facts, and what each block shall do."""
    for batch in batches:
        out = []
        for blocks in batch["blocks"].to_pylist():
            cost, steps, end = joined([[tuple(o.values()) for o in b["options"]] for b in blocks])
            filled = [b for b in blocks if b["head"] is not None]
            lows, highs = [b["low"] for b in filled if b["low"] is not None], [b["high"] for b in filled if b["high"] is not None]
            out.append({c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")} | {
                "gaps": _gaps(min(lows, default=None), max(highs, default=None), sum(b["distinct"] for b in blocks)), "cost": cost,
                "audit": "".join(e for _, e in steps) + end,
                "steps": [{"blk": b["blk"], "entry": s, "edits": e, "closing": end if b is blocks[-1] else ""} for b, (s, e) in zip(blocks, steps)]})
            out[-1]["illegal"] += sum(_illegal(a["tail"], b["head"]) for a, b in zip(filled, filled[1:]))
        names, kinds = [*_COUNTS, "audit", "steps"], [pa.int64()] * 6 + [pa.string(), _CHOSEN]
        yield pa.RecordBatch.from_arrays([batch["k"], *_columns(out, names, kinds)], ["k", *names])


def _carried_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_dicts(edited(_read_block(listed, None)["rows"], edits + closing, entry))
               for listed, edits, closing, entry in zip(*(batch[c].to_pylist() for c in ("rows", "edits", "closing", "entry")))]
        yield pa.RecordBatch.from_arrays([batch["k"], batch["blk"], pa.array(out, _REPAIRED)], ["k", "blk", "part"])


# ---- tables ----

def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and ``repaired`` (role, text).

    Rows are taken by turn, nulls first, ties by role and text.  ``times`` says how often a row stands in its place, 0
    for a row that only tells of its conversation.  Null roles and texts count as one space; a role without one of the
    initials s, u, a must be changed or go.  A null conversation is one of its own.  A conversation without rows is
    empty and sound.  Repeated rows are rows, other columns are ignored, an empty table gives an empty result.

    Blocks of one conversation are searched apart; only rows of one turn of one conversation are never parted.
    """
    k = F.struct(F.col(conv_col).alias("id"))
    turn = F.col(turn_col).cast("bigint")
    # Null turns come first, so their block does too.
    flat = rows.select(k.alias("k"), F.coalesce(F.floor(turn / BLOCK_TURNS).cast("bigint"), F.lit(-(1 << 62))).alias("blk"), turn.alias("turn"),
                       F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
                       (F.lit(1) if times is None else times).cast("int").alias("times"))
    flat = flat.withColumn("text", F.when(F.col("times") > 0, F.col("text")).otherwise(""))
    blocks = flat.groupBy("k", "blk").agg(F.collect_list(F.struct("turn", "role", "text", "times")).alias("rows"))

    # Longer conversations: which blocks they have, and which rows of a block were seen in an earlier one.
    parts = flat.groupBy("k", "blk").agg(F.count(F.lit(1)).alias("_n"))
    longer = parts.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("k")
    named = (flat.where("times > 0").join(longer, "k", "left_semi")
             .groupBy("k", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("h"), "blk").agg(F.count(F.lit(1)).alias("_n")))
    first = named.groupBy("k", "h").agg(F.min("blk").alias("first"), F.max("blk").alias("last")).where("last > first").select("k", "h", "first")
    seen = named.join(first, ["k", "h"]).where("blk > first").groupBy("k", "blk").agg(F.collect_list("h").alias("seen"))
    context = parts.join(longer, "k", "left_semi").select("k", "blk", F.lit(True).alias("long")).join(seen, ["k", "blk"], "left")
    staged = materialize(blocks.join(context, ["k", "blk"], "left"), "conversation-blocks")

    id_ddl = f"k struct<id:{rows.schema[conv_col].dataType.simpleString()}>"
    repaired_ddl = "array<struct<role:string,text:string>>"
    short = staged.where("long IS NULL").select("k", "rows").mapInArrow(_whole, f"{id_ddl}, {_RESULT_DDL}, repaired {repaired_ddl}")

    long = staged.where("long")
    searched = long.select("k", "blk", "rows", "seen").mapInArrow(
        _searched, f"{id_ddl}, blk bigint, {_FACTS_DDL}, options array<struct<entry:int,exit:int,cost:bigint,edits:string>>")
    facts = F.struct("blk", *[n for n, _ in _FACTS if n != "code"], "options")
    chosen = materialize(searched.groupBy("k").agg(F.array_sort(F.collect_list(facts)).alias("blocks")).mapInArrow(
        _chosen, f"{id_ddl}, {_RESULT_DDL}, steps array<struct<blk:bigint,entry:int,edits:string,closing:string>>"), "conversation-edits")
    steps = chosen.select("k", F.inline("steps"))
    done = long.select("k", "blk", "rows").join(steps, ["k", "blk"]).mapInArrow(_carried_out, f"{id_ddl}, blk bigint, part {repaired_ddl}")
    whole = done.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("blk", "part"))), lambda b: b["part"])).alias("repaired"))
    both = short.unionByName(chosen.drop("steps").join(whole, "k"))
    return both.select(F.col("k.id").alias(conv_col), *_COUNTS, "audit", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage of the query's contract: ``times`` is 0 for dropped rows and 2 for repeated ones."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    return conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, one row for each id, with the digest of the repaired rows.

    Nulls in any column count as one space (in the key of the damage too); otherwise as ``repair``.
    """
    out = repair(damaged(conversations), times=F.col("times"))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.select("conv_id", *_COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

"""Chat formatting from event logs.

A conversation is kept as a log of events: a message is opened, text is streamed to it in deltas, edited, regenerated
or deleted.  The log is partitioned by message and sorted by sequence; folding it gives the message as it stood at the
end.  Final messages are rendered with a template that marks turns, escapes control strings inside texts and roles so
that they can be read back, and says by spans which characters are under the loss mask.

Built from DataFrame functions only.  Messages are placed in blocks of a conversation, and running lengths go over
blocks first, so only finished block strings meet in the one row that a formatted conversation is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SEQUENCES = 4096

# Control strings of common chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

# What an event does to its message.  All but delta begin its text anew.
OPEN, DELTA, EDIT, REGENERATE, DELETE = "open", "delta", "edit", "regenerate", "delete"
TIES = [OPEN, EDIT, REGENERATE, DELTA, DELETE]  # order of events with one sequence number


@dataclass(frozen=True)
class Template:
    """``start`` role newline text ``end`` newline, for each turn.

    A control string inside a role or text gets a backslash after its first character, and one more where backslashes
    stand there already, so the escaped form has no control string and taking one backslash away gives the old text.
    In roles, backslashes and newlines are written as ``\\\\`` and ``\\n`` first.
    """
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = tuple(CONTROLS)
    learned_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if self.start not in self.controls or self.end not in self.controls:
            raise ValueError("the marks of turns must be control strings")
        for a in self.controls:
            if len(a) < 2 or "\\" in a or "\n" in a:
                raise ValueError(f"no control string: {a!r}")
            for b in self.controls:
                # Strings that overlap could hide each other from the escape.
                if a != b and b in a or any(a.endswith(b[:n]) for n in range(1, len(b))):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    def _pattern(self, slashes: str) -> str:
        return "|".join(f"(?<={re.escape(c[0])}){slashes}(?=\\\\*{re.escape(c[1:])})" for c in self.controls)

    def _may_hold(self, text: Column) -> Column:
        """A plain search for first characters of control strings, which most texts do not have."""
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in sorted({c[0] for c in self.controls})])

    def escape(self, text: Column) -> Column:
        # An empty match right after the first character of a control string, with or without backslashes behind it.
        return F.when(self._may_hold(text), F.regexp_replace(text, self._pattern(""), r"\\")).otherwise(text)

    def unescape(self, text: Column) -> Column:
        return F.when(self._may_hold(text), F.regexp_replace(text, self._pattern(r"\\"), "")).otherwise(text)

    def escape_role(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: Column) -> Column:
        # Pairs are read from the left, so what lies between two pairs has newlines only.
        return F.array_join(F.transform(F.split(self.unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame, conv_col: str = "conv_id", message_cols: tuple[str, ...] = ("message_id",), seq_col: str = "seq",
         kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages of all conversations: conversation, message columns, ``first`` (its first sequence), role, text, ``kept``.

    Events of a message are sorted by sequence (ties by ``TIES``, role and text).  ``open``, ``edit`` and ``regenerate``
    begin the text anew, with their own text if they have one; ``delta`` appends; ``delete`` takes the message away
    until it is begun anew.  The role is the last one given.  A regeneration also takes back all messages of the
    conversation that were opened between the message's own first event and itself.  Messages that are not kept stay
    as rows with ``kept`` false.  Null texts append nothing, unknown kinds are deltas, null ids are ids.
    """
    kind, seq = F.coalesce(F.col(kind_col), F.lit(DELTA)), F.col(seq_col).cast("bigint")
    keyed = events.select(F.struct(F.col(conv_col).alias("id")).alias("k"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(message_cols)],
                          F.struct(seq.alias("seq"), F.array_position(F.array(*map(F.lit, TIES)), kind).alias("tie"), kind.alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("e"))
    ids = [f"m{i}" for i in range(len(message_cols))]
    logs = keyed.groupBy("k", *ids).agg(F.array_sort(F.collect_list("e")).alias("log"))
    begun = F.transform("log", lambda e, i: F.when(e["kind"].isin(OPEN, EDIT, REGENERATE, DELETE), i))
    messages = logs.withColumn("at", F.coalesce(F.array_max(begun), F.lit(0))).select(
        "k", *ids, F.col("log")[0]["seq"].alias("first"),
        F.try_element_at(F.array_compact(F.transform("log", lambda e: e["role"])), F.lit(-1)).alias("role"),
        F.array_join(F.transform(F.expr("slice(log, at + 1, size(log))"), lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
        (F.col("log")[F.col("at")]["kind"] != DELETE).alias("alive"),
        F.array_max(F.transform("log", lambda e: F.when(e["kind"] == REGENERATE, e["seq"]))).alias("again"),
        _block("log").alias("blk"))
    # A message goes if one opened before it was regenerated after it: running maximum over blocks, then inside them.
    order = [F.col(c) for c in ("first", *ids)]
    inside = Window.partitionBy("k", "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = messages.groupBy("k", "blk").agg(F.max("again").alias("top")).withColumn(
        "before", F.max("top").over(Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).select("k", "blk", "before")
    placed = messages.withColumn("inside", F.max("again").over(inside)).join(tops.where("before IS NOT NULL"), ["k", "blk"], "left")
    taken = F.coalesce(F.greatest("inside", "before") > F.col("first"), F.lit(False))
    return placed.select("k", "blk", *ids, "first", "role", "text", (F.col("alive") & ~taken).alias("kept"))


def _block(log: str) -> Column:
    """Block of a message by its first sequence; messages without one come first."""
    return F.coalesce(F.floor(F.col(log)[0]["seq"] / BLOCK_SEQUENCES).cast("bigint"), F.lit(-(1 << 62)))


def render(messages: DataFrame, template: Template, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted`` and ``loss_spans``.

    Takes what ``fold`` gives.  Spans are (start, end) in code points and (start_byte, end_byte) in UTF-8 bytes of
    ``formatted``; each covers the text of one turn of a learned role, without marks and role.  A conversation whose
    messages are all gone has no turns and an empty text.  A formatted conversation is one value, up to 2 GB.
    """
    ids = [c for c in messages.columns if re.fullmatch(r"m\d+", c)]
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = messages.withColumn("head", F.concat(F.lit(template.start), template.escape_role(role), F.lit("\n"))).withColumn("body", template.escape(text))
    shown = shown.select("k", "blk", "first", *ids, "kept", role.isin(*template.learned_roles).alias("learned"), F.col("head"), F.col("body"))
    tail = template.end + "\n"
    piece = F.struct("first", *ids, "head", "body", "learned", *[f(c).cast("bigint").alias(f"{n}_{u}") for u, f in (("c", F.char_length), ("b", F.octet_length)) for n, c in (("h", "head"), ("l", "body"))])
    blocks = shown.groupBy("k", "blk").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), piece))).alias("turns"))

    def width(t: Column, u: str) -> Column:
        return t[f"h_{u}"] + t[f"l_{u}"] + F.lit(len(tail) if u == "c" else len(tail.encode()))

    none = F.expr("struct(0L AS c, 0L AS b, cast(array() as array<struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>>) AS spans)")

    def step(s: Column, t: Column) -> Column:
        c, b = s["c"] + t["h_c"], s["b"] + t["h_b"]
        span = F.struct(c.alias("start"), (c + t["l_c"]).alias("end"), b.alias("start_byte"), (b + t["l_b"]).alias("end_byte"))
        return F.struct((s["c"] + width(t, "c")).alias("c"), (s["b"] + width(t, "b")).alias("b"), F.when(t["learned"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    parts = blocks.select("k", "blk", F.size("turns").cast("bigint").alias("n"), F.aggregate("turns", none, step).alias("mask"),
                          F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("part"))
    whole = parts.groupBy("k").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("blk", "part", "mask"))).alias("parts"))
    # Spans move by what lies in the blocks before; a conversation has few blocks.
    start = F.expr("struct(0L AS c, 0L AS b, cast(array() as array<array<struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>>>) AS lists)")

    def move(s: Column, p: Column) -> Column:
        moved = F.transform(p["mask"]["spans"], lambda x: F.struct((x["start"] + s["c"]).alias("start"), (x["end"] + s["c"]).alias("end"),
                                                                     (x["start_byte"] + s["b"]).alias("start_byte"), (x["end_byte"] + s["b"]).alias("end_byte")))
        return F.struct((s["c"] + p["mask"]["c"]).alias("c"), (s["b"] + p["mask"]["b"]).alias("b"), F.array_append(s["lists"], moved).alias("lists"))

    return whole.select(F.col("k.id").alias(conv_col), "n_turns", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
                        F.aggregate("parts", start, move, lambda s: F.flatten(s["lists"])).alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template, text_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Adds ``turns`` (role, text), read from the formatted text, and ``loss_texts``, what its spans cover, unescaped."""
    pieces = F.split(F.col(text_col), re.escape(template.start), -1)
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        role = F.substring(p, F.lit(1), line - 1)
        text = F.substring(p, line + 1, F.char_length(p) - line - len(template.end) - 1)
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(text).alias("text"))

    # Cut by bytes: each cut reads its own bytes only, however long the conversation is.
    def cuts(raw: Column) -> Column:
        return F.transform(F.col(spans_col), lambda s: template.unescape(F.substring(raw, (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int")).cast("string")))

    return formatted.withColumn("turns", F.transform(inner, turn)).withColumn(
        "loss_texts", F.flatten(F.transform(F.array(F.col(text_col).cast("binary")), cuts)))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as a log: each row opens a message and streams its text.

    Rows of one turn (repeated rows too) are messages of their own, in the order of role and text.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("copy", copy)
    seq = F.col("turn").cast("bigint")
    none = F.lit(None).cast("string")
    events = F.array(F.struct(F.lit(OPEN).alias("kind"), F.col("role").cast("string").alias("role"), none.alias("text")),
                     F.struct(F.lit(DELTA).alias("kind"), none.alias("role"), F.col("text").cast("string").alias("text")))
    return rows.select("conv_id", "turn", "copy", seq.alias("seq"), F.inline(events))


def formatted_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The rows of the query's contract: digests of what is read back from each formatted conversation.

    Rows are taken by turn (nulls first, ties by role and text).  Null texts and roles are empty, a null conversation
    is one of its own, repeated rows are turns, other columns are ignored, an empty table still has conversation -1.
    """
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", conversations.schema["conv_id"].dataType), ("turn", "bigint"), ("role", "string"), ("text", "string"))])
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    log = conversation_events(rows.unionByName(extra.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))))
    out = read_back(render(fold(log, message_cols=("turn", "copy")), template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                      F.char_length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("bigint").alias("formatted_chars"))

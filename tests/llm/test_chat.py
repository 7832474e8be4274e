import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import chat

PIECES = [*chat.CONTROLS, "\\", "\\\\", "\n", "<", "[", "|", "s>", "é😀", " ok ", "INST]", "</s", "\\n", "|im_end|>"]


def escaped(text):
    out, i = "", 0
    while i < len(text):
        out += text[i]
        j = i + 1
        while j < len(text) and text[j] == "\\":
            j += 1
        if any(c[0] == text[i] and text.startswith(c[1:], j) for c in chat.CONTROLS):
            out += "\\"
        i += 1
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        shown = sum(len(f"<|im_start|>{escaped(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(t)}<|im_end|>\n") for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), shown))
    return sorted(out, key=str)


def test_query_equals_plain_reading(spark):
    r = random.Random(11)
    text = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))
    rows = [(i % 40, r.choice([None, 0, 1, 2, 5000, 9000]), r.choice(["user", "assistant", "system", None, "", "a\\n\nb", "<|im_end|>"]), r.choice([None, text(), text(), text()])) for i in range(300)]
    rows += rows[:20] + [(None, 3, "assistant", "null id"), (77, 1, "assistant", "long é " * 100_000), (78, None, None, None)]
    rows += [(90, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(300)]
    df = spark.createDataFrame([(*x, "formatted", 1) for x in rows], "conv_id long, turn long, role string, text string, turns string, k int").repartition(4)
    got = [tuple(x) for x in chat.formatted_conversations(df).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert [tuple(x) for x in chat.formatted_conversations(df.where("false")).collect()] == expected([])


def folded(events):
    """Messages of one conversation by plain loops over the sorted log."""
    logs = {}
    for seq, kind, m, role, text in sorted(events, key=lambda e: (e[0], e[1], e[3] or "", e[4] or "")):
        logs.setdefault(m, []).append((seq, kind, role, text))
    out = {}
    for m, log in logs.items():
        role, text, alive, again = None, "", True, []
        for seq, kind, r, t in log:
            role = r or role
            if kind != "delta":
                text, alive = "", kind != "delete"
            text += t or ""
            again += [seq] if kind == "regenerate" else []
        out[m] = [log[0][0], role, text, alive, again]
    gone = {m for m, x in out.items() for y in out.values() if (y[0], ) < (x[0], ) and any(s > x[0] for s in y[4])}
    return [(x[1], x[2]) for m, x in sorted(out.items(), key=lambda kv: (kv[1][0], kv[0])) if x[3] and m not in gone]


def test_fold_of_deltas_edits_and_regenerations(spark):
    r = random.Random(5)
    events = []
    for conv in range(60):
        seqs = r.sample(range(0, 20_000, 7), 25)
        opened = {}
        for seq in sorted(seqs):
            m = r.randint(0, 7)
            kind = "open" if m not in opened else r.choice(["delta", "delta", "delta", "edit", "regenerate", "delete"])
            opened[m] = 1
            events.append((conv, seq, kind, m, r.choice(["user", "assistant"]) if kind == "open" else None, r.choice([None, f"<s>{seq} ", "x"])))
    r.shuffle(events)
    df = spark.createDataFrame(events, "conv_id int, seq long, kind string, message_id int, role string, text string").repartition(6)
    template = chat.Template()
    out = chat.read_back(chat.render(chat.fold(df), template), template).collect()
    assert len(out) == 60
    for row in out:
        want = folded([e[1:] for e in events if e[0] == row["conv_id"]])
        assert [tuple(t) for t in row["turns"]] == want and row["n_turns"] == len(want)
        assert row["loss_texts"] == [t for role, t in want if role == "assistant"]
        for s, t in zip(row["loss_spans"], row["loss_texts"]):
            assert row["formatted"][s["start"]:s["end"]] == escaped(t)
            assert row["formatted"].encode()[s["start_byte"]:s["end_byte"]].decode() == escaped(t)


def test_streamed_answer(spark):
    log = [(1, 1, "open", "q", "user", "Hi?"), (1, 2, "open", "a", "assistant", None), (1, 3, "delta", "a", None, "Wro"), (1, 4, "regenerate", "a", None, None),
           (1, 5, "delta", "a", None, "Hel"), (1, 6, "delta", "a", None, "lo."), (1, 7, "open", "t", "user", "thanks"), (1, 8, "regenerate", "a", None, "Bye.")]
    df = spark.createDataFrame(log, "conv_id int, seq int, kind string, message_id string, role string, text string")
    row = chat.render(chat.fold(df), chat.Template()).first()
    assert row["formatted"] == "<|im_start|>user\nHi?<|im_end|>\n<|im_start|>assistant\nBye.<|im_end|>\n"


def test_escape_is_reversible(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    t = chat.Template()
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.escape(F.col("text")).alias("e"), t.escape_role(F.col("text")).alias("r"))
    for row in df.select("*", t.unescape(F.col("e")).alias("back"), t.unescape_role(F.col("r")).alias("role_back")).collect():
        assert row["e"] == escaped(row["text"]) and row["back"] == row["text"] == row["role_back"]
        assert not any(c in row["e"] or c in row["r"] for c in chat.CONTROLS) and "\n" not in row["r"]
    with pytest.raises(ValueError):
        chat.Template(controls=(*chat.CONTROLS, "s></s>"))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.formatted_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

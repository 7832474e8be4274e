import hashlib
import random
import re
import time
import zlib
from itertools import product

from marginalia.llm import structure

PATTERN = re.compile(r"(s?(ua)+)?")


def plain(code):
    """Cheapest (cost, audit) by growing all states row by row, with strings compared whole."""
    best = {0: (0, "")}
    for letter in [*code, None]:
        for _ in range(3):  # inserted turns before the row
            for q, (c, a) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (9**9, "")), (c + 3, a + "I"))
        if letter is None:
            break
        after = {}

        def put(q, key):
            after[q] = min(after.get(q, (9**9, "")), key)
        for q, (c, a) in best.items():
            put(q, (c + 4, a + "D"))
            if letter != "d":
                t = 3 if letter.isupper() else 0
                to = 3 if q == 2 else 2
                put(to, (c + t + 3, a + "R"))
                if letter.lower() == "s" and q == 0:
                    put(1, (c + t, a + "K"))
                if letter.lower() == ("a" if q == 2 else "u"):
                    put(to, (c + t, a + "K"))
        best = after
    return min(best[q] for q in (0, 3) if q in best)


def test_search_equals_exhaustive_edit_lists():
    for n in range(4):
        for code in product("suaxdUS", repeat=n):
            code, found = "".join(code), []
            for k in range(n, n + 5):
                for audit in product("DIKR", repeat=k):
                    audit = "".join(audit)
                    if len(audit.replace("I", "")) != n:
                        continue
                    cost, state, at, ok = 0, "", 0, True
                    for e in audit:
                        role = "a" if state.endswith("u") else "u"
                        if e == "I":
                            state, cost = state + role, cost + 3
                            continue
                        c = code[at]
                        at += 1
                        if e == "D":
                            cost += 4
                        elif c == "d":
                            ok = False
                        else:
                            cost += (3 if c.isupper() else 0) + (3 if e == "R" else 0)
                            state += role if e == "R" else c.lower()
                    if ok and PATTERN.fullmatch(state):
                        found.append((cost, audit))
                if k == n + 1 and n == 3:
                    break
            got = structure.cheapest(code)
            assert got == plain(code), code
            if n < 3:
                assert got == min(found), code
            else:
                assert got <= min(found)


def test_blocks_joined_equal_the_direct_search():
    r = random.Random(2)
    for _ in range(400):
        code = "".join(r.choice("uauauaSsdxUA") for _ in range(r.randint(0, 30)))
        cuts = sorted(r.randint(0, len(code)) for _ in range(r.randint(1, 4)))
        parts = [code[a:b] for a, b in zip([0, *cuts], [*cuts, len(code)])]
        cost, steps, end = structure.joined([structure.crossings(p) for p in parts])
        assert (cost, "".join(e for _, e in steps) + end) == structure.cheapest(code) == plain(code)


def test_long_codes_are_quick():
    r = random.Random(4)
    for code in ("u" * 400, "ua" * 300, "a" * 300, "s" * 300, "x" * 300, "".join(r.choice("uaUAd") for _ in range(256))):
        began = time.time()
        cost, audit = structure.cheapest(code)
        assert time.time() - began < 20
        assert (cost, audit) == plain(code)


def expected(rows):
    """Results of the contract by plain loops; rows are (conv_id, turn, role, text)."""
    text = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, body in rows:
        kept = convs.setdefault(conv, [])
        role, body = text(role), text(body)
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            body = ""
        if kind == 2:
            body = re.sub("[.!?]", "", body)
        if kind == 4:
            role = "user"
        kept += [(turn, role, body)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        n, code, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, body in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", body)
            fault = "blank" if not ink else "duplicate" if (role, body) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, body))
            if fault:
                n[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code += "d" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = plain(code)
        fixed, at, last = [], 0, ""
        for e in audit:
            role = "assistant" if last == "u" else "user"
            if e == "I":
                fixed.append(role + ":")
            else:
                if e != "D":
                    role = role if e == "R" else kept[at][1]
                    fixed.append(role + ":" + kept[at][2])
                at += 1
            last = fixed[-1][0] if fixed else ""
        turns = {x[0] for x in kept} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def table(r, convs):
    rows = []
    for conv, n in convs:
        rows += [(conv, t if r.random() < 0.97 else None, r.choice(["user", "assistant"]) if r.random() < 0.2 else ("system" if t == 0 and conv and conv % 3 == 0 else "user" if t % 2 == 0 else "assistant"),
                  r.choice(["Yes.", "No!", "How?", "cut off", "A b. c", f"text {t}.", None, " \n"])) for t in range(n)]
    return [(*x, "clash", "k") for x in rows]


def test_query_equals_brute_force(spark):
    r = random.Random(6)
    rows = table(r, [(i, r.randint(1, 9)) for i in range(120)] + [(500, 900), (None, 40), (501, 300)])
    rows += rows[:40] + [(700, None, None, None, None, None), (701, 0, "tool", "done.", None, None), (702, 4, "user", "é " * 40_000 + ".", None, None)]
    rows += [(703, t, "user", "same words again.", None, None) for t in range(250, 1300, 50)]  # copies in different blocks
    schema = "conv_id long, turn long, role string, text string, audit string, k string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = structure.conversation_repairs(df).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected([x[:4] for x in rows])
    assert structure.conversation_repairs(df.where("false")).collect() == []


def test_general_interface(spark):
    df = spark.createDataFrame([("x", 1, "user", "Hello."), ("x", 2, "user", "Hello there."), ("y", 1, "assistant", "Yes.")], "c string, n int, r string, t string")
    out = {x["c"]: x for x in structure.repair(df, "c", "n", "r", "t").collect()}
    assert (out["x"]["cost"], out["x"]["audit"], [tuple(t) for t in out["x"]["repaired"]]) == (3, "KR", [("user", "Hello."), ("assistant", "Hello there.")])
    assert (out["y"]["cost"], out["y"]["audit"]) == (3, "IK")

import json

import html
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as T
from marginalia.functions.json_tables import json_leaves, safe_json, usage_counts
from marginalia.functions.registry import register_all
from marginalia.functions.similarity import similarity


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_strip_and_collapse_use_unicode_blanks(spark):
    rows = ["　a  b \n", " ", None, "x\x1fy"]
    assert values(spark, rows, T.strip) == ["a  b", "", None, "x\x1fy"]
    assert values(spark, rows, T.collapse) == ["a b", "", None, "x y"]


def test_clear_values(spark):
    rows = ["Title", " 未知 ", "NULL", "", None, "x" * 19, "x" * 20]
    assert values(spark, rows, lambda c: T.is_clear(c, "abstract")) == [False, False, False, False, False, False, True]


def test_markup_decodes_once(spark):
    rows = ["<b>A</b>&amp;lt; &#65;&#x4E2D; &eacute;", "no entity", "&unknown; &amp;amp;"]
    want = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(x))).strip() for x in rows]
    assert values(spark, rows, T.strip_markup) == want


def test_match_text(spark):
    assert values(spark, ["“Deep”：\n Nets  !", "a : b."], T.match_text) == ["deep: nets", "a: b"]


def test_redaction_order(spark):
    rows = ['token = "abc" x', "password: hunter2, next", "Authorization: Bearer abc.def", "key sk-abcdefgh1 end", "plain"]
    got = values(spark, rows, T.redact)
    assert got[0] == 'token = "<redacted>" x'
    assert got[1] == "password: <redacted>, next"
    assert got[2] == "Authorization: <redacted> abc.def"
    assert got[3] == "key <redacted-api-key> end" and got[4] == "plain"


def test_session_title(spark):
    got = values(spark, ["  hello \n world ", "x" * 50, "  "], T.session_title)
    assert got == ["hello world", "x" * 39 + "…", None]


def test_identifiers(spark):
    assert values(spark, ["see 10.1234/Ab.1 now", "none"], T.extract_doi) == ["10.1234/Ab.1", ""]
    assert values(spark, ["arXiv:2401.01234v2", "cs.LG/0101234", ""], T.extract_arxiv) == ["2401.01234v2", "cs.LG/0101234", ""]


def test_author_names_and_chinese_front_matter(spark):
    assert values(spark, ["张三1，李小四2*、Ann"], T.author_names) == [["张三", "李小四"]]
    raw = "摘 要：" + "本文研究图像分割方法并给出完整实验结果与分析，共计三十余字以上。" + "\n关键词：深度学习；图像-文本；abc\nAbstract\n"
    assert values(spark, [raw], T.zh_keywords) == [["深度学习", "图像-文本"]]
    assert values(spark, [raw], T.zh_abstract)[0].startswith("本文研究")


def test_rescued_json(spark):
    rows = ['```json\n{"a":1}\n```', 'x {"a":1} y', '{"a":', "none", "[1]"]
    assert values(spark, rows, T.rescue_json) == ['{"a":1}', '{"a":1}', None, None, None]


def test_similarity_is_the_library_matcher(spark):
    pairs = [("Deep nets", "deep  nets"), ("abcd", "bcde"), ("", "x"), ("aaab" * 80, "ab" * 120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    want = [SequenceMatcher(None, norm(a), norm(b)).ratio() if norm(a) and norm(b) else 0.0 for a, b in pairs]
    assert got == want


def test_json_leaves_native_and_function_agree(spark):
    doc = '{"a":{"b":[1,{"c":"{x}"}]},"d":{},"e":null,"f":"s"}'
    df = spark.createDataFrame([(1, doc)], "id int, j string")
    native = {(r.path, r.value) for r in json_leaves(df, ["id"], "j", 5).collect()}
    register_all(spark)
    df.createOrReplaceTempView("leaf_docs")
    table = {(r.path, r.value) for r in spark.sql("SELECT l.* FROM leaf_docs, LATERAL json_leaves(leaf_docs.j) l").collect()}
    assert {("a.b.0", "1"), ("a.b.1.c", "{x}"), ("d", "{}"), ("f", "s")} <= native & table


def test_secrets_hide_at_every_level(spark):
    doc = {"My_Password": "p", "text": "x" * 30, "a": [{"b": {"c": {"api_key": "k", "say": "password=hunter22 ok", "n": 1}}}], "list": list(range(120))}
    deep: dict = {}
    at = deep
    for _ in range(12):
        at["k"] = {}
        at = at["k"]
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(deep),), ("no json, token: abc",), (None,)], "j string")
    got = [r.s and json.loads(r.s) for r in df.select(safe_json(F.col("j"), 10).alias("s")).collect()]
    assert got[0]["My_Password"] == "[redacted]" and got[0]["text"] == "x" * 10 + "…" and len(got[0]["list"]) == 100
    assert got[0]["a"][0]["b"]["c"] == {"api_key": "[redacted]", "say": "password=<…", "n": 1}
    assert json.dumps(got[1]).count("{") == 8 and "[truncated]" in json.dumps(got[1])
    assert got[2].startswith("no json") and got[3] is None


def test_nested_values_against_a_recursive_walk(spark):
    import random
    import re
    from marginalia import constants as K
    rnd = random.Random(11)

    def made(depth):
        kind = rnd.randrange(6 if depth < 8 else 4)
        if kind == 0:
            return rnd.choice([None, True, False, 0, -7, 12345678901])
        if kind < 4:
            return rnd.choice(["", 'q"uote\\', "password: hunter2 and more", "bearer abc.def", "\u4e2d" * 9, "sk-abcdefghijk"])
        if kind == 4:
            return [made(depth + 1) for _ in range(rnd.randrange(6))]
        return {rnd.choice("abcdefgh") + rnd.choice(["", "Token", " secret"]): made(depth + 1) for _ in range(rnd.randrange(6))}

    def walk(v, depth):
        if depth >= 5:
            return "[truncated]"
        if isinstance(v, str):
            for pattern, put in K.REDACTIONS:
                v = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), v)
            return v if len(v) <= 7 else v[:7] + "…"
        if isinstance(v, dict):
            return {k: "[redacted]" if any(p in k.lower() for p in K.SENSITIVE_KEY_PARTS) else walk(x, depth + 1) for k, x in sorted(v.items())[:4]}
        return [walk(x, depth + 1) for x in v[:4]] if isinstance(v, list) else v

    values = [made(0) for _ in range(60)] + [made(5) for _ in range(5)] + [[[], {}, None], {}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    out = df.select("i", safe_json(F.col("j"), 7, 4, 5).alias("s"))
    assert "Python" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert r.s == json.dumps(walk(values[r.i], 0), ensure_ascii=False, separators=(",", ":")), values[r.i]


def test_usage_counts_walk_four_levels_and_take_numbers_only(spark):
    u = {"prompt_tokens": 5, "api_token": "x", "n_tokens": "12", "b_tokens": True, "prompt_tokens_details": {"cached_tokens": 3, "n": 1, "x_tokens": {"y_tokens": {"z_tokens": 2, "d_tokens": {"e_tokens": 1}}}}}
    m = spark.createDataFrame([(json.dumps(u),)], "u string").select(usage_counts(F.col("u")).alias("m")).first().m
    assert m == {"prompt_tokens": 5.0, "prompt_tokens_details.cached_tokens": 3.0, "prompt_tokens_details.x_tokens.y_tokens.z_tokens": 2.0}


def test_leaves_open_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a":' * 6 + "1" + "}" * 6), (2, '{"b":[[[[[[7]]]]]]}')], "id int, j string")
    assert {(r.path, r.value) for r in json_leaves(df, ["id"], "j", depth=1).collect()} == {("a.a.a.a.a.a", "1"), ("b.0.0.0.0.0.0", "7")}


def test_similarity_equals_the_matcher(spark):
    from difflib import SequenceMatcher
    import random
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcé xyz") for _ in range(n)).strip()
    rows = [(word(r.randrange(0, 12)), word(r.randrange(0, 12))) for _ in range(300)]
    rows += [("abc", "xabcx" * 60), ("ab " * 90, "ab"), ("abc", "xyz"), ("aaa", "a"), (None, "a"), ("", ""), ("A  b", "a b")]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for x in out:
        a, b = (" ".join((t or "").lower().split()) for t in (x.a, x.b))
        assert abs(x.s - (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)) < 1e-12, (a, b)


def test_word_index_is_built_inside_the_row(spark):
    from marginalia.sources import markup as M
    texts = {1: " b a\tb  c b ", 2: "", 3: None, 4: "one", 5: "é e é B b"}
    got = M.word_index(spark.createDataFrame(list(texts.items()), "doc_id int, text string"))
    want = {}
    for i, t in texts.items():
        want[i] = {}
        for p, w in enumerate((t or "").split()):
            want[i].setdefault(w, []).append(p)
    rows = got.select("doc_id", "m", M.abstract_from_index(F.col("m")).alias("back")).collect()
    assert {r.doc_id: r.m for r in rows} == want and {r.doc_id: r.back for r in rows} == {i: " ".join((t or "").split()) for i, t in texts.items()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_white_space_is_one_range_away_for_most_characters(spark):
    """the class tests one range before its rare members, and still has exactly the same members."""
    assert T.WS.count("&&") == 1
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string").where(F.rlike("c", F.lit(T.WS)))
    assert sorted(chr(r["code"]) for r in rows.collect()) == sorted(T.WS_CHARS)


def test_provider_payloads_are_read_without_interpreted_comparisons(spark):
    """positions sort by their natural order; a comparator would be interpreted for every pair of words."""
    from marginalia.sources import markup as M
    docs = spark.createDataFrame([(1, "b a  b\tc"), (2, None), (3, "")], "doc_id int, text string")
    back = M.word_index(docs).select("doc_id", M.abstract_from_index(F.col("m")).alias("t"))
    assert "lambdafunction(if" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert dict(map(tuple, back.collect())) == {1: "b a b c", 2: "", 3: ""}


def test_tokens_are_parted_by_one_range(spark):
    """what lies between tokens is told by ASCII members and one range, with the same members as the plain class."""
    assert T.BETWEEN_TOKENS.count("&&") == 1
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string").where(F.rlike("c", F.lit(T.BETWEEN_TOKENS)))
    assert sorted(r["code"] for r in rows.collect()) == [c for c in codes if not re.match("[a-z0-9_ıſ一-鿿]", chr(c))]


def test_texts_without_a_secret_word_are_not_given_to_the_patterns(spark):
    """words are sought first; letters that equal ASCII ones without case still count."""
    from marginalia import constants as K
    texts = ["plain prose: with colons = signs", "Passſword: abcdef12", "API-KEY = 'xyz'", "authorizıng", "AUTHORİZATİON=zz", "see BEARER a.b-c", "sk-abcdefgh1", "", None,
             "tokens", "ſecret = q"]
    def always(c):
        for pattern, put in K.REDACTIONS:
            c = F.regexp_replace(c, pattern.replace("(?i)", "(?iu)") if K.SECRET_NAMES in pattern else pattern, put)
        return c
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.redact(t).alias("a"), always(t).alias("b"), T.mentions(t, K.REDACTION_WORDS).alias("m")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a != r.t for r in rows) >= 5
    assert not rows[0].m and not rows[7].m and all(r.m for r in rows if r.a != r.t)


def test_one_small_file_of_events_is_counted_by_all_cores(spark):
    """the walk costs far more than reading, so the rows of a file with few splits are dealt out."""
    import __spark_entry__ as entry
    c = entry.queries()["pr11_usage_counts"](spark, "/root/testdata/sf0.001")
    assert "RoundRobinPartitioning" in c._jdf.queryExecution().executedPlan().toString()


def test_usage_counts_of_odd_members(spark):
    """objects are opened before a value's schema is asked for; lists, strings with JSON and nulls hold no counters."""
    u = '{"a_tokens":{"b_tokens":2.5,"c_tokens":[1],"d_tokens":"{\\"e_tokens\\":1}","f_tokens":null,"g_tokens":{}},"h_tokens":-1}'
    rows = spark.createDataFrame([(u,), ("[1]",), ("7",), ("x",), (None,)], "u string").select(usage_counts(F.col("u")).alias("m")).collect()
    assert [r.m for r in rows] == [{"a_tokens.b_tokens": 2.5, "h_tokens": -1.0}, {}, {}, {}, None]


def test_word_index_of_a_batch_keeps_texts_apart(spark):
    """Equal words of different texts, repeated words, texts without words and odd white space."""
    from marginalia.sources import markup as M
    texts = ["b a b", "", "  ", "a　b  a\n\tc\ta", None, "one", "é  é x", "a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r.m for r in M.word_index(df).collect()}
    for i, t in enumerate(texts):
        want = {}
        for n, w in enumerate(x for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x):
            want.setdefault(w, []).append(n)
        assert got[i] == want, t


def test_lone_blanks_are_no_runs(spark):
    texts = ["a b  c\td\n e 　f  g", " ", "\t", "a\tb", "  a ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", T.WS + "+", " "))
    assert all(r[0] == r[1] for r in df.select(T.collapse(F.col("t")), plain).collect())
    assert [r[0] for r in df.select(F.regexp_count("t", F.lit(T.runs(T.WS)))).collect()] == [5, 0, 1, 1, 1, 0]

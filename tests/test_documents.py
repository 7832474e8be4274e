from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.operators import blocks as B
from marginalia.operators import chunks as C
from marginalia.operators import headings as H
from marginalia.operators import layout as L
from marginalia.operators import quality as Q

EN = "Abstract\nfoo bar\n1 Introduction\nbody text\nrelated\nwork\nzzz\nII. METHODS:\nmm\n3.1 Results\nrr\nresults\nss\nReferences\n[1] x"
ZH = "摘要：这是一个关于模型的摘要，长度要超过三十个字符才能有足够的可信度，所以多写一些文字。\n关键词：模型\n一、引言\n引言内容\n第二章 材料与方法\n方法内容。\n结论\n完"


def docs(spark):
    return spark.createDataFrame([(1, "en", EN), (2, "zh", ZH), (3, "en", "no heading at all")], "doc_id int, paper_language string, raw_text string")


def test_headings_numbering_styles_and_two_line_alias(spark):
    got = [(r.section, r.title, r.start, r.end) for r in H.find_headings(docs(spark)).where("doc_id = 1").orderBy("ordinal").collect()]
    assert [g[0] for g in got] == ["abstract", "introduction", "related_work", "method", "experiments", "experiments", "_references"]
    for _, title, start, end in got:
        assert EN[start:end].strip() == title


def test_headings_have_no_raw_length_or_line_limit(spark):
    text = " " * 200 + "abstract\nx\nbackground\nand\n\n related\nwork\ny\n2. literature\n" + " " * 300 + "review" + " " * 300 + "\nz"
    df = spark.createDataFrame([(1, text)], "doc_id int, raw_text string")
    got = [(r.section, " ".join(r.title.split())) for r in H.find_headings(df).orderBy("ordinal").collect()]
    assert got == [("abstract", "abstract"), ("introduction", "background"), ("related_work", "background and related work"), ("related_work", "related work"), ("related_work", "2. literature review")]


def test_sentences_are_no_headings(spark):
    df = spark.createDataFrame([(1, "background and related work。\nMethod, model; results\nIntroduction")], "doc_id int, raw_text string")
    assert [r.section for r in H.find_headings(df).collect()] == ["introduction"]


def test_sections_join_repeats_and_drop_boundaries(spark):
    s = {(r.doc_id, r.section): r for r in H.extract_sections(docs(spark)).collect()}
    assert s[1, "experiments"].content == "rr\n\nss" and s[1, "experiments"].matched_title == "3.1 Results"
    assert s[1, "conclusion"].source == "missing" and s[1, "conclusion"].start_char == -1
    assert s[2, "abstract"].content.startswith("这是一个") and s[2, "abstract"].confidence == 95
    assert "模型\n" not in s[2, "introduction"].content and s[2, "conclusion"].content == "完"
    assert all(s[3, k].content == "" for k in ("abstract", "method"))


def test_pivot_without_exchange_equals_grouped_pivot(spark):
    wide = {r.doc_id: r.asDict() for r in Q.wide_sections(docs(spark)).collect()}
    grouped = {r.doc_id: r.asDict() for r in Q.pivot_sections(H.extract_sections(docs(spark))).collect()}
    assert wide == grouped
    assert "Exchange" not in Q.wide_sections(docs(spark))._jdf.queryExecution().executedPlan().toString()


def test_chunks_stay_in_sections_and_overlap(spark):
    rows = [(1, "method", "We propose a small model. " * 12), (1, "experiments", "We test it on data. " * 12), (2, "method", "  ")]
    df = spark.createDataFrame(rows, "doc_id int, section string, content string")
    got = C.build_chunks(df, ["doc_id", "section"], size=80, overlap=12).orderBy("section", "idx").collect()
    text = {s: t.strip() for _, s, t in rows if t.strip()}
    assert {r.section for r in got} == {"method", "experiments"}
    last = {}
    for r in got:
        assert len(r.text) <= 80 and text[r.section][r.start_char:r.end_char].strip() == r.text
        if r.section in last:
            assert r.start_char < last[r.section]
        last[r.section] = r.end_char
    assert all(last[s] == len(t) for s, t in text.items())


def test_chunk_function_agrees_with_batch_form(spark):
    from marginalia.functions.registry import register_all
    register_all(spark)
    df = spark.createDataFrame([(1, "word " * 700)], "doc_id int, text string")
    df.createOrReplaceTempView("cf_docs")
    a = [tuple(r) for r in spark.sql("SELECT c.* FROM cf_docs, LATERAL chunk_text(cf_docs.text, 1200, 200) c ORDER BY idx").collect()]
    b = [(r.idx, r.start_char, r.end_char, r.text) for r in C.chunk_documents(df).orderBy("idx").collect()]
    assert a == b and len(b) > 2


def test_quality_and_repair(spark):
    raw = "Abstract\n" + "a" * 300 + "\nMethod\n" + "m" * 1200 + "\nExperiments\n" + "e " * 700 + "\nConclusion\n" + "c" * 500 + " References [1] a [2] b doi " + "r" * 100
    df = spark.createDataFrame([(1, "en", raw)], "doc_id int, paper_language string, raw_text string")
    s = H.extract_sections(df, keep=["paper_language"])
    ev = Q.evaluate(Q.score_sections(s))
    by = {r.section: r for r in ev.collect()}
    assert by["method"].score == 100 and by["introduction"].issues == ["missing"]
    assert "conclusion_pollution" in by["conclusion"].issues and by["conclusion"].blocking
    fixed = {r.section: r for r in Q.repair(ev, s, df).collect()}
    assert fixed["conclusion"].action == "truncated" and fixed["conclusion"].content == "c" * 500
    assert fixed["method"].action == "kept"


def test_duplicate_sections(spark):
    df = spark.createDataFrame([(1, "same text here", "same text here"), (2, "alpha", "zzzz")], "doc_id int, method string, experiments string")
    assert {r.doc_id: r.duplicate for r in Q.duplicate_sections(df).collect()} == {1: True, 2: False}


def test_block_sections_stop_at_references(spark):
    rows = [(1, 0, "x"), (1, 1, "一、引言"), (1, 2, "aa"), (1, 3, "2.1 实验设计"), (1, 4, "bb"), (1, 5, "参考文献"), (1, 6, "结论"), (2, 0, "only")]
    s = B.segment_blocks(spark.createDataFrame(rows, "doc_id int, pos bigint, text string"))
    got = {(r.doc_id, r.ordinal): (r.title, r.text, r.level) for r in s.collect()}
    assert got == {(1, 0): ("正文", "x", 1), (1, 1): ("一、引言", "aa", 1), (1, 2): ("2.1 实验设计", "bb", 2), (1, 3): ("参考文献", "结论", 1), (2, 0): ("正文", "only", 1)}
    loc = B.locate_sections(s)
    text = {r.doc_id: r.raw_text for r in B.rebuild_text(loc).collect()}
    for r in loc.collect():
        assert text[r.doc_id][r.start_char:r.end_char] == r.block


def test_layout_titles_and_authors(spark):
    rows = [(1, 0, "基于深度网络的图像", 100., 50., 300., 70., 20., 400., 800.), (1, 1, "语义分割理论与应用", 110., 75., 290., 95., 20., 400., 800.),
            (1, 2, "张三，李四", 150., 160., 250., 170., 10., 400., 800.), (1, 3, "正文内容这里是一些文字没有结尾", 10., 300., 390., 310., 10., 400., 800.)]
    ly = spark.createDataFrame(rows, "doc_id int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page_width double, page_height double")
    best = L.title_candidates(ly).orderBy("rank").collect()
    assert best[0].text == "基于深度网络的图像语义分割理论与应用" and best[0].score == 100
    assert all(len([c for c in r.text if "一" <= c <= "鿿"]) >= 6 for r in best)
    titles = spark.createDataFrame([(1, "基于深度网络的图像")], "doc_id int, title string")
    lines = spark.createDataFrame([(1, 0, "基于深度网络的图像"), (1, 1, "某某大学"), (1, 2, "张三，李四"), (1, 3, "摘要：x"), (1, 4, "王五")], "doc_id int, pos int, text string")
    assert L.first_page_authors(lines, titles).first().authors == ["张三", "李四"]


def test_summaries_say_what_is_cut_and_missing(spark):
    from marginalia.operators.summaries import document_summaries
    docs = spark.createDataFrame([(1, "T", ["A"], "abs", 3, ["w"], True), (2, "", [], None, None, None, None), (3, "T", None, "", 1, [], False)],
                                 "doc_id int, title string, authors array<string>, abstract string, page_count int, warnings array<string>, cached boolean")
    sections = spark.createDataFrame([(1, 2, "b" * 1201, "Two", 2), (1, 1, "a" * 1200, "One", None), (3, 1, None, None, 1), (9, 1, "x", "no such document", 1)], "doc_id int, pos int, text string, title string, level int")
    refs = spark.createDataFrame([(1, 2, "r" * 801, "R", ["X"], "2020"), (1, 1, "r" * 800, None, None, None)], "doc_id int, pos int, text string, title string, authors array<string>, year string")
    m = {r.doc_id: r for r in document_summaries(docs, sections, refs).collect()}
    assert sorted(m) == [1, 2, 3]
    assert [(s.title, s.level, len(s.preview), s.truncated) for s in m[1].sections] == [("One", 1, 1200, False), ("Two", 2, 1200, True)]
    assert [(r.title, r.authors, r.year, len(r.preview), r.truncated) for r in m[1].references] == [("", [], None, 800, False), ("R", ["X"], "2020", 800, True)]
    assert m[1].missing_fields == [] and m[1].warnings == ["w"] and m[1].cached
    assert m[2].missing_fields == ["title", "authors", "abstract", "sections"] and m[2].sections == [] and m[2].references == [] and m[2].page_count == 0
    assert m[3].missing_fields == ["authors", "abstract"] and m[3].sections[0].preview == ""
    assert document_summaries(docs.limit(0), sections, refs).count() == 0


def test_chunk_windows_are_sought_backwards():
    """Breaks are sought from the end of a window, and the windows are those of a plain search over all breaks."""
    import random
    from marginalia.operators.chunks import spans
    r = random.Random(3)
    for _ in range(500):
        text, size = "".join(r.choice(r.choice([" \nab", "abcdefgh"])) for _ in range(r.randint(0, 120))), r.randint(1, 30)
        overlap = r.randint(0, size - 1)
        want, start = [], 0
        while start < len(text):
            soft = [i for i in range(max(start + size // 2, start + 1), start + size) if i < len(text) and text[i] in " \n"]
            end = len(text) if start + size >= len(text) else soft[-1] if soft else start + size
            want.append((start, end))
            start = len(text) if end == len(text) else max(end - overlap, start + 1)
        assert list(spans(text, size, overlap)) == want


def test_patterns_behind_a_front_test_find_what_the_plain_ones_find(spark):
    """Case, folded letters, word ends and one-character texts; the front tests may only drop what cannot match."""
    words = ["References", "REFERENCES", "referencesx", "reſultſ", "Keywords", "ındex termıs", "İNDEX TERMS", "关  键 词", "关键\n词", "参考文献", "[ 12 ]", "[]", "doi", "Doix",
             "ablation", "EVALUATION", "Experimental Results", "对比实验", "网络结构", "frameworK", "Model", "models", "附录", "Acknowledgement", "İntroduction", "绪论", "r", "", "é", "致"]
    texts = [f"{a}{w}{b}" for w in words for a in ("", "x", "é ", "\n", "see ") for b in ("", "y", " z", "。")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [K.KEYWORD_MARKERS, K.INTRO_MARKERS, K.CONCLUSION_MARKERS, K.RESULT_TERMS, K.METHOD_TERMS, "|".join(K.REFERENCE_PATTERNS)]
    rows = df.select("t", *[F.struct(F.col("t").rlike(T.java(p)), F.col("t").rlike(T.java(T.ahead(p)))) for p in patterns]).collect()
    assert all(a == b for r in rows for a, b in r[1:])
    assert all(any(r[k + 1][0] for r in rows) and not all(r[k + 1][0] for r in rows) for k in range(len(patterns)))


def test_front_of_a_line_decides_only_what_no_pattern_matches(spark):
    """Long lines are dropped by their beginning; long numbers, blanks and aliases in all forms are not."""
    aliases = [w for t in (K.ZH_ALIASES, K.EN_ALIASES) for ws in t.values() for w in ws]
    numbers = ["", "1. ", "1.2.3 ", "IV. ", "xii ", "第三章 ", "（二）", "1." * 40 + "1 ", " " * 50, "\t1 　", "٣. ", "三、", "i" * 40 + " "]
    lines = [n + w + e for n in numbers for w in aliases + ["Related", "İndex", "diſcussion", "frameworK", "word"] for e in ("", " : ", "x" * 100)]
    found = spark.createDataFrame([(x,) for x in lines], "l string").select(
        "l", (F.col("l").rlike(H.ZH_LINE) | F.col("l").rlike(H.EN_LINE) | F.col("l").rlike(H.OPEN_LINE)).alias("plain"),
        F.left("l", F.lit(2 * H.FRONT)).rlike(H.FRONT_LINE).alias("front")).collect()
    assert sum(r.plain for r in found) > 1000 and not [r.l for r in found if r.plain and not r.front]
    assert sum(not r.front for r in found) > 20


def test_repair_of_stored_scores_equals_repair_by_joins(spark):
    """Scored once, with own texts and abstracts in the row; kept sections keep their score unread."""
    long = "word " * 80
    texts = [EN, ZH, f"Abstract\n{long}\nKeywords: x\n1 Introduction\n{long}\n2 Method\n{long}[1] a [2] b References\n3 Experiments\nshort\nConclusion\n{long} Appendix A",
             f"Abstract\n{long}\nThe Introduction says {long}\n1 Introduction\n{long * 3}\n2 Method\n{long * 4}\n3 Experiments\n{long * 4}\nConclusion\n{long * 2}", "nothing"]
    df = spark.createDataFrame([(i, "zh" if i % 2 else "en", t) for i, t in enumerate(texts)], "doc_id int, paper_language string, raw_text string").cache()
    s = H.extract_sections(df, keep=["paper_language"]).cache()
    by_joins = Q.repair(Q.evaluate(Q.score_sections(s)), s, df)
    stored = Q.evaluate(Q.fresh_abstract(Q.score_sections(H.extract_sections(df, keep=["paper_language", "raw_text"])))).cache()
    in_rows = Q.repair(stored)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(by_joins) == rows(in_rows.select(*by_joins.columns))
    assert {"kept", "truncated", "recopied", "rebounded"} == {r.action for r in in_rows.select("action").collect()}
    narrow = Q.rescored(Q.repair(stored, kept_texts=False)).select("doc_id", "section", "score", "action")
    assert rows(Q.score_sections(by_joins).select("doc_id", "section", "score", "action")) == rows(narrow)

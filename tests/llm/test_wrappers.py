import time
import random
import re

from marginalia.llm import wrappers as W
from marginalia.llm import wrappers as w

TOP = '<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><article>no</article>";</script></head><body>'


def word(r):
    return r.choice(["alpha", "beta", "gamma &amp; co", "d&eacute;lta", "x&nbsp;y", "1 &lt; 2", "zeta"])


def plain(t):
    import html
    return re.sub(r"\s+", " ", html.unescape(t)).strip()


def page(r, style, i):
    """A page of one of several site styles and the text that is its article."""
    paras = [" ".join(word(r) for _ in range(r.randint(3, 30))) for _ in range(r.randint(1, 6))]
    head = f"Heading {i} {word(r)}"
    menu = "".join(f'<li><a href="/{k}">menu{k}</a>' for k in range(r.randint(1, 6)))
    extra = r.choice(["", '<div class="ad">buy now</div>', '<aside>see also <a href="x">this</a></aside>', "<!-- note <p>gone</p> -->"])
    notes = "".join(f'<div class="comment"><p>reader {k} says so</p></div>' for k in range(r.randint(0, 3)))
    body = "".join(f"<p>{p}</p>" if r.random() < 0.7 else f"<p><b>{p}</b><br>" for p in paras)
    want = [plain(head), *map(plain, paras)]
    if style == 0:
        html = f"{TOP}<nav><ul>{menu}</ul></nav>{extra}<article><h1>{head}</h1>{body}</article>{notes}<footer>&copy; me {i}</footer></body></html>"
    elif style == 1:
        html = f"{TOP}<div id=menu><ul>{menu}</ul></div><div class='main-content'><h1>{head}</h1>{extra}{body}</div><div id='comments'>{notes}</div><div class=footer>foot {i}</div>"
    elif style == 2:
        html = f"{TOP}<header><h2>Site</h2></header><main>{extra}<article><header><h1>{head}</h1><p>by me</p></header><section>{body}</section><form><input name=q>Send<button>Go</button></form></article>{notes}</main><div role='contentinfo'>imprint</div></body></html>"
    else:
        items = [f"item {k} {word(r)}" for k in range(r.randint(1, 5))]
        html = f"<table><tr><td class=sidebar>{menu}<td><h1>{head}</h1>{body}<ul>{''.join(f'<li>{x}' for x in items)}</ul></table><script>x('<p>')</script><noscript>turn on</noscript>"
        want += [plain(x) for x in items]
    return html, "\n".join(want)


def test_articles_of_four_styles(spark):
    r = random.Random(8)
    rows, want = [], {}
    for i in range(160):
        style = i % 4
        html, want[i] = page(r, style, i)
        rows.append((i, f"https://s{style}.example.com/{i}", html, "x"))
    out = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)).collect()
    assert len(out) == 160
    for x in out:
        assert x["covered"] and x["text"] == want[x["page_id"]], (x["text"], want[x["page_id"]])
        assert x["n_chars"] == len(x["text"])


def test_wrapper_covers_every_page_of_its_host():
    r = random.Random(9)
    for style in range(4):
        trees = [w.tree(page(r, style, i)[0]) for i in range(40)]
        out = w.expression(trees[0])
        for t in trees[1:]:
            out = w.merged(out, w.expression(t))
        assert all(w.covers(out, t) for t in trees)
        halves = [None, None]
        for i, t in enumerate(trees):
            e = w.expression(t)
            halves[i % 2] = w.merged(halves[i % 2], e) if halves[i % 2] else e
        assert all(w.covers(w.merged(*halves), t) for t in trees)


def test_alignment_finds_slots_optional_and_repeated_groups():
    make = lambda s: w.expression(w.tree(s))
    a = w.merged(make("<div><h1>Fixed</h1><p>one</p></div>"), make("<div><h1>Fixed</h1><em>x</em><p>two</p><p>three</p></div>"))
    div = a[4][0]
    assert [(p[1], p[2], p[3]) for p in div[4]] == [("h1", False, False), ("em", True, False), ("p", False, True)]
    assert div[4][0][4][0][1] == "Fixed" and div[4][2][4][0][1] is None


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "just text"), (None, "http://h/c", "<p>a<p>b"), (4, "not a url", "<div hidden>no</div><p>yes"), (4, "not a url", "<div hidden>no</div><p>yes"),
            (5, "http://h/d", "<p " + "x" * 1000), (6, "http://h/e", "<article>" + "<p>word &amp; more</p>" * 20_000 + "</article>"), (7, "http://h/f", '<a b="c>open quote<p>t'), (8, "http://H:80/g", "</div></p>" * 50 + "<b>z")]
    out = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {x["page_id"]: x for x in out}
    assert len(out) == len(rows)
    assert by[1]["text"] == by[2]["text"] == "" and by[3]["text"] == "just text" and by[None]["text"] == "a\nb" and by[4]["text"] == "yes"
    assert by[6]["text"].count("\n") == 19_999 and by[8]["text"] == "z" and by[8]["host"] == "h"
    assert w.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_listed_words_do_not_cut_the_article_and_shared_text_is_left_out(spark):
    r = random.Random(10)
    say = lambda k: " ".join(word(r) for _ in range(30)) + f" no {k}"
    rows, want = [], {}
    for i in range(40):
        a, b, c, d, e = (say(f"{i}-{k}") for k in range(5))
        box = '<div class="box3"><h2>Get the paper</h2><p>Every week, for nothing.</p></div>'
        side = '<div class="kasten"><p>' + "This text is the same on each page of the site. " * 3 + "</p></div>"
        parts = f'<section id="discussion"><p>{b}</p></section><h2 id="related-work">Related work</h2><p class="form">{c}</p><div class="notice-period">{d}</div>{box}<table><tr><td>Weight<td>{i} kg</table>'
        text = [f"Head {i}", *map(plain, (a, b)), "Related work", *map(plain, (c, d)), "Weight", f"{i} kg"]
        if i % 4 == 0:
            host, page_, lines = "declared", f"<body>{side}<article><h1>Head {i}</h1><p>{a}</p>{parts}</article>{side}", text
        elif i % 4 == 1:
            host, page_, lines = "bare", f"<body><div class=x><div class=y><h1>Head {i}</h1><p>{a}</p>{parts}</div>{side}</div>", text
        elif i % 4 == 2:
            host, page_, lines = "below", f'<body><div class="notice"><article><h1>Head {i}</h1><p>{e}</p></article></div>{side}', [f"Head {i}", plain(e)]
        else:
            host, page_, lines = "copies", "<body><article><h1>One</h1><p>the same page again</p></article>", ["One", "the same page again"]
        rows.append((i, f"https://{host}.example/{i}", page_))
        want[i] = "\n".join(lines)
    for x in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect():
        assert x["covered"] and x["text"] == want[x["page_id"]], (x["text"], want[x["page_id"]])


def test_names_of_single_pages_do_not_grow_the_wrapper(spark):
    r = random.Random(11)
    rows, want = [], {}
    for i in range(240):
        text = " ".join(word(r) for _ in range(20)) + f" {i}"
        slug = "".join(chr(97 + int(c)) for c in str(i))
        rows.append((i, "https://one.example/", f'<div class=nav>go</div><article id="post-{i}" class="post {slug}-x"><h1 id="{slug}">Head {i}</h1><div class="body b{i}"><p id="p-{slug}">{text}</p></div></article><div class="foot">me</div>'))
        want[i] = f"Head {i}\n{plain(text)}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    size = [len(w.infer(pages.where(f"page_id < {n}")).first()["wrapper"]) for n in (60, 240)]
    assert size[1] < 1.2 * size[0] < 1200, size
    for x in w.extract(pages).collect():
        assert x["covered"] and x["text"] == want[x["page_id"]]


OLD_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""", re.S)


def test_scanner_cuts_like_the_pattern():
    r = random.Random(3)
    parts = ["<a", "<p ", "</p", ">", '"', "'", "x=", " ", "text", "<!--", "-->", "<![CDATA[", "]]>", "<!d", "<?x", "<", "/", "b"]
    for _ in range(4000):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want, at = [], 0
        for m in OLD_TOKEN.finditer(page):
            if m.start() > at:
                want.append(("text", page[at:m.start()]))
            at = m.end()
            if m["cdata"] is not None:
                want.append(("text", m["cdata"]))
            elif m["tag"]:
                want.append(("close" if m["end"] else "open", m["tag"].lower()))
        if at < len(page):
            want.append(("text", page[at:]))
        assert [t[:2] for t in W.tokens(page)] == want, page


def test_deep_and_broken_pages_are_read_whole_and_quickly(spark):
    deep = "".join(f"<div>d{i} " for i in range(10_000)) + "".join(f"e{i} </div>" for i in range(10_000))
    pages = ["<article>" + deep + "</article>", '<a href="x ' * 90_000, "<a href='x \"" * 60_000 + ">", "<p>" + "<b>x" * 20_000, "</div>" * 20_000 + "<p>end</p>"]
    began = time.time()
    for page in pages:
        for _ in W.tokens(page):
            pass
        W.tree(page)
    assert time.time() - began < 20
    rows = [(i, f"http://h{i}.example/a", page) for i, page in enumerate(pages)]
    out = {x["page_id"]: x["text"] for x in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert out[0].split() == [f"d{i}" for i in range(10_000)] + [f"e{i}" for i in range(10_000)]
    assert out[4] == "end"

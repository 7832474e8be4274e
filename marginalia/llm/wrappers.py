"""Article text from pages, by wrappers inferred per host as union-free regular expressions.

A page is a stream of tags and texts.  Repeated neighbours of one shape fold into a repeated group, and streams of
one host are aligned with each other: equal tags match, differing texts become text slots, parts that only some
pages have become optional groups, and one against several becomes a repeated group.  Folding and alignment go on
until one expression, without alternatives, covers all pages of the host: its wrapper.

Texts that stand on nearly all pages of a host are its template.  The wrapper counts what its slots held, over all
pages: number of pages, characters, and characters of the template.  Slots with text of the pages' own mark the
article once per host; names of elements decide outside of it only.  Each page is then read through the wrapper, and
blocks that are all template are left out, but for headings over text of the page and labels in rows with such text.

Labels have the names that many pages of the host share; others, such as an id for each page, are one open name, so
that a wrapper grows with the structure of its site and not with the number of its pages.  Streams of one host are
merged where they are scanned, so a host with a third of all pages sends a few small expressions to one task.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices
from marginalia.scale import materialize

# Fixed values of HTML: elements without end tag, elements that end a paragraph, elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
                   "hr html li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul").split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table select article section div body html main td th nav aside footer header form menu".split())

# Elements and name parts that are not the article.
NOT_ARTICLE = frozenset(("nav menu footer aside form script style noscript template head title svg math canvas iframe object embed applet button input select option textarea dialog datalist "
                         "audio video map xmp noembed noframes search").split())
NOT_NAMES = frozenset(("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navi menu menubar breadcrumb breadcrumbs header masthead topbar "
                       "footer foot bottombar colophon sidebar aside rail widget widgets notice notices cookie cookies consent gdpr alert alerts announcement popup modal overlay comment comments "
                       "commentlist respond reply replies disqus discussion form search searchbox subscribe subscription newsletter signup login register share sharing social related recommended "
                       "recommendations copyright pagination pager toolbar contentinfo complementary").split())
# Of these, words that are as well headings of an article: alone they do not refuse a section.
WEAK_NAMES = frozenset("discussion form notice notices register share related reply replies respond alert alerts announcement promotion advertising recommendations consent copyright subscription".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

# A text is template if this share of the host's pages has it.  Hosts with fewer pages, or with more copies than
# different pages, show no template.
TEMPLATE_SHARE, LEAST_PAGES = 0.8, 4
NAME_SHARE = 0.05           # names on fewer of the host's pages, or on one page, are an open name
SENT_CHARS = 16_000_000     # tables by host up to this size go to the tasks whole; larger ones are joined

MOST_DEPTH = 128            # elements nested deeper stand on this level, as browsers limit the depth of a page too

_START = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
# The usual tag in one match, without a step back; once a tag fails here, the rest of its page is read by _START.
_USUAL = re.compile(_START.pattern[:-1] + r"""(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?P<close>>)?)""")
_NO_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?]))(?P<tag>(?!))?")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_FIXED_NAME = re.compile(r"(?:aria-)?hidden=\w*|role=main|articleBody")   # names that have a meaning by themselves stay in labels
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_BLANKS = re.compile(r"\s+")


class _TagEnds:
    """Ends of tags in one page, in time linear in its length whatever quotes are left open.

    A tag ends at the first ``>`` outside quotes, or at the first ``>`` at all where there is none.  Places from which
    a search outside quotes once failed are remembered, so no stretch of the page is searched twice in vain.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def after(self, at: int) -> int:
        """Index of the closing ``>`` for attributes that begin at ``at``; -1 if the tag is never closed."""
        if at > self.last[">"]:
            return -1
        walked, here = [], at
        while here not in self.dead:
            m = _QUOTE_OR_END.search(self.page, here)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last[m[0]]:
                break
            here = self.page.index(m[0], m.start() + 1) + 1
            walked.append(here)
        self.dead.update(walked)
        return self.page.index(">", at)


def tokens(page: str):
    """("open", tag, names), ("close", tag, "") and ("text", characters, "") in page order."""
    at, size, begun, ends, start = 0, len(page), 0, None, _USUAL
    while m := start.search(page, at):
        if m["tag"]:
            if start is _USUAL and m["close"]:
                stop = m.end() - 1
            else:
                if ends is None:
                    ends, start = _TagEnds(page), _START
                stop = ends.after(m.end("tag"))
            if stop < 0:
                at, start = m.start() + 1, _NO_TAG  # text, like all later tags: no tag ends behind here
                continue
            past = stop + 1
        else:
            mark = "-->" if m["comment"] else "]]>" if m["cdata"] else ">"
            stop = page.find(mark, m.end())
            stop = size if stop < 0 else stop
            past = min(size, stop + len(mark))
        if m.start() > begun:
            yield "text", html.unescape(page[begun:m.start()]), ""
        at = begun = past
        if m["cdata"]:
            yield "text", page[m.end():stop], ""
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                yield "close", tag, ""
                continue
            attrs = page[m.end("tag"):stop]
            names = ""
            if attrs:
                parts = [f"{n[0].lower()}={n[1] or n[2] or n[3]}" for n in _NAME.findall(attrs)]
                names = " ".join(sorted(parts))
            yield "open", tag, names
            if tag in RAW and not attrs.rstrip().endswith("/"):
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                yield "text", html.unescape(page[at:over.start()]) if tag in ("title", "textarea") else "", ""
                yield "close", tag, ""
                at = begun = over.end()
    if begun < size:
        yield "text", html.unescape(page[begun:]), ""


class Node:
    """An element of a page: label, children (nodes and texts), tag."""

    __slots__ = ("tag", "label", "raw", "kids")

    def __init__(self, tag: str, label: str, raw: str):
        self.tag, self.label, self.raw, self.kids = tag, label, raw, []


def text_key(words: str) -> int:
    """64-bit name of a text without outer and double blanks."""
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Site(NamedTuple):
    """What the pages of a host share: keys of template texts, and keys of usual names (None: all names count)."""

    texts: frozenset = frozenset()
    names: frozenset | None = None

    def label(self, tag: str, names: str) -> str:
        """Tag and names; names that are not usual together give way to one usual name and an open one."""
        whole = tag + "[" + names + "]"
        if not names or self.names is None or text_key(whole) in self.names:
            return whole if names else tag
        words = sorted(set(_FIXED_NAME.findall(names)))
        return tag + "[" + " ".join([*words, *next(([n] for n in names.split() if text_key(tag + " " + n) in self.names), []), "*"]) + "]"


def tree(page: str, site: Site = Site()) -> Node:
    """Tags matched as browsers do for what matters here: open paragraphs and items end where a new one starts."""
    root = Node("", "", "")
    known: dict[tuple[str, str], str] = {}
    path = [root]

    def close(tags, barrier):
        for k in range(len(path) - 1, 0, -1):
            if path[k].tag in tags:
                del path[k:]
                return
            if path[k].tag in barrier:
                return

    for kind, value, names in tokens(page):
        if kind == "text":
            kids = path[-1].kids
            if len(path) > MOST_DEPTH:
                level = path[MOST_DEPTH - 1].kids
                kids = kids if level[-1] is path[-1] else level  # page order goes before depth
            if kids and isinstance(kids[-1], str):
                kids[-1] += value
            else:
                kids.append(value)
        elif kind == "open":
            if value in BLOCK and value not in ("option", "optgroup", "hr"):
                close(("p",), BARRIER)
            if value in CLOSES:
                close(CLOSES[value], BARRIER - CLOSES[value])
            if (value, names) not in known:
                known[value, names] = site.label(value, names)
            node = Node(value, known[value, names], value + ("[" + names + "]" if names else ""))
            path[min(len(path), MOST_DEPTH) - 1].kids.append(node)
            if value not in VOID:
                path.append(node)
        elif value not in VOID:
            close((value,), BARRIER - {value} if value not in BLOCK else frozenset(("body", "html")) - {value})
    return root


# Expressions are lists: ["t", fixed text or None, pages, characters, characters of the template] for a text place, and
# ["e", label, optional, repeated, parts, pages] for an element with its content.

def expression(node: Node, many: int = 1, template: frozenset = frozenset()) -> list:
    """Expression of one element; neighbouring children of one shape fold into a repeated group."""
    parts: list = []
    for kid in node.kids:
        if isinstance(kid, str):
            words = _BLANKS.sub(" ", kid).strip()
            if not words:
                continue
            part = ["t", words if len(words) <= 80 else None, many, len(words) * many, len(words) * many if template and text_key(words) in template else 0]
        else:
            part = expression(kid, many, template)
        parts.append(part)
    return ["e", node.label, False, False, folded(parts), many]


def same_shape(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] == "t" or a[1] == b[1])


def folded(parts: list) -> list:
    """Runs of elements with one label become one repeated group."""
    out: list = []
    for part in parts:
        if out and part[0] == "e" and same_shape(out[-1], part):
            pages = max(out[-1][5], part[5])
            out[-1] = merged(out[-1], part)
            out[-1][3], out[-1][5] = True, pages
        else:
            out.append(part)
    return out


def merged(a: list, b: list) -> list:
    """One expression for what both stand for; both have the same shape."""
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] + b[4]]
    return ["e", a[1], a[2] or b[2], a[3] or b[3], aligned(a[4], b[4]), a[5] + b[5]]


def aligned(a: list, b: list) -> list:
    """Align two part lists on their longest common run of shapes; what has no partner becomes optional."""
    if len(a) == len(b) and all(map(same_shape, a, b)):
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same_shape(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and same_shape(a[i], b[j]):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    # Optional groups of one label that came to stand together are one repeated group.
    done: list = []
    for part in out:
        if done and part[0] == "e" and same_shape(done[-1], part) and (part[2] or done[-1][2]):
            both = merged(done[-1], part)
            both[2], both[3] = part[2] and done[-1][2], True
            done[-1] = both
        else:
            done.append(part)
    return done


def _optional(part: list) -> list:
    return ["e", part[1], True, *part[3:]] if part[0] == "e" else part


def _read(parts: list, node: Node) -> list | None:
    """The part that each child of a page's element stands for (None for texts), or None if an element has no place.

    The first part that fits, in order, is taken: if any reading places all children, this one does.
    """
    out, at = [], 0
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(None)
            continue
        k = next((k for k in range(max(at - 1, 0), len(parts)) if parts[k][0] == "e" and parts[k][1] == kid.label and (k >= at or parts[k][3])), None)
        if k is None:
            return None
        out.append(parts[k])
        at = k + 1
    return out


def covers(wrapper: list, node: Node) -> bool:
    """Whether every element of a page has its place in the expression."""
    read = _read(wrapper[4], node)
    return wrapper[1] == node.label and read is not None and all(p is None or covers(p, kid) for kid, p in zip(node.kids, read, strict=True))


def _kind(label: str) -> tuple[str, set[str], str]:
    tag, _, names = label.partition("[")
    return tag, {x.lower() for x in _SPLIT.split(re.sub(r"(class|id|role|itemprop)=", " ", names)) if x}, names


def refused(label: str, inside: bool, named: bool = True) -> bool:
    """Whether an element is no part of an article by its tag or, outside the article, by its names."""
    tag, names, raw = _kind(label)
    if tag in NOT_ARTICLE or re.search(r"(?:^|[ \[])hidden=|aria-hidden=true", raw):
        return True
    if tag == "header":
        return not inside
    if not named or tag in ("html", "body", "p") or tag in HEADING:
        return False
    if tag in ("article", "main") and not names & {"comment", "comments", "reply", "related", "ad", "ads", "sponsored", "promo"}:
        return False
    return bool(names & (NOT_NAMES - WEAK_NAMES if tag == "section" else NOT_NAMES))


def wholly_named(label: str) -> bool:
    """Whether one name of an element, with all its words, is of what is not the article."""
    tag, _, raw = _kind(label)
    if tag == "p" or tag in HEADING:
        return False
    known = NOT_NAMES - WEAK_NAMES if tag == "section" else NOT_NAMES
    names = [{x.lower() for x in _SPLIT.split(n) if x} for n in re.sub(r"(?:class|id|role|itemprop)=|\]$", " ", raw).split()]
    return any(n and n <= known for n in names)


def _links(node: Node, link: bool = False) -> tuple[int, int]:
    """Characters of an element, and those in links."""
    total = inside = 0
    for kid in node.kids:
        n, m = (len(kid.strip()), len(kid.strip()) * link) if isinstance(kid, str) else _links(kid, link or kid.tag == "a")
        total, inside = total + n, inside + m
    return total, inside


def _mass(part: list, link: bool = False, named: bool = True) -> tuple[float, float]:
    """Characters of text places that are no template, and those in links, that are not refused."""
    if part[0] == "t":
        own = part[3] - part[4]
        return own, own * link
    if refused(part[1], False, named):
        return 0, 0
    tag = part[1].partition("[")[0]
    both = [_mass(p, link or tag == "a", named) for p in part[4]]
    return sum(x for x, _ in both), sum(y for _, y in both)


def regions(wrapper: list) -> tuple[list[tuple[int, ...]], bool]:
    """Paths (child numbers) of the wrapper's parts that hold the article, and whether the markup says so.

    An article element that is not refused, else main or an article body by name; else the deepest element that
    holds nearly all text outside links.  Text is what the pages do not share.  Articles below an element that names
    alone refuse count if they hold most of the text.
    """
    found: dict[tuple, list] = {}

    def look(part, path, below):
        if part[0] != "e" or (path and refused(part[1], False, False)):
            return
        below = below or bool(path) and refused(part[1], False)
        tag, names, raw = _kind(part[1])
        rank = 0 if tag == "article" else 1 if tag == "main" or "role=main" in raw or "articleBody" in raw else None
        if rank is not None:
            found.setdefault((below, rank), []).append((path, part))
            if rank == 0:
                return
        for k, p in enumerate(part[4]):
            look(p, (*path, k), below)

    look(wrapper, (), False)
    for below, rank in sorted(found):
        if not below or 2 * sum(_mass(p, False, False)[0] for _, p in found[below, rank]) > _mass(wrapper, False, False)[0]:
            return [path for path, _ in found[below, rank]], True
    # Where names refuse all text, they say nothing.
    named = _mass(wrapper)[0] > 0
    part, path = wrapper, ()
    while True:
        total = _mass(part, False, named)
        best = max(((_mass(p, False, named), k) for k, p in enumerate(part[4]) if p[0] == "e"), default=None, key=lambda x: x[0][0] - x[0][1])
        if best is None or best[0][0] - best[0][1] < 0.9 * max(1, total[0] - total[1]) or _kind(part[4][best[1]][1])[0] in HEADING | {"p", "a", "b", "i", "em", "strong", "span"}:
            return [path], False
        part, path = part[4][best[1]], (*path, best[1])


def article(page: str, wrapper: list, site: Site = Site()) -> tuple[str, bool]:
    """Text of the article's blocks, one per line, and whether the wrapper covered the page."""
    root, template = tree(page, site), site.texts
    chosen: set[int] = set()
    above: set[int] = set()
    whole = True
    paths, declared = regions(wrapper)
    wanted = set(paths)
    prefixes = {p[:k] for p in wanted for k in range(len(p) + 1)}

    def walk(node, part, path):
        nonlocal whole
        if path in wanted:
            chosen.add(id(node))
            return
        if path not in prefixes:
            return
        above.add(id(node))
        places = {id(p): k for k, p in enumerate(part[4])}
        read = _read(part[4], node)
        if read is None:
            whole = False
            return
        for kid, p in zip(node.kids, read, strict=True):
            if p is not None:
                walk(kid, p, (*path, places[id(p)]))

    walk(root, wrapper, ())
    if not whole or not chosen:
        # Not covered, or without any of the host's article parts: the page's own expression has at least one.
        return article(page, expression(root, 1, template), site)[0], whole
    # Text, level of a heading, whether all of it is template, table row, depth of what it has in common with the block before.
    blocks: list[tuple[str, int, bool, int, int]] = []
    lowest = 0
    line: list[str] = []
    fixed: list[bool] = []

    def flush(level, row, depth):
        nonlocal lowest
        text = _BLANKS.sub(" ", "".join(line)).strip()
        if text:
            blocks.append((text, level, bool(fixed) and all(fixed), row, min(lowest, depth)))
            lowest = depth
        line.clear()
        fixed.clear()

    def away(kid, here):
        if id(kid) in chosen or id(kid) in above:
            return False
        if not here or refused(kid.raw, True, False):
            return refused(kid.raw, here)
        # Inside the article a name has to be backed: by the lack of markup for the article, or by links.
        if not wholly_named(kid.raw):
            return False
        total, linked = _links(kid)
        return not declared or 2 * linked > total

    def collect(node, inside, headings, level, row, depth):
        nonlocal lowest
        for kid in node.kids:
            if isinstance(kid, str):
                if inside and not headings:
                    line.append(kid)
                    words = _BLANKS.sub(" ", kid).strip() if template else ""
                    if words:
                        fixed.append(text_key(words) in template)
                continue
            here = inside or id(kid) in chosen
            if away(kid, here):
                continue
            block = kid.tag in BLOCK
            if block:
                flush(level, row, depth)
            if kid.tag == "br":
                line.append(" ")
            below = int(kid.tag[1]) if kid.tag in HEADING else level
            cells = id(kid) if kid.tag in ("tr", "dl") else row if not block or kid.tag in ("td", "th", "dt", "dd") else 0
            # Of a header inside the article only the headings are article text.
            collect(kid, here, (headings or kid.tag == "header") and kid.tag not in HEADING, below, cells, depth + 1)
            if block:
                flush(below, cells, depth + 1)
            lowest = min(lowest, depth)

    collect(root, id(root) in chosen, False, 0, 0, 0)
    flush(0, 0, 0)
    own = {row for _, _, same, row, _ in blocks if row and not same}
    stay = [not same or row in own for _, _, same, row, _ in blocks]
    for k in range(len(blocks) - 2, -1, -1):
        if blocks[k][1] and not stay[k]:
            # A shared heading stays over text that stays, in the element that it has in common with what comes next.
            for j in range(k + 1, len(blocks)):
                if blocks[j][4] < blocks[k + 1][4] or 0 < blocks[j][1] <= blocks[k][1]:
                    break
                if stay[j]:
                    stay[k] = True
                    break
    kept = [block[0] for block, yes in zip(blocks, stay, strict=True) if yes]
    if not kept and template:
        return article(page, expression(tree(page)))[0], whole
    return "\n".join(kept), True


def _seen(batches):
    """On how many pages of its host a text stands, by batch; of each page its longest text, as kind 1; names, as kind 2."""
    for batch in batches:
        count: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts, names, open_text = set(), set(), ""
            for kind, value, named in (*tokens(page.as_py() or ""), ("close", "", "")):
                if kind == "text":
                    open_text += value
                    continue
                if named:
                    names.add(value + "[" + named + "]")
                    names.update(value + " " + n for n in named.split())
                if open_text:
                    texts.add(_BLANKS.sub(" ", open_text).strip())
                    open_text = ""
            texts.discard("")
            count.update((host, 0, text_key(t)) for t in texts)
            count.update((host, 2, text_key(n)) for n in names)
            count[host, 1, text_key(max(texts, key=lambda t: (len(t), t), default=""))] += 1
        hosts, kinds, keys = zip(*count) if count else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(list(count.values()), pa.int64())], names=["host", "kind", "key", "n"])


def templates(pages: DataFrame) -> DataFrame:
    """host and known (keys of its template texts and of its usual names, as JSON), for hosts with enough pages."""
    seen = materialize(pages.select("host", "html").mapInArrow(_seen, "host string, kind int, key bigint, n bigint")
                       .groupBy("host", "kind", "key").agg(F.sum("n").alias("n")).where(f"kind = 1 or n >= {LEAST_PAGES} or (kind = 2 and n >= 2)"), "seen")
    hosts = seen.where("kind = 1").groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("different"))
    hosts = hosts.where(F.col("pages") >= LEAST_PAGES)
    text = (F.col("kind") == 0) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")) & (2 * F.col("different") >= F.col("pages"))
    name = (F.col("kind") == 2) & (F.col("n") >= NAME_SHARE * F.col("pages"))
    same = seen.where("kind <> 1").join(hosts, "host").where(text | name).select("host", "kind", "key")
    keys = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("key"))))
    return hosts.select("host", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("bigint").alias("key")).unionByName(same) \
        .groupBy("host").agg(F.to_json(F.struct(keys(0).alias("texts"), keys(2).alias("names"))).alias("known"))


def _by_host(pages: DataFrame, table: DataFrame, name: str):
    """Pages with the column ``name`` of a table by host, and a look-up instead of it where the table is small."""
    size = table.agg(F.coalesce(F.sum(F.length("host") + F.length(name)), F.lit(0))).first()[0]
    if size > SENT_CHARS:
        return pages.join(table, "host", "left"), None
    return pages.withColumn(name, F.lit(None).cast("string")), pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in table.select("host", name).collect()})


class _Known:
    """Values by host, from a row's own text or the look-up, parsed once while they are in use."""

    def __init__(self, sent, parse):
        self.sent, self.parse, self.held = sent.value if sent else None, parse, {}

    def __call__(self, host: str, text: str | None):
        if host not in self.held:
            if len(self.held) > 200:
                self.held.clear()
            self.held[host] = self.parse(self.sent.get(host) if self.sent is not None else text)
        return self.held[host]


def _site(text: str | None) -> Site:
    return Site(*(frozenset(json.loads(text)[n]) for n in ("texts", "names"))) if text else Site()


def _merge_host(table):
    parts = [json.loads(w) for w in sorted(table["wrapper"].to_pylist())]
    out = parts[0]
    for part in parts[1:]:
        out = merged(out, part)
    return pa.table({"host": [table["host"][0].as_py()], "wrapper": [json.dumps(out)]})


def with_host(pages: DataFrame, url_col: str, html_col: str, *more) -> DataFrame:
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))
    return pages.select(*more, F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(host, F.lit("")).alias("host"))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", known: DataFrame | None = None) -> DataFrame:
    """host and wrapper (the expression as JSON) for every host; pages without a host are one host."""
    named = with_host(pages, url_col, html_col).select("host", "html")
    met, sent = _by_host(named, templates(named) if known is None else known, "known")

    def partial_wrappers(batches):
        """One expression per host and batch: pages of one shape meet as they come."""
        of = _Known(sent, _site)
        for batch in batches:
            held: dict[str, list] = {}
            for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                site = of(host, text)
                one = expression(tree(page.as_py() or "", site), 1, site.texts)
                held[host] = merged(held[host], one) if host in held else one
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

    partial = met.select("host", "html", "known").mapInArrow(partial_wrappers, "host string, wrapper string")
    # A host brings one expression per batch of its pages: a salted round first, so that few meet at the end.
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16)).cast("int"))
    some = salted.groupBy("host", "salt").applyInArrow(_merge_host, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge_host, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host, covered (whether the host's wrapper matched the page).

    A null html is empty and gives an empty text; a null url belongs to the host without name.  A page that its
    wrapper does not cover, or that has no part of the host's article, is read by its own expression; one that is
    template only is read as if its host had none.  Repeated rows each get a row, other columns are
    ignored, an empty table gives an empty result.  Nothing is cut.
    """
    raw = with_host(pages, url_col, html_col, F.col(id_col).cast("bigint").alias("page_id"))
    known = materialize(templates(raw), "templates")
    wrappers = materialize(infer(pages, url_col, html_col, known), "wrappers")
    met, sent_wrappers = _by_host(raw, wrappers, "wrapper")
    met, sent_known = _by_host(met, known, "known")

    def rows(batches):
        wrapper_of, known_of = _Known(sent_wrappers, json.loads), _Known(sent_known, _site)
        for batch in slices(batches, "html"):
            texts, covered = [], []
            for page, host, wrapper, keys in zip(batch.column(2), *[batch.column(k).to_pylist() for k in (3, 4, 5)], strict=True):
                text, ok = article(page.as_py() or "", wrapper_of(host, wrapper), known_of(host, keys))
                texts.append(text)
                covered.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3), pa.array(covered)],
                                             names=["page_id", "url", "text", "n_chars", "host", "covered"])

    return met.select("page_id", "url", "html", "host", "wrapper", "known").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint, host string, covered boolean")

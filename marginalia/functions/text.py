"""Column functions for cleaning and matching text (PR-1 .. PR-18). All run in the JVM."""

from __future__ import annotations

import html.entities
import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import constants as K

# White space as a language runtime with Unicode strings trims it.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The pattern engine tests a class of single characters below 256 in one step, but all others one after another for every
# character of a text; the range before them answers for nearly all.
_LOW, _HIGH = ("".join(f"\\u{ord(c):04x}" for c in WS_CHARS if (ord(c) < 256) == low) for low in (True, False))
WS = f"[{_LOW}[\\u1680-\\u3000&&[{_HIGH}]]]"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.trim(c, F.lit(WS_CHARS))


def runs(space: str) -> str:
    """Runs of white space but the lone blank, for replacement by one."""
    return f"{space}(?:{space}+|(?<! ))"


def collapse(c: Column) -> Column:
    """PR-2: runs of white space become one blank, ends trimmed.  A lone blank stays as it is: nearly all runs are one."""
    return F.trim(F.regexp_replace(c, runs(WS), " "))


def java(pattern: str, flags: str = "iU") -> str:
    """A pattern with Unicode classes and, by default, ignored case."""
    return f"(?{flags}){pattern}"


def is_clear(c: Column, field: str | None = None) -> Column:
    """PR-1 for a string column."""
    s = strip(c)
    ok = c.isNotNull() & ~s.isin(K.UNCLEAR_VALUES) & ~F.lower(s).isin(K.UNCLEAR_LOWER)
    if field == "abstract":
        ok = ok & (F.length(s) >= 20)
    return F.coalesce(ok, F.lit(False))


def has_clear(c: Column) -> Column:
    """PR-1 for an array column: some element is clear."""
    return F.coalesce(F.exists(c, lambda x: is_clear(x)), F.lit(False))


def clear_or_null(c: Column, field: str | None = None) -> Column:
    return F.when(is_clear(c, field), c)


def match_text(c: Column) -> Column:
    """PR-3: form used to compare titles, names and venues."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.replace(t, F.lit("："), F.lit(":")), WS + "+", " ")
    t = F.regexp_replace(t, f"{WS}*:{WS}*", ": ")
    t = F.regexp_replace(t, "[\"'“”‘’`]+", "")
    t = F.rtrim(t, F.lit(WS_CHARS + ".,;:，。；：!?？！"))
    return strip(t)


def _entities() -> Column:
    table = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";") and k != "amp;"}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def unescape(c: Column) -> Column:
    """Character references to characters; '&amp;' last so nothing is decoded twice."""
    named = F.array_distinct(F.regexp_extract_all(c, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    named = F.filter(named, lambda n: n != "amp")
    t = F.aggregate(named, c, lambda acc, n: F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")),
                    F.coalesce(F.try_element_at(_entities(), n), F.concat(F.lit("&"), n, F.lit(";")))))

    def char(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    dec = F.array_distinct(F.regexp_extract_all(t, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    t = F.aggregate(dec, t, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char(n.cast("bigint"))))
    hexa = F.array_distinct(F.regexp_extract_all(t, F.lit("&#[xX]([0-9A-Fa-f]{1,6});"), F.lit(1)))
    t = F.aggregate(hexa, t, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit("&#[xX]"), n, F.lit(";")),
                    char(F.conv(n, 16, 10).cast("bigint"))))
    return F.when(F.contains(c, F.lit("&")), F.replace(t, F.lit("&amp;"), F.lit("&"))).otherwise(c)


def strip_markup(c: Column) -> Column:
    """PR-4: decode references, turn tags into blanks, collapse."""
    return collapse(F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " "))


def extract_doi(c: Column) -> Column:
    """PR-5: first DOI or ''."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), java(K.DOI_PATTERN), 0)


def extract_arxiv(c: Column) -> Column:
    """PR-5: first arXiv id, new style before old style, or ''."""
    s = F.coalesce(c, F.lit(""))
    new = F.regexp_extract(s, java(K.ARXIV_PATTERN), 1)
    return F.when(new != "", new).otherwise(F.regexp_extract(s, java(K.ARXIV_OLD_PATTERN), 1))


def normalize_doi(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.replace(F.replace(t, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))


def normalize_arxiv(c: Column) -> Column:
    return F.lower(extract_arxiv(strip(c)))


def identifier_flags(preview: Column) -> tuple[Column, Column]:
    """PR-5: has DOI, has arXiv id, looked for in the first 5000 characters."""
    head = F.left(preview, F.lit(5000))
    return head.rlike(java(K.DOI_PATTERN)), head.rlike(r"(?U)\b\d{4}\.\d{4,5}(?:v\d+)?\b")


def title_guess(c: Column) -> Column:
    """PR-6: first line of 8-220 characters in the first 2000, page markers skipped."""
    lines = F.transform(F.split(F.left(c, F.lit(2000)), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), strip)
    good = F.filter(lines, lambda x: ~F.startswith(x, F.lit("--- Page")) & F.length(x).between(8, 220))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def has_cjk(c: Column) -> Column:
    """PR-7."""
    return c.rlike("[\\u4e00-\\u9fff]")


def english_title_signal(c: Column) -> Column:
    return ~has_cjk(c) & c.rlike("[A-Za-z]{8,}")


def looks_english_title(c: Column) -> Column:
    s = strip(c)
    return ~has_cjk(s) & (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 8) & (F.length(s) >= 12)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Characters beyond ASCII that equal an ASCII letter once case is ignored in Unicode: long s, Kelvin, I with a dot, i without one.
FOLDED = "\u017f\u212a\u0130\u0131"


def mentions(c: Column, words: list[str]) -> Column:
    """May a pattern that needs one of these lower-case words, case ignored, match?  Words are sought far faster than
    patterns, so what cannot match is not given to them.  A text with a character of FOLDED may always match."""
    return let(F.lower(c), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])) | c.rlike(f"[{FOLDED}]")


def ahead(pattern: str) -> str:
    """Alternatives of literal beginnings, case ignored, behind a test of the next two characters.

    The pattern engine folds case for every alternative at every character of a text; the two classes, in which case is
    not ignored, answer for nearly all of them in one step each.
    """
    starts = [re.match(r"(?:\\b)?(\\\[|\w)(\w?)", a) for a in pattern.split("|")]
    def one_of(chars: set[str]) -> str:
        low = "".join(sorted({f"\\u{ord(x):04x}" for c in chars for x in (c, c.lower(), c.upper()) if ord(x) < 256}))
        high = "".join(sorted({f"\\u{ord(c):04x}" for c in (*chars, *FOLDED) if ord(c) > 255}))
        return f"[{low}[\\u0130-\\u9fff&&[{high}]]]"
    first, second = one_of({m[1][-1] for m in starts}), {m[2] for m in starts}
    return rf"(?-iuU:(?={first}{'' if '' in second else one_of(second)}))(?:{pattern})"


def redact(c: Column) -> Column:
    """PR-8: quoted values, bare values, bearer tokens, key-shaped strings, in that order."""
    def cleaned(t: Column) -> Column:
        for pattern, put in K.REDACTIONS:
            t = F.regexp_replace(t, pattern.replace("(?i)", "(?iu)") if K.SECRET_NAMES in pattern else pattern, put)
        return t
    # What is put in holds none of these words, so a text without them passes all patterns unchanged.
    return let(c, lambda t: F.when(mentions(t, K.REDACTION_WORDS), cleaned(t)).otherwise(t))


def bounded(c: Column, limit: int) -> Column:
    """Cut with a visible ellipsis."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit)), F.lit("…")))


def rescue_json(c: Column) -> Column:
    """PR-12: strip a code fence, cut to the outermost braces; NULL unless it parses to an object."""
    t = strip(c)
    fence = F.regexp_extract(t, "(?is)```(?:json)?\\s*(.*?)```", 1)
    t = F.when(t.rlike("(?is)```(?:json)?\\s*(.*?)```"), strip(fence)).otherwise(t)
    # From the first '{' to the last '}' when they are in that order.
    body = F.regexp_extract(t, "(?s)^[^{]*(\\{.*\\})", 1)
    t = F.when(F.startswith(t, F.lit("{")) | (body == ""), t).otherwise(body)
    parsed = F.try_parse_json(t)
    return F.when(F.startswith(t, F.lit("{")) & parsed.isNotNull(), t)


def overflow_error(provider: Column, status: Column, body: Column) -> Column:
    """PR-13: does a provider error say the context was too long?"""
    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(body, f"$.error.{name}"), F.get_json_object(body, f"$.{name}"), F.lit(""))
    coded = field("code").isin(K.OVERFLOW_CODES) | field("type").isin(K.OVERFLOW_TYPES)
    said = field("message").rlike(K.OVERFLOW_MESSAGE)
    return provider.isin(K.OVERFLOW_PROVIDERS) & (status.isNull() | status.isin(K.OVERFLOW_STATUS)) & (coded | said)


def result_summary(tool: Column, ok: Column, error: Column, content: Column) -> Column:
    """PR-14: one line that tells what a tool result holds, without its payload."""
    def size(name: str) -> Column:
        return F.json_array_length(F.get_json_object(content, f"$.{name}"))
    parser = F.get_json_object(content, "$.parser")
    known = parser.isin(K.PARSERS)
    done = F.concat(tool, F.lit(" completed"))
    no_title = F.when(F.contains(F.coalesce(F.get_json_object(content, "$.missing_fields"), F.lit("")), F.lit('"title"')),
                      F.lit(", title missing")).otherwise(F.lit(""))
    previews = F.json_object_keys(F.get_json_object(content, "$.section_previews"))
    return (
        F.when(~ok, F.left(F.when(F.coalesce(error, F.lit("")) == "", F.lit("Tool execution failed.")).otherwise(error), F.lit(200)))
        .when(F.json_object_keys(content).isNull(), done)
        .when(known & (F.get_json_object(content, "$.success") == "false"),
              F.concat(parser, F.lit(" failed: "), F.left(F.coalesce(F.get_json_object(content, "$.error"), F.lit("unknown error")), F.lit(140))))
        .when(known & size("pages").isNotNull(), F.format_string("%s extracted %d page(s)", parser, size("pages")))
        .when(known & size("sections").isNotNull(), F.concat(F.format_string("%s parsed %d sections", parser, size("sections")), no_title))
        .when(size("chunks").isNotNull(), F.format_string("retrieved %d relevant chunks", size("chunks")))
        .when(size("papers").isNotNull(), F.format_string("retrieved context from %d papers", size("papers")))
        .when(previews.isNotNull(), F.format_string("extracted %d section previews", F.size(previews)))
        .when(F.array_contains(F.json_object_keys(content), "title"), F.lit("retrieved paper information"))
        .otherwise(done)
    )


def request_error(doc_id: Column, top_k: Column, query: Column) -> Column:
    """PR-15: reason a retrieval request is refused, or NULL."""
    return (
        F.when(doc_id.isNull() | ~doc_id.rlike("^[A-Za-z0-9_-]{1,128}\\z"), F.lit("bad_id"))
        .when(top_k.isNull() | ~top_k.between(1, K.MAX_TOP_K), F.lit("bad_top_k"))
        .when(query.isNull() | ~F.length(strip(query)).between(1, 2000), F.lit("bad_query"))
    )


def valid_ref(doc_id: Column, parser: Column, version: Column, chunk_id: Column) -> Column:
    """PR-15: is an evidence reference well formed?"""
    ok = doc_id.rlike("^[A-Za-z0-9_-]{1,128}\\z") & parser.isin(K.PARSERS) & \
        version.rlike("^sha256:[0-9a-f]{64}\\z") & chunk_id.rlike("^c_[0-9a-f]{64}\\z")
    return F.coalesce(ok, F.lit(False))


def language(c: Column) -> Column:
    """PR-16."""
    v = F.lower(strip(F.coalesce(c, F.lit("zh"))))
    return F.when(v.isin("zh", "en"), v).otherwise(F.lit("zh"))


def base_name(c: Column) -> Column:
    return F.substring_index(F.rtrim(c, F.lit("/")), "/", -1)


def safe_name(c: Column) -> Column:
    return F.replace(base_name(c), F.lit(" "), F.lit("_"))


def safe_json_name(c: Column) -> Column:
    name = base_name(c)
    stem = F.when(name.rlike("^.+\\.[^.]+$"), F.regexp_replace(name, "\\.[^.]+$", "")).otherwise(name)
    clean = F.trim(F.regexp_replace(stem, '[<>:"/\\\\|?*\\x00-\\x1f]', "_"), F.lit(" ._"))
    return F.concat(F.when(clean == "", F.lit("paper_sections")).otherwise(clean), F.lit(".json"))


def original_name(path: Column, doc_id: Column) -> Column:
    name, prefix = base_name(path), F.concat(doc_id, F.lit("_"))
    return F.when(F.startswith(name, prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)


def session_title(message: Column) -> Column:
    """PR-17: NULL when blank."""
    t = collapse(message)
    cut = F.concat(F.left(t, F.lit(K.TITLE_LENGTH - 1)), F.lit("…"))
    return F.when(t == "", None).when(F.length(t) > K.TITLE_LENGTH, cut).otherwise(t)


def author_names(line: Column) -> Column:
    """PR-18: names of 2-5 Chinese characters in an author line."""
    t = F.regexp_replace(line, "(?U)[\\d*＊#（）()]+", " ")
    t = F.regexp_replace(t, f"(?<=[\\u4e00-\\u9fff]){WS}+(?=[\\u4e00-\\u9fff])", "")
    return F.filter(F.split(t, "(?U)[\\s,，、;；]+"), lambda x: x.rlike("^[\\u4e00-\\u9fff]{2,5}\\z"))


def zh_abstract(raw: Column) -> Column:
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "\\r\\n?", "\n")
    body = F.regexp_extract(t, rf"(?sU)摘\s*要\s*[:：]?\s*(.*?)(?=\n?\s*(?:关\s*键\s*词|关键词|{K.ZH_FRONT_END}))", 1)
    a = collapse(body)
    return F.when(F.length(a) < 30, F.lit("")).otherwise(F.left(a, F.lit(1500)))


def zh_keywords(raw: Column) -> Column:
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "\\r\\n?", "\n")
    body = F.regexp_extract(t, rf"(?sU)关\s*键\s*词\s*[:：;；]?\s*(.*?)(?=\n?\s*(?:{K.ZH_FRONT_END}|中图分类号|文献标识码))", 1)
    line = strip(F.get(F.split(body, "\n"), F.lit(0)))
    items = F.filter(F.split(line, "(?U)[；;，,\\s]+"), lambda x: (x != "") & (F.length(x) <= 30) & (has_cjk(x) | F.contains(x, F.lit("-"))))
    return F.slice(items, 1, 12)


# As in WS: ASCII is named character by character, and one range answers for nearly all others.
BETWEEN_TOKENS = "[^abcdefghijklmnopqrstuvwxyz0123456789_[\\u0131-\\u9fff&&[\\u0131\\u017f\\u4e00-\\u9fff]]]"


def tokens(c: Column) -> Column:
    """RT-1: lower-cased ASCII word runs and single CJK characters.

    The text is split at what lies between tokens, which is linear in its length; extracting all matches copies the
    text once per match.
    """
    t = F.lower(c)
    spaced = F.when(t.rlike(r"[\u4e00-\u9fff]"), F.regexp_replace(t, r"([\u4e00-\u9fff])", " $1 ")).otherwise(t)
    return F.array_remove(F.split(spaced, BETWEEN_TOKENS + "+"), "")

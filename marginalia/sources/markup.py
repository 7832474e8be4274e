"""Markup to documents (IN-8, IN-9) and provider payloads to candidates (IN-10, IN-11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Namespaces are ignored by the reader; names are local.
PERSON = "struct<persName:struct<forename:array<string>,surname:array<string>>>"
TEI_SCHEMA = f"""
teiHeader struct<
  fileDesc:struct<titleStmt:struct<title:string,author:array<{PERSON}>>,
                  sourceDesc:struct<biblStruct:struct<analytic:struct<author:array<{PERSON}>>>>>,
  profileDesc:struct<textClass:struct<keywords:struct<term:array<string>>>, abstract:struct<p:array<string>>>>,
text struct<body:struct<div:array<struct<head:string,p:array<string>>>>,
            back:struct<listBibl:struct<biblStruct:array<struct<
                analytic:struct<title:string,author:array<{PERSON}>>, monogr:struct<title:string,imprint:struct<date:struct<_when:string>>>>>>>>
"""


def _names(people: Column) -> Column:
    clean = lambda arr: F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), T.collapse), lambda x: x != "")
    names = F.transform(people, lambda p: F.array_join(F.concat(clean(p["persName"]["forename"]), clean(p["persName"]["surname"])), " "))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def parse_tei(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """IN-8 / IN-9: header fields, sections and references of TEI documents; explicit schema, no inference."""
    none = F.array().cast("array<string>")
    d = docs.select(id_col, F.from_xml(F.col(xml_col), TEI_SCHEMA, {"attributePrefix": "_"}).alias("x"))
    head = F.col("x.teiHeader")
    people = lambda c: F.coalesce(c, F.array().cast(f"array<{PERSON}>"))
    authors = F.concat(people(head["fileDesc"]["sourceDesc"]["biblStruct"]["analytic"]["author"]), people(head["fileDesc"]["titleStmt"]["author"]))
    words = F.transform(F.coalesce(head["profileDesc"]["textClass"]["keywords"]["term"], none), T.collapse)
    divs = F.transform(F.coalesce(F.col("x.text.body.div"), F.array().cast("array<struct<head:string,p:array<string>>>")), lambda v: F.struct(
        T.collapse(F.coalesce(v["head"], F.lit(""))).alias("title"),
        F.array_join(F.filter(F.transform(F.coalesce(v["p"], none), T.collapse), lambda p: p != ""), "\n").alias("text")))
    refs = F.transform(F.col("x.text.back.listBibl.biblStruct"), lambda r: F.struct(
        T.collapse(F.coalesce(r["analytic"]["title"], r["monogr"]["title"], F.lit(""))).alias("title"),
        _names(people(r["analytic"]["author"])).alias("authors"), F.left(r["monogr"]["imprint"]["date"]["_when"], F.lit(4)).alias("year")))
    return d.select(
        id_col, T.collapse(F.coalesce(head["fileDesc"]["titleStmt"]["title"], F.lit(""))).alias("title"), _names(authors).alias("authors"),
        F.array_distinct(F.filter(words, lambda w: w != "")).alias("keywords"),
        T.collapse(F.array_join(F.coalesce(head["profileDesc"]["abstract"]["p"], none), " ")).alias("abstract"),
        F.filter(divs, lambda s: (s["title"] != "") | (s["text"] != "")).alias("sections"), refs.alias("references"))


def section_rows(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """IN-9: exploded sections."""
    s = parsed.select(id_col, F.posexplode("sections").alias("p", "s"))
    return s.select(id_col, F.col("p").cast("bigint").alias("ordinal"), "s.title", "s.text", F.lit(1).cast("bigint").alias("level"),
                    F.lit("grobid_tei_div").alias("source"))


HTML_BLOCK = "(?is)<(h[1-6]|p)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p)>"


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """IN-9 on web pages: headings and paragraphs in order; script, style and comments dropped, markup stripped."""
    bare = F.regexp_replace(html_col, "(?is)<(script|style)(?:\\s[^>]*)?>.*?</(?:script|style)>|<!--.*?-->", "")
    p = pages.select(id_col, bare.alias("_h"))
    p = p.select(id_col, F.regexp_extract_all("_h", F.lit(HTML_BLOCK), F.lit(1)).alias("_tags"), F.regexp_extract_all("_h", F.lit(HTML_BLOCK), F.lit(2)).alias("_bodies"))
    b = p.select(id_col, F.posexplode(F.arrays_zip("_tags", "_bodies")).alias("pos", "b"))
    return b.select(id_col, F.col("pos").cast("bigint").alias("pos"), F.lower(F.col("b._tags")).alias("tag"), T.strip_markup(F.col("b._bodies")).alias("text"))


# ---- providers ------------------------------------------------------------------------------

DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF_SCHEMA = (
    f"title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, abstract string, DOI string, URL string, "
    f"`published-print` {DATE}, `published-online` {DATE}, issued {DATE}")
OPENALEX_SCHEMA = (
    "title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, "
    "primary_location struct<source:struct<display_name:string>>, host_venue struct<display_name:string>, "
    "abstract_inverted_index map<string,array<int>>, doi string, id string")
ATOM_SCHEMA = "title string, author array<struct<name:string>>, published string, summary string, doi string, id string"
CANDIDATE = ["doc_id", "provider", "pos", "title", "authors", "year", "venue", "abstract", "doi", "url"]


@F.arrow_udf("map<string,array<int>>")
def _index_of(texts: pa.Array) -> pa.Array:
    """Per text, which is split at blanks, the map from its words to their positions.

    All texts of a batch are done at once: equal words get one number, and one stable sort by text and number brings
    the positions of a word together.
    """
    split = pc.split_pattern(texts, " ")
    ends, words = split.offsets.to_numpy(), split.flatten()
    row = np.repeat(np.arange(len(split)), np.diff(ends))
    place = np.arange(len(words)) - (ends[:-1] - ends[0])[row]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(full)).dictionary_encode()
    key = row[full] * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    entries = np.searchsorted(key[first] // max(len(coded.dictionary), 1), np.arange(len(split) + 1))
    ints = lambda a: pa.array(a.astype(np.int32))
    places = pa.ListArray.from_arrays(ints(np.append(first, len(key))), ints(place[full][order]))
    return pa.MapArray.from_arrays(ints(entries), coded.dictionary.take(coded.indices.take(pa.array(order[first]))), places)


def word_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and column m, the inverted index (word to positions) of the whole text; texts without words get an empty one.

    The index is one value of its row: no word leaves it.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), T.runs("\\s"), " "))
    return docs.withColumn("m", _index_of(spaced))


def abstract_from_index(index: Column) -> Column:
    """IN-11: words put back at their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.trim(F.array_join(F.sort_array(pairs)["w"], " ")), F.lit(""))


def _fields(payloads: DataFrame, read: Column) -> DataFrame:
    """The fields of parsed payloads as columns.  Each is named once here, so a query that needs one field has the others skipped
    by the reader, while cleaning may name a column as often as it likes."""
    kept = ["doc_id", "pos"]
    j = payloads.select(*kept, read.alias("j"))
    return j.select(*kept, "j.*")


def crossref(payloads: DataFrame) -> DataFrame:
    """IN-10: doc_id, pos, json -> candidates.  Dates: print before online before issued."""
    d = _fields(payloads, F.from_json("json", CROSSREF_SCHEMA))
    year = F.coalesce(*[F.get(F.get(F.col(f"`{k}`.`date-parts`"), F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "issued")])
    blank = lambda c: T.strip(F.coalesce(c, F.lit("")))
    names = F.transform("author", lambda a: T.strip(F.concat_ws(" ", F.nullif(blank(a["given"]), F.lit("")), F.nullif(blank(a["family"]), F.lit("")))))
    text = lambda c: T.strip_markup(F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), " "))
    return d.select("doc_id", F.lit("crossref").alias("provider"), "pos", text(F.col("title")).alias("title"),
                    F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "").alias("authors"), F.coalesce(year.cast("string"), F.lit("")).alias("year"),
                    text(F.col("`container-title`")).alias("venue"), T.strip_markup(F.col("abstract")).alias("abstract"),
                    F.coalesce("DOI", F.lit("")).alias("doi"), F.coalesce("URL", F.lit("")).alias("url"))


def openalex(payloads: DataFrame) -> DataFrame:
    """IN-10: doc_id, pos, json -> candidates; the host venue stands in for a missing source."""
    d = _fields(payloads, F.from_json("json", OPENALEX_SCHEMA))
    names = F.filter(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), lambda n: n != "")
    venue = F.coalesce(F.nullif("primary_location.source.display_name", F.lit("")), "host_venue.display_name", F.lit(""))
    return d.select("doc_id", F.lit("openalex").alias("provider"), "pos", T.strip_markup(F.col("title")).alias("title"),
                    F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.coalesce(F.col("publication_year").cast("string"), F.lit("")).alias("year"),
                    T.strip_markup(venue).alias("venue"), abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"),
                    F.replace(F.coalesce("doi", F.lit("")), F.lit("https://doi.org/"), F.lit("")).alias("doi"), F.coalesce("id", F.lit("")).alias("url"))


def arxiv(payloads: DataFrame) -> DataFrame:
    """IN-10: doc_id, pos, xml (one Atom entry) -> candidates."""
    d = _fields(payloads, F.from_xml(F.col("xml"), ATOM_SCHEMA))
    names = F.transform("author", lambda a: T.strip_markup(a["name"]))
    return d.select("doc_id", F.lit("arxiv").alias("provider"), "pos", T.strip_markup(F.col("title")).alias("title"),
                    F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.left(T.strip_markup(F.col("published")), F.lit(4)).alias("year"),
                    F.lit("arXiv").alias("venue"), T.strip_markup(F.col("summary")).alias("abstract"), T.strip_markup(F.col("doi")).alias("doi"),
                    T.strip_markup(F.col("id")).alias("url"))


def all_candidates(*providers: DataFrame) -> DataFrame:
    """SE-5: candidates of all providers in one table."""
    out = providers[0].select(*CANDIDATE)
    for p in providers[1:]:
        out = out.unionByName(p.select(*CANDIDATE))
    return out

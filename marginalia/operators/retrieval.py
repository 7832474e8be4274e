"""Lexical retrieval for batches of queries (RT-1 .. RT-6).

The score of a chunk is the shared token count over the query's token count, plus 1 when the chunk
contains the query text.  Frequent words would pair every query with every chunk, so the top k is found
exactly with less work, from the stored index of ``token_index``:

1. Equal chunk texts are scored once; per text only the first ``MAX_TOP_K`` chunk ids can ever be shown.
2. Maximum counts bound what a block of neighbouring texts can reach for a query, without its texts being read.
3. The few blocks with the highest bounds are scored; their k-th best overlap is what a text must reach.
4. Blocks whose bound is lower are skipped, the others are scored.
5. Texts that contain the whole query also contain its rarest inner tokens, which give the candidates for the phrase
   bonus; they come before all others.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import constants as K
from marginalia.functions import text as T
from marginalia.operators import token_index
from marginalia.operators.token_index import TokenIndex
from marginalia.scale import first_rows, materialize, settle, shared_folder

SEED_BLOCKS = 24  # per query, how many blocks give the first bound
SLOTS = 1024      # places for queries in a range's row of wanted blocks; two queries in one place only cost time
RARE_TOKENS = 4   # per query, how many of its rarest inner tokens a text must hold before it is read for the phrase


def token_counts(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """RT-1: text frequency and total count of every token."""
    per = texts.select(id_col, F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_total"))


def query_bags(queries: DataFrame) -> DataFrame:
    """query_id, token, qn, total; queries hold at most 2000 characters, so a bag is small."""
    q = queries.select("query_id", T.tokens(T.strip(F.col("query"))).alias("toks"))
    bag = q.select("query_id", F.size("toks").cast("bigint").alias("total"), F.explode("toks").alias("token"))
    return bag.groupBy("query_id", "total", "token").agg(F.count("*").alias("qn"))


def block_bounds(bags: DataFrame, index: TokenIndex) -> DataFrame:
    """query_id, range, block, upper: what no text of the block can exceed.  Reads counts only, no texts' entries."""
    met = bags.select("query_id", "token", "qn").join(index.blocks().select("token", "range", "block", "max_n"), "token")
    return met.groupBy("query_id", "range", "block").agg(F.sum(F.least("qn", "max_n")).alias("upper"))


def _slot(query_id: str = "query_id") -> Column:
    return F.pmod(F.xxhash64(query_id), F.lit(SLOTS)).cast("int")


def block_masks(wanted: DataFrame) -> DataFrame:
    """range, masks of the wanted (query_id, range, block): in the place of a query's slot, one bit for each block of the range.

    One row of bounded size per range, however many pairs of query and block there are.
    """
    bit = F.expr(f"shiftleft(1L, cast(block % {token_index.RANGE_BLOCKS} AS int))")
    per = wanted.groupBy("range", _slot().alias("slot")).agg(F.bit_or(bit).alias("mask"))
    rows = per.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("slot", "mask"))).alias("_m"))
    return rows.select("range", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint"))).alias("masks"))


def overlaps(bags: DataFrame, index: TokenIndex, wanted: DataFrame) -> DataFrame:
    """query_id, text_no, overlap, total of the texts of the wanted (query_id, range, block); queries that share a slot
    also get each other's blocks.

    All tokens of a block lie in one bucket, and what is wanted of a range is one row in the same bucket.  So entries
    are never exchanged, neither for the join nor for the sum, however large the index and the wanted pairs are.
    """
    masks = token_index.store_by_range(block_masks(wanted), "wanted_blocks")
    slotted = bags.withColumn("slot", _slot())
    text_no, n = token_index.entry()
    asked = F.expr(f"(shiftright(masks[slot], cast(block % {token_index.RANGE_BLOCKS} AS int)) & 1) = 1")

    def of(blocks: DataFrame) -> DataFrame:
        # The masks of a bucket are few against its entries: they are the side that is looked up, nothing is sorted.
        met = slotted.join(blocks.select("token", "range", "block", "entries"), "token").join(masks.hint("shuffle_hash"), "range").where(asked)
        rows = met.select("query_id", "total", "range", "block", "qn", F.explode("entries").alias("entry")).select(
            "query_id", "total", "range", "qn", text_no.alias("text_no"), n.alias("n"))
        return rows.groupBy("query_id", "range", "text_no").agg(F.sum(F.least("qn", "n")).alias("overlap"), F.first("total").alias("total")).drop("range")

    out = reduce(DataFrame.unionByName, map(of, index.block_tables()))
    living = index.living_texts()
    return out if living is None else out.join(living, "text_no", "left_semi")


def bounds(bags: DataFrame, index: TokenIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """Upper bounds of all blocks, and per query the overlap that k texts are known to reach."""
    upper = materialize(block_bounds(bags, index), "block-bounds")
    # Small sides of joins with the index are stored first: their measured size spares the index an exchange.
    seeds = materialize(first_rows(upper, ["query_id"], [F.col("upper").desc(), F.col("block")], SEED_BLOCKS, "_s").drop("_s"), "seeds")
    best = first_rows(overlaps(bags, index, seeds), ["query_id"], [F.col("overlap").desc(), F.col("text_no")], k, "_s")
    low = best.groupBy("query_id").agg(F.count("*").alias("c"), F.min("overlap").alias("low"))
    return upper, low.select("query_id", F.when(F.col("c") >= k, F.col("low")).otherwise(1).alias("bound"))


def candidates(queries: DataFrame, index: TokenIndex, k: int, phrase: bool = True) -> DataFrame:
    """query_id, text_no, overlap, total, phrase: a set that surely holds the k best texts of every query."""
    # One row per query token and one per query; several joins read them.
    bags = materialize(query_bags(queries), "query-tokens")
    upper, low = bounds(bags, index, k)
    low = materialize(low, "bounds")
    alive = upper.join(low, "query_id").where(F.col("upper") >= F.col("bound")).select("query_id", "range", "block")
    if not phrase:
        return overlaps(bags, index, materialize(alive, "alive")).join(low, "query_id").where(F.col("overlap") >= F.col("bound")).drop("bound").withColumn("phrase", F.lit(False))
    # Texts with the whole query count whatever their block's bound is.
    hits = materialize(phrase_hits(queries, bags, index), "phrase-hits")
    block = F.floor(F.col("text_no") / token_index.BLOCK_TEXTS).cast("bigint")
    places = hits.select("query_id", F.floor(block / token_index.RANGE_BLOCKS).cast("bigint").alias("range"), block.alias("block"))
    scored = overlaps(bags, index, materialize(alive.unionByName(places).distinct(), "alive")).join(low, "query_id", "left")
    marked = scored.join(hits.withColumn("phrase", F.lit(True)), ["query_id", "text_no"], "left").withColumn("phrase", F.coalesce("phrase", F.lit(False)))
    return marked.where(F.col("phrase") | (F.col("overlap") >= F.col("bound"))).drop("bound")


def _phrase_pairs(queries: DataFrame, bags: DataFrame, index: TokenIndex) -> DataFrame:
    """Texts that hold the query's rarest inner tokens (or any token of a query of one or two).

    Inner tokens are delimited inside the query itself, so a text with the whole query has them as tokens.
    """
    blocks = index.blocks()
    toks = queries.select("query_id", T.tokens(T.strip(F.col("query"))).alias("toks"))
    inner = F.when(F.size("toks") > 2, F.slice("toks", F.lit(2), F.size("toks") - 2)).otherwise(F.col("toks"))
    inner = toks.select("query_id", (F.size("toks") > 2).alias("long"), F.explode(F.array_distinct(inner)).alias("token"))
    asked = bags.select("token").distinct()
    freq = blocks.select("token", "n_texts").join(asked, "token", "left_semi").groupBy("token").agg(F.sum("n_texts").alias("df"))
    # A token no text holds has no postings: then no text contains the phrase.
    known = inner.join(freq, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # The text must hold every one of the rarest tokens; all entries of a block lie in one bucket, so they meet without an exchange.
    order = Window.partitionBy("query_id").orderBy("df", "token")
    rare = known.where("long").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= RARE_TOKENS).select("query_id", "long", "token")
    asked = rare.unionByName(known.where("NOT long").select("query_id", "long", "token"))
    per = Window.partitionBy("query_id")
    asked = materialize(asked.select("query_id", "token", F.when(F.col("long"), F.count("*").over(per)).otherwise(1).alias("need")), "phrase-tokens")
    met = asked.join(blocks.select("token", "range", "block", "entries"), "token")
    held = met.select("query_id", "need", "range", "block", F.explode("entries").alias("entry")).select(
        "query_id", "need", "range", token_index.entry()[0].alias("text_no"), F.lit(1).alias("one"))
    return held.groupBy("query_id", "range", "text_no").agg(F.count("one").alias("n"), F.first("need").alias("need")).where("n >= need").select("query_id", "text_no")


def phrase_hits(queries: DataFrame, bags: DataFrame, index: TokenIndex) -> DataFrame:
    """RT-3: (query_id, text_no) whose text contains the query, case ignored."""
    pairs = materialize(_phrase_pairs(queries, bags, index), "phrase-pairs")
    q = queries.select("query_id", F.lower(T.strip(F.col("query"))).alias("needle"))
    hits = pairs.join(index.texts(), "text_no").join(q, "query_id").where(F.contains(F.lower("text"), F.col("needle"))).select("query_id", "text_no")
    living = index.living_texts()
    return hits if living is None else hits.join(living, "text_no", "left_semi")


def phrase_matches(queries: DataFrame, index: TokenIndex) -> DataFrame:
    """RT-3 on its own."""
    return phrase_hits(queries, query_bags(queries), index)


def retrieve(queries: DataFrame, source: DataFrame | TokenIndex, k: int = K.TOP_K, phrase: bool = True) -> DataFrame:
    """RT-2 .. RT-4: the k best chunks of every query by (score desc, chunk_id asc).

    ``queries``: query_id, query; ``source``: a stored index, or chunks (doc_id, chunk_id, text), which get one.
    """
    if not 1 <= k <= K.MAX_TOP_K:
        raise ValueError(f"k must be between 1 and {K.MAX_TOP_K}")
    index = source
    if not isinstance(source, TokenIndex):
        index = token_index.of_chunks(source, f"{shared_folder(source.sparkSession).rstrip('/')}/marginalia/token-index-{uuid.uuid4().hex}")
    scored = materialize(candidates(queries, index, k, phrase), "scored")
    # More than k texts are never shown, and of each text its first k chunks; ties need whole score groups,
    # so texts are cut by score only after the owners' ids have joined.
    owners = index.owners().join(scored.select("text_no").distinct(), "text_no", "left_semi")
    owned = scored.join(first_rows(owners, ["text_no"], [F.col("chunk_id")], k, "_copy").drop("_copy"), "text_no")
    best = first_rows(owned, ["query_id"], [F.col("phrase").desc(), F.col("overlap").desc(), F.col("chunk_id")], k)
    score = F.col("overlap") / F.col("total") + F.when(F.col("phrase"), 1.0).otherwise(0.0)
    return best.select("query_id", "rank", "doc_id", "chunk_id", "text_no", "overlap", "total", "phrase", F.round(score, 4).alias("score"))


def retrieve_scoped(requests: DataFrame, chunks: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """RT-5: each request asks one document; every parser result of it gives its own k best chunks.

    ``requests``: request_id, doc_id, query; ``chunks``: doc_id, parser, chunk_id, text.
    """
    # Equal questions to one document are answered once.
    key = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), T.strip(F.col("query"))), 256)
    asked = requests.withColumn("query_id", key)
    q = asked.groupBy("query_id", "doc_id").agg(F.first(T.strip(F.col("query"))).alias("query"))
    # A query's bag is small (2000 characters at most), so it is made and overlap is counted inside the row: no token leaves it.
    # Every word that both have counts once; words that the query has more than once count on as far as the text has them.
    times = lambda words, w: F.size(words) - F.size(F.array_remove(words, w))
    q = settle(q.withColumn("_q", T.tokens(F.col("query")))).where("size(_q) > 0")
    more = F.filter(F.transform(F.array_distinct("_q"), lambda w: F.struct(w.alias("w"), times(F.col("_q"), w).alias("n"))), lambda e: e["n"] > 1)
    q = settle(q.select("query_id", "doc_id", "query", F.size("_q").cast("bigint").alias("total"), F.array_distinct("_q").alias("_words"), more.alias("_more")))
    pairs = settle(q.join(chunks.select("doc_id", "parser", "chunk_id", "text"), "doc_id").withColumn("_toks", T.tokens(F.col("text"))))
    overlap = F.size(F.array_intersect("_toks", "_words")) + F.aggregate("_more", F.lit(0), lambda acc, e: acc + F.greatest(
        F.least(e["n"], times(F.col("_toks"), e["w"])) - 1, F.lit(0)))
    scored = settle(pairs.select("query_id", "doc_id", "parser", "chunk_id", "total", overlap.cast("bigint").alias("overlap"),
                                 F.contains(F.lower("text"), F.lower("query")).alias("phrase"))).where("overlap > 0")
    best = first_rows(scored, ["query_id", "doc_id", "parser"], [F.col("phrase").desc(), F.col("overlap").desc(), F.col("chunk_id")], k)
    return asked.select("request_id", "query_id").join(best, "query_id").drop("query_id")


def multi_document(requests: DataFrame, hits: DataFrame, available: DataFrame) -> DataFrame:
    """RT-6: one row per (request, distinct requested document) with its status and the request's status.

    ``requests``: request_id, doc_ids ARRAY (at most 8); ``hits``: request_id, doc_id, ... ; ``available``: doc_id.
    """
    d = requests.select("request_id", F.posexplode(F.transform("doc_ids", T.strip)).alias("p", "doc_id")) \
        .groupBy("request_id", "doc_id").agg(F.min("p").alias("first_pos"))
    n = hits.groupBy("request_id", "doc_id").agg(F.count("*").alias("chunks"))
    have = available.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("success", F.lit(True))
    j = d.join(have, "doc_id", "left").join(n.withColumn("doc_id", F.col("doc_id").cast("string")), ["request_id", "doc_id"], "left")
    j = j.withColumn("success", F.coalesce("success", F.lit(False))).withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint")))
    w = Window.partitionBy("request_id")
    good, all_ = F.count_if("success").over(w), F.count("*").over(w)
    status = F.when(good == all_, "success").when(good > 0, "partial").otherwise("error")
    return j.select("request_id", "doc_id", F.row_number().over(w.orderBy("first_pos")).cast("bigint").alias("position"), "success", "chunks",
                    status.alias("status"))

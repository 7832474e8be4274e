"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import read
from marginalia.llm.secrets import RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return put


@query("op1_hilbert_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.sharding import document_shards
    return document_shards(read(spark, folder, "documents"))


@query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.dedup import name_documents
    return name_documents(read(spark, folder, "documents"))


@query("op8_decontaminate", r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, f),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, f),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
       FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item, w, least(len(w), 13) AS m FROM b WHERE len(w) > 0))),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, dw.m, i, item FROM dw JOIN bw ON dw.m = bw.m AND dw.phrase = bw.phrase),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.decontaminate import contamination
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def _kind_sql(no: int, kind: str, pattern: str, least: int) -> str:
    rx = "'" + pattern.replace("'", "''") + "'"
    part = f"regexp_extract(m, {rx}, 2)" if kind == "assign" else "m"
    return f"""SELECT r, {no} AS no, '{kind}' AS kind, m, g, i, length({part}) >= {least} AS ok FROM (
      SELECT r, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM (
        SELECT r, regexp_extract_all(t, {rx}) AS m, string_split_regex(t, {rx}) AS g FROM d WHERE regexp_matches(t, {rx})))"""


SECRETS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(_kind_sql(no, *rule) for no, rule in enumerate(RULES))}),
p AS (SELECT *, CAST(sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS st FROM x WINDOW w AS (PARTITION BY r, no ORDER BY i)),
s AS (SELECT r, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS k, count(*) FILTER (no = 2) AS h,
        string_agg(concat(kind, ':', st, ':', st + length(m)), ',' ORDER BY st, no) AS spans FROM p WHERE ok GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)"""


@query("op9_secret_ledger", SECRETS_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.secrets import document_secrets
    return document_secrets(read(spark, folder, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.packing import pack
    return pack(read(spark, folder, "documents"))


@query("op6_language_bitmasks")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.language import document_languages
    return document_languages(read(spark, folder, "documents"))


@query("op4_factorisation_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.quality import document_quality
    return document_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op5_set_relation_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.jaccard import near_components
    return near_components(read(spark, folder, "documents"))


@query("op10_license_dice")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.licences import scan
    return scan(read(spark, folder, "documents"))


@query("op2_wrapper_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.wrappers import extract
    return extract(read(spark, folder, "pages"))


@query("op12_square_catchers")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.periodic import document_runs
    return document_runs(read(spark, folder, "documents"))


CHAT_SQL = r"""WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(t)),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS plain_role,
             '<\\*(?:/?s>|<SYS>>|</SYS>>|\|(?:im_start|im_end|endoftext)\|>)|\[\\*/?INST\]' AS control FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(plain_role) + len(regexp_extract_all(plain_role, control)) + length(text) + len(regexp_extract_all(text, control))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op11_event_sourced_chat", CHAT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.chat import formatted_conversations
    return formatted_conversations(read(spark, folder, "conversations"))


# The same edits by another way: the cheapest prefix for each state, row by row.
REPAIR_SQL = r"""WITH RECURSIVE crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(unicode(c) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, range(2) x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
marked AS (
  SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last_ink, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(role, 1) AS head, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
faulty AS (SELECT *, CASE WHEN last_ink = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last_ink NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND concat(before, head) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)) v(q, after, m)),
walk AS (
  SELECT conv_id, 0 AS i, 0 AS q, {'cost': 0, 'audit': '', 'fixed': CAST([] AS VARCHAR[])} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, min({'cost': cost, 'audit': audit, 'fixed': fixed}) AS best FROM (
    SELECT w.conv_id, f.i::INTEGER AS i, e.q, w.best.cost + 3 * s.m + e.cost AS cost, concat(w.best.audit, repeat('I', s.m), e.edit) AS audit,
      list_concat(w.best.fixed, CASE s.m WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [CASE w.q WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE ['user:', 'assistant:'] END,
        CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) ELSE [concat(CASE e.edit WHEN 'K' THEN f.role WHEN 'R' THEN CASE s.after WHEN 2 THEN 'assistant' ELSE 'user' END END, ':', f.text)] END) AS fixed
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts s ON s.q = w.q,
    LATERAL (
      SELECT 'D' AS edit, 4 AS cost, s.after AS q
      UNION ALL SELECT 'K', CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END, CASE f.head WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
        WHERE f.fault NOT IN ('blank', 'duplicate') AND (f.head = 's' AND s.after = 0 OR f.head = 'u' AND s.after <> 2 OR f.head = 'a' AND s.after = 2)
      UNION ALL SELECT 'R', CASE f.fault WHEN 'truncated' THEN 6 ELSE 3 END, CASE s.after WHEN 2 THEN 3 ELSE 2 END WHERE f.fault NOT IN ('blank', 'duplicate')) e)
  GROUP BY conv_id, i, q),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 3 * s.m, 'audit': concat(w.best.audit, repeat('I', s.m)),
    'fixed': list_concat(w.best.fixed, CASE s.m WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [CASE w.q WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE ['user:', 'assistant:'] END)}) AS best
  FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts s ON s.q = w.q
  WHERE w.i = coalesce(f.n, 0) AND s.after IN (0, 3) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.fixed, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id"""


@query("op13_structure_repair", REPAIR_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.llm.structure import conversation_repairs
    return conversation_repairs(read(spark, folder, "conversations"))

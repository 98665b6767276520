"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.flows.registry import Query, table
from millrace.llm import (
    grid_order,
    kd_search,
    language,
    line_runs,
    mixing,
    packing,
    passages,
    periodic,
    prefix_trie,
    simhash_grid,
    simhash_tables,
    token_files,
    warc,
)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


@query()
def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


@query()
def op2_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.near_duplicates(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH whole AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM whole
), lines AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, place) AS nr FROM counted WHERE words > 0
), same AS (
  SELECT a.doc_id AS first_doc, b.doc_id, b.nr, b.place, b.words, b.nr - a.nr AS lag,
    b.nr - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.nr - a.nr ORDER BY b.nr) AS run
  FROM lines AS a JOIN lines AS b ON a.line = b.line AND a.nr < b.nr
), runs AS (
  -- as long as both stretches are equal and in one document each
  SELECT *, sum(words) OVER (PARTITION BY first_doc, doc_id, lag, run) AS run_words FROM same
), deleted AS (
  SELECT DISTINCT doc_id, place FROM runs WHERE run_words >= 10
), kept AS (
  SELECT c.doc_id, count(*) FILTER (words > 0) AS n_lines, count(d.place) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY c.place) FILTER (d.place IS NULL), '') AS text
  FROM counted AS c LEFT JOIN deleted AS d ON c.doc_id = d.doc_id AND c.place = d.place GROUP BY c.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM documents LEFT JOIN kept USING (doc_id)"""


@query(LINES_SQL)
def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.without_copies(docs).select("doc_id", "n_lines", "n_removed", "text")


PAYLOAD_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha, min(page_id) OVER (PARTITION BY payload) AS first_id,
    row_number() OVER (PARTITION BY payload ORDER BY page_id) AS place
  FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM firsts"""


@query(PAYLOAD_SQL)
def op5_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query()
def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query()
def op9_simhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tables.fingerprinted(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors AS q JOIN vectors AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


@query(TOP_K_SQL)
def op10_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


@query()
def op8_span_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


#: ``crc_steps``: the checksum of each byte, in a list; ``crc(number)`` by it, as an expression over ``steps``.
CRC_STEPS_SQL = """crc_steps AS (
  SELECT list(list_reduce(list_prepend(byte, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY byte) AS steps
  FROM range(256) AS bytes(byte)
)"""


def crc_sql(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


PERIODIC_SQL = rf"""
WITH {CRC_STEPS_SQL}, cut AS (
  SELECT doc_id, {crc_sql("doc_id")} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents, crc_steps
), placed AS (
  SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 AS more FROM cut
), echoed AS (
  SELECT doc_id, n, list_transform(range(n), lambda i: CASE WHEN h % 10 = 0 AND i >= a
    THEN ws[a + (i - a) % (1 + (n - a) // (3 + more)) + 1] ELSE ws[i + 1] END) AS ws
  FROM placed
), words AS (
  SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM echoed
), same AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM words AS a JOIN words AS b ON a.doc_id = b.doc_id AND a.w = b.w
    AND b.i > a.i AND b.i - a.i <= a.n // 4
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches AS r WHERE NOT EXISTS (
    FROM stretches AS o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words AS w WHERE NOT EXISTS (
    FROM runs AS r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents AS d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query(PERIODIC_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH {CRC_STEPS_SQL}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc_sql("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_steps
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, role, said FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, role, said FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.place >= c.h
), numbered AS (
  SELECT conv_id, role, said, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rebuilt
), prefixes AS (
  SELECT conv_id, d, d = n AS ends, length(said) AS chars,
    list({{'role': role, 'said': said}}) OVER (PARTITION BY conv_id ORDER BY d) AS path
  FROM numbered
  UNION ALL SELECT conv_id, 0, conv_id NOT IN (SELECT conv_id FROM numbered), 0, [] FROM convs
), nodes AS (
  SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM prefixes GROUP BY path
), children AS (
  SELECT p.path, count(c.path) AS n_children FROM nodes AS p LEFT JOIN nodes AS c ON c.d = p.d + 1 AND c.path[1:p.d] = p.path GROUP BY p.path
), whole AS (
  SELECT * FROM nodes JOIN children USING (path)
), below AS (
  SELECT p.path, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved
  FROM whole AS p JOIN whole AS c ON c.d >= p.d AND c.path[1:p.d] = p.path GROUP BY p.path
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM whole AS n JOIN below USING (path) LEFT JOIN nodes AS p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]"""


@query(TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sound AS (
  SELECT * FROM vectors WHERE length > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound AS a JOIN sound AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.length * b.length) >= 0.9
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a
), named AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings AS e LEFT JOIN counted USING (vec_id) LEFT JOIN named USING (vec_id)"""


@query(NEAR_VECTORS_SQL)
def op13_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_duplicates(table(spark, sf_dir, "embeddings"))

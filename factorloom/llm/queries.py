"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .cover_tree import hard_negatives
from .fingerprints import fingerprint_documents
from .line_dedup import dedup_lines
from .maxscore import top_k
from .media import media_columns
from .mixing import mix_plan
from .packing import pack_documents
from .quality import held_out, score, train
from .repair import pieces_joined, repair_conversations
from .setsketch import near_duplicates
from .token_counts import count_tokens
from .url_filter import judge_urls
from .warc import parse_headers, resolve_revisits

#: Rules of the url filter: verdict, then host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.sha2(F.col("text"), 256).alias("text_sha256"), "n_deleted")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))


def op6_mixing_sources_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``, one a minute in the order of page_id.

    Every third page is a not-modified answer without a body. An entity tag follows from the url's path; of each seven
    pages one has a new tag, and one has none but a date.
    """
    revisit = F.col("page_id") % 3 == 2
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    path = F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^?#]*?)(?:\.html|/)?(?:[?#]|$)", 1)
    version = F.when(F.col("page_id") % 7 == 5, F.lit("2")).otherwise(F.lit("1"))
    tag = F.when(F.col("page_id") % 7 == 6, F.lit("")).otherwise(F.concat(F.lit('ETag: "'), F.md5(F.concat(path, version)), F.lit('"\r\n')))
    block = F.concat(tag, F.lit("Last-Modified: 2024-01-0"), version, F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.octet_length("html").cast("string")), F.lit("\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col("page_id").alias("record_id"),
        F.concat(F.lit("https://www."), path, F.lit("#"), F.col("page_id").cast("string")).alias("url"),
        at.alias("captured"),
        F.when(revisit, 304).otherwise(200).alias("status"),
        parse_headers(block).alias("headers"),
        F.when(~revisit, F.md5("html")).alias("payload_digest"),
        F.when(~revisit, F.octet_length("html").cast("long")).alias("payload_bytes"),
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(read(spark, sf_dir, "pages")), body=("payload_digest", "payload_bytes"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "url", "captured", "status", "base_id", "validation", "resolved", F.array_join(lines, ";").alias("headers"), "payload_digest", "payload_bytes")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows lost, emptied, cut, repeated or given another role, as the checksum of conv_id and turn says; lost ones are marked."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(times).alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_joined(repair_conversations(damaged(read(spark, sf_dir, "conversations")), dropped="lost"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows.filter("vec_id % 100 = 0"), rows)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_minhash_near_dedup,
        op3_url_filters,
        op4_line_dedup,
        op5_media_columns,
        op6_mixing_sources_to_target_weights,
        op7_warc_revisits,
        op8_document_fingerprints,
        op9_best_fit_packing,
        op10_token_counts,
        op11_conversation_repair,
        op12_hard_negatives,
        op13_exact_top_k,
    )
}

_OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n
    FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_OP6_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
k AS (SELECT *, md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS key FROM d),
src AS (
  SELECT s, sum(size)::BIGINT AS total, CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM k GROUP BY s),
o AS (
  SELECT *, total * 2 AS cap, row_number() OVER (ORDER BY total * 2 / weight, s) AS place FROM src),
lev AS (
  SELECT *, (SELECT sum(total) FROM src)::BIGINT * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words,
    ((SELECT sum(weight) FROM src)
      - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_weight
  FROM o),
best AS (SELECT place, words, left_weight FROM lev WHERE words * weight <= cap * left_weight ORDER BY place LIMIT 1),
tgt AS (
  SELECT o.s, o.total, CASE WHEN b.place IS NULL OR o.place < b.place THEN o.cap::DOUBLE
    ELSE b.words * o.weight / b.left_weight END AS target
  FROM o LEFT JOIN best b ON true),
rep AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole FROM tgt),
keys AS (SELECT s, key, sum(size)::BIGINT AS n FROM k GROUP BY s, key),
run AS (
  SELECT s, key, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keys),
pick AS (
  SELECT run.s, run.key, run.before + run.n / 2 <= rep.target - rep.whole * rep.total AND rep.target > rep.whole * rep.total AS more
  FROM run JOIN rep ON rep.s = run.s)
SELECT k.doc_id, k.size, rep.total AS source_size, rep.target,
  k.size * (rep.whole + CASE WHEN pick.more THEN 1 ELSE 0 END) AS taken
FROM k JOIN rep ON rep.s = k.s JOIN pick ON pick.s = k.s AND pick.key = k.key
"""

_OP3_SQL = """
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, host, path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
m AS (
  SELECT u.*, (SELECT max_by({'rule': r.rule, 'verdict': r.verdict}, length(r.host) * 1000 + length(r.path)) FROM r
    WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS f
  FROM u)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM m
"""

_OP7_SQL = """
WITH p AS (
  SELECT page_id AS record_id, page_id % 3 = 2 AS revisit, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * page_id AS captured,
    regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^?#]*?)(?:\\.html|/)?(?:[?#]|$)', 1) AS path,
    CASE WHEN page_id % 7 = 5 THEN '2' ELSE '1' END AS version, page_id % 7 <> 6 AS tagged,
    md5(html) AS digest, strlen(html)::BIGINT AS bytes
  FROM pages),
r AS (
  SELECT *, CASE WHEN tagged THEN '"' || md5(path || version) || '"' END AS etag, '2024-01-0' || version AS modified FROM p),
b AS (
  SELECT r.*, f.record_id AS base_id, f.etag AS b_etag, f.modified AS b_modified, f.digest AS b_digest, f.bytes AS b_bytes
  FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE NOT revisit) f ON r.path = f.path AND r.record_id > f.record_id),
v AS (
  SELECT *, CASE WHEN NOT revisit THEN NULL WHEN base_id IS NULL THEN 'none'
      WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'etag' ELSE 'mismatch' END
      WHEN modified = b_modified THEN 'last-modified' ELSE 'mismatch' END AS validation
  FROM b),
t AS (SELECT *, revisit AND validation IN ('etag', 'last-modified') AS take FROM v)
SELECT record_id, 'https://www.' || path || '#' || record_id AS url, captured,
  CASE WHEN revisit AND NOT take THEN 304 ELSE 200 END AS status,
  CASE WHEN revisit THEN base_id END AS base_id, validation, (NOT revisit OR take) AS resolved,
  concat_ws(';', 'content-length=' || CASE WHEN take THEN b_bytes WHEN revisit THEN 0 ELSE bytes END,
    'etag=' || CASE WHEN take THEN coalesce(etag, b_etag) ELSE etag END,
    'last-modified=' || modified, 'x-page=' || record_id) AS headers,
  CASE WHEN take THEN b_digest WHEN NOT revisit THEN digest END AS payload_digest,
  CASE WHEN take THEN b_bytes WHEN NOT revisit THEN bytes END AS payload_bytes
FROM t
"""

_OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda d, e: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END))) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(x)),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
    left(role, 1) AS ini
  FROM d),
r AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM n),
g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
v AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS v0, {'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']} AS v1,
    {'c': 5, 'a': 'I', 'l': ['assistant:']} AS v2, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS v3
  FROM g
  UNION ALL
  SELECT conv_id, i, least(b0, {'c': u.c + 5, 'a': 'I' || u.a, 'l': ['user:'] || u.l}), least(b1, {'c': u.c + 5, 'a': 'I' || u.a, 'l': ['user:'] || u.l}),
    u, least(b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 'l': ['user:'] || b2.l})
  FROM (
    SELECT *, least(b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 'l': ['assistant:'] || b3.l}) AS u
    FROM (
      SELECT conv_id, i,
        least({'c': v0.c + 2, 'a': 'D' || v0.a, 'l': v0.l}, k1, ku, ru) AS b0, least({'c': v1.c + 2, 'a': 'D' || v1.a, 'l': v1.l}, ku, ru) AS b1,
        least({'c': v2.c + 2, 'a': 'D' || v2.a, 'l': v2.l}, ka, ra) AS b2, least({'c': v3.c + 2, 'a': 'D' || v3.a, 'l': v3.l}, ku, ru) AS b3
      FROM (
        SELECT v.conv_id, v.i - 1 AS i, v0, v1, v2, v3,
          {'c': v1.c + more + CASE WHEN ini = 's' THEN 0 ELSE 1000000 END, 'a': 'K' || v1.a, 'l': [r.role || ':' || r.text] || v1.l} AS k1,
          {'c': v2.c + more + CASE WHEN ini = 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || v2.a, 'l': [r.role || ':' || r.text] || v2.l} AS ku,
          {'c': v3.c + more + CASE WHEN ini = 'a' THEN 0 ELSE 1000000 END, 'a': 'K' || v3.a, 'l': [r.role || ':' || r.text] || v3.l} AS ka,
          {'c': v2.c + more + 1, 'a': 'R' || v2.a, 'l': ['user:' || r.text] || v2.l} AS ru,
          {'c': v3.c + more + 1, 'a': 'R' || v3.a, 'l': ['assistant:' || r.text] || v3.l} AS ra
        FROM v JOIN (SELECT *, CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS more FROM r) r
          ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i))))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM v WHERE i = 0) f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_VECTORS_SQL = """
v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_OP12_SQL = f"""
WITH {_VECTORS_SQL},
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND a.label IS NOT NULL AND c.label IS NOT NULL),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER o AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER o <= 5
"""

_OP13_SQL = f"""
WITH {_VECTORS_SQL},
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER o AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER o <= 5
"""

SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _OP2_SQL,
    "op3_url_filters": _OP3_SQL,
    "op7_warc_revisits": _OP7_SQL,
    "op11_conversation_repair": _OP11_SQL,
    "op12_hard_negatives": _OP12_SQL,
    "op13_exact_top_k": _OP13_SQL,
    "op6_mixing_sources_to_target_weights": _OP6_SQL,
}

"""Registered queries of this package, one per operator, and their check SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    decontaminate, exact_dedup, hard_negatives, language_model, lexical_search, line_dedup, mixing, quality, sharding, simhash, suffix_dedup,
    token_counts, warc,
)
from fleetlens.llm.common import table


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    stripped = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return stripped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return language_model.log_scores(table(spark, folder, "documents"), held_out)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in [
    op1_decontamination, op2_quality, op3_exact_dedup, op4_warc, op5_simhash, op6_line_dedup, op7_suffix_dedup, op8_mixing,
    op9_token_counts, op10_sharding, op11_language_model, op12_hard_negatives, op13_lexical_search,
]}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op6_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count_if(first_id IS NOT NULL AND doc_id <> first_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_id IS NULL OR doc_id = first_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(weight) OVER after AS shares
  FROM s WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (
  SELECT CAST(rest AS BIGINT) AS rest, CAST(shares AS BIGINT) AS shares FROM o WHERE 3 * source_size * shares > weight * rest
  ORDER BY source_size / weight, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size * shares <= weight * rest THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(rest AS DOUBLE) * weight / shares END AS target FROM s, l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota, greatest(source_size, 1) AS one FROM t)
SELECT doc_id, size, q.source, source_size, target,
  quota // one * size + least(greatest(quota % one - coalesce(sum(size) OVER w, 0), 0), size) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
WINDOW w AS (PARTITION BY d.source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "op10_sharding": r"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS bits
  FROM documents),
s AS (
  SELECT depth, bits >> (48 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes
  FROM d, (SELECT unnest(range(0, 49)) AS depth) GROUP BY ALL),
f AS (
  SELECT doc_id, n_bytes, bits, min(s.depth) AS depth FROM d, s
  WHERE bits >> (48 - s.depth) = prefix AND (shard_bytes <= 16777216 OR s.depth = 48) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE substr(lpad(bin(bits), 48, '0'), 1, CAST(f.depth AS INTEGER)) END AS shard,
  f.depth, shard_bytes, shard_bytes > 16777216 AS oversized
FROM f JOIN s ON f.depth = s.depth AND f.bits >> (48 - f.depth) = s.prefix""",
    "op12_hard_negatives": r"""
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, uid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_lexical_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY ALL),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT doc_id, 10 + (90 * n * docs) // total AS m FROM n, g),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER v AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW v AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER v <= 10""",
}

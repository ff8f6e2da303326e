"""Queries over whole tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, context_tree, hard_negatives, imatch, near_dup, packing, pii, quality, segment, sharding, suffix, toxicity, warc
from .common import documents, shared_folder

#: A public byte-fallback model that the box offers; any SentencePiece file of that kind does.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op2_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def _segments(spark: SparkSession, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Three segmentations of every row, decoded again."""
    vocabulary = segment.load_vocabulary(spark.conf.get(segment.SETTING, TOKENIZER))
    drawn = segment.sample_segmentations(rows, vocabulary, key=key, decoded=True)
    return drawn.select(*key, "rank", "ids", F.size("ids").alias("n_pieces"), "log_probability", "perturbed", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, documents(spark, sf_dir), ("doc_id",))


def op4_gumbel_segments_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), ("conv_id", "turn"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(documents(spark, sf_dir))


def op7_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.load_in_arrivals(documents(spark, sf_dir), shared_folder(spark))
    return table.read().select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 50 == 0)


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scores(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_pii_boosted": op2_pii_boosted,
    "op3_order_minhash": op3_order_minhash,
    "op4_gumbel_segments": op4_gumbel_segments,
    "op4_gumbel_segments_turns": op4_gumbel_segments_turns,
    "op5_quality_cascade": op5_quality_cascade,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_ngram_toxicity": op7_ngram_toxicity,
    "op8_tiered_shards": op8_tiered_shards,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_imatch_fingerprints": op10_imatch_fingerprints,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_context_tree": op13_context_tree,
}

_OP1 = r"""
WITH p AS (
  SELECT page_id AS p, url, sha256(html) AS digest, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS front,
         '"' || substr(sha256(url || 'a'), 1, 16) || '"' AS tag_a, '"' || substr(sha256(url || 'b'), 1, 16) || '"' AS tag_b,
         cast((page_id * 7919) % 365 AS varchar) AS day
  FROM pages),
records AS (
  SELECT p * 4 AS record_id, 'response' AS kind, url, (p * 7919) % 31536000 AS ts, 200 AS status, digest,
         ['content-type: text/html; charset=utf-8', 'etag: ' || tag_a, 'last-modified: day ' || day, 'server: a', 'date: day ' || (p * 31) % 365] AS head, tag_a AS tag, 'day ' || day AS modified FROM p
  UNION ALL
  SELECT p * 4 + 1, 'revisit', regexp_replace(url, '#.*$', '') || '#again', (p * 7919) % 31536000 + 60 + p % 7 * 86400, 304, NULL,
         ['etag: ' || tag_a, 'date: day ' || (p * 31 + 1) % 365], tag_a, NULL FROM p
  UNION ALL
  SELECT p * 4 + 2, 'revisit', regexp_replace(url, '^https?://', 'HTTP://WWW.'), (p * 7919) % 31536000 + 5000 - p % 9 * 1000, 304, CASE WHEN p % 8 = 3 THEN digest END,
         list_filter([CASE p % 4 WHEN 0 THEN 'etag: W/' || tag_a WHEN 1 THEN 'etag: ' || tag_b WHEN 2 THEN 'last-modified: day ' || day END, 'cache-control: max-age=60', 'server: b', 'date: day ' || (p * 31 + 2) % 365], lambda x: x IS NOT NULL),
         CASE p % 4 WHEN 0 THEN tag_a WHEN 1 THEN tag_b END, CASE p % 4 WHEN 2 THEN 'day ' || day END FROM p
  UNION ALL
  SELECT p * 4 + 3, CASE WHEN p % 16 = 0 THEN 'response' ELSE 'revisit' END, front || '/', (p * 104729) % 31536000, CASE WHEN p % 16 = 0 THEN 200 ELSE 304 END, CASE WHEN p % 16 = 0 THEN digest END,
         ['etag: "f' || p % 5 || '"', 'vary: accept', 'x-page: ' || p, 'date: day ' || (p * 31 + 3) % 365], '"f' || p % 5 || '"', NULL FROM p),
parts AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS whole FROM records),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(whole, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www[0-9]*\.', '')
         || regexp_replace(regexp_extract(whole, '^[^/?]*//[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(whole, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-zA-Z]+|gclid|fbclid|sessionid|ref)=', 'i'))) AS query FROM parts) t),
full_ AS (SELECT key, ts, record_id, head, digest, tag, modified FROM keyed WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY record_id DESC) = 1),
met AS (
  SELECT r.record_id, r.key, f.record_id AS base_id, r.head AS own, f.head AS stored, f.digest,
         CASE WHEN f.record_id IS NULL THEN 'no_response'
              WHEN r.tag IS NOT NULL AND f.tag IS NOT NULL THEN CASE WHEN r.tag = f.tag THEN 'resolved' ELSE 'validator_mismatch' END
              WHEN r.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN r.modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END
              WHEN r.digest IS NOT NULL AND f.digest IS NOT NULL THEN CASE WHEN r.digest = f.digest THEN 'resolved' ELSE 'validator_mismatch' END
              ELSE 'unvalidated' END AS outcome
  FROM (SELECT * FROM keyed WHERE kind = 'revisit') r ASOF LEFT JOIN full_ f ON r.key = f.key AND r.ts > f.ts),
fresh AS (
  SELECT *, list_filter(own, lambda x: split_part(x, ':', 1) IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')) AS new FROM met)
SELECT record_id, key AS canonical_url, base_id, outcome,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN array_to_string(list_sort(list_concat(list_filter(stored, lambda s: NOT list_contains(list_transform(new, lambda n: split_part(n, ':', 1)), split_part(s, ':', 1))), new)), chr(10)) END AS merged_headers,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN digest END AS payload_digest
FROM fresh
"""

_OP8 = """
SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""

_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i, k FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) ks),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM spread WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, cast(2000000::hugeint * c.a // (l.a + r.a) AS bigint) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') AND l.k = cut
       JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ') AND r.k = c.k - cut
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
gone AS (
  SELECT s.lang, s.phrase FROM c s JOIN (SELECT lang, array_to_string(w[x:x + y - 1], ' ') AS part, a FROM c, (SELECT unnest([1, 2, 3]) AS x) xs, (SELECT unnest([2, 3]) AS y) ys WHERE y < k AND x + y - 1 <= k) g
  ON g.lang = s.lang AND g.part = s.phrase WHERE 100 * g.a >= 80 * s.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, cast(n AS bigint) AS n, score
FROM scored s JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = s.lang AND g.phrase = s.phrase)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER w <= 2000
"""

_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_dot_product(a.e, b.e) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER w AS integer) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""

ORACLES: dict[str, str] = {"op1_warc_revisits": _OP1, "op8_tiered_shards": _OP8, "op11_collocations": _OP11, "op12_hard_negatives": _OP12}

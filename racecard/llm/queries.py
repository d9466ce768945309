"""One query per operator: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from racecard.llm import (
    bpe, hard_negatives, langid, neardup, packing, pii, quality_gam, quality_rules, resampling, secrets,
    sentence_pieces, simhash, toxicity,
)
from racecard.llm.registry import query, table


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return bpe.byte_pair_digest(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "score")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query("op8_personal_data")
def op8_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_simhash_fingerprints")
def op10_simhash_fingerprints(spark, sf_dir):
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"))


#: The SQL computes every score; it needs vectors without a segment's shortcut.
HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(moved, anchors=F.col("id") % 100 == 0)


#: Bytes of a word by its hexadecimal digits; the checksum by its table of 256 values.
RESAMPLING_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) t(i))),
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
found AS (
  SELECT side, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
each AS (SELECT side, doc_id, unnest(words) AS word FROM found),
buckets AS (
  SELECT word, xor(list_reduce(
      list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM each), crc),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM each JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weighed AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM each JOIN buckets USING (word) JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM found LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
ranked AS (
  SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (n >= 20) OVER () AS eligible
  FROM scored)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= eligible * 10 // 100 THEN place END AS rank
FROM ranked
"""


@query("op12_target_resampling", RESAMPLING_SQL)
def op12_target_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark, sf_dir):
    encoded = sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents"),
                                                public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.digests(encoded)

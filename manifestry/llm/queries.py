"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, centroids, html_crf, langid, media, minhash, mixing, pairwise, ppm, pseudonym, quality_rules, simhash
from .common import read

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Key of the queries over the public test tables; a deployment sets pseudonym.KEY_SETTING instead.
TABLE_KEY = "public test tables"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def rank_file(name: str = RANKS) -> tuple[str, str]:
    """Path of a rank file and the pattern that splits texts, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read(spark, sf_dir, "documents"), *rank_file())


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature``: codec, timescale, duration, samples, keyframes, and a digest of the keyframes' byte ranges, which
    stand in columns of their own as well."""
    seen = media.describe(media.store(read(spark, sf_dir, "documents")))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["size"])), ",")
    feature = F.concat_ws("|", F.trim("codec"), "timescale", "duration", "samples", F.size("keyframes"), F.md5(ranges))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "timescale", "duration", "samples", "keyframes")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pairwise.score_documents(docs, pairwise.fit(docs, read(spark, sf_dir, "labels")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages"), html_crf.trained())


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def table_key(spark: SparkSession) -> str:
    return spark.conf.get(pseudonym.KEY_SETTING, None) or TABLE_KEY


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key=table_key(spark), found="n_replaced")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.sort_means(read(spark, sf_dir, "embeddings"))


def op12_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edits(read(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_simhash_dedup, op3_byte_bpe, op4_media_columns, op5_quality_classifier, op6_html_extraction, op7_source_mixing, op8_pii_pseudonyms, op9_language_id, op10_lm_scoring, op11_centroid_clusters, op12_minhash_fingerprints, op13_filter_interactions, pipeline)
    return {f.__name__: f for f in ops}


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(docs.doc_id > first_id, false)] AS f
  FROM docs JOIN first USING (t) LEFT JOIN marked ON marked.doc_id = docs.doc_id
), kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(f, lambda x: x)) AS fails FROM failing GROUP BY part, f
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM letter a, letter b, letter d, letter e, letter g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
), steps AS (SELECT filter_order, step, filter_order[step] AS letter, ascii(filter_order[step]) - 64 AS k FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), asked AS (
  SELECT kinds.*, steps.*, f[k] AS fails_here, len(list_filter([1, 2, 3, 4, 5], lambda i: i < step AND f[ascii(filter_order[i]) - 64])) > 0 AS gone FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT fails_here AND NOT gone) AS kept, sum(n) FILTER (fails_here AND NOT gone) AS removed,
    sum(n) FILTER (fails_here AND gone) AS redundant, sum(n) FILTER (fails_here AND fails = 1) AS unique_fails,
    sum(good) FILTER (fails_here AND NOT gone) AS good_lost, sum(toxic) FILTER (fails_here AND NOT gone) AS toxic_lost
  FROM asked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    """The audit alone: models, keyed networks, XXH64 and BPE have no SQL form, nor has clustering whose start follows
    from digests of ids in rounds; tests hold these against brute force."""
    return {"op13_filter_interactions": OP13_SQL}

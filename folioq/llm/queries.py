"""The queries of this package, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, matroska, mixing, packing, pii, quality, secrets, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model)


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_pii_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op5_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = ann.build_index(_table(spark, sf_dir, "embeddings"))
    return ann.search(index, books, F.col("vec_id") % 20 == 0)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(_table(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity.categories(_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, chain)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_quality_ordinal,
        op3_pack_best_fit,
        op4_pii_deobfuscated,
        op5_shard_lpt,
        op6_simhash_near_dedup,
        op7_secret_scan,
        op8_additive_quantisation,
        op9_matroska,
        op10_toxicity_chain,
    )
}

#: The mix in SQL: the same hash, the same nested thresholds, written as running sums over all documents.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 2 * source_size AS most,
         CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM r WINDOW f AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT r.*, least(CAST(most AS DOUBLE), w * (SELECT level FROM l WHERE level * w <= most ORDER BY most / w, source LIMIT 1)) AS target FROM r),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
c AS (SELECT source, h, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, h),
u AS (SELECT c.source, h, size, target - repeats * source_size AS budget, sum(size) OVER (PARTITION BY c.source ORDER BY h) AS upto
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, h + CASE WHEN 2 * (budget - (upto - size)) >= size THEN 1 ELSE 0 END AS threshold
  FROM u WHERE budget > 0 AND upto >= budget AND upto - size < budget)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.repeats + CASE WHEN d.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": MIX_SQL}

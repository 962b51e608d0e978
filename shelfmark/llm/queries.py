"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, licenses, line_dedup, media, merkle, mixing, negatives, pii, sharding, simhash, toxicity
from .common import OWN, crc_of_id, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "pages"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.of_texts(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", F.col(f"{OWN}size").alias("size"), F.col(f"{OWN}source_size").alias("source_size"), F.col(f"{OWN}target").alias("target"), (F.col(f"{OWN}copies") * F.col(f"{OWN}size")).alias("taken"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.with_slots(sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    names = {"size": "size", "text_crc32": "crc", "shard": "shard", "slot": "slot", "grown_shard": "grown"}
    return placed.select("doc_id", F.lit("key").alias("law"), *[F.col(OWN + own).alias(name) for name, own in names.items()])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.of_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", label, "embedding")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    content = bpe.read(public_tokenizers.path("byte_bpe_50k.json"))
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), content).drop("text")
    back = bpe.decode(ids, content)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media": op2_media,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe": op13_bpe,
}

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 3 AS cap FROM s
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), f AS (
  SELECT *, CAST(cap AS DOUBLE) * rest <= CAST(w AS DOUBLE) * (total - before) AS is_full FROM o
), g AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS spent, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS open_w FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * (total - spent) / open_w END AS target FROM g
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 4294967296) AS BIGINT) ELSE 0 END AS units,
         CAST('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 8) AS BIGINT) AS start FROM t
), r AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.units, u.start,
         sum(CAST(u.units AS HUGEINT)) OVER (PARTITION BY u.source ORDER BY length(bin(d.size)) * 16 + (d.size >> greatest(length(bin(d.size)) - 4, 0)), md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.digest) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(3, (upto + start) // 4294967296 - (upto + start - units) // 4294967296) AS BIGINT) * size AS taken
FROM r
"""

_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.oracle(), "op3_mixing": _MIX_SQL, "op12_hard_negatives": _NEGATIVES_SQL}

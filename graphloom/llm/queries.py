"""Registered queries of the subpackage with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.abuse import THRESHOLD, fit_abuse, score_abuse
from graphloom.llm.leaks import leaked_items, matched_windows, reparameterised
from graphloom.llm.mix import mix_sources, normal_source, reached_shares
from graphloom.llm.similar import most_similar, similar_pairs
from graphloom.llm.split import split_oversized
from graphloom.sources import read


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).select("entity_id", "chunk_index").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(read(spark, sf, "code_chunk"), "text", ["entity_id", "chunk_index"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(read(spark, sf, "code_embedding"), "id", "vector", "model_id", dim=64, k=5, least=0.9)


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = most_similar(read(spark, sf, "code_embedding"), "id", "vector", "model_id", dim=64, k=5)
    return near.select(F.col("model").alias("model_id"), "id", "neighbour_id", "rank", F.round("similarity", 6).alias("similarity"))


def _eval_windows(spark: SparkSession, sf: str) -> DataFrame:
    return matched_windows(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_eval_windows(spark, sf))


def p7_templates(spark: SparkSession, sf: str) -> DataFrame:
    return reparameterised(_eval_windows(spark, sf))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(read(spark, sf, "documents"), "doc_id", "text", "source", read(spark, sf, "mix_target"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reached_shares(p8_mix(spark, sf), read(spark, sf, "documents"), "source", read(spark, sf, "mix_target"))


def p8_shares_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets = read(spark, sf, "documents"), read(spark, sf, "mix_target")
    return reached_shares(mix_sources(docs, "doc_id", "text", "source", targets, shortfall="shrink"), docs, "source", targets)


def _scores(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    docs = read(spark, sf, "documents").withColumn("source", normal_source(F.col("source")))
    return score_abuse(docs, "doc_id", "text", fit_abuse(docs, "doc_id", "text", read(spark, sf, "safety_label"), "is_abusive"), keep)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scores(spark, sf, ("source",))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("score") >= THRESHOLD, 1)).alias("n_abusive"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p4_found, p4_neighbours, p7_found, p7_templates, p8_mix, p8_shares, p8_shares_exact, p9_found, p9_scores, p9_rates)}

_SOLID = "regexp_replace(text, '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')"

_NEAR = """WITH v AS (SELECT model_id, id, any_value(CAST(vector AS DOUBLE[])) AS x FROM code_embedding
  WHERE len(vector) = 64 AND id IS NOT NULL AND model_id IS NOT NULL AND len(list_filter(vector, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY ALL),
 p AS (SELECT a.model_id, a.id, b.id AS neighbour_id, CASE WHEN a.x = b.x THEN 1.0 ELSE list_cosine_similarity(a.x, b.x) END AS s FROM v a JOIN v b ON a.model_id = b.model_id AND a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY model_id, id ORDER BY s DESC, neighbour_id) AS rank FROM p)"""

ORACLES = {
    "p1_found": f"SELECT DISTINCT entity_id, chunk_index FROM code_chunk WHERE length({_SOLID}) > 1500",
    "p4_found": f"{_NEAR} SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM r WHERE rank <= 5 AND s >= 0.9",
    "p4_neighbours": f"{_NEAR} SELECT model_id, id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity FROM r WHERE rank <= 5",
}

"""Packing ranked nodes into a token budget, for any number of requests at once (column query_id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: stands where a fragment has no provenance to cite.
NO_PROVENANCE = "provenance non disponibile"


@dataclass(frozen=True)
class Budget:
    """Tokens in all, their shares, and which nodes may give their whole source. The share of summaries is reserved."""

    total: int = 8000
    definitions: float = 0.4
    relations: float = 0.2
    summaries: float = 0.2
    source: float = 0.2
    source_top_k: int = 4
    source_threshold: float = 0.5


def byte_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def citation(repo: Column, path: Column, start: Column, end: Column, commit: Column) -> Column:
    """repo/path:start-end@commit, or the placeholder where path is empty or null, or commit is null."""
    return F.when(F.coalesce(path != "", F.lit(False)) & commit.isNotNull(), F.format_string("%s/%s:%d-%d@%s", F.coalesce(repo, F.lit("")), path, F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(0)), commit)).otherwise(NO_PROVENANCE)


def deduplicated(ranked: DataFrame) -> DataFrame:
    """One row per node and request, that of the highest final_score (first input_pos on ties), with score_pos and u_pos.

    u_pos: the best node first, the second last, the third second and so on, so that good ones stand at both ends.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.desc("final_score"), "input_pos"))
    rows = ranked.withColumn("r", best).where("r = 1").drop("r")
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "input_pos", "node_id")
    rows = rows.withColumn("score_pos", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    half = F.floor(F.col("score_pos") / 2).cast("int")
    return rows.withColumn("u_pos", F.when(F.col("score_pos") % 2 == 0, half).otherwise((F.col("n") - 1).cast("int") - half)).drop("n")


def _fitting(rows: DataFrame, section: str, text: Column, quota: int, best_always: bool) -> DataFrame:
    """Fragments in order of score until the first that would pass the quota."""
    rows = rows.withColumn("text", text).withColumn("tokens", byte_tokens(F.col("text")) + byte_tokens(F.col("citation")))
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("score_pos").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("used") <= quota
    if best_always:
        fits = fits | (F.col("score_pos") == 0)
    kept = rows.withColumn("used", used).where(fits)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("u_pos")) - 1
    return kept.select("query_id", F.lit(section).alias("section"), place.alias("pos"), "node_id", "text", "citation", "tokens")


def pack(ranked: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """query_id, section, pos, node_id, text, citation, tokens: definitions, relations and full sources within their quotas.

    ranked: query_id, node_id, name, hop, impact_norm, final_score, input_pos, source_text, citation; null texts count
    as empty. A section takes fragments by score and stops at the first that doesn't fit; definitions always have the
    best node. Full source is for nodes of hop 0 or impact above the threshold, the first source_top_k of them. Within
    a section fragments stand in U order.
    """
    filled = ranked.withColumn("source_text", F.coalesce("source_text", F.lit(""))).withColumn("name", F.coalesce("name", F.lit("")))
    rows = deduplicated(filled)
    line = F.substring_index("source_text", "\n", 1)
    definition = F.when(line == "", F.col("name")).otherwise(F.concat(F.col("name"), F.lit(": "), line))
    relation = F.when(F.col("hop").isNull(), F.col("name")).otherwise(F.format_string("%s (hop %d)", F.col("name"), F.col("hop").cast("int")))
    eligible = rows.where((F.col("hop") == 0) | (F.col("impact_norm") > budget.source_threshold))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("score_pos"))
    eligible = eligible.withColumn("e", first).where(F.col("e") <= budget.source_top_k).drop("e")
    return (
        _fitting(rows, "definitions", definition, int(budget.total * budget.definitions), True)
        .unionByName(_fitting(rows, "relations", relation, int(budget.total * budget.relations), False))
        .unionByName(_fitting(eligible, "full_source", F.col("source_text"), int(budget.total * budget.source), False))
    )

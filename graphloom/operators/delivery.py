"""At-least-once delivery: one copy of each message.

The copies of a message are folded with min_by over a struct of position, tie-breaks and a digest of the row, so the
fold has one answer whatever repeats. Spark merges such folds on the map side: an id that holds a third of all rows
reaches the shuffle as one row per map task. deduplicate folds whole rows in one shuffle; surplus_deliveries only
moves ids and those structs, which are spread evenly however often an id repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_uuid


def _known(messages: DataFrame, id_col: str, position: str) -> DataFrame:
    return messages.where(F.col(id_col).rlike(r"[^\p{IsWhite_Space}]") & F.col(position).isNotNull())


def _order(messages: DataFrame, position: str, tie: tuple[str, ...]) -> Column:
    """The order of deliveries: position, tie columns, and a digest of the whole row, in which only equal rows agree."""
    plain = (F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in messages.dtypes)
    return F.struct(F.col(position).alias("at"), *(F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)), F.xxhash64(*plain).alias("digest"))


def first_deliveries(messages: DataFrame, id_col: str, position: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Columns message_id and first_position: of each message, the lowest position.

    Deliveries with a null or blank id or without position are no messages and are left out. An empty input gives no
    rows.
    """
    return _firsts(messages, id_col, position, tie).select("message_id", F.col("first.at").alias("first_position"))


def _firsts(messages: DataFrame, id_col: str, position: str, tie: tuple[str, ...]) -> DataFrame:
    known = _known(messages, id_col, position)
    return known.groupBy(canonical_uuid(F.col(id_col)).alias("message_id")).agg(F.min(_order(messages, position, tie)).alias("first"))


def deduplicate(messages: DataFrame, id_col: str, position: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """One row of each message, its first delivery, all columns kept.

    On equal positions the tie columns decide, in order, nulls first; on equal ties a digest of the row. Deliveries
    without id or position are left out.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in messages.columns))
    folded = _known(messages, id_col, position).groupBy(canonical_uuid(F.col(id_col))).agg(F.min_by(row, _order(messages, position, tie)).alias("kept_row"))
    return folded.select("kept_row.*")


def surplus_deliveries(messages: DataFrame, id_col: str, position: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """The positions of all deliveries but the one that deduplicate keeps; rows without id are neither kept nor surplus.

    A position comes out as often as it is surplus: of n equal rows that are the first delivery, n - 1 times.
    """
    known = _known(messages, id_col, position)
    # deliveries are counted by their place in the order, which the hottest id shares with none but equal rows
    placed = known.groupBy(_order(messages, position, tie).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    kept = _firsts(messages, id_col, position, tie).select(F.col("first").alias("place"), F.lit(1).alias("keep"))
    left = placed.join(kept, "place", "left").withColumn("n_surplus", F.col("n") - F.coalesce("keep", F.lit(0))).where("n_surplus > 0")
    return left.select(F.explode(F.array_repeat("place.at", F.col("n_surplus").cast("int"))).alias(position))

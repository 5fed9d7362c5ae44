"""A feed of inserts, updates and deletes, folded into the current state.

The fold is the maximum of a struct (sequence, operation, payload) per key. Maxima commute and absorb repeats, so
order of arrival and repeated delivery do not matter, and Spark folds on the map side before it shuffles. Base rows
take part as upserts; a key whose maximum is a delete stays as a tombstone, so that a late change cannot revive it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean_label

UPSERT, DELETE = "UPSERT", "DELETE"
#: Name of the folded struct, which no column of the data should have.
CHANGE = "__change"


def fold_changes(changes: DataFrame, key: str, sequence: list[str], operation: str, payload: list[str], base: DataFrame | None = None) -> DataFrame:
    """One row per key: key, the sequence columns, is_deleted and the payload columns of its last change.

    operation is read without regard to case and surrounding white space; rows with another operation than UPSERT
    or DELETE, and rows without key, are no changes. base holds an earlier result of this function (or rows
    without is_deleted, which count as upserts). Null sequence values sort before all others; on equal sequence a
    delete wins, then the larger payload, a null one being the smallest.
    """
    label = clean_label(F.col(operation))
    rank = F.when(label == UPSERT, 0).when(label == DELETE, 1)
    rows = changes.where(F.col(key).isNotNull() & label.isin(UPSERT, DELETE)).select(key, _change(sequence, rank, payload))
    if base is not None:
        deleted = F.coalesce(F.col("is_deleted").cast("int"), F.lit(0)) if "is_deleted" in base.columns else F.lit(0)
        rows = rows.unionByName(base.where(F.col(key).isNotNull()).select(key, _change(sequence, deleted, payload)))
    last = rows.groupBy(key).agg(F.max(CHANGE).alias(CHANGE))
    fields = [F.col(CHANGE)[f"s{i}"].alias(c) for i, c in enumerate(sequence)]
    values = [F.col(CHANGE)[f"p{i}"].alias(c) for i, c in enumerate(payload)]
    return last.select(key, *fields, (F.col(CHANGE)["op"] == 1).alias("is_deleted"), *values)


def _change(sequence: list[str], rank: Column, payload: list[str]) -> Column:
    return F.struct(
        *(F.col(c).alias(f"s{i}") for i, c in enumerate(sequence)),
        rank.cast("int").alias("op"),
        *(F.col(c).alias(f"p{i}") for i, c in enumerate(payload)),
    ).alias(CHANGE)


def current_state(folded: DataFrame) -> DataFrame:
    """The keys that exist after all changes, tombstones left out."""
    return folded.where(~F.col("is_deleted")).drop("is_deleted")

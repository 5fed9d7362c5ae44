"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key has at least 1/HOT_KEYS of the counted rows, so there are at most so many hot keys: the bound of what is broadcast.
HOT_KEYS = 1000
#: Keys with fewer rows than this are never called hot.
HOT_LEAST = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join of left with right, which has one row per key and in count the number of rows of left with that key.

    Rows of hot keys are joined in place by broadcast of at most HOT_KEYS rows, the others in a shuffled join that no
    longer sees the hot keys. right is used several times and should have been cut. The column count is kept.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(total / HOT_KEYS, HOT_LEAST)
    hot, cold = right.where(is_hot), right.where(~F.coalesce(is_hot, F.lit(False)))
    if hot.isEmpty():
        return left.join(cold, on)
    here = left.join(F.broadcast(hot), on)
    return here.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))

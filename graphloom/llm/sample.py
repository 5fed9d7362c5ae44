"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most n rows of df, of total rows: those whose key has the smallest hash.

    A hash filter keeps about 2n rows before the exact cut, so that what tasks send to the driver is bounded whatever
    their number.
    """
    if total > 2 * n:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(2 * n / total * (1 << 30)) + 1))
    return df.orderBy(F.xxhash64(key), key).limit(n)

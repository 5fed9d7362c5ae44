"""Deterministic stand-ins for models, for tests and offline runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 1536  # fixed value: the length of the stand-in's vectors


def digest_vector(text: str, dim: int = DIM) -> list[float]:
    """dim numbers in [-1, 1] from a chain of SHA-256 digests that starts at the text, four bytes each."""
    import hashlib
    import struct

    out: list[float] = []
    block = hashlib.sha256(text.encode()).digest()
    while len(out) < dim:
        out += [v / 0xFFFFFFFF * 2 - 1 for v in struct.unpack(">8I", block)]
        block = hashlib.sha256(block).digest()
    return out[:dim]


def embed(text: Column, dim: int = DIM) -> Column:
    """digest_vector of a column, null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else digest_vector(t, dim))

    return run(text)


def jittered_backoff(attempt: Column, base_s: float = 1.0, cap_s: float = 60.0) -> Column:
    """A delay in seconds between half of the capped doubled base and all of it, at random."""
    most = F.least(F.lit(base_s) * F.pow(F.lit(2.0), attempt), F.lit(cap_s))
    return most / 2 + most / 2 * F.rand()

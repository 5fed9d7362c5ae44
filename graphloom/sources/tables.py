"""Parquet tables of one directory, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_path(directory: str, name: str) -> str:
    return f"{directory}/{name}.parquet"


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table as stored; column pruning and filters are left to the scan. Its schema is read once per application."""
    path = table_path(directory, name)
    known = (spark.sparkContext.applicationId, path)
    if known in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[known]).parquet(path)
    found = spark.read.parquet(path)
    _SCHEMAS[known] = found.schema
    return found


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, removed at exit; others are refused.

    Checkpoints are deleted with their last reference if spark.cleaner.referenceTracking.cleanCheckpoints is set, as
    bench.py and the tests set it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as cut leaves it, and its number of rows, counted while it is computed."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return kept, seen.get["rows"]

"""Source files as tables, and results as files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.cdc import verify_source


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, source of the text files below path, one row each."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def fetched(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """expected (name, sha256, size) with status and source: files below path by name, verified; source only if verified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substring_index("path", "/", -1).alias("name"), "content")
    rows = expected.join(files, "name", "left")
    status = verify_source(F.col("content"), F.col("sha256"), F.col("size"))
    return rows.withColumn("status", status).withColumn("source", F.when(F.col("status") == "verified", F.col("content").cast("string"))).drop("content")


def write_json_lines(rows: list[dict], path: str) -> None:
    """A small local report, put in place at once by renaming a finished temporary file."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events, appended by day of recorded_at; nothing that is there is rewritten."""
    events.withColumn("day", F.to_date("recorded_at")).write.mode("append").partitionBy("day").json(path)

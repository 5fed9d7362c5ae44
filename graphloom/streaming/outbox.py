"""The outbox as a stream: deliveries folded into a state table, batch by batch.

The state lies in hash buckets of its keys. A batch reads the buckets that its changes touch, folds them in, and writes
these buckets anew into its own folder, with a note of which they are; the state is the newest version of each bucket.
So a batch costs what it touches, a repeated batch writes the same folder again and nothing is applied twice; the fold
itself absorbs repeated and late changes. Accepted rows also go to one folder per aggregate type, the others to a reject
folder with their outcome.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_uuid
from graphloom.operators.cdc import routed
from graphloom.operators.changes import fold_changes
from graphloom.sources.tables import ensure_checkpoint_dir, table_path

SEQUENCE, PAYLOAD = ["created_at", "tx_order"], ["event_id", "aggregate_type", "payload"]
#: Buckets of a state; fixed for its life. More of them let a batch touch less of a large state.
BUCKETS = 16


def outbox_stream(spark: SparkSession, directory: str, files_per_batch: int = 1) -> DataFrame:
    """The outbox table as a stream of its files, of a folder or the single file of that name."""
    path = table_path(directory, "outbox")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern that fits the path alone: streams take no single file otherwise


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def state_at(spark: SparkSession, target: str, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The state after the batch (default: the last one finished), of all buckets or some; None if there is none."""
    try:
        notes = spark.read.schema("bucket int, batch bigint").parquet(f"{target}/notes/*")
    except AnalysisException:  # no batch is finished
        return None
    notes = notes if batch is None else notes.where(F.col("batch") <= batch)
    notes = notes if buckets is None else notes.where(F.col("bucket").isin(buckets))
    newest = notes.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most BUCKETS rows
    return spark.read.parquet(*(f"{target}/state/batch={r['batch']}/bucket={r['bucket']}" for r in newest)) if newest else None


def apply_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Routes the batch and folds it into the state. Batches before it must be finished; batches without changes leave the state."""
    spark = batch.sparkSession
    rows = routed(batch.withColumn("event_id", canonical_uuid(F.col("id")))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good = F.col("outcome").isin("accepted", "bad_payload")
        rows.where(good).write.mode("overwrite").partitionBy("aggregate_type").parquet(f"{target}/routed/batch={batch_id}")
        rows.where(~good).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        bucket = _bucket(F.col("aggregate_id"))
        touched = [r[0] for r in rows.where("aggregate_id IS NOT NULL").select(bucket).distinct().collect()] if batch_id else None
        before = state_at(spark, target, batch_id - 1, touched) if batch_id else None
        path = f"{target}/state/batch={batch_id}"
        fold_changes(rows, "aggregate_id", SEQUENCE, "event_type", PAYLOAD, before).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # a bucket of which the batch had no valid change, and that had no state, was not written
        written = spark.read.schema("aggregate_id string, bucket int").parquet(path).select("bucket").distinct()
        written.select("bucket", F.lit(batch_id).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{target}/notes/batch={batch_id}")
    finally:
        rows.unpersist()


def run_outbox(spark: SparkSession, directory: str, target: str, files_per_batch: int = 1) -> DataFrame:
    """Everything there is, as micro-batches, until the stream is drained; the state with its tombstones."""
    stream = outbox_stream(spark, directory, files_per_batch).writeStream.foreachBatch(lambda df, n: apply_batch(df, n, target)).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    return state_at(spark, target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def deduplicated_stream(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """One row per message id; rows without aggregate_id or id fall out.

    Without a delay all ids are remembered and no message is lost, however late. With a delay of event time only ids of
    that time are: the memory is bounded, but rows that come later than it behind the newest are dropped, first
    deliveries among them.
    """
    rows = stream.where("aggregate_id IS NOT NULL AND id IS NOT NULL").withColumn("message_id", canonical_uuid(F.col("id")))
    return rows.dropDuplicates(["message_id"]) if delay is None else rows.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["message_id"])

"""References to records that do not exist.

Parent keys and referenced keys are range-partitioned and sorted together, which turns each key into an integer: its
dense rank in that order. Parent ranks without a foreign rank between them are compressed into contiguous runs; each
referenced rank is matched as of the run that starts at or before it, and lies beyond that run's end exactly if the
key is no parent. Two keys get one rank only if they are equal character by character.

References are folded to distinct keys before they are shuffled, so a key that holds a third of all references is one
row here. Suspect keys then meet their references again in a join that takes hot keys aside.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import join_counted
from graphloom.sources.tables import cut

SUSPECTS = "ref_key string, reason string, valid_from timestamp, n_refs bigint"


def suspect_keys(parents: DataFrame, ref_keys: DataFrame) -> DataFrame:
    """Referenced keys that are missing, deleted, or valid only after a reference to them was made.

    parents: key, deleted boolean, valid_from timestamp, one row per key. ref_keys: key, first_ref timestamp, n_refs
    bigint, one row per key. Null keys must have been left out. Result: SUSPECTS, with reason missing, deleted or
    late; a late key may have other references that are in order.
    """
    rows = parents.select("key", F.lit(0).alias("kind"), "deleted", "valid_from", F.lit(None).cast("timestamp").alias("first_ref"), F.lit(None).cast("bigint").alias("n_refs")).unionByName(
        ref_keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("deleted"), F.lit(None).cast("timestamp").alias("valid_from"), "first_ref", "n_refs")
    )
    return rows.repartitionByRange("key").sortWithinPartitions("key", "kind").mapInArrow(_match_runs, SUSPECTS)


def _match_runs(batches: Iterator) -> Iterator:
    """Over rows sorted by (key, kind): ranks, runs of parents, as-of match of references. State between batches: the last key, its rank and the open run."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last_key, last_rank, run_start, run_end = None, -1, -1, -2
    end_deleted, end_from = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key")
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        new = np.empty(len(key), dtype=bool)
        new[0] = last_key is None or key[0].as_py() != last_key
        if len(key) > 1:
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        rank = last_rank + np.cumsum(new)

        at = np.flatnonzero(kind == 0)
        parent_rank = np.concatenate([[run_end], rank[at]]) if run_end >= 0 else rank[at]
        deleted = pc.fill_null(batch.column("deleted"), False).to_numpy(zero_copy_only=False)[at].astype(bool)
        since = pc.cast(batch.column("valid_from"), pa.timestamp("us", "UTC")).cast(pa.int64())
        since = pc.fill_null(since, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[at]
        if run_end >= 0:
            deleted = np.concatenate([[end_deleted], deleted])
            since = np.concatenate([[end_from], since])

        if len(parent_rank):
            breaks = np.flatnonzero(np.diff(parent_rank) > 1)
            starts = parent_rank[np.concatenate([[0], breaks + 1])]
            ends = parent_rank[np.concatenate([breaks, [len(parent_rank) - 1]])]
            if run_end >= 0:
                starts[0] = run_start
        else:
            starts = ends = np.empty(0, dtype=np.int64)

        refs = np.flatnonzero(kind == 1)
        if len(refs):
            ref_rank = rank[refs]
            run = np.searchsorted(starts, ref_rank, side="right") - 1
            missing = np.ones(len(refs), dtype=bool)
            inside = run >= 0
            missing[inside] = ref_rank[inside] > ends[run[inside]]
            parent = np.searchsorted(parent_rank, ref_rank)
            parent = np.minimum(parent, max(len(parent_rank) - 1, 0))
            is_deleted, is_late = np.zeros(len(refs), dtype=bool), np.zeros(len(refs), dtype=bool)
            there = ~missing
            first = pc.cast(batch.column("first_ref"), pa.timestamp("us", "UTC")).cast(pa.int64())
            first = pc.fill_null(first, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[refs]
            valid_from = np.full(len(refs), np.iinfo(np.int64).min)
            if len(parent_rank):
                is_deleted[there] = deleted[parent[there]]
                valid_from[there] = since[parent[there]]
                is_late = there & ~is_deleted & (valid_from > first)
            out = missing | is_deleted | is_late
            if out.any():
                reason = np.where(missing, "missing", np.where(is_deleted, "deleted", "late"))[out]
                chosen = pa.array(refs[out])
                stamp = pa.array(valid_from[out], mask=~is_late[out]).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([key.take(chosen), pa.array(reason, pa.string()), stamp, batch.column("n_refs").take(chosen)], names=["ref_key", "reason", "valid_from", "n_refs"])

        last_key, last_rank = key[len(key) - 1].as_py(), int(rank[-1])
        if len(parent_rank):
            run_start, run_end = int(starts[-1]), int(ends[-1])
            end_deleted, end_from = bool(deleted[-1]), int(since[-1])


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference to a key that is missing, deleted, or appeared only after the reference was made.

    references: ref_id, ref_field, ref_key, ref_time and any further columns; a null key refers to nothing and is no
    case. parents: key, deleted, valid_from; repeated rows are folded (deleted if any row is, valid from the first
    time; null is always). Keys compare exactly. Result: the columns of references and reason, which replaces
    a column of that name. A null ref_time is never late. Repeated references come out as often as they came in.
    """
    parents = parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("deleted", F.lit(False))).alias("deleted"), _earliest("valid_from").alias("valid_from"))
    references = references.drop("reason", "__valid_from", "__n_refs").where(F.col("ref_key").isNotNull())
    ref_keys = references.groupBy(F.col("ref_key").alias("key")).agg(F.min("ref_time").alias("first_ref"), F.count(F.lit(1)).alias("n_refs"))
    suspects = cut(suspect_keys(parents, ref_keys)).withColumnsRenamed({"valid_from": "__valid_from", "n_refs": "__n_refs"})
    in_order = (F.col("reason") == "late") & ~F.coalesce(F.col("__valid_from") > F.col("ref_time"), F.lit(False))
    met = join_counted(references, suspects, ["ref_key"], "__n_refs")
    return met.where(~in_order).drop("__valid_from", "__n_refs")


def _earliest(name: str):
    """The minimum, where a null means from the beginning."""
    return F.when(F.count(F.when(F.col(name).isNull(), 1)) > 0, F.lit(None)).otherwise(F.min(name))


def orphans_by_period(orphans: DataFrame, table: str) -> DataFrame:
    """Counts by table, field, month of the reference and reason."""
    month = F.date_format("ref_time", "yyyy-MM").alias("month")
    return orphans.groupBy(F.lit(table).alias("ref_table"), "ref_field", month, "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ref_key").alias("n_keys"))

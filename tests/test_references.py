import datetime as dt
import random

from graphloom.operators.references import orphan_references, orphans_by_period
from graphloom.operators.skew import HOT_LEAST
from pyspark.sql import functions as F

T = lambda n: dt.datetime(2026, 1 + n // 28, 1 + n % 28)
REFS = "ref_id string, ref_field string, ref_key string, ref_time timestamp, valid_from string, reason string, n_refs string"
PARENTS = "key string, deleted boolean, valid_from timestamp, kind string"


def frames(spark, refs, parents):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in refs], REFS), spark.createDataFrame([(*p, "x") for p in parents], PARENTS)


def brute(refs, parents):
    known = {}
    for k, d, f in parents:
        if k is not None:
            old = known.get(k, (False, dt.datetime.max))
            known[k] = (old[0] or bool(d), min(old[1], f or dt.datetime.min))
    out = []
    for i, field, k, t in refs:
        if k is None:
            continue
        why = "missing" if k not in known else "deleted" if known[k][0] else "late" if t is not None and known[k][1] > t else None
        if why:
            out.append((i, field, why))
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    for seed in range(4):
        r = random.Random(seed)
        keys = [f"{r.choice(['a', 'A', 'é', 'doc:'])}{r.randrange(60)}" for _ in range(80)]
        parents = [(r.choice([*keys, None]), r.choice([None, False, False, True]), r.choice([None, T(r.randrange(50))])) for _ in range(60)]
        refs = [(f"r{i}", r.choice(["from_id", "to_id"]), r.choice([*keys, None, "", "a1 "]), r.choice([None, T(r.randrange(50))])) for i in range(400)]
        a, b = frames(spark, refs, parents)
        assert rows(orphan_references(a, b), "ref_id", "ref_field", "reason") == brute(refs, parents)


def test_hot_missing_key_and_many_batches(spark):
    n = 3 * HOT_LEAST
    refs = spark.range(3 * n).select(F.col("id").cast("string").alias("ref_id"), F.lit("f").alias("ref_field"), F.when(F.col("id") < n, "gone").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("ref_key"), F.lit(T(1)).alias("ref_time"))
    parents = spark.range(n, 3 * n).where("id % 7 <> 0").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("valid_from"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # runs and ranks go on from batch to batch
    try:
        found = orphan_references(refs, parents).groupBy("reason").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r[0], r[1]) for r in found] == [("missing", n + sum(1 for i in range(n, 3 * n) if i % 7 == 0))]


def test_empty_sides_and_counts(spark, rows):
    a, b = frames(spark, [("r", "f", "k", T(1)), ("r", "f", "k", T(1)), ("s", "f", "k", T(40)), ("s", "f", "j", None)], [])
    assert rows(orphans_by_period(orphan_references(a, b), "t")) == [("t", "f", "2026-01", "missing", 2, 1), ("t", "f", "2026-02", "missing", 1, 1), ("t", "f", None, "missing", 1, 1)]
    none, parents = frames(spark, [], [("k", False, None)])
    assert rows(orphan_references(none, parents)) == []

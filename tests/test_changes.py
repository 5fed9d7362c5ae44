import datetime as dt
import random

from graphloom.operators.changes import current_state, fold_changes

T = lambda n: dt.datetime(2026, 1, 1, 0, 0, n)
SCHEMA = "k string, at timestamp, tx int, op string, v string, change string, is_deleted_by string"


def fold(spark, data, base=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    return fold_changes(df, "k", ["at", "tx"], "op", ["v"], base)


def test_order_of_arrival_and_repeats_do_not_matter(spark, rows):
    data = [("a", T(1), 0, "UPSERT", "1"), ("a", T(2), 0, " delete ", None), ("a", T(2), 1, "Upsert", "2"), ("b", T(5), 0, "UPSERT", "3"), ("b", T(6), 0, "DELETE", None), ("c", T(1), None, "upsert", None), (None, T(1), 0, "UPSERT", "n"), ("d", T(1), 0, "HEARTBEAT", "n"), ("e", T(1), 0, None, "n"), ("f", None, None, "UPSERT", "late")]
    want = [("a", "2"), ("c", None), ("f", "late")]
    for seed in range(3):
        mixed = data * 3
        random.Random(seed).shuffle(mixed)
        assert rows(current_state(fold(spark, mixed)), "k", "v") == sorted(want, key=repr)


def test_tombstones_withstand_late_changes(spark, rows):
    base = fold(spark, [("a", T(5), 0, "DELETE", None), ("b", T(5), 0, "UPSERT", "b5")])
    after = fold(spark, [("a", T(4), 0, "UPSERT", "late"), ("b", T(4), 9, "DELETE", None), ("c", T(1), 0, "UPSERT", "c")], base)
    assert rows(current_state(after), "k", "v") == [("b", "b5"), ("c", "c")]
    plain_base = spark.createDataFrame([("z", T(1), 0, "kept")], "k string, at timestamp, tx int, v string")
    assert rows(current_state(fold(spark, [("y", T(1), 0, "UPSERT", "y")], plain_base)), "k", "v") == [("y", "y"), ("z", "kept")]


def test_ties_and_empty_input(spark, rows):
    tie = fold(spark, [("a", T(1), 0, "UPSERT", "x"), ("a", T(1), 0, "DELETE", None), ("b", T(1), 0, "UPSERT", None), ("b", T(1), 0, "UPSERT", "p")])
    assert rows(tie, "k", "is_deleted", "v") == [("a", True, None), ("b", False, "p")]
    assert rows(fold(spark, [])) == []

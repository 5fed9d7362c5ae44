from graphloom.functions.text import canonical_uuid
from graphloom.operators.delivery import deduplicate, surplus_deliveries
from pyspark.sql import functions as F

A, B = "890cde7c-5d0b-475e-9db5-1067808d0d0e", "890cde7c-5d0b-475e-9db5-1067808d0d0f"
SCHEMA = "seq bigint, id string, message_id string, first_position string, seq_copy int"


def test_writings_of_one_uuid(spark, rows):
    forms = [A, A.upper(), A.replace("-", ""), "{" + A + "}", "urn:uuid:" + A, f" {A}", f"{A}​", "URN:UUID:" + A.upper()]
    df = spark.createDataFrame([(x,) for x in forms], "id string")
    assert rows(df.select(canonical_uuid(F.col("id"))).distinct()) == [(A,)]
    odd = spark.createDataFrame([("not-a-uuid",), (None,), ("",), ("deadbeef",)], "id string")
    assert rows(odd.select(canonical_uuid(F.col("id")).eqNullSafe(F.col("id")))) == [(True,)] * 4


def test_lowest_position_is_kept_and_the_rest_is_surplus(spark, rows):
    df = spark.createDataFrame([(3, A, "x", "y", 1), (1, A.upper(), None, None, 2), (2, B, "x", "y", 3), (9, "{" + B + "}", "x", "y", None), (4, None, "x", "y", 4), (5, " ", "x", "y", 4), (6, " ", "x", "y", 4), (None, A, "x", "y", 5)], SCHEMA)
    assert rows(deduplicate(df, "id", "seq"), "seq", "message_id") == [(1, None), (2, "x")]
    assert rows(surplus_deliveries(df, "id", "seq")) == [(3,), (9,)]


def test_empty_and_hot(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(deduplicate(empty, "id", "seq")) == [] and rows(surplus_deliveries(empty, "id", "seq")) == []
    hot = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, A).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("id"))
    assert surplus_deliveries(hot, "id", "seq").count() == 999
    assert rows(deduplicate(hot.where("id like '89%'"), "id", "seq"), "seq", "id") == [(0, A)]


def test_equal_positions_keep_exactly_one(spark, rows):
    schema = "seq bigint, id string, t int, m map<string, int>, kept_row int"
    data = [(1, A, 5, {"a": 1}, 1), (1, A.upper(), 4, {"a": 2}, 2), (1, A, 4, {"a": 3}, 3), (1, B, None, None, 4), (1, B, None, None, 4), (1, B, 0, None, 5), (2, B, 0, None, 6)]
    df = spark.createDataFrame(data, schema)
    kept = rows(deduplicate(df, "id", "seq", ("t",)), "id", "t", "kept_row")
    assert len(kept) == 2 and {k[1] for k in kept} == {4, None}
    assert kept == rows(deduplicate(df.repartition(3), "id", "seq", ("t",)), "id", "t", "kept_row")
    assert rows(surplus_deliveries(df, "id", "seq", ("t",))) == [(1,), (1,), (1,), (1,), (2,)]
    assert len(rows(deduplicate(df, "id", "seq"))) == 2 and len(rows(surplus_deliveries(df, "id", "seq"))) == 5

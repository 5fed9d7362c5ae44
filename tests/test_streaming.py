import random

from graphloom.operators.changes import current_state, fold_changes
from graphloom.sources.files import fetched, text_files, write_json_lines
from graphloom.functions.models import digest_vector, embed
from graphloom.functions.text import canonical_uuid
from graphloom.streaming.outbox import apply_batch, deduplicated_stream, outbox_stream, run_outbox, state_at
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def batch_state(spark, df):
    return fold_changes(df.withColumn("event_id", canonical_uuid(F.col("id"))), "aggregate_id", ["created_at", "tx_order"], "event_type", ["event_id", "aggregate_type", "payload"])


def test_the_stream_reaches_the_batch_state_in_any_order(spark, rows, tmp_path):
    outbox = spark.read.parquet(f"{SF}/outbox.parquet")
    want = rows(batch_state(spark, outbox), "aggregate_id", "event_id", "is_deleted")
    outbox.withColumn("b", F.pmod(F.hash("delivery_seq"), F.lit(4))).repartition(4, "b").drop("b").write.parquet(str(tmp_path / "outbox.parquet"))
    target = str(tmp_path / "out")
    assert rows(run_outbox(spark, str(tmp_path), target), "aggregate_id", "event_id", "is_deleted") == want
    again = run_outbox(spark, str(tmp_path), target)  # nothing new
    assert rows(again, "aggregate_id", "event_id", "is_deleted") == want
    accepted = spark.read.parquet(f"{target}/routed").count() + spark.read.option("recursiveFileLookup", True).parquet(f"{target}/rejected").count()
    assert accepted == outbox.count()


def test_a_repeated_batch_changes_nothing(spark, rows, tmp_path):
    outbox = spark.read.parquet(f"{SF}/outbox.parquet")
    a, b = outbox.where("delivery_seq % 2 = 0"), outbox.where("delivery_seq % 2 = 1")
    target = str(tmp_path)
    for n, part in ((0, a), (1, b), (1, b)):
        apply_batch(part, n, target)
    assert rows(state_at(spark, target), "aggregate_id", "event_id") == rows(batch_state(spark, outbox), "aggregate_id", "event_id")
    assert rows(current_state(state_at(spark, target, 0)), "aggregate_id") == rows(current_state(batch_state(spark, a)), "aggregate_id")


def test_streaming_dedup(spark, tmp_path):
    out = deduplicated_stream(outbox_stream(spark, SF), "400 days").writeStream.format("memory").queryName("seen_messages").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    out.awaitTermination()
    want = spark.read.parquet(f"{SF}/outbox.parquet").where("aggregate_id IS NOT NULL AND id IS NOT NULL").select(canonical_uuid(F.col("id"))).distinct().count()
    assert spark.table("seen_messages").count() == want


def test_no_first_delivery_is_lost_however_late(spark, tmp_path):
    for n, day in enumerate(("2026-03-01", "2026-01-01", "2026-02-01")):
        ids = [f"{n}0000000-0000-0000-0000-000000000000", "f0000000-0000-0000-0000-000000000000"]
        spark.createDataFrame([(x, "a") for x in ids], "id string, aggregate_id string").withColumn("created_at", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, aggregate_id string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = deduplicated_stream(stream).writeStream.format("memory").queryName("all_firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("all_firsts").count() == 4


def test_files(spark, rows, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "a.go").write_text("package a\n")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    assert [r["source"] for r in text_files(spark, str(tmp_path / "in"), "*.go").collect()] == ["package a\n"]
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = spark.createDataFrame([("a.go", sha(b"package a\n"), 10), ("b.txt", sha(b"\xff"), 1), ("c", "x", 1)], "name string, sha256 string, size int")
    assert rows(fetched(spark, str(tmp_path / "in"), want), "name", "status", "source") == [("a.go", "verified", "package a\n"), ("b.txt", "source_not_utf8", None), ("c", "source_not_found", None)]
    write_json_lines([{"b": 1, "a": "é"}], str(tmp_path / "r.jsonl"))
    assert (tmp_path / "r.jsonl").read_text() == '{"a": "é", "b": 1}\n' and len(list(tmp_path.iterdir())) == 2


def test_stand_in_vectors(spark):
    v = digest_vector("x", 20)
    assert len(v) == 20 and all(-1 <= x <= 1 for x in v) and v == digest_vector("x", 40)[:20]
    df = spark.createDataFrame([("x",), (None,)], "t string")
    got = [r[0] for r in df.select(embed(F.col("t"), 20)).collect()]
    assert max(abs(a - b) for a, b in zip(got[0], v)) < 1e-6 and got[1] is None


def test_batches_of_random_changes_in_any_split(spark, rows, tmp_path):
    r = random.Random(7)
    data = [(i, f"{r.randrange(16**8):08x}-0000-0000-0000-000000000000", "CodeNode", f"a{r.randrange(6)}", r.choice(["UPSERT", "delete "]), "{}", r.randrange(50), r.randrange(9)) for i in range(60)]
    df = spark.createDataFrame(data, "delivery_seq bigint, id string, aggregate_type string, aggregate_id string, event_type string, payload string, t int, tx_order int").withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    for n in range(3):
        apply_batch(df.where(F.col("delivery_seq") % 3 == n), n, str(tmp_path))
    assert rows(state_at(spark, str(tmp_path)), "aggregate_id", "event_id", "is_deleted") == rows(batch_state(spark, df), "aggregate_id", "event_id", "is_deleted")

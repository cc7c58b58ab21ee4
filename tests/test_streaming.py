"""Streams give what the batch folds give."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import admission
from gleaner.streaming import stateful


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture()
def requests(spark, tmp_path):
    rows = [("a", i, 1000.0 + t) for i, t in enumerate((0, 0, 0, 59, 60, 61, 200))] + [("b", 50, 1000.0), ("b", 51, 1060.0)]
    spark.createDataFrame(rows, "client string, id long, ts double").coalesce(1).write.parquet(f"{tmp_path}/r")
    return spark.readStream.schema("client string, id long, ts double").parquet(f"{tmp_path}/r"), rows


def test_admission(spark, requests):
    stream, rows = requests
    got = {r.id: (r.admitted, r.retry_after) for r in run(stateful.sliding_admission(stream, 2, 60.0), "admitted").collect()}
    batch = spark.createDataFrame(rows, "client string, id long, ts double").withColumn("at", F.timestamp_seconds("ts"))
    want = {r.id: (r.admitted, r.retry_after) for r in admission.sliding_admission(batch, ["client"], "at", "id", 2, 60.0).collect()}
    assert got == want and got[2] == (False, 60) and got[4] == (True, 0) and got[3] == (False, 1)


def test_budget(spark, tmp_path):
    at = lambda d: datetime.datetime(2026, 3, d, 12)
    rows = [("x", i, at(d), u) for i, (d, u) in enumerate([(1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (4, 1)])]
    schema = "category string, id long, ts timestamp, units long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b")
    got = {r.id: r.admitted for r in run(stateful.reserve_budget(spark.readStream.schema(schema).parquet(f"{tmp_path}/b"), 2, 5), "budget").collect()}
    want = {r.id: r.admitted for r in admission.reserve_budget(spark.createDataFrame(rows, schema), "category", "ts", "units", "id", 2, 5).collect()}
    assert got == want == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}


def test_conversations(spark, tmp_path):
    rows = [(1, t, topic, "ask") for t, topic in enumerate(["a", "a", None, "b", "c", "d", "e"])]
    schema = "conv_id long, turn long, topic string, intent string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/c")
    made = stateful.conversation_memory(spark.readStream.schema(schema).parquet(f"{tmp_path}/c"))
    q = made.writeStream.format("memory").queryName("talk").outputMode("append").start()
    end = time.time() + 60
    while spark.table("talk").count() < len(rows) and time.time() < end:  # with a time-out, a query never runs out of batches
        time.sleep(0.5)
    q.stop()
    got = [(r.turn, r.topic, r.remembered) for r in spark.table("talk").orderBy("turn").collect()]
    assert got == [(0, "a", 1), (1, "a", 1), (2, "a", 1), (3, "b", 2), (4, "c", 3), (5, "d", 4), (6, "e", 4)]


def test_retention(spark, tmp_path):
    spark.range(20).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/log")
    q = stream.writeStream.foreachBatch(stateful.retain(f"{tmp_path}/kept", 5, "id")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = stateful.compacted(spark.read.parquet(f"{tmp_path}/kept"), 3, "id").collect()
    assert sorted(r.id for r in kept) == [17, 18, 19]


def test_retention_compacts(spark, tmp_path):
    """After every tenth batch the log has one folder, with the latest rows of all batches."""
    write = stateful.retain(f"{tmp_path}/log", 4, "id", every=3)
    for k in range(7):
        write(spark.range(k * 10, k * 10 + 10), k)
    folders = sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir())
    assert folders == ["batch=5.all", "batch=6"]
    write(spark.range(60, 70), 6)  # a repeated batch
    assert sorted(r.id for r in stateful.compacted(spark.read.parquet(f"{tmp_path}/log"), 4, "id").collect()) == [66, 67, 68, 69]


def test_windows_and_first_requests(spark, tmp_path):
    schema = "session string, key string, ts timestamp"
    at = lambda m: datetime.datetime(2026, 3, 1, 12, m)
    spark.createDataFrame([("s", "k", at(0)), ("s", "k", at(1)), ("s", "j", at(2)), ("t", "k", at(40))], schema).coalesce(1).write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/w")
    assert run(stateful.first_requests(stream, ["session", "key"], "ts", "10 minutes"), "firsts").count() == 3
    assert run(stateful.windowed_counts(stream, "ts", "10 minutes", "1 minute", ["session"]), "windows", "complete").count() == 2

from conftest import rows
from pyspark.sql import functions as F

from strandloom.streaming import windows


def _stream(spark, sf, tmp_path, name):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / name))
    schema = spark.read.parquet(str(tmp_path / name)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def _run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tumbling_on_a_stream_equals_batch(spark, sf, tmp_path):
    batch = windows.tumbling(spark.read.parquet(f"{sf}/events.parquet"), "1 day")
    live = _run(windows.tumbling(_stream(spark, sf, tmp_path, "ev"), "1 day", watermark="60 days"), "t1", "complete", tmp_path)
    assert rows(live, "window_start", "event_type", "n") == rows(batch, "window_start", "event_type", "n")


def test_dedup_on_a_stream(spark, sf, tmp_path):
    live = _run(windows.dedup(_stream(spark, sf, tmp_path, "ev2"), ["user_id", "event_type"], "90 days"), "t2", "append", tmp_path)
    want = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type").distinct().count()
    assert live.count() == want


def test_probes_of_a_stream(spark, sf, tmp_path):
    stream = _stream(spark, sf, tmp_path, "ev3").withColumn("ws", F.array("event_type"))
    vocabulary = spark.createDataFrame([("purchase",)], "word string")
    live = _run(windows.probe_stream(stream, vocabulary, "ws", ["event_id"]), "t3", "append", tmp_path)
    assert live.count() == spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").count()


def test_a_row_with_several_hits_comes_once(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, ["b"])], "event_id int, ws array<string>")
    assert rows(windows.probe_stream(df, spark.createDataFrame([("a",), ("b",), ("b",)], "word string"), "ws", ["event_id"])) == [(1,), (3,)]


def test_dedup_in_batch_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 50), (3, "a", 60), (4, "a", 61), (5, "a", 121), (6, "a", 122), (7, "b", 5), (8, "b", 5)], "event_id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r[0] for r in rows(windows.dedup(df, ["k"], "60 seconds"), "event_id")] == [1, 4, 6, 7]


def test_gaps_of_a_stream_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    days = sorted(r["d"] for r in events.select(F.to_date("ts").alias("d")).distinct().collect())
    events.where(F.to_date("ts") <= days[len(days) // 2]).coalesce(1).write.parquet(str(tmp_path / "gaps"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "gaps"))
    q = windows.quiet_gaps(stream, 3600).writeStream.format("memory").queryName("t4").outputMode("append").option("checkpointLocation", str(tmp_path / "cp4"))
    q.trigger(availableNow=True).start().awaitTermination()
    events.where(F.to_date("ts") > days[len(days) // 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "gaps"))
    more = windows.quiet_gaps(stream, 3600).writeStream.format("parquet").option("path", str(tmp_path / "more")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp5")).trigger(availableNow=True).start()
    more.awaitTermination()
    times = {}
    for r in events.orderBy("ts").collect():
        times.setdefault(r["user_id"], []).append(r["ts"])
    want = sorted((u, a, b) for u, t in times.items() for a, b in zip(t, t[1:]) if (b - a).total_seconds() > 3600)
    got = spark.read.parquet(str(tmp_path / "more"))
    assert sorted(tuple(r) for r in got.collect()) == want
    half = [w for w in want if w[2].date() <= days[len(days) // 2]]
    assert sorted(tuple(r) for r in spark.table("t4").collect()) == half

from pyspark.sql import functions as F

from tidewatch.streaming import alarms as S


def run(spark, df, name, mode="complete"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    late = "60 days"
    hot = F.col("value") > 50
    got = run(spark, S.threshold_alarms(stream, "ts", ["event_type"], hot, "2 hours", late), "alarms")
    want = S.threshold_alarms(events, "ts", ["event_type"], hot, "2 hours", late)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0
    got = run(spark, S.sliding(stream, "ts", ["event_type"], late=late).select("window", "event_type", "n", "top"), "windows")
    want = S.sliding(events, "ts", ["event_type"], late=late).select("window", "event_type", "n", "top")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    seen = run(spark, S.first_seen(stream, "ts", ["event_type", "user_id"], late).select("event_type", "user_id"), "seen", "append")
    assert seen.count() == events.select("event_type", "user_id").distinct().count()


def test_periodic_task(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []
    q = S.periodic(stream, lambda df, n: seen.append(df.count()), "1 second", str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 3

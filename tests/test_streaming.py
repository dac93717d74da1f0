"""Streaming forms, fed from files."""

from pyspark.sql import functions as F

from tidewell import streaming


def fed(spark, tmp_path, make, mode="append"):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table("out").collect()


def test_fixed_windows_per_key(spark, tmp_path):
    rows = fed(spark, tmp_path, lambda s: streaming.window_fixed(s, "k", "v", 4))
    assert sorted((r.key, len(r.window)) for r in rows) == [(0, 4), (0, 4), (1, 4), (1, 4)]


def test_running_sums(spark, tmp_path):
    rows = fed(spark, tmp_path, lambda s: streaming.scan_sum(s, "k", "v"))
    assert max(r.value for r in rows if r.key == 0) == sum(range(0, 20, 2)) and len(rows) == 20


def test_event_time_groups(spark, tmp_path):
    rows = fed(spark, tmp_path, lambda s: streaming.grouping_by(s, "k", "ts", "5 minutes", "1 hour", n=F.count("*")), "complete")
    assert sum(r.n for r in rows) == 20

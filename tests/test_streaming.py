"""Ingestion takes each event once, over several runs."""

import shutil

from pyspark.sql import functions as F

from grainmill.streaming.ingest import ingest, windowed


def test_ingest_resumes(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, target = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    events.coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("*.parquet"))
    shutil.copy(part, source / "a.parquet")
    ingest(spark, str(source), events.schema, target, f"{tmp_path}/ck")
    assert spark.read.parquet(target).count() == events.count()
    ingest(spark, str(source), events.schema, target, f"{tmp_path}/ck")
    assert spark.read.parquet(target).count() == events.count()
    late = events.limit(3).withColumns({"event_id": F.col("event_id") + 10_000_000, "ts": F.expr("timestamp'2030-01-01 00:00:00'")})
    late.coalesce(1).write.parquet(f"{tmp_path}/two")
    shutil.copy(next((tmp_path / "two").glob("*.parquet")), source / "b.parquet")
    ingest(spark, str(source), events.schema, target, f"{tmp_path}/ck")
    assert spark.read.parquet(target).count() == events.count() + 3


def test_windows_of_stream_and_batch_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rounded = lambda df: df.select(F.col("start").cast("timestamp").alias("start"), "event_type", "n", F.round("total", 6).alias("t"))
    a, b = rounded(spark.table("w")), rounded(windowed(events))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0

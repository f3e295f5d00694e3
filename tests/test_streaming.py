"""Streaming aggregates give the batch result once the stream is read."""

import shutil

from spinel.streaming import windows


def run(spark, tmp_path, sf, make, name):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{sf}/events.parquet", src / "part-0.parquet")
    batch = spark.read.parquet(str(src))
    stream = make(spark.readStream.schema(batch.schema).parquet(str(src)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(str, spark.table(name).collect())), sorted(map(str, make(batch).collect()))


def test_windowed_counts(spark, tmp_path, sf):
    got, want = run(spark, tmp_path, sf, lambda e: windows.windowed_counts(e).drop("total"), "counts")
    assert got == want and got


def test_sessions(spark, tmp_path, sf):
    got, want = run(spark, tmp_path, sf, windows.sessions, "sessions")
    assert got == want and got

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowtree import more_queries
from flowtree import operators as ops
from flowtree.streaming import batch_stream, stop_when, watch_directory


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()


def test_new_and_modified_files_are_emitted(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a").write_text("1")
    q = watch_directory(spark, str(d)).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        (d / "b").write_text("2")
        later = time.time() + 5
        os.utime(d / "a", (later, later))
        q.processAllAvailable()
        assert sorted(os.path.basename(r.path) for r in spark.table("watched").collect()) == ["a", "a", "b"]
    finally:
        q.stop()


def test_streaming_join_and_window(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 100000), (2, "a", 100020), (3, "b", 100500), (4, "a", 109000)], "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    drained(ops.stream_join({"x": (stream, "k"), "y": (stream, "k")}, 30).select("key", "x.id", F.col("y.id").alias("other")), "joined", tmp_path)
    assert sorted(map(tuple, spark.table("joined").collect())) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("a", 4, 4), ("b", 3, 3)]
    drained(ops.time_window(stream, 60, 30, aggregates={"n": F.count(F.lit(1))}).select("start", "n"), "windowed", tmp_path)
    assert sum(r.n for r in spark.table("windowed").collect()) >= 6


def test_batches_with_a_rest(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "s"))
    q = batch_stream(stream, 3, timeout=0.5, lanes=1).writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            if sum(len(r.batch) for r in spark.table("batched").collect()) == 7:
                break
            time.sleep(0.5)
        assert sorted(len(r.batch) for r in spark.table("batched").collect()) == [1, 3, 3]
    finally:
        q.stop()


def test_stopping_on_a_condition(spark, tmp_path):
    seen = []
    stream = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    q = stop_when(stream, F.col("value") > 20, lambda df, n: seen.append(df.count()), str(tmp_path / "ck"), max_time=90)
    assert not q.isActive and sum(seen) > 20


def test_batches_of_one_frame_and_over_many(spark, tmp_path):
    """Each frame's full batches, with a rest that goes into the next frame's and is kept in the state."""
    spark.range(25_025).coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 130)
    try:
        out = more_queries._drained(batch_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "s")), 100, timeout=3600, lanes=1), str(tmp_path / "out"), timeouts=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [x for r in out.collect() for x in r.batch]
    assert [len(r.batch) for r in out.collect()] == [100] * 250 and len(set(rows)) == 25_000


def test_a_stream_of_a_folder_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = more_queries.stream_batches(spark, str(tmp_path))
    assert [r.n for r in got.collect()] == [100] * (events.count() // 100)


def test_a_stream_that_fails_or_does_not_end_has_no_result(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "s"))
    for k, timeouts in enumerate((False, True)):
        with pytest.raises(TimeoutError):
            more_queries._drained(stream, str(tmp_path / f"late{k}"), timeouts, most=0.001)
        with pytest.raises(StreamingQueryException):
            more_queries._drained(stream.select(F.raise_error(F.lit("no")).alias("x")), str(tmp_path / f"failed{k}"), timeouts)

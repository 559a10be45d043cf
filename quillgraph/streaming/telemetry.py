"""Streams: running statistics of calls, windows with late rows, last-writer-wins tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.changes import latest
from quillgraph.sources.readers import TELEMETRY
from quillgraph.sources.writers import swap


def stream_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(TELEMETRY).json(path).filter("tool_name IS NOT NULL")


def running_stats(calls: DataFrame) -> DataFrame:
    """Calls, bytes, latency and errors per tool so far (update or complete mode)."""
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.sum("response_bytes").alias("bytes"), F.sum("latency_ms").alias("latency"), F.count_if("is_error").alias("errors"))


def windowed(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are given up (streams only)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def upsert_stream(changes: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keep a table at ``path`` with the latest row of every key; a batch seen twice changes nothing.

    The table is cut by a hash of the key into ``buckets`` folders ``bucket=...``; a batch
    rewrites those that it touches and leaves the others alone.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        cut = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = latest(batch, key, order).withColumn("bucket", cut)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b in touched:
            folder = f"{path}/bucket={b}"
            rows = fresh.filter(F.col("bucket") == b).drop("bucket")
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
                rows = latest(rows.unionByName(spark.read.schema(rows.schema).parquet(folder)), key, order)
            fs.mkdirs(at)
            swap(rows, folder)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changed_files(files: DataFrame, time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each state of a file once: ``id, file_hash`` pairs not seen before.

    With ``time`` the pairs of rows older than ``late`` are forgotten, so the state is bounded.
    """
    if time is None:
        return files.dropDuplicates(["id", "file_hash"])
    return files.withWatermark(time, late).dropDuplicatesWithinWatermark(["id", "file_hash"])

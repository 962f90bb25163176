"""The audit log as a stream: appends, limits, counters and costs, with watermarks that let state expire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.audit import record


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with ts as a timestamp with a time zone, as watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def per_minute(events: DataFrame, limit: int, key: str = "tenant_id", late: str = "10 minutes") -> DataFrame:
    """key, minute, n and n_over: requests beyond the limit of a minute. Also for batches."""
    windowed = timed(events).withWatermark("ts", late).groupBy(key, F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(key, F.col("w.start").alias("minute"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("n_over"))


def block_rate(events: DataFrame, blocked, length: str = "15 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Start of each sliding window, n and the share that blocked holds for."""
    windowed = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.avg(blocked.cast("double")).alias("rate"))
    return windowed.select(F.col("w.start").alias("start"), "n", "rate")


def counters(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def run_costs(events: DataFrame, run: str = "run_id") -> DataFrame:
    return events.groupBy(run).agg(F.sum("cost").alias("cost"))


def append_log(turns: DataFrame, path: str, checkpoint: str):
    """A query that appends turns, their questions hashed, to the log at path with what has come so far, then ends."""
    return record(turns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_cases(cases: DataFrame, path: str, checkpoint: str, key: str = "case_id", buckets: int = 64):
    """A query that appends the cases that the table at path doesn't have yet; running it again changes nothing. The table lies in buckets of the key (a column bucket), and a
    micro-batch is held against those of its own cases only."""

    def once(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            own = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as buckets at most
            new = fresh
            try:
                there = spark.read.parquet(path).where(F.col("bucket").isin(own)).select("bucket", key)
                new = fresh.join(there, ["bucket", key], "left_anti")
            except Exception as e:  # there is no table yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            new.write.mode("append").partitionBy("bucket").parquet(path)
        finally:
            fresh.unpersist()

    return cases.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

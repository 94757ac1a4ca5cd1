"""Sessions, chunk ingest, tumbling buckets and resume over streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timeweave.operators.incremental import upsert_chunks


def pause_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions separated by pauses (J1); works on batch and streaming input alike."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    sessions = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return sessions.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def tumbling_extremes(samples: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Min and max per tumbling window."""
    rows = samples.withWatermark("ts", lateness) if samples.isStreaming else samples
    return rows.groupBy(key, F.window("ts", width).alias("w")).agg(
        F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("bucket_start"), "min_v", "max_v", "n")


def ingest_chunks(chunks: DataFrame, path: str, checkpoint: str, version: str = "version", buckets: int = 16) -> StreamingQuery:
    """Last write per (run, position) into a table partitioned by run bucket.

    Every micro-batch merges with the stored rows of the buckets it touches and writes the
    result under its own batch folder before those buckets are overwritten, so a replayed
    batch gives the same table.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("run_bucket", F.pmod(F.xxhash64("run_id", "position"), F.lit(buckets)).cast("int"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("run_bucket").distinct()
        try:
            stored = spark.read.parquet(path).select(*batch.columns)
        except AnalysisException as error:  # no table before the first batch
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            stored = batch.filter("false")
        merged = upsert_chunks(stored.join(touched, "run_bucket", "left_semi"), batch, version)
        staged = f"{checkpoint}/staged/batch={batch_id}"
        merged.write.mode("overwrite").parquet(staged)
        spark.read.schema(merged.schema).parquet(staged).repartition("run_bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("run_bucket").parquet(path)

    return keyed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_safe(chunks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop replays of the same chunk version inside the watermark."""
    return chunks.withWatermark("written_at", lateness).dropDuplicatesWithinWatermark(["run_id", "position", "version"])


def pending_chunks(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned chunks that are not complete yet (J4); ``planned`` may be a stream."""
    complete = done.filter("status = 'complete'").select("run_id", "position", F.lit(True).alias("__done"))
    return planned.join(complete, ["run_id", "position"], "left_outer").filter("__done is null").drop("__done")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

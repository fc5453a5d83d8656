"""Structured Streaming forms of the cumulative combine (ST1-ST3).

* ST1 ``start_combine`` — new collection files as a file stream; each micro-batch is merged into
  the stored table with keep-latest (``foreachBatch``), replacing only the channels it touched.
  A replayed batch produces the same table, so the sink is idempotent under restarts.
* ST2 ``dedup_within_watermark`` — append-only de-duplication of (channel, id) inside a
  watermark (keeps the *first* copy; only for feeds where latest-wins is not required).
* ST3 ``daily_counts`` — the daily timeline as a windowed aggregation with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators import clean
from chatlens.plans import jobs
from chatlens.sources import collections


def file_stream(spark: SparkSession, raw_dir: str, *, glob: str = "*.json",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New collection files as a stream of (source_file, file_name_src, value) rows. The stream
    only tracks which files are new; parsing happens per micro-batch with the batch code."""
    r = spark.readStream.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.text(raw_dir, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name_src"), "value")


def parse_batch(files: DataFrame) -> DataFrame:
    raw, _ = collections.parse_files(files)
    return jobs.to_store_rows(clean.loader_clean(clean.typed_messages(raw)))


def collection_stream(spark: SparkSession, raw_dir: str, *, glob: str = "*.json",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming typed message rows (for append-only consumers such as ST2 / ST3)."""
    return parse_batch(file_stream(spark, raw_dir, glob=glob, max_files_per_trigger=max_files_per_trigger))


def merge_batch(spark: SparkSession, store_path: str, rejects_path: str | None = None):
    """foreachBatch body: parse the new files of one micro-batch and merge them (keep-latest)
    into the stored table, replacing only the (channel, id block) partitions they touch. Rejected
    files and elements go to ``rejects_path``, one folder per batch that a replay replaces."""
    from chatlens.session import cut_lineage

    def run(files: DataFrame, batch_id: int) -> None:
        if rejects_path:
            collections.parse_files(files)[1].write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")
        batch = cut_lineage(parse_batch(files), "stream-batch")
        if batch.isEmpty():
            return
        merged = jobs.merge_into(jobs.touched_existing(spark, store_path, batch), batch)
        jobs.commit(spark, store_path, cut_lineage(merged, "stream-merge"), jobs.touched_partitions(batch))
    return run


def start_combine(spark: SparkSession, raw_dir: str, store_path: str, checkpoint_location: str, *,
                  available_now: bool = True, glob: str = "*.json", rejects_path: str | None = None):
    """ST1: start the streaming combine; ``available_now`` processes what exists and stops."""
    q = (file_stream(spark, raw_dir, glob=glob).writeStream
         .foreachBatch(merge_batch(spark, store_path, rejects_path))
         .option("checkpointLocation", checkpoint_location))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def dedup_within_watermark(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST2: first copy of each (channel, id) within the watermark; state is bounded by the delay."""
    # watermarks need TIMESTAMP (the session time zone is UTC, so the instant is unchanged)
    return (stream.where(F.col("date").isNotNull()).withColumn("event_time", F.col("date").cast("timestamp"))
                  .withWatermark("event_time", delay)
                  .dropDuplicatesWithinWatermark(["channel_username", "message_id"]))


def daily_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """ST3: messages per channel and calendar day, finalised once the watermark passes the day."""
    return (stream.where(F.col("date").isNotNull()).withColumn("ts", F.col("date").cast("timestamp"))
                  .withWatermark("ts", delay)
                  .groupBy("channel_username", F.window("ts", "1 day").alias("day"))
                  .agg(F.count(F.lit(1)).alias("count"))
                  .select("channel_username", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "count"))

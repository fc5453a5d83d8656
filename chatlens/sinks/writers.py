"""Sinks (K1-K7). Every writer is one distributed write; partitioning by channel lets later
reads prune to the channels asked for and lets a re-run replace only the channels it touched
(dynamic partition overwrite), which is what makes the combine job idempotent and restartable:
a lost executor only re-runs tasks, and a failed job leaves the previous partitions in place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chatlens.functions.expr import channel_key
from chatlens.operators import clean, merge, validate
from chatlens.schema import MESSAGE_COLUMNS

PART = "channel"
BLOCK = "id_block"
BLOCK_SIZE = 100_000  # message ids per storage block (ids grow per channel, so loads touch few blocks)
NO_CHANNEL = "~"  # partition of rows without a channel in the message store; a null would not prune by equality


def with_partition(df: DataFrame) -> DataFrame:
    """Partition column: the normalised channel name (no '@')."""
    return df.withColumn(PART, channel_key("channel_username"))


def id_block(message_id="message_id", size: int = BLOCK_SIZE):
    """Storage block of a message id; null ids share block -1."""
    c = F.col(message_id) if isinstance(message_id, str) else message_id
    return F.coalesce(F.floor(c / size), F.lit(-1)).cast("bigint")


def with_store_partition(df: DataFrame) -> DataFrame:
    """Message-store partitioning: (channel, id block). A combine replaces only the blocks its
    new messages fall in, so a hot channel is never rewritten whole; readers still prune by channel. Neither column is ever null."""
    return df.withColumn(PART, F.coalesce(F.nullif(channel_key("channel_username"), F.lit("")), F.lit(NO_CHANNEL))).withColumn(BLOCK, id_block())


def collection_manifest(df: DataFrame) -> DataFrame:
    """K1 naming and envelope metadata per channel: id range, count and the reference's file name
    ``tg_<channel>_<min>_<max>.json`` ('unknown' / 'none' when absent)."""
    return (df.groupBy(channel_key("channel_username").alias(PART))
              .agg(F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"),
                   F.count(F.lit(1)).alias("total_messages"))
              .withColumn("file_name", F.concat(
                  F.lit("tg_"), F.coalesce(F.col(PART), F.lit("unknown")), F.lit("_"),
                  F.coalesce(F.col("min_id").cast("string"), F.lit("none")), F.lit("_"),
                  F.coalesce(F.col("max_id").cast("string"), F.lit("none")), F.lit(".json"))))


def export_collection(df: DataFrame, path: str, *, fmt: str = "json") -> DataFrame | None:
    """K1: write messages partitioned by channel (JSON lines or Parquet) and return the manifest;
    nothing is written for an empty input (returns None)."""
    if df.isEmpty():
        return None
    (with_partition(df).write.mode("overwrite").partitionBy(PART)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").format(fmt).save(path))
    return collection_manifest(df)


def write_messages(df: DataFrame, path: str) -> None:
    """K2: the combined message table, Parquet partitioned by (channel, id block). Only the
    partitions present in ``df`` are replaced (dynamic partition overwrite), when all of ``df`` is written."""
    (with_store_partition(df.drop(PART, BLOCK)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy(PART, BLOCK).parquet(path))


def write_results(tables: Mapping[str, DataFrame], path: str, *, fmt: str = "parquet") -> None:
    """K3: one dataset per result table, partitioned by channel when the table has one; ``read_results`` has the same default format."""
    for name, t in tables.items():
        w = (with_partition(t) if "channel_username" in t.columns else t).write.mode("overwrite")
        if "channel_username" in t.columns:
            # only the channels of this run are replaced
            w = w.partitionBy(PART).option("partitionOverwriteMode", "dynamic")
        w.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").format(fmt).save(f"{path}/{name}")


def combined_results(tables: Mapping[str, DataFrame]) -> DataFrame:
    """K4: many result tables as one (table, channel_username, row_json) dataset."""
    out = None
    for name, t in tables.items():
        ch = F.col("channel_username") if "channel_username" in t.columns else F.lit(None).cast("string")
        part = t.select(F.lit(name).alias("table"), ch.alias("channel_username"),
                        F.to_json(F.struct(*[F.col(c) for c in t.columns])).alias("row_json"))
        out = part if out is None else out.unionByName(part)
    return out


def write_combined_results(tables: Mapping[str, DataFrame], path: str) -> None:
    combined_results(tables).write.mode("overwrite").partitionBy("table").json(path)


def import_messages(df: DataFrame, store_path: str | None, *, stored: DataFrame | None = None,
                    skip_duplicates: bool = True, dry_run: bool = False, validate_only: bool = False,
                    limit: int | None = None, batch_size: int = 100) -> dict:
    """K5: validate -> type and normalise values (C4) -> skip already stored keys and repeated keys of the batch -> append.

    ``limit`` keeps the first n messages in (channel, id) order (the reference's --limit).
    Counts come from Observations on the rows while they are written, or from aggregations of
    the same rows for ``dry_run`` / ``validate_only`` (nothing written).
    """
    rows = df
    if limit is not None:
        rows = rows.orderBy("channel_username", "message_id").limit(limit)
    tagged = rows.withColumn("_code", validate.reject_code(rows))
    valid = F.col("_code").isNull()
    metrics = [F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid")]
    writes = not (validate_only or dry_run or store_path is None)
    obs, obs_new = Observation(), Observation()
    typed = clean.typed_messages((tagged.observe(obs, *metrics) if writes else tagged).where(valid))
    if skip_duplicates:
        typed = merge.skip_existing(typed, stored) if stored is not None else typed
        # of equal keys in the batch the first is imported: by lineage where the rows have one, else by content
        order = [c for c in ("source_file", "split_pos", "doc_pos", "msg_pos") if c in typed.columns] + [f for f in MESSAGE_COLUMNS if f in typed.columns]
        typed = merge.keep_first(typed, order)
    out = clean.import_strings(clean.store_projection(typed))
    if writes:
        out = with_store_partition(out.observe(obs_new, F.count(F.lit(1)).alias("new")))
        out.write.mode("append").partitionBy(PART, BLOCK).parquet(store_path)
        m, would = obs.get, obs_new.get["new"]
        imported = would
    else:
        m, imported, would = tagged.agg(*metrics).first(), 0, out.count()
    return {"total": m["total"], "valid": m["valid"], "invalid": m["total"] - m["valid"], "imported": imported,
            "would_import": would, "skipped": m["valid"] - would, "batches": -(-would // batch_size),
            "dry_run": dry_run, "validate_only": validate_only}


def write_report_json(rep: DataFrame, path: str) -> None:
    """K6: the report JSON text per channel."""
    rep.select("report_json").write.mode("overwrite").text(path)


def write_converted(good: DataFrame, counts: DataFrame, path: str) -> DataFrame | None:
    """K7: converted legacy messages as a collection, plus the success / failed counts."""
    manifest = export_collection(good.select(*[c for c in good.columns if c in clean.STORE_BASE + clean.STORE_OPTIONAL]),
                                 f"{path}/messages")
    counts.write.mode("overwrite").json(f"{path}/conversion_counts")
    return manifest

"""Set operations, de-duplication and incremental merge.

Keep-latest (U2) is an aggregation, not a window: ``max_by(row, (load order, position))`` per
(channel, message_id). The aggregation is partial on the map side, so a key that appears
millions of times (all null ids of a channel, Q18) is reduced inside each task before the
shuffle and never sorted as one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.operators.topk import BY

KEY = ("channel_username", "message_id")


def union_loads(*frames: DataFrame) -> DataFrame:
    """Existing + new rows, schema-tolerant (missing columns become null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_latest(df: DataFrame, order: Sequence[str | Column], *, key: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the one with the greatest ``order`` tuple (later load, later
    position wins). Null ids form one key per channel, as in the reference (Q18)."""
    cols = [c for c in df.columns]
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    payload = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*key).agg(F.max_by(payload, ordering).alias("_row"))
              .select(*[F.col(f"_row.{c}").alias(c) for c in cols]))


def keep_first(df: DataFrame, order: Sequence[str | Column], *, key: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the one with the smallest ``order`` tuple."""
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    payload = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(payload, ordering).alias("_row")).select("_row.*")


def dedup_report(before: DataFrame, after: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """U2 count of removed duplicates per channel (rows before - rows after)."""
    b = before.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_after"))
    return (b.join(a, list(by), "left").fillna(0, ["rows_after"])
             .withColumn("removed", F.col("rows_before") - F.col("rows_after")))


def combine_summary(existing: DataFrame, new: DataFrame, combined: DataFrame | None = None, *,
                    counted: DataFrame | None = None, by: Sequence[str] = BY, key: Sequence[str] = KEY) -> DataFrame:
    """Per channel: existing rows, new rows, rows after combine, new messages added
    (keys not present before), duplicates removed, status created / updated / no_new_files.

    ``existing`` may be the part of the store that ``new`` can meet; ``counted`` then has the ``rows`` of the whole store
    (one row or several a channel). Without ``combined``, the rows after combine are the stored ones, unique by key, plus those added.
    Null channels and null ids are values like others."""
    count = F.count(F.lit(1))
    keys = (new.select(*key, F.lit(True).alias("new")).unionByName(existing.select(*key, F.lit(False).alias("new")))
               .groupBy(*key).agg(F.every("new").alias("added")))
    parts = [(existing.groupBy(*by).agg(count.alias("existing_messages")) if counted is None
              else counted.groupBy(*by).agg(F.sum("rows").alias("existing_messages"))),
             new.groupBy(*by).agg(count.alias("new_rows")),
             keys.groupBy(*by).agg(F.count_if("added").alias("new_messages_added"))]
    if combined is not None:
        parts.append(combined.groupBy(*by).agg(count.alias("total_messages")))
    sums = ["existing_messages", "new_rows", "new_messages_added"] + ["total_messages"] * (combined is not None)
    out = union_loads(*parts).groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    if combined is None:
        out = out.withColumn("total_messages", F.col("existing_messages") + F.col("new_messages_added"))
    status = (F.when(F.col("existing_messages") == 0, "created")
               .when(F.col("new_rows") > 0, "updated").otherwise("no_new_files"))
    return out.withColumn("duplicates_removed", F.col("existing_messages") + F.col("new_rows") - F.col("total_messages")) \
              .withColumn("status", status)


def id_ranges(df: DataFrame, *, by: Sequence[str] = BY, unit: Sequence[str] = ("source_file",)) -> DataFrame:
    """U4: [min, max] message id per loaded unit (file) of a channel."""
    return df.groupBy(*by, *unit).agg(F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"),
                                      F.count(F.lit(1)).alias("messages"))


def lineage(ranges: DataFrame, *, by: Sequence[str] = BY, unit: str = "source_file") -> DataFrame:
    """U4: per channel the sorted list of [min, max] ranges, the source units and the overall
    range 'min-max'. One entry per file: bounded by the number of files, not rows."""
    return ranges.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.array("min_id", "max_id"))).alias("message_id_ranges"),
        F.sort_array(F.collect_list(unit)).alias("source_files"),
        F.concat_ws("-", F.min("min_id").cast("string"), F.max("max_id").cast("string")).alias("overall_range"))


def coalesce_ranges(ranges: DataFrame, *, by: Sequence[str] = BY, span: int = 10_000_000) -> DataFrame:
    """U4: the id ranges of a ledger melted into islands without a gap, per channel: ``min_id, max_id, ranges, messages, first_load, last_load``.

    Ranges meet when they overlap or follow each other. A first pass melts them inside spans of ids, so that a channel of very many files is not
    sorted in one task; what is left, at most a few islands a span, is melted again. Ranges without ids are left out."""
    def melt(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("min_id", "max_id")
        before = F.max("max_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.coalesce((F.col("min_id") > before + 1).cast("long"), F.lit(1))
        island = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return (rows.withColumn("_starts", starts).withColumn("_island", island).groupBy(*keys, "_island")
                .agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("ranges").alias("ranges"), F.sum("messages").alias("messages"),
                     F.min("first_load").alias("first_load"), F.max("last_load").alias("last_load")).drop("_island"))

    rows = ranges.where(F.col("min_id").isNotNull()).select(*by, "min_id", "max_id", F.lit(1).cast("long").alias("ranges"), "messages",
                                                            F.col("load").alias("first_load"), F.col("load").alias("last_load"))
    spans = rows.withColumn("_span", F.floor(F.col("min_id") / span))
    return melt(melt(spans, [*by, "_span"]).drop("_span"), list(by))


def changed_rows(left: DataFrame, right: DataFrame, *, key: Sequence[str] = KEY, compare: Sequence[str]) -> DataFrame:
    """Rows in which two sources differ, with ``status`` (only_left, only_right, changed), taken from the right where it has the key.

    Only keys and a 128-bit hash of the compared values are shuffled to find them; whole rows move for the keys that differ alone. Keys are unique on each side."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        values = F.to_json(F.struct(*compare), {"ignoreNullFields": "false"})
        return df.select(*key, F.md5(values.cast("binary")).alias(name))

    on = F.lit(True)
    for k in key:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = hashed(left, "l_hash").alias("l").join(hashed(right, "r_hash").alias("r"), on, "full_outer")
    status = F.when(F.col("r_hash").isNull(), "only_left").when(F.col("l_hash").isNull(), "only_right").otherwise("changed")
    differ = both.where(~F.col("l_hash").eqNullSafe(F.col("r_hash"))).select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in key], status.alias("status"))

    def whole(df: DataFrame, which: Column) -> DataFrame:
        same = F.lit(True)
        for k in key:
            same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"d.{k}"))
        return df.alias("x").join(differ.where(which).alias("d"), same).select(*[F.col(f"x.{c}").alias(c) for c in df.columns], F.col("d.status").alias("status"))

    return whole(right, F.col("status") != "only_left").unionByName(whole(left, F.col("status") == "only_left"), allowMissingColumns=True)


def range_overlaps(ranges: DataFrame, *, by: Sequence[str] = BY, unit: str = "source_file") -> DataFrame:
    """Gaps-and-islands over id ranges. For each range (ordered by min, max, unit) the running
    maximum of earlier ranges decides: overlap (starts at or below it), gap (starts more than one
    above it) or contiguous. Window partitions hold one row per file of a channel."""
    w = Window.partitionBy(*by).orderBy("min_id", "max_id", unit)
    prev_max = F.max("max_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (ranges.withColumn("prev_max_id", prev_max)
                  .withColumn("relation", F.when(F.col("prev_max_id").isNull(), "first")
                              .when(F.col("min_id") <= F.col("prev_max_id"), "overlap")
                              .when(F.col("min_id") > F.col("prev_max_id") + 1, "gap")
                              .otherwise("contiguous"))
                  .withColumn("overlap_ids", F.when(F.col("relation") == "overlap",
                              F.least("max_id", "prev_max_id") - F.col("min_id") + 1).otherwise(0))
                  .withColumn("gap_ids", F.when(F.col("relation") == "gap",
                              F.col("min_id") - F.col("prev_max_id") - 1).otherwise(0)))


def skip_existing(new: DataFrame, stored: DataFrame, *, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (left anti join; the stored side is
    projected to the key columns so only keys are shuffled)."""
    return new.join(stored.select(*key).distinct(), list(key), "left_anti")


def source_diff(left: DataFrame, right: DataFrame, *, key: Sequence[str] = KEY,
                compare: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the key; status only_left / only_right / changed / same, comparing
    ``compare`` columns null-safely (<=>). Of strings the length and a 128-bit hash move and are compared, not the strings."""
    compare = list(compare or [c for c in left.columns if c not in key and c in right.columns])

    def value(df: DataFrame, c: str) -> Column:
        """What is equal where the values are; null for null."""
        if df.schema[c].dataType.typeName() != "string":
            return F.col(c)
        raw = F.col(c).cast("binary")
        return F.when(raw.isNotNull(), F.struct(F.octet_length(raw).alias("n"), F.md5(raw).alias("h")))

    lsel = left.select(*key, *[value(left, c).alias(f"l_{c}") for c in compare], F.lit(True).alias("_l"))
    rsel = right.select(*key, *[value(right, c).alias(f"r_{c}") for c in compare], F.lit(True).alias("_r"))
    j = lsel.join(rsel, list(key), "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    status = (F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right")
               .when(same, "same").otherwise("changed"))
    changed = F.filter(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in compare]),
                       lambda x: x.isNotNull())
    return j.select(*key, status.alias("status"),
                    F.when(status == "changed", changed).alias("changed_columns"))

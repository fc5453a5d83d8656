"""Roll-ups, comparisons, reports and chart datasets.

Everything here is built from the metric tables of the other operators; nothing re-reads raw
files (Q10, Q15). Metric tables hold one row (or k rows) per channel, so the joins below are
between small tables (Spark broadcasts them after measuring their size, or shuffles).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import MIB, MONTH_NAMES, non_blank, pct, round_half_even
from chatlens.operators import content, files, people, profile
from chatlens.operators.topk import BY

SOURCE_TYPES = ("file", "db", "diff")


def channel_rollup(df: DataFrame, *, by: str = "channel_username") -> DataFrame:
    """Messages, files (size > 0) and bytes per channel plus a grand-total row
    (``channel_username`` null, ``level`` 1) carrying the channel count. Rolled up from the
    per-channel table, so the Expand of ROLLUP runs on one row per channel."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("messages"),
                             F.count_if(F.col("file_size") > 0).alias("files"),
                             F.coalesce(F.sum(F.when(F.col("file_size") > 0, F.col("file_size"))), F.lit(0)).alias("bytes"))
    return (per.rollup(by).agg(F.sum("messages").alias("total_messages"), F.sum("files").alias("total_files"),
                               F.sum("bytes").alias("total_bytes"), F.count(F.lit(1)).alias("channels"),
                               F.grouping_id().cast("bigint").alias("level")))


def source_breakdown(df: DataFrame, *, source: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Messages and files per source type, every type of every channel present (zeros)."""
    src = F.col(source) if source else F.lit("file")
    counts = (df.select(*by, src.alias("source"), "file_size").groupBy(*by, "source")
                .agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("file_size") > 0).alias("files")))
    spine = df.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(s) for s in SOURCE_TYPES])).alias("source"))
    return (spine.join(counts, list(by) + ["source"], "left")
                 .select(*by, "source", F.coalesce("messages", F.lit(0)).alias("messages"),
                         F.coalesce("files", F.lit(0)).alias("files")))


def source_cube(sources: dict[str, DataFrame], *, by: str = "channel_username") -> DataFrame:
    """A26 over real sources: messages and files for each channel and source, each channel, each source and all (``level`` 0, 1, 2, 3: which of
    channel (2) and source (1) are summed up). Every source of every channel is there, with zeros where it has none.

    The cube is taken over the counts by channel and source, not over the rows."""
    rows = None
    for name, df in sources.items():
        part = df.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("file_size") > 0).alias("files")).withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    empty = F.explode(F.array(*[F.lit(s) for s in sources])).alias("source")
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(rows.select(by).distinct().select(by, empty, zero.alias("messages"), zero.alias("files")))
    return rows.cube(by, "source").agg(F.sum("messages").alias("messages"), F.sum("files").alias("files"), F.grouping_id().alias("level"))


def channel_metrics(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Long metric table (channel, metric, value) used by run comparison."""
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(non_blank("text")).alias("messages_with_text"),
        F.count_if(non_blank("media_type")).alias("media_messages"),
        F.count_if(F.col("file_size") > 0).alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("file_size") > 0, F.col("file_size"))), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"))
    names = ["total_messages", "messages_with_text", "media_messages", "total_files", "total_bytes", "total_views"]
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value"))
                                                for n in names])).alias("m")).select(*by, "m.*")


def run_compare(current: DataFrame, previous: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Current vs previous value of every metric, difference (null side = 0)."""
    c = channel_metrics(current, by=by).withColumnRenamed("value", "current")
    p = channel_metrics(previous, by=by).withColumnRenamed("value", "previous")
    j = c.join(p, list(by) + ["metric"], "full_outer")
    return (j.select(*by, "metric", F.coalesce("current", F.lit(0)).alias("current"),
                     F.coalesce("previous", F.lit(0)).alias("previous"))
             .withColumn("difference", F.col("current") - F.col("previous")))


def media_breakdown(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Messages per media type (all non-empty types, 'text' included)."""
    return (df.where(non_blank("media_type")).groupBy(*by, "media_type")
              .agg(F.count(F.lit(1)).alias("count")))


def media_summary(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Total media (non-empty type other than 'text'), share of messages, storage in MiB."""
    is_media = non_blank("media_type") & (F.col("media_type") != "text")
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_messages"),
                                F.count_if(is_media).alias("total_media"),
                                round_half_even(F.coalesce(F.sum("file_size"), F.lit(0)) / float(MIB), 2).alias("storage_mb"))
              .withColumn("media_percentage", pct("total_media", "total_messages", 2)))


def channel_overview(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """One row per channel assembled from metric tables by left joins on the channel spine."""
    spine = df.select(*by).distinct()
    cs = content.content_stats(df, by=by).select(*by, "total_messages", "messages_with_text", "media_messages")
    fs = files.file_summary(df, by=by).select(*by, "total_files", "total_storage_mb")
    en = people.engagement(df, by=by).select(*by, "total_views", "total_forwards", "total_replies")
    cr = people.creator_stats(df, by=by).select(*by, "total_creators")
    ht = content.token_totals(df, "hashtag", by=by).select(*by, "total_unique_hashtags")
    out = spine
    for t in (cs, fs, en, cr, ht):
        out = out.join(t, list(by), "left")
    return out.fillna(0, ["total_files", "total_creators", "total_unique_hashtags"]).fillna(0.0, ["total_storage_mb"])


def report_status(df: DataFrame, requested: DataFrame | None = None, *, by: str = "channel_username") -> DataFrame:
    """One row per requested channel: success with its message count, or failed with a reason."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("messages"))
    spine = requested if requested is not None else df.select(by).distinct()
    return (spine.join(counts, by, "left")
                 .select(by, F.coalesce("messages", F.lit(0)).alias("messages"),
                         F.when(F.col("messages") > 0, "success").otherwise("failed").alias("status"),
                         F.when(F.col("messages").isNull(), "no messages found").alias("reason")))


def _top_list(t: DataFrame, key: str, count: str = "count", by: Sequence[str] = BY) -> DataFrame:
    """Top-k rows (already <= k per channel) nested as a sorted array of structs."""
    return t.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", key, count))).alias(f"top_{key}s"))


def report(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Comprehensive per-channel report, nested like the reference's result files, as a
    struct column plus its JSON text. Lists are the top-k tables (bounded by k)."""
    spine = df.select(*by).distinct()
    parts = {
        "content_statistics": content.content_stats(df, by=by),
        "creator_message_stats": people.creator_stats(df, by=by),
        "duplicate_filename_detection": files.filename_duplicates(df, by=by),
        "filename_length": files.filename_length_stats(df, by=by),
        "duplicate_filesize_detection": files.filesize_duplicates(df, by=by),
        "urls": content.url_totals(df, by=by),
        "engagement": people.engagement(df, by=by),
    }
    lists = {
        "hashtags": _top_list(content.top_tokens(df, "hashtag", 10, by=by), "hashtag", by=by),
        "mentions": _top_list(content.top_tokens(df, "mention", 10, by=by), "mention", by=by),
        "emojis": _top_list(content.top_tokens(df, "emoji", 10, by=by), "emoji", by=by),
        "domains": _top_list(content.url_domains_top(df, 5, by=by), "domain", by=by),
        "creators": _top_list(people.creators_top(df, 10, by=by), "username", "message_count", by=by),
        "extensions": _top_list(files.extensions_top(df, 10, by=by), "ext", by=by),
        "filenames": _top_list(files.filename_top(df, 10, by=by), "filename", by=by),
    }
    out = spine
    for name, t in parts.items():
        cols = [c for c in t.columns if c not in by]
        out = out.join(t.select(*by, F.struct(*cols).alias(name)), list(by), "left")
    for name, t in lists.items():
        lst = t.columns[-1]
        empty = F.array_compact(F.array(F.lit(None).cast(t.schema[lst].dataType.elementType)))
        out = (out.join(t.select(*by, F.col(lst).alias(name)), list(by), "left")
                  .withColumn(name, F.coalesce(F.col(name), empty)))  # structured empty list, as the reference
    body = F.struct(*[F.col(c) for c in list(parts) + list(lists)])
    return out.select(*by, body.alias("report"), F.to_json(body).alias("report_json"))


def validate_report(rep: DataFrame, *, max_chars: int = 1_000_000,
                    required: Sequence[str] = ("content_statistics", "hashtags", "engagement")) -> DataFrame:
    """V8: serialised size within the payload limit and required sections present."""
    present = F.lit(True)
    for r in required:
        present = present & F.col(f"report.{r}").isNotNull()
    return rep.select("channel_username", F.length("report_json").alias("json_chars"),
                      (F.length("report_json") <= max_chars).alias("within_limit"), present.alias("has_required"))


# ------------------------------------------------------------------------------- chart datasets
# Names of the chart datasets.
CHARTS = ("file_uniqueness", "file_languages", "emojis", "file_sizes", "file_types", "hashtags", "timeline", "monthly", "sources", "mentions", "urls", "languages", "contributors")


def charts_long(df: DataFrame, names: Sequence[str] | None = None, *, by: Sequence[str] = BY) -> DataFrame:
    """G1-G13 in one tidy table: (channel, chart, ord, label, value), from one pass over the messages."""
    out = profile.charts(profile.profile(df, by=by), by=by)
    return out if names is None else out.where(F.col("chart").isin(*names))


def _one_chart(name: str):
    def chart(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
        return charts_long(df, [name], by=by)
    return chart


# One chart dataset alone, by its name.
(chart_file_uniqueness, chart_file_languages, chart_emojis, chart_file_sizes, chart_file_types, chart_hashtags, chart_timeline, chart_monthly, chart_sources,
 chart_mentions, chart_urls, chart_languages, chart_contributors) = map(_one_chart, CHARTS)


__all__ = ["channel_rollup", "source_breakdown", "run_compare", "media_breakdown", "media_summary", "channel_overview",
           "report_status", "report", "validate_report", "charts_long", "CHARTS", "MONTH_NAMES"]


def global_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of every row by ``value``, highest first, over all rows, and no task that sees all of them.

    Rows are dealt out by ranges of the value (equal values share a range), ranked inside their range, and the rows of the ranges before are
    added: one count a range reaches the driver."""
    from chatlens.session import cut_lineage
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, F.col(value).desc()).withColumn("_range", F.spark_partition_id()), "global-rank")
    before, offsets = 0, []
    for k, n in sorted(map(tuple, ranged.groupBy("_range").count().collect())):
        offsets.append((k, before))
        before += n
    inside = F.rank().over(Window.partitionBy("_range").orderBy(F.col(value).desc()))
    table = spark.createDataFrame(offsets, "_range int, _before long")
    return ranged.join(F.broadcast(table), "_range").withColumn(name, (inside + F.col("_before")).cast("bigint")).drop("_range", "_before")


def channel_comparison(df: DataFrame, *, by: str = "channel_username") -> DataFrame:
    """Channels side by side with their rank by messages, views and files, over however many channels there are."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("messages"),
                             F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
                             F.count_if(F.col("file_size") > 0).alias("files"))
    for m in ("messages", "views", "files"):
        out = global_rank(out, m, f"rank_{m}")
    return out

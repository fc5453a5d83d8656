"""Creators and engagement: A16, X5, X7, X13, X19 forward edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.expr import extension, non_blank, ratio, round_half_even
from chatlens.operators.topk import BY, key_counts, top_k, top_k_by_count, with_share


def creator_counts(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return key_counts(df, "creator_username", by=by, name="username", count_col="message_count")


def creator_stats(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A16 totals: distinct creators, messages with a creator, mean messages per creator."""
    return (creator_counts(df, by=by).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("total_creators"), F.sum("message_count").alias("total_messages"))
            .withColumn("avg_messages_per_creator", ratio("total_messages", "total_creators", 2)))


def creators_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """A16 most active creators with their share of creator messages (2 dp)."""
    counts = creator_counts(df, by=by)
    totals = counts.groupBy(*by).agg(F.sum("message_count").alias("total"))
    top = top_k_by_count(counts, k, key="username", count_col="message_count", by=by)
    return with_share(top, totals, count_col="message_count", by=by) \
        .select(*by, "rank", "username", "message_count", "percentage")


ENGAGEMENT = ("views", "forwards", "replies")


def engagement(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Totals and per-message means of views, forwards, replies (missing counts as 0)."""
    aggs = []
    for c in ENGAGEMENT:
        v = F.coalesce(F.col(c), F.lit(0))
        aggs += [F.sum(v).alias(f"total_{c}"), round_half_even(F.avg(v), 2).alias(f"avg_{c}")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_messages"), *aggs)


def correlation(df: DataFrame, *, by: Sequence[str] = BY, digits: int = 6) -> DataFrame:
    """Pearson correlation of text length, file size and hour of day with engagement."""
    x = {"text_length": F.length("text").cast("double"), "file_size": F.col("file_size").cast("double"),
         "hour": F.hour("date").cast("double")}
    aggs = []
    for xn, xc in x.items():
        for yn in ("views", "forwards", "replies"):
            yc = F.col(yn).cast("double")
            # corr() divides by the product of deviations and raises under ANSI when one side is
            # constant; a constant side has no correlation, so it is NULL here.
            flat = (F.stddev_pop(xc) == 0) | (F.stddev_pop(yc) == 0)
            c = F.when(~flat, F.try_divide(F.covar_pop(xc, yc), F.stddev_pop(xc) * F.stddev_pop(yc)))
            aggs.append(round_half_even(c, digits).alias(f"corr_{xn}_{yn}"))
    return df.groupBy(*by).agg(*aggs)


def engagement_by_type(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Mean engagement per media type and per file extension."""
    kinds = F.explode(F.array(
        F.struct(F.lit("media_type").alias("dimension"), F.col("media_type").alias("value")),
        F.struct(F.lit("extension").alias("dimension"), extension("file_name").alias("value")),
    ))
    return (df.select(*by, *ENGAGEMENT, kinds.alias("k")).select(*by, *ENGAGEMENT, "k.*")
              .where(non_blank("value"))
              .groupBy(*by, "dimension", "value")
              .agg(F.count(F.lit(1)).alias("messages"),
                   *[round_half_even(F.avg(F.coalesce(F.col(c), F.lit(0))), 2).alias(f"avg_{c}") for c in ENGAGEMENT]))


def popular_files(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """The k most viewed files (views desc, message_id asc)."""
    files = df.where(non_blank("file_name")).select(*by, "message_id", "file_name", "file_size", "views")
    return top_k(files, k, by=by, order=[F.col("views").desc_nulls_last(), F.col("message_id").asc()]) \
        .select(*by, "rank", "message_id", "file_name", "file_size", "views")


def forward_edges(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Forwarding graph edges (source channel -> channel) with message counts."""
    return (df.where(F.col("is_forwarded") & non_blank("forwarded_from"))
              .groupBy(F.col("forwarded_from").alias("source"), *by)
              .agg(F.count(F.lit(1)).alias("messages"), F.sum(F.coalesce("views", F.lit(0))).alias("views")))

"""Time profiles: daily timeline (A17), down-sampled timeline (A18), monthly histogram (A19),
year-month table, channel info (X1), temporal activity (X3), month-over-month trend (X19).

All counts come from the cleaned timestamp column (rows without a date are not counted) of the
de-duplicated table, with exact channel names (Q9-Q11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import MONTH_NAMES, round_half_even
from chatlens.operators.topk import BY, every_nth


def dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull())


def daily(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Messages per calendar day ('yyyy-MM-dd')."""
    return (dated(df).groupBy(*by, F.date_format("date", "yyyy-MM-dd").alias("day"))
                     .agg(F.count(F.lit(1)).alias("count")))


def daily_sampled(df: DataFrame, max_points: int = 100, *, by: Sequence[str] = BY) -> DataFrame:
    """When a channel has more than ``max_points`` days keep every (days // max_points)-th
    day in date order (point pick). Operates on the per-day table (one row per channel-day)."""
    return every_nth(daily(df, by=by), "day", max_points=max_points, by=by)


def monthly_histogram(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """12 calendar months per channel, summed across years, zero-filled, labels Jan..Dec."""
    counts = dated(df).groupBy(*by, F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("count"))
    spine = (dated(df).select(*by).distinct()
             .select(*by, F.posexplode(F.array(*[F.lit(m) for m in MONTH_NAMES])).alias("pos", "label"))
             .withColumn("month", F.col("pos") + 1).drop("pos"))
    return (spine.join(counts, list(by) + ["month"], "left")
                 .select(*by, F.col("month").cast("bigint").alias("month"), "label",
                         F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def year_month(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A19 companion: messages per 'yyyy-MM'."""
    return (dated(df).groupBy(*by, F.date_format("date", "yyyy-MM").alias("year_month"))
                     .agg(F.count(F.lit(1)).alias("count")))


def channel_info(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Total messages, first and last date, active days (distinct calendar days)."""
    main = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_messages"),
                               F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    days = daily(df, by=by).groupBy(*by).agg(F.count(F.lit(1)).alias("active_days"))
    return main.join(days, list(by), "left").fillna(0, ["active_days"])


def temporal_activity(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Monthly, daily and hourly counts in one pass (the GROUPING SETS of the three keys):
    each row contributes one (granularity, key) per level, aggregated by one shuffle."""
    levels = F.explode(F.array(
        F.struct(F.lit("monthly").alias("granularity"), F.date_format("date", "yyyy-MM").alias("period")),
        F.struct(F.lit("daily").alias("granularity"), F.date_format("date", "yyyy-MM-dd").alias("period")),
        F.struct(F.lit("hourly").alias("granularity"), F.date_format("date", "HH").alias("period")),
    ))
    return (dated(df).select(*by, levels.alias("l")).select(*by, "l.*")
                     .groupBy(*by, "granularity", "period").agg(F.count(F.lit(1)).alias("count")))


def activity_by_hour(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """X3 hourly view: messages per hour of day (0-23) with the share of the channel's messages."""
    h = dated(df).groupBy(*by, F.hour("date").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy(*by))  # <= 24 rows per channel
    return h.withColumn("percentage", round_half_even(F.col("count") * 100.0 / tot, 2))


def monthly_trend(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """X19 trends: month-over-month change of message counts (lag over the per-month table)."""
    ym = year_month(df, by=by)
    prev = F.lag("count").over(Window.partitionBy(*by).orderBy("year_month"))
    return (ym.withColumn("previous", prev)
              .withColumn("change", F.col("count") - F.col("previous"))
              .withColumn("change_pct", round_half_even(F.try_divide((F.col("count") - F.col("previous")) * 100.0,
                                                                     F.col("previous")), 2)))

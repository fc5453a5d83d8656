"""Top-k, share-of-total and every-n-th helpers.

Top-k is ``row_number() over (partition by <group> order by <count> desc, <key> asc) <= k``.
Spark rewrites that filter into a WindowGroupLimit that runs *before* the shuffle, so each task
sends at most k rows per group to the window stage: the window never sees a whole hot channel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import pct

BY = ("channel_username",)


def key_counts(df: DataFrame, key: str | Column, *, by: Sequence[str] = BY, name: str = "key",
               count_col: str = "count", drop_null: bool = True) -> DataFrame:
    """groupBy(by, key).count() with map-side partial aggregation; null keys dropped.

    ``drop_null=False`` for keys that are never null but costly to compute: a filter on a
    computed column is pushed below its projection with the expression inlined, which would
    evaluate it twice."""
    k = F.col(key) if isinstance(key, str) else key
    rows = df.select(*by, k.alias(name))
    if drop_null:
        rows = rows.where(F.col(name).isNotNull())
    return rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias(count_col))


def top_k(counts: DataFrame, k: int, *, by: Sequence[str] = BY, order: Sequence[Column],
          rank_col: str = "rank") -> DataFrame:
    """Keep the first k rows per group under ``order`` (which must be a total order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (counts.withColumn("_rn", F.row_number().over(w))
                  .where(F.col("_rn") <= k)
                  .withColumn(rank_col, F.col("_rn").cast("bigint")).drop("_rn"))


def top_k_by_count(counts: DataFrame, k: int, *, key: str = "key", count_col: str = "count",
                   by: Sequence[str] = BY) -> DataFrame:
    """Count desc, then key asc (deterministic tie rule, Q3)."""
    return top_k(counts, k, by=by, order=[F.col(count_col).desc(), F.col(key).asc()])


def with_share(rows: DataFrame, totals: DataFrame, *, count_col: str = "count", total_col: str = "total",
               out: str = "percentage", by: Sequence[str] = BY, digits: int = 2) -> DataFrame:
    """T4: count / group total * 100. ``totals`` holds one row per group (small), so the join
    is a broadcast when its measured size allows and a shuffle otherwise."""
    return (rows.join(totals.select(*by, total_col), list(by), "left")
                .withColumn(out, pct(F.col(count_col), F.col(total_col), digits))
                .drop(total_col))


def every_nth(df: DataFrame, order_col: str, *, max_points: int = 100, by: Sequence[str] = BY) -> DataFrame:
    """When a group has more than ``max_points`` rows keep every (n // max_points)-th row
    (point pick, not re-aggregation). Groups here are per-day rows of a channel (bounded)."""
    w = Window.partitionBy(*by).orderBy(order_col)
    wn = Window.partitionBy(*by)
    step = F.when(F.col("_n") > max_points, F.floor(F.col("_n") / max_points)).otherwise(F.lit(1))
    return (df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(wn))
              .where((F.col("_rn") - 1) % step == 0).drop("_rn", "_n"))

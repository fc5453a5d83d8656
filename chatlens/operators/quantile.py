"""Exact quantiles (linear interpolation, like ``percentile``/``quantile_cont``) without buffering a
group in one task.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in one aggregation
buffer; for a hot channel with billions of distinct file sizes that is unbounded. Here the
values are first collapsed to a (group, value, count) table with partial aggregation, then
the ranks are located by *radix select* over the 64-bit key: four passes, each building a
histogram of the next 16 bits restricted to the prefixes still in play (at most 65,536 rows
per group and target). Every step is a shuffle aggregation or a join against a table whose
size is bounded by groups x targets, so no task holds more than one histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.operators.topk import BY

_SIGN = -9223372036854775808  # flips the sign bit so unsigned order equals signed order
_MASK = (1 << 64) - 1


def _digit(u: int, level: int) -> int:
    return (u >> (48 - 16 * level)) & 0xFFFF


def _signed(u: int) -> int:
    return u - (1 << 64) if u >= (1 << 63) else u


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = BY,
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one double column per probability (interpolated at (n-1)*p)."""
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(*by, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
                .select(*by, F.col("_v").bitwiseXOR(F.lit(_SIGN)).alias("_k"), "_c"))
    counts = counts.persist()
    # 16-bit digits shared by every key (the global minimum and maximum agree on them) are the
    # same for all targets, so those passes are skipped; one scalar aggregation finds them.
    b = (counts.agg(F.min(F.col("_k").bitwiseXOR(F.lit(_SIGN))).alias("lo"),
                    F.max(F.col("_k").bitwiseXOR(F.lit(_SIGN))).alias("hi")).first())
    if b["lo"] is None:
        empty = counts.groupBy(*by).agg(*[F.lit(None).cast("double").alias(nm) for nm in names])
        return empty.limit(0)
    lo_u, hi_u = (b["lo"] ^ _SIGN) & _MASK, (b["hi"] ^ _SIGN) & _MASK
    start_level = 0
    while start_level < 4 and _digit(lo_u, start_level) == _digit(hi_u, start_level):
        start_level += 1
    prefix0 = _signed(lo_u >> (64 - 16 * start_level)) if start_level else 0
    n = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(p)).alias("_p"))
                            for i, p in enumerate(probs)]))
    tg = (n.select(*by, "_n", q.alias("t")).select(*by, "_n", "t.*")
           .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("_p")))
    side = F.explode(F.array(F.struct(F.lit(0).alias("_w"), F.floor("_h").alias("_r")),
                             F.struct(F.lit(1).alias("_w"), F.ceil("_h").alias("_r"))))
    state = (tg.select(*by, "_q", "_h", side.alias("s")).select(*by, "_q", "_h", "s.*")
               .withColumn("_pfx", F.lit(prefix0).cast("bigint")))
    for level in range(start_level, 4):
        digit = F.shiftrightunsigned("_k", 48 - 16 * level).bitwiseAND(F.lit(0xFFFF))
        if level == start_level:
            hist = (counts.groupBy(*by, digit.alias("_d")).agg(F.sum("_c").alias("_hc"))
                          .withColumn("_pfx", F.lit(prefix0).cast("bigint")))
        else:
            need = state.select(*by, "_pfx").distinct()
            hist = (counts.withColumn("_pfx", F.shiftrightunsigned("_k", 64 - 16 * level))
                          .join(need, by + ["_pfx"], "left_semi")
                          .groupBy(*by, "_pfx", digit.alias("_d")).agg(F.sum("_c").alias("_hc")))
        w = Window.partitionBy(*by, "_pfx").orderBy("_d")
        hist = hist.withColumn("_cum", F.sum("_hc").over(w))
        state = (state.join(hist, by + ["_pfx"])
                      .where((F.col("_cum") - F.col("_hc") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
                      .select(*by, "_q", "_h", "_w",
                              (F.col("_r") - (F.col("_cum") - F.col("_hc"))).alias("_r"),
                              F.shiftleft("_pfx", 16).bitwiseOR(F.col("_d")).alias("_pfx")))
    vals = state.withColumn("_val", F.col("_pfx").bitwiseXOR(F.lit(_SIGN)).cast("double"))
    per_q = (vals.groupBy(*by, "_q", "_h")
                 .agg(F.max(F.when(F.col("_w") == 0, F.col("_val"))).alias("_lo"),
                      F.max(F.when(F.col("_w") == 1, F.col("_val"))).alias("_hi"))
                 .withColumn("_x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))))
    return per_q.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(nm)
                                    for i, nm in enumerate(names)])

"""Validation, quality issues, contracts and row filters.

Validation never drops data silently: ``split_valid`` returns the good rows and a rejects table
that carries a reason code (V12) per row; issue and violation counts are one aggregation pass.
Works on typed frames and on raw frames whose values are still strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.expr import channel_key, non_blank
from chatlens.operators.topk import BY, top_k

# ---- FIXED VALUES: reject / issue codes of the design documents --------------------------------
FILE_CORRUPTED = "FILE_CORRUPTED"
FILE_EMPTY = "FILE_EMPTY"
VALIDATION_MISSING_FIELD = "VALIDATION_MISSING_FIELD"
VALIDATION_INVALID_FORMAT = "VALIDATION_INVALID_FORMAT"
REQUIRED_FOR_IMPORT = ("message_id", "channel_username", "text")
REQUIRED_FOR_ANALYSIS = ("message_id", "channel_username", "date", "text", "creator_username",
                         "media_type", "file_name", "file_size", "views", "forwards", "replies", "is_forwarded")
CRITICAL_COLUMNS = ("message_id", "channel_username", "date")
MAX_TEXT_LENGTH = 4096
MAX_FILE_NAME_LENGTH = 255
MIN_DATE = "2020-01-01 00:00:00"
LARGE_FILE_BYTES = 100 * 1024 * 1024
SOURCES = ("file", "api")
# ------------------------------------------------------------------------------------------------


def _is_string(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.StringType)


def reject_code(df: DataFrame) -> Column:
    """V1: null when the row is valid for import, else the reason code."""
    missing = None
    for c in REQUIRED_FOR_IMPORT:
        cond = F.col(c).isNull() if c in df.columns else F.lit(True)
        missing = cond if missing is None else (missing | cond)
    bad_id = (F.col("message_id").isNotNull() & F.col("message_id").try_cast("bigint").isNull()) \
        if _is_string(df, "message_id") else F.lit(False)
    return (F.when(missing, F.lit(VALIDATION_MISSING_FIELD))
             .when(bad_id, F.lit(VALIDATION_INVALID_FORMAT)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1 split: (valid rows, rejected rows with ``code``). Both are lazy filters of one plan."""
    tagged = df.withColumn("code", reject_code(df))
    return tagged.where(F.col("code").isNull()).drop("code"), tagged.where(F.col("code").isNotNull())


def message_validation(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """V1 counts per channel."""
    code = reject_code(df)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code.isNull()).alias("valid"),
        F.count_if(code.isNotNull()).alias("invalid"),
        F.count_if(code == VALIDATION_MISSING_FIELD).alias("missing_field"),
        F.count_if(code == VALIDATION_INVALID_FORMAT).alias("invalid_format"))


def issue_rules(df: DataFrame, min_text: int = 3) -> list[tuple[str, Column]]:
    """V2 rules as (issue, predicate). String-typed numeric fields are also checked for the
    textual NaN / infinity values the reference flags."""
    rules = [("text too short", F.col("text").isNotNull() & (F.length(F.trim("text")) < min_text)),
             ("negative file size", F.col("file_size").try_cast("double") < 0)]
    for c in ("file_size", "views", "forwards", "replies"):
        if c in df.columns:
            v = F.col(c).try_cast("double")
            rules.append((f"invalid float in {c}", F.isnan(v) | (F.abs(v) == float("inf"))))
    return rules


def quality_issues(df: DataFrame, *, min_text: int = 3, keep: Sequence[str] = ("message_id",),
                   by: Sequence[str] = BY) -> DataFrame:
    """V2: one row per (message, issue)."""
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in issue_rules(df, min_text)])
    return (df.select(*by, *keep, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("issue")))


def quality_issue_counts(df: DataFrame, *, min_text: int = 3, by: Sequence[str] = BY) -> DataFrame:
    return (quality_issues(df, min_text=min_text, by=by).groupBy(*by, "issue")
            .agg(F.count(F.lit(1)).alias("count")))


def dataset_check(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """V3: rows and null counts of the critical columns per channel; missing required columns
    are reported by ``missing_columns`` (schema metadata, no data pass)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"),
                               *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in CRITICAL_COLUMNS
                                 if c in df.columns])


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_FOR_ANALYSIS) -> list[str]:
    return [c for c in required if c not in df.columns]


def contract_violations(df: DataFrame, *, by: Sequence[str] = BY, now: Column | None = None) -> DataFrame:
    """V4: per-channel counts of rows breaking each rule of the message contract."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    neg = None
    for c in ("file_size", "views", "forwards", "replies"):
        cond = F.coalesce(F.col(c) < 0, F.lit(False))
        neg = cond if neg is None else (neg | cond)
    aggs = [
        F.count_if(F.length("text") > MAX_TEXT_LENGTH).alias("text_too_long"),
        F.count_if(F.length("file_name") > MAX_FILE_NAME_LENGTH).alias("file_name_too_long"),
        F.count_if(neg).alias("negative_counts"),
        F.count_if(F.col("date") < F.lit(MIN_DATE).cast("timestamp_ntz")).alias("date_too_old"),
        F.count_if(F.col("date") > now).alias("date_in_future"),
        F.count_if(F.col("date").isNull()).alias("date_missing"),
        F.count_if(F.col("file_size") > LARGE_FILE_BYTES).alias("large_files"),
    ]
    if "source" in df.columns:
        aggs.append(F.count_if(~F.col("source").isin(*SOURCES)).alias("bad_source"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *aggs)


def source_summary(df: DataFrame, *, by: Sequence[str] = BY, source_type: str = "file") -> DataFrame:
    """Records, date range, fixed quality score (0.95) and the completeness score over
    message_id, channel_username and date (non-null values / (3 x rows))."""
    filled = sum(F.count(F.col(c)) for c in ("message_id", "channel_username", "date"))
    return df.groupBy(*by).agg(
        F.lit(source_type).alias("source_type"),
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("date_start"), F.max("date").alias("date_end"),
        F.lit(0.95).alias("quality_score"),
        (filled.cast("double") / (F.count(F.lit(1)) * 3).cast("double")).alias("completeness_score"))


def run_stats(df: DataFrame, *, batch_size: int = 100, min_text: int = 3) -> DataFrame:
    """One-row import / validation statistics (valid, invalid, issues, batches)."""
    code = reject_code(df)
    any_issue = None
    for _, cond in issue_rules(df, min_text):
        c = F.coalesce(cond, F.lit(False))
        any_issue = c if any_issue is None else (any_issue | c)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code.isNull()).alias("valid"),
        F.count_if(code.isNotNull()).alias("invalid"),
        F.count_if(any_issue).alias("rows_with_issues"),
        F.ceil(F.count(F.lit(1)) / float(batch_size)).alias("batches"))


def first_issues(df: DataFrame, n: int = 10, *, min_text: int = 3) -> DataFrame:
    """The first n issues in (channel, message_id) order (a report preview; limit is the feature)."""
    return quality_issues(df, min_text=min_text).orderBy("channel_username", "message_id", "issue").limit(n)


# ------------------------------------------------------------------------------------- filters
def filter_channels(df: DataFrame, channels: str | Sequence[str] = "all") -> DataFrame:
    """V5: comma list or 'all'; names compared without a leading '@' (Q12)."""
    if isinstance(channels, str):
        if channels.strip().lower() == "all":
            return df
        channels = [c for c in channels.split(",") if c.strip()]
    wanted = [c.strip().lstrip("@") for c in channels]
    return df.where(channel_key("channel_username").isin(*wanted))


def filter_channel_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """Wildcard selection ('*' any run, '?' one character), '@' optional."""
    rx = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\Q" + ch + "\\E" for ch in pattern.lstrip("@")) + "$"
    return df.where(channel_key("channel_username").rlike(rx))


def filter_date_range(df: DataFrame, spec: str) -> DataFrame:
    """V10: 'YYYY-MM-DD:YYYY-MM-DD' inclusive of both days; either side may be empty."""
    start, _, end = spec.partition(":")
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("date") >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        cond = cond & (F.col("date") < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz"))
    return df.where(cond)


def filter_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """V9: keep rows whose value is one of the supported values."""
    return df.where(F.col(column).isin(*allowed))


def latest_messages(df: DataFrame, limit: int, *, before_id: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """V6: per channel, the newest ``limit`` messages with id below ``before_id`` (offset)."""
    rows = df if before_id is None else df.where(F.col("message_id") < before_id)
    return top_k(rows, limit, by=by, order=[F.col("message_id").desc()]).drop("rank")


def has_value(c: str) -> Column:
    """V7 predicates: not null and not ''."""
    return non_blank(c)

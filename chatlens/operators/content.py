"""Message content profiles: patterns (A11-A14, X15), content statistics (A15, A22, A23),
content classes (X4, X12, X14).

Pattern extraction is ``explode(regexp_extract_all(text, pattern))`` followed by a
(channel, token) count with map-side partial aggregation: the shuffle carries one row per
distinct token per task, never the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import patterns as P
from chatlens.functions.expr import non_blank, round_half_even, url_domain
from chatlens.operators.topk import BY, key_counts, top_k_by_count

PATTERNS = {"hashtag": P.HASHTAG, "mention": P.MENTION, "url": P.URL, "emoji": P.EMOJI}


def extract_all(text: str | Column, pattern: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))


def scan_text(kind: str) -> Column:
    """Text the pattern is run on. For emojis the ASCII runs that cannot take part in an emoji
    are collapsed first (exact, see patterns.EMOJI_FREE_ASCII_RUN): the supplementary-plane
    emoji classes are the costliest per character, and most text is ASCII."""
    if kind == "emoji":
        t = F.col("text")
        # pure-ASCII text (bytes == characters) holds no emoji: skip its regex work entirely
        return F.when(F.octet_length(t) == F.length(t), F.lit("")).otherwise(
            F.regexp_replace(t, P.EMOJI_FREE_ASCII_RUN, " "))
    return F.col("text")


def tokens(df: DataFrame, kind: str, *, by: Sequence[str] = BY, name: str | None = None) -> DataFrame:
    """One row per occurrence of a pattern in ``text`` (hashtag / mention / url / emoji)."""
    name = name or kind
    return (df.where(non_blank("text"))
              .select(*by, F.explode(extract_all(scan_text(kind), PATTERNS[kind])).alias(name)))


def token_counts(df: DataFrame, kind: str, *, by: Sequence[str] = BY) -> DataFrame:
    return key_counts(tokens(df, kind, by=by), kind, by=by, name=kind)


def top_tokens(df: DataFrame, kind: str, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """A11/A12/A14 top lists (and A13b top URLs): channel, rank, <kind>, count."""
    return top_k_by_count(token_counts(df, kind, by=by), k, key=kind, by=by).select(*by, "rank", kind, "count")


def token_totals(df: DataFrame, kind: str, *, by: Sequence[str] = BY) -> DataFrame:
    """Distinct and total occurrences per channel (two-level aggregation, no countDistinct)."""
    return (token_counts(df, kind, by=by).groupBy(*by)
            .agg(F.count(F.lit(1)).alias(f"total_unique_{kind}s"),
                 F.sum("count").alias(f"total_{kind}s")))


def url_domains_top(df: DataFrame, k: int = 5, *, by: Sequence[str] = BY) -> DataFrame:
    """A13 top domains (network location as the reference's URL parser returns it)."""
    dom = tokens(df, "url", by=by).select(*by, url_domain("url").alias("domain"))
    return top_k_by_count(key_counts(dom, "domain", by=by, name="domain"), k, key="domain", by=by) \
        .select(*by, "rank", "domain", "count")


def url_totals(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Total URLs (with repeats), distinct URLs, distinct domains, messages with URLs."""
    per_domain = (token_counts(df, "url", by=by).groupBy(*by, url_domain("url").alias("domain"))
                  .agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("urls")))
    named = F.lit(True)
    for c in by:
        named = named & F.col(c).isNotNull()
    domains = F.count_if(F.col("domain").isNotNull() & named)  # rows without a channel have their domains not counted
    return per_domain.groupBy(*by).agg(F.sum("total").alias("total_urls"), F.sum("urls").alias("total_unique_urls"),
                                       domains.alias("total_unique_domains"))


def content_stats(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A15 in one aggregation pass.

    ``median`` keeps one entry per *distinct length* in its buffer (a value -> count map merged
    across partial aggregates), so memory is bounded by the length domain, not by rows.
    """
    has_text = non_blank("text")
    tlen = F.when(has_text, F.length("text").cast("bigint"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(has_text).alias("messages_with_text"),
        F.count(tlen).alias("text_length_count"),
        F.min(tlen).alias("text_length_min"),
        F.max(tlen).alias("text_length_max"),
        round_half_even(F.avg(tlen), 2).alias("text_length_mean"),
        F.floor(F.median(tlen)).alias("text_length_median"),
        F.count_if(non_blank("media_type")).alias("media_messages"),
        F.count_if(F.col("is_forwarded")).alias("forwarded_messages"),
    )


def basic_metrics(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A22 (collection view): text = trimmed non-empty; media = file name or size > 0;
    length statistics over the raw text of text messages, unrounded."""
    has_text = F.coalesce(F.trim("text") != "", F.lit(False))
    has_media = F.coalesce(non_blank("file_name"), F.lit(False)) | F.coalesce(F.col("file_size") > 0, F.lit(False))
    tlen = F.when(has_text, F.length("text").cast("bigint"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(has_text).alias("text_messages"),
        F.count_if(has_media).alias("media_messages"),
        F.count_if(F.coalesce(F.col("is_forwarded"), F.lit(False))).alias("forwarded_messages"),
        F.avg(tlen).alias("avg_text_length"),
        F.min(tlen).alias("min_text_length"),
        F.max(tlen).alias("max_text_length"),
    )


def text_size_audit(df: DataFrame, *, by: Sequence[str] = BY, text_long: int = 10_000,
                    text_huge: int = 100_000, caption_long: int = 5_000,
                    caption_huge: int = 50_000) -> DataFrame:
    """Presence and size of text and caption fields."""
    out = []
    for c, long_, huge in (("text", text_long, text_huge), ("caption", caption_long, caption_huge)):
        ln = F.when(F.col(c).isNotNull(), F.length(c).cast("bigint"))
        out += [
            F.count_if(F.col(c).isNotNull()).alias(f"{c}_present"),
            F.count_if(F.col(c).isNull()).alias(f"{c}_missing"),
            round_half_even(F.avg(ln), 1).alias(f"{c}_avg_length"),
            F.min(ln).alias(f"{c}_min_length"),
            F.max(ln).alias(f"{c}_max_length"),
            F.count_if(ln > long_).alias(f"{c}_over_{long_}"),
            F.count_if(ln > huge).alias(f"{c}_over_{huge}"),
        ]
    return df.groupBy(*by).agg(*out)


def pattern_presence(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Messages with URLs / hashtags / mentions and total occurrences."""
    sizes = {k: F.size(extract_all(F.coalesce(F.col("text"), F.lit("")), PATTERNS[k]))
             for k in ("url", "hashtag", "mention")}
    return df.groupBy(*by).agg(
        F.count_if(sizes["url"] > 0).alias("messages_with_urls"),
        F.count_if(sizes["hashtag"] > 0).alias("messages_with_hashtags"),
        F.count_if(sizes["mention"] > 0).alias("messages_with_mentions"),
        F.sum(sizes["hashtag"]).alias("total_hashtags"),
        F.sum(sizes["mention"]).alias("total_mentions"),
        F.sum(sizes["url"]).alias("total_urls"),
    )


def content_types(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """text_only / media_only / text_media / empty split."""
    t = non_blank("text")
    m = non_blank("media_type")
    kind = (F.when(t & m, "text_media").when(t, "text_only").when(m, "media_only").otherwise("empty"))
    return df.groupBy(*by, kind.alias("content_type")).agg(F.count(F.lit(1)).alias("count"))


def length_classes(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Text length distribution short (<50) / medium (50-200) / long (>200), with the
    average and total length of texts."""
    ln = F.length("text")
    cls = F.when(ln < 50, "short").when(ln <= 200, "medium").otherwise("long")
    return (df.where(non_blank("text")).groupBy(*by, cls.alias("length_class"))
              .agg(F.count(F.lit(1)).alias("count"), F.sum(ln).alias("total_length"),
                   round_half_even(F.avg(ln), 2).alias("avg_length")))


WORD_TOKEN = r"[\p{L}\p{N}_]+"


def common_words(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY, min_len: int = 1) -> DataFrame:
    """Most common lower-cased words of message texts."""
    w = (df.where(non_blank("text"))
           .select(*by, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_TOKEN), F.lit(0))).alias("word"))
           .where(F.length("word") >= min_len))
    return top_k_by_count(key_counts(w, "word", by=by, name="word"), k, key="word", by=by) \
        .select(*by, "rank", "word", "count")


def caption_stats(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Caption presence and length statistics."""
    has = non_blank("caption")
    ln = F.when(has, F.length("caption").cast("bigint"))
    return df.groupBy(*by).agg(
        F.count_if(has).alias("messages_with_caption"),
        round_half_even(F.count_if(has) * 100.0 / F.count(F.lit(1)), 2).alias("caption_percentage"),
        F.min(ln).alias("caption_min_length"),
        F.max(ln).alias("caption_max_length"),
        round_half_even(F.avg(ln), 2).alias("caption_avg_length"),
    )


def word_count_stats(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Words per message (runs of word characters): min, max, mean (2 dp), median (truncated)."""
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(WORD_TOKEN), F.lit(0)))
    wc = F.when(non_blank("text"), words)
    return df.groupBy(*by).agg(F.min(wc).cast("bigint").alias("min_words"), F.max(wc).cast("bigint").alias("max_words"),
                               round_half_even(F.avg(wc), 2).alias("mean_words"),
                               F.floor(F.median(wc)).alias("median_words"))


def search_messages(df: DataFrame, term: str, *, column: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Messages whose text contains ``term`` (a filter; pushed into the scan when the table
    is Parquet)."""
    c = F.col(column)
    return df.where(c.contains(term) if case_sensitive else F.lower(c).contains(term.lower()))

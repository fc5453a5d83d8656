"""Registered queries: each key maps to a Spark callable ``(spark, sf_dir) -> DataFrame`` over the
message view and, where SQL can express it, the equivalent DuckDB statement (the oracle).

Every query reads the whole driver tables (through the view); nothing is sampled or capped
except the top-k limits that are the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatlens.functions import patterns as P
from chatlens.functions.expr import sql_round
from chatlens.operators import content, people
from chatlens.sources import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RAW_SQL: dict[str, str] = {}  # oracle bodies without the view CTE, for composition


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            RAW_SQL[key] = sql.strip()
            ORACLE[key] = view.oracle_with(sql)
        return fn
    return deco


def msgs(spark: SparkSession, sf: str) -> DataFrame:
    return view.messages(spark, sf)


def lit(p: str) -> str:
    return P.sql_literal(p)


def sql_top(inner: str, key: str, k: int, count: str = "count", extra: str = "") -> str:
    return (f"SELECT channel_username, rank, {key}, {count}{extra} FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY {count} DESC, {key} ASC) AS rank "
            f"FROM ({inner}) q) r WHERE rank <= {k}")


def sql_tokens(pattern: str, name: str) -> str:
    return (f"SELECT channel_username, unnest(regexp_extract_all(text, {lit(pattern)})) AS {name} "
            f"FROM messages WHERE text IS NOT NULL AND text <> ''")


def sql_token_counts(pattern: str, name: str) -> str:
    tokens = SQL_EMOJIS if name == "emoji" else sql_tokens(pattern, name)
    return f"SELECT channel_username, {name}, count(*) AS count FROM ({tokens}) t GROUP BY ALL"


SQL_DOMAIN = (f"CASE WHEN regexp_extract(url, {lit(P.URL_NETLOC)}, 1) <> '' AND "
              f"contains(regexp_extract(url, {lit(P.URL_NETLOC)}, 1), '[') = "
              f"contains(regexp_extract(url, {lit(P.URL_NETLOC)}, 1), ']') "
              f"THEN regexp_extract(url, {lit(P.URL_NETLOC)}, 1) END")

# Emojis by a table of character classes: every character is looked up, and the text of classes is cut by the emoji grammar; what is cut says where
# the sequence lies in the message. R regional indicator, D keycap base, V variation selector, K keycap, T skin tone (an emoji itself), B other emoji, G tag, E cancel tag, Z joiner.
_RANGES = ([("R", 0x1F1E6, 0x1F1FF), ("V", 0xFE0F, 0xFE0F), ("K", 0x20E3, 0x20E3), ("G", 0xE0020, 0xE007E), ("E", 0xE007F, 0xE007F), ("Z", 0x200D, 0x200D), ("D", 0x30, 0x39),
            ("D", 0x23, 0x23), ("D", 0x2A, 0x2A), ("T", 0x1F3FB, 0x1F3FF)]
           + [("B", int(r.split("-")[0], 16), int(r.split("-")[-1], 16)) for r in P.EMOJI_RANGES.split()])
SQL_EMOJIS = f"""
SELECT channel_username, substr(text, CAST(upto - len + 1 AS BIGINT), len) AS emoji
FROM (SELECT row_number() OVER (ORDER BY message_id) AS r, channel_username, text FROM messages WHERE text <> '' AND strlen(text) <> length(text)) w
JOIN (
  SELECT r, piece, length(piece) AS len, sum(length(piece)) OVER (PARTITION BY r ORDER BY k) AS upto FROM (
    SELECT r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM (
      SELECT r, regexp_extract_all(array_to_string(list_transform(letters, lambda c: coalesce(classes[c], 'O')), ''),
        'RR|DV?K|[BT](?:G+E|[VT])?(?:Z[BT](?:G+E|[VT])?)*|[^RDBT]+|.') AS pieces
      FROM (SELECT row_number() OVER (ORDER BY message_id) AS r, regexp_extract_all(text, '(?s).') AS letters FROM messages WHERE text <> '' AND strlen(text) <> length(text)),
        (SELECT map(list(c), list(class)) AS classes FROM (
          SELECT c, min_by(class, ord) AS class FROM (
            SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS c FROM messages WHERE strlen(text) <> length(text)),
            (VALUES {", ".join(f"({i}, '{k}', {a}, {b})" for i, (k, a, b) in enumerate(_RANGES))}) AS t(ord, class, low, high)
          WHERE unicode(c) BETWEEN low AND high GROUP BY c))))
  ) p ON p.r = w.r
WHERE regexp_full_match(piece, 'RR|D.+|[BT].*')"""

# ---------------------------------------------------------------- patterns
for _kind, _pat, _k, _topkey in (("hashtag", P.HASHTAG, 10, "hashtags_top10"),
                                 ("mention", P.MENTION, 10, "mentions_top10"),
                                 ("emoji", P.EMOJI, 10, "emojis_top10"),
                                 ("url", P.URL, 15, "urls_top15")):
    register(_topkey, sql_top(sql_token_counts(_pat, _kind), _kind, _k))(
        (lambda kind, k: lambda s, sf: content.top_tokens(msgs(s, sf), kind, k))(_kind, _k))
    if _kind != "url":
        register(f"{_kind}_totals",
                 f"SELECT channel_username, CAST(count(*) AS BIGINT) AS total_unique_{_kind}s, "
                 f"CAST(sum(count) AS BIGINT) AS total_{_kind}s FROM ({sql_token_counts(_pat, _kind)}) c GROUP BY ALL")(
            (lambda kind: lambda s, sf: content.token_totals(msgs(s, sf), kind))(_kind))


@register("url_totals", f"""
WITH u AS ({sql_token_counts(P.URL, 'url')}),
a AS (SELECT channel_username, CAST(sum(count) AS BIGINT) AS total_urls, CAST(count(*) AS BIGINT) AS total_unique_urls
      FROM u GROUP BY ALL),
d AS (SELECT channel_username, CAST(count(DISTINCT {SQL_DOMAIN}) AS BIGINT) AS total_unique_domains FROM u GROUP BY ALL)
SELECT a.channel_username, total_urls, total_unique_urls, coalesce(total_unique_domains, 0) AS total_unique_domains
FROM a LEFT JOIN d ON a.channel_username = d.channel_username""")
def _url_totals(s, sf):
    return content.url_totals(msgs(s, sf))


register("url_domains_top5", sql_top(
    f"SELECT channel_username, domain, count(*) AS count FROM (SELECT channel_username, {SQL_DOMAIN} AS domain "
    f"FROM ({sql_tokens(P.URL, 'url')}) t) x WHERE domain IS NOT NULL GROUP BY ALL", "domain", 5))(
    lambda s, sf: content.url_domains_top(msgs(s, sf), 5))

# ---------------------------------------------------------------- content statistics
register("content_stats", f"""
SELECT channel_username,
  count(*) AS total_messages,
  count_if(text IS NOT NULL AND text <> '') AS messages_with_text,
  count(CASE WHEN text <> '' THEN length(text) END) AS text_length_count,
  min(CASE WHEN text <> '' THEN length(text) END) AS text_length_min,
  max(CASE WHEN text <> '' THEN length(text) END) AS text_length_max,
  {sql_round("avg(CASE WHEN text <> '' THEN length(text) END)", 2)} AS text_length_mean,
  CAST(floor(median(CASE WHEN text <> '' THEN length(text) END)) AS BIGINT) AS text_length_median,
  count_if(media_type IS NOT NULL AND media_type <> '') AS media_messages,
  count_if(is_forwarded) AS forwarded_messages
FROM messages GROUP BY ALL""")(lambda s, sf: content.content_stats(msgs(s, sf)))

# ---------------------------------------------------------------- creators
SQL_CREATOR_COUNTS = ("SELECT channel_username, creator_username AS username, count(*) AS message_count "
                      "FROM messages WHERE creator_username IS NOT NULL GROUP BY ALL")
register("creators_top10", f"""
WITH c AS ({SQL_CREATOR_COUNTS}),
t AS (SELECT channel_username, sum(message_count) AS total FROM c GROUP BY ALL)
SELECT r.channel_username, rank, username, message_count,
  coalesce({sql_round("message_count * 100.0 / total", 2)}, 0.0) AS percentage
FROM ({sql_top("SELECT * FROM c", "username", 10, "message_count")}) r
JOIN t ON r.channel_username = t.channel_username""")(lambda s, sf: people.creators_top(msgs(s, sf), 10))

register("creator_stats", f"""
SELECT channel_username, count(*) AS total_creators, CAST(sum(message_count) AS BIGINT) AS total_messages,
  {sql_round("sum(message_count) * 1.0 / count(*)", 2)} AS avg_messages_per_creator
FROM ({SQL_CREATOR_COUNTS}) c GROUP BY ALL""")(lambda s, sf: people.creator_stats(msgs(s, sf)))

# ================================================================ files
from chatlens.functions.expr import ANALYSIS_BINS, COLLECTION_BINS  # noqa: E402
from chatlens.operators import files  # noqa: E402

NAMED = "file_name IS NOT NULL AND file_name <> ''"
SQL_EXT = f"lower(nullif(regexp_extract(file_name, {lit(P.EXTENSION)}, 1), ''))"


def sql_zero_filled(rows: str, label: str, labels) -> str:
    vals = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""WITH r AS ({rows}),
sp AS (SELECT DISTINCT channel_username FROM r),
l AS (SELECT * FROM (VALUES {vals}) v(ord, {label})),
c AS (SELECT channel_username, {label}, count(*) AS count FROM r GROUP BY ALL)
SELECT sp.channel_username, CAST(l.ord AS BIGINT) AS ord, l.{label}, coalesce(c.count, 0) AS count
FROM sp CROSS JOIN l LEFT JOIN c ON c.channel_username = sp.channel_username AND c.{label} = l.{label}"""


def sql_dup_summary(counts: str, what: str) -> str:
    return f"""SELECT channel_username,
  CAST(coalesce(sum(CASE WHEN count > 1 THEN count END), 0) AS BIGINT) AS files_with_duplicate_{what}s,
  count(*) AS total_unique_file{what}s, CAST(sum(count) AS BIGINT) AS total_files,
  coalesce({sql_round("sum(CASE WHEN count > 1 THEN count ELSE 0 END) * 1.0 / sum(count)", 3)}, 0.0) AS duplicate_ratio
FROM ({counts}) c GROUP BY ALL"""


SQL_NAME_COUNTS = f"SELECT channel_username, file_name AS filename, count(*) AS count FROM messages WHERE {NAMED} GROUP BY ALL"
SQL_SIZE_COUNTS = "SELECT channel_username, file_size AS size_bytes, count(*) AS count FROM messages WHERE file_size > 0 GROUP BY ALL"


def sql_bins(kind: str) -> str:
    m = 1048576
    if kind == "analysis":
        return (f"CASE WHEN file_size <= {m} THEN '0-1MB' WHEN file_size <= {5 * m} THEN '1-5MB' "
                f"WHEN file_size <= {10 * m} THEN '5-10MB' ELSE '10MB+' END")
    return (f"CASE WHEN file_size < {m} THEN '0-1MB' WHEN file_size < {10 * m} THEN '1-10MB' "
            f"WHEN file_size < {100 * m} THEN '10-100MB' WHEN file_size < {1024 * m} THEN '100MB-1GB' ELSE '1GB+' END")


def sql_human(x: str) -> str:
    parts = []
    for k, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        v = f"(CAST({x} AS DOUBLE) / {float(1024 ** k)})"
        parts.append(f"WHEN {v} < 1024.0 THEN printf('%.1f', round_even({v}, 1)) || ' {unit}'")
    pb = f"(CAST({x} AS DOUBLE) / {float(1024 ** 5)})"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '0 B' " + " ".join(parts)
            + f" ELSE printf('%.1f', round_even({pb}, 1)) || ' PB' END")


register("filename_duplicates", sql_dup_summary(SQL_NAME_COUNTS, "name"))(
    lambda s, sf: files.filename_duplicates(msgs(s, sf)))
register("filename_top10", sql_top(SQL_NAME_COUNTS, "filename", 10))(lambda s, sf: files.filename_top(msgs(s, sf), 10))
register("filename_length_stats", f"""
SELECT channel_username, count(*) AS count, min(length(file_name)) AS min, max(length(file_name)) AS max,
  {sql_round("avg(length(file_name))", 2)} AS mean, CAST(floor(median(length(file_name))) AS BIGINT) AS median
FROM messages WHERE {NAMED} GROUP BY ALL""")(lambda s, sf: files.filename_length_stats(msgs(s, sf)))
register("extensions_top10", f"""
SELECT channel_username, rank, '.' || ext AS ext, count FROM ({sql_top(
    f"SELECT channel_username, {SQL_EXT} AS ext, count(*) AS count FROM messages WHERE {NAMED} AND {SQL_EXT} IS NOT NULL GROUP BY ALL",
    "ext", 10)}) x""")(lambda s, sf: files.extensions_top(msgs(s, sf), 10))
register("filename_char_flags", f"""
SELECT channel_username, count_if(regexp_matches(file_name, {lit(P.SPECIAL_CHAR)})) AS files_with_special_chars,
  count_if(contains(file_name, ' ')) AS files_with_spaces
FROM messages WHERE {NAMED} GROUP BY ALL""")(lambda s, sf: files.filename_char_flags(msgs(s, sf)))
register("filename_length_buckets", sql_zero_filled(
    f"SELECT channel_username, CASE WHEN length(file_name) <= 10 THEN '1-10' WHEN length(file_name) <= 20 THEN '11-20' "
    f"WHEN length(file_name) <= 30 THEN '21-30' WHEN length(file_name) <= 40 THEN '31-40' "
    f"WHEN length(file_name) <= 50 THEN '41-50' ELSE '50+' END AS bucket FROM messages WHERE {NAMED}",
    "bucket", ["1-10", "11-20", "21-30", "31-40", "41-50", "50+"]))(
    lambda s, sf: files.filename_length_buckets(msgs(s, sf)))

register("filesize_duplicates", sql_dup_summary(SQL_SIZE_COUNTS, "size"))(
    lambda s, sf: files.filesize_duplicates(msgs(s, sf)))
register("filesize_top10", f"""
SELECT channel_username, rank, size_bytes, count, {sql_round("size_bytes / 1048576.0", 2)} AS size_mb
FROM ({sql_top(SQL_SIZE_COUNTS, "size_bytes", 10)}) x""")(lambda s, sf: files.filesize_top(msgs(s, sf), 10))
register("filesize_histogram", sql_zero_filled(
    f"SELECT channel_username, {sql_bins('analysis')} AS bin FROM messages WHERE file_size > 0", "bin", ANALYSIS_BINS))(
    lambda s, sf: files.filesize_histogram(msgs(s, sf)))
register("filesize_potential_dups", """
WITH s AS (SELECT * FROM messages WHERE file_size > 0),
sz AS (SELECT channel_username, file_size AS size_bytes, count(*) AS n_files FROM s GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY size_bytes DESC) AS rank FROM sz) q
      WHERE rank <= 10),
nm AS (SELECT channel_username, file_size AS size_bytes, file_name, count(*) AS occurrences FROM s GROUP BY ALL)
SELECT t.channel_username, t.rank, t.size_bytes, t.n_files, nm.file_name, nm.occurrences
FROM t JOIN nm ON t.channel_username = nm.channel_username AND t.size_bytes = nm.size_bytes""")(
    lambda s, sf: files.filesize_potential_dups(msgs(s, sf), 10))
register("total_data_size", f"""
SELECT channel_username, total_bytes, file_count, {sql_human("total_bytes")} AS total_human FROM (
  SELECT channel_username, CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*) AS file_count
  FROM messages WHERE file_size > 0 GROUP BY ALL) x""")(lambda s, sf: files.total_data_size(msgs(s, sf)))
register("file_uniqueness_singletons", """
WITH s AS (SELECT * FROM messages WHERE file_size > 0),
sc AS (SELECT channel_username, CAST(sum(n) AS BIGINT) AS total_files, count_if(n = 1) AS unique_sizes, count_if(n > 1) AS duplicate_sizes
       FROM (SELECT channel_username, file_size, count(*) AS n FROM s GROUP BY ALL) a GROUP BY ALL),
nc AS (SELECT channel_username, count_if(n = 1) AS unique_filenames, count_if(n > 1) AS duplicate_filenames
       FROM (SELECT channel_username, file_name, count(*) AS n FROM s WHERE file_name IS NOT NULL AND file_name <> '' GROUP BY ALL) b
       GROUP BY ALL)
SELECT sc.channel_username, total_files, unique_sizes, duplicate_sizes, total_files - unique_sizes AS files_with_duplicate_sizes,
  coalesce(unique_filenames, unique_sizes) AS total_unique_filenames,
  total_files - coalesce(unique_filenames, unique_sizes) AS files_with_duplicate_names,
  CAST(total_files - coalesce(unique_filenames, unique_sizes) AS DOUBLE) / CAST(total_files AS DOUBLE) AS duplicate_ratio
FROM sc LEFT JOIN nc ON sc.channel_username = nc.channel_username""")(
    lambda s, sf: files.file_uniqueness_singletons(msgs(s, sf)))
register("filesize_histogram_wide", sql_zero_filled(
    f"SELECT channel_username, {sql_bins('collection')} AS bin FROM messages WHERE file_size > 0", "bin", COLLECTION_BINS))(
    lambda s, sf: files.filesize_histogram_wide(msgs(s, sf)))
register("extensions_wide_top10", sql_top(
    f"SELECT channel_username, lower(string_split(file_name, '.')[-1]) AS extension, count(*) AS count FROM messages "
    f"WHERE file_size > 0 AND {NAMED} AND contains(file_name, '.') GROUP BY ALL", "extension", 10))(
    lambda s, sf: files.extensions_wide_top(msgs(s, sf), 10))
register("file_summary", f"""
SELECT channel_username, count(*) AS total_files, CAST(sum(file_size) AS BIGINT) AS total_storage_bytes,
  {sql_round("sum(file_size) / 1048576.0", 2)} AS total_storage_mb,
  {sql_round("avg(file_size)", 2)} AS average_file_size_bytes,
  {sql_round("avg(file_size) / 1048576.0", 2)} AS average_file_size_mb
FROM messages WHERE file_size IS NOT NULL GROUP BY ALL""")(lambda s, sf: files.file_summary(msgs(s, sf)))
register("mime_top10", sql_top(
    "SELECT channel_username, mime_type, count(*) AS count FROM messages WHERE mime_type IS NOT NULL AND mime_type <> '' GROUP BY ALL",
    "mime_type", 10))(lambda s, sf: files.mime_top(msgs(s, sf), 10))
register("size_percentiles", """
SELECT channel_username, count_if(file_size < 1048576) AS small,
  count_if(file_size >= 1048576 AND file_size <= 10485760) AS medium, count_if(file_size > 10485760) AS large,
  quantile_cont(file_size, 0.5) AS p50, quantile_cont(file_size, 0.75) AS p75, quantile_cont(file_size, 0.9) AS p90
FROM messages WHERE file_size > 0 GROUP BY ALL""")(lambda s, sf: files.size_percentiles(msgs(s, sf)))
register("largest_files_top10", """
SELECT channel_username, rank, message_id, file_name, file_size FROM (
  SELECT channel_username, message_id, file_name, file_size,
    row_number() OVER (PARTITION BY channel_username ORDER BY file_size DESC, message_id ASC) AS rank
  FROM messages WHERE file_size > 0) x WHERE rank <= 10""")(lambda s, sf: files.largest_files(msgs(s, sf), 10))


def _sql_family() -> str:
    parts = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{fam}'"
                     for fam, exts in files.FORMAT_FAMILIES.items())
    return f"CASE {parts} ELSE 'other' END"


register("format_families", f"""
SELECT channel_username, {_sql_family()} AS family, upper(ext) AS format, count(*) AS count,
  {sql_round("avg(file_size)", 2)} AS avg_size_bytes
FROM (SELECT channel_username, {SQL_EXT} AS ext, file_size FROM messages WHERE {NAMED}) x
WHERE ext IS NOT NULL GROUP BY ALL""")(lambda s, sf: files.format_families(msgs(s, sf)))

# ================================================================ time
from chatlens.functions.expr import MONTH_NAMES  # noqa: E402
from chatlens.operators import timeline, validate  # noqa: E402

SQL_DAILY = ("SELECT channel_username, strftime(date, '%Y-%m-%d') AS day, count(*) AS count "
             "FROM messages WHERE date IS NOT NULL GROUP BY ALL")
register("timeline_daily", SQL_DAILY)(lambda s, sf: timeline.daily(msgs(s, sf)))
register("timeline_sampled", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY day) AS rn,
                 count(*) OVER (PARTITION BY channel_username) AS n FROM ({SQL_DAILY}) d)
SELECT channel_username, day, count FROM r WHERE (rn - 1) % (CASE WHEN n > 100 THEN n // 100 ELSE 1 END) = 0""")(
    lambda s, sf: timeline.daily_sampled(msgs(s, sf), 100))
_months = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(MONTH_NAMES))
register("monthly_histogram", f"""
WITH d AS (SELECT * FROM messages WHERE date IS NOT NULL),
sp AS (SELECT DISTINCT channel_username FROM d),
l AS (SELECT * FROM (VALUES {_months}) v(month, label)),
c AS (SELECT channel_username, month(date) AS month, count(*) AS count FROM d GROUP BY ALL)
SELECT sp.channel_username, CAST(l.month AS BIGINT) AS month, l.label, coalesce(c.count, 0) AS count
FROM sp CROSS JOIN l LEFT JOIN c ON c.channel_username = sp.channel_username AND c.month = l.month""")(
    lambda s, sf: timeline.monthly_histogram(msgs(s, sf)))
register("year_month", "SELECT channel_username, strftime(date, '%Y-%m') AS year_month, count(*) AS count "
                       "FROM messages WHERE date IS NOT NULL GROUP BY ALL")(lambda s, sf: timeline.year_month(msgs(s, sf)))
register("channel_info", """
SELECT channel_username, count(*) AS total_messages, min(date) AS first_date, max(date) AS last_date,
  count(DISTINCT CAST(date AS DATE)) AS active_days
FROM messages GROUP BY ALL""")(lambda s, sf: timeline.channel_info(msgs(s, sf)))
register("temporal_activity", """
SELECT channel_username, granularity, period, count(*) AS count FROM (
  SELECT channel_username, 'monthly' AS granularity, strftime(date, '%Y-%m') AS period FROM messages WHERE date IS NOT NULL
  UNION ALL SELECT channel_username, 'daily', strftime(date, '%Y-%m-%d') FROM messages WHERE date IS NOT NULL
  UNION ALL SELECT channel_username, 'hourly', strftime(date, '%H') FROM messages WHERE date IS NOT NULL) x
GROUP BY ALL""")(lambda s, sf: timeline.temporal_activity(msgs(s, sf)))
register("activity_by_hour", f"""
SELECT channel_username, hour, count, {sql_round("count * 100.0 / sum(count) OVER (PARTITION BY channel_username)", 2)} AS percentage
FROM (SELECT channel_username, CAST(hour(date) AS BIGINT) AS hour, count(*) AS count FROM messages
      WHERE date IS NOT NULL GROUP BY ALL) h""")(lambda s, sf: timeline.activity_by_hour(msgs(s, sf)))
register("monthly_trend", f"""
SELECT channel_username, year_month, count, previous, count - previous AS change,
  {sql_round("(count - previous) * 100.0 / nullif(previous, 0)", 2)} AS change_pct
FROM (SELECT *, lag(count) OVER (PARTITION BY channel_username ORDER BY year_month) AS previous FROM (
  SELECT channel_username, strftime(date, '%Y-%m') AS year_month, count(*) AS count FROM messages
  WHERE date IS NOT NULL GROUP BY ALL) a) b""")(lambda s, sf: timeline.monthly_trend(msgs(s, sf)))

# ================================================================ validation and quality
register("message_validation", """
SELECT channel_username, count(*) AS total,
  count_if(message_id IS NOT NULL AND channel_username IS NOT NULL AND text IS NOT NULL) AS valid,
  count_if(NOT (message_id IS NOT NULL AND channel_username IS NOT NULL AND text IS NOT NULL)) AS invalid,
  count_if(NOT (message_id IS NOT NULL AND channel_username IS NOT NULL AND text IS NOT NULL)) AS missing_field,
  CAST(0 AS BIGINT) AS invalid_format
FROM messages GROUP BY ALL""")(lambda s, sf: validate.message_validation(msgs(s, sf)))
register("quality_issues", """
SELECT channel_username, issue, count(*) AS count FROM (
  SELECT channel_username, 'text too short' AS issue FROM messages WHERE text IS NOT NULL AND length(trim(text)) < 3
  UNION ALL SELECT channel_username, 'negative file size' FROM messages WHERE file_size < 0) x
GROUP BY ALL""")(lambda s, sf: validate.quality_issue_counts(msgs(s, sf)))
register("contract_violations", """
SELECT channel_username, count(*) AS total,
  count_if(length(text) > 4096) AS text_too_long,
  count_if(length(file_name) > 255) AS file_name_too_long,
  count_if(coalesce(file_size < 0, false) OR coalesce(views < 0, false) OR coalesce(forwards < 0, false)
           OR coalesce(replies < 0, false)) AS negative_counts,
  count_if(date < TIMESTAMP '2020-01-01 00:00:00') AS date_too_old,
  count_if(date > now()::TIMESTAMP) AS date_in_future,
  count_if(date IS NULL) AS date_missing,
  count_if(file_size > 104857600) AS large_files
FROM messages GROUP BY ALL""")(lambda s, sf: validate.contract_violations(msgs(s, sf)))
register("dataset_check", """
SELECT channel_username, count(*) AS rows, count_if(message_id IS NULL) AS null_message_id,
  count_if(channel_username IS NULL) AS null_channel_username, count_if(date IS NULL) AS null_date
FROM messages GROUP BY ALL""")(lambda s, sf: validate.dataset_check(msgs(s, sf)))
register("source_summary", """
SELECT channel_username, 'file' AS source_type, count(*) AS total_records, min(date) AS date_start, max(date) AS date_end,
  CAST(0.95 AS DOUBLE) AS quality_score,
  CAST(count(message_id) + count(channel_username) + count(date) AS DOUBLE) / CAST(count(*) * 3 AS DOUBLE) AS completeness_score
FROM messages GROUP BY ALL""")(lambda s, sf: validate.source_summary(msgs(s, sf)))
register("run_stats", """
SELECT count(*) AS total,
  count_if(message_id IS NOT NULL AND channel_username IS NOT NULL AND text IS NOT NULL) AS valid,
  count_if(NOT (message_id IS NOT NULL AND channel_username IS NOT NULL AND text IS NOT NULL)) AS invalid,
  count_if((text IS NOT NULL AND length(trim(text)) < 3) OR coalesce(file_size < 0, false)) AS rows_with_issues,
  CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches
FROM messages""")(lambda s, sf: validate.run_stats(msgs(s, sf)))

_audit = []
for _c, _l, _h in (("text", 10000, 100000), ("caption", 5000, 50000)):
    _audit.append(f"""count({_c}) AS {_c}_present, count_if({_c} IS NULL) AS {_c}_missing,
  {sql_round(f"avg(length({_c}))", 1)} AS {_c}_avg_length, min(length({_c})) AS {_c}_min_length,
  max(length({_c})) AS {_c}_max_length, count_if(length({_c}) > {_l}) AS {_c}_over_{_l},
  count_if(length({_c}) > {_h}) AS {_c}_over_{_h}""")
register("text_size_audit", f"SELECT channel_username, {', '.join(_audit)} FROM messages GROUP BY ALL")(
    lambda s, sf: content.text_size_audit(msgs(s, sf)))
register("basic_metrics", """
SELECT channel_username, count(*) AS total_messages,
  count_if(coalesce(trim(text) <> '', false)) AS text_messages,
  count_if(coalesce(file_name <> '', false) OR coalesce(file_size > 0, false)) AS media_messages,
  count_if(coalesce(is_forwarded, false)) AS forwarded_messages,
  avg(CASE WHEN trim(text) <> '' THEN length(text) END) AS avg_text_length,
  min(CASE WHEN trim(text) <> '' THEN length(text) END) AS min_text_length,
  max(CASE WHEN trim(text) <> '' THEN length(text) END) AS max_text_length
FROM messages GROUP BY ALL""")(lambda s, sf: content.basic_metrics(msgs(s, sf)))

# ================================================================ content classes and engagement
from chatlens.operators.content import WORD_TOKEN  # noqa: E402

_has_text = "text IS NOT NULL AND text <> ''"
register("pattern_presence", f"""
SELECT channel_username,
  count_if(len(regexp_extract_all(coalesce(text, ''), {lit(P.URL)})) > 0) AS messages_with_urls,
  count_if(len(regexp_extract_all(coalesce(text, ''), {lit(P.HASHTAG)})) > 0) AS messages_with_hashtags,
  count_if(len(regexp_extract_all(coalesce(text, ''), {lit(P.MENTION)})) > 0) AS messages_with_mentions,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), {lit(P.HASHTAG)}))) AS BIGINT) AS total_hashtags,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), {lit(P.MENTION)}))) AS BIGINT) AS total_mentions,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), {lit(P.URL)}))) AS BIGINT) AS total_urls
FROM messages GROUP BY ALL""")(lambda s, sf: content.pattern_presence(msgs(s, sf)))
register("content_types", """
SELECT channel_username, CASE WHEN t AND m THEN 'text_media' WHEN t THEN 'text_only' WHEN m THEN 'media_only' ELSE 'empty' END
  AS content_type, count(*) AS count
FROM (SELECT channel_username, coalesce(text <> '', false) AS t, coalesce(media_type <> '', false) AS m FROM messages) x
GROUP BY ALL""")(lambda s, sf: content.content_types(msgs(s, sf)))
register("length_classes", f"""
SELECT channel_username, CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) <= 200 THEN 'medium' ELSE 'long' END
  AS length_class, count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS total_length,
  {sql_round("avg(length(text))", 2)} AS avg_length
FROM messages WHERE {_has_text} GROUP BY ALL""")(lambda s, sf: content.length_classes(msgs(s, sf)))
register("common_words", sql_top(
    f"SELECT channel_username, word, count(*) AS count FROM (SELECT channel_username, "
    f"unnest(regexp_extract_all(lower(text), {lit(WORD_TOKEN)})) AS word FROM messages WHERE {_has_text}) w "
    f"WHERE length(word) >= 1 GROUP BY ALL", "word", 10))(lambda s, sf: content.common_words(msgs(s, sf), 10))
register("caption_stats", f"""
SELECT channel_username, count_if(caption <> '') AS messages_with_caption,
  {sql_round("count_if(caption <> '') * 100.0 / count(*)", 2)} AS caption_percentage,
  min(CASE WHEN caption <> '' THEN length(caption) END) AS caption_min_length,
  max(CASE WHEN caption <> '' THEN length(caption) END) AS caption_max_length,
  {sql_round("avg(CASE WHEN caption <> '' THEN length(caption) END)", 2)} AS caption_avg_length
FROM messages GROUP BY ALL""")(lambda s, sf: content.caption_stats(msgs(s, sf)))

_eng = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS total_{c}, {sql_round(f'avg(coalesce({c}, 0))', 2)} AS avg_{c}"
                 for c in ("views", "forwards", "replies"))
register("engagement", f"SELECT channel_username, count(*) AS total_messages, {_eng} FROM messages GROUP BY ALL")(
    lambda s, sf: people.engagement(msgs(s, sf)))
_corr = ", ".join(f"{sql_round(f'CASE WHEN stddev_pop(CAST({x} AS DOUBLE)) = 0 OR stddev_pop(CAST({y} AS DOUBLE)) = 0 THEN NULL ELSE corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) END', 6)} AS corr_{xn}_{y}"
                  for xn, x in (("text_length", "length(text)"), ("file_size", "file_size"), ("hour", "hour(date)"))
                  for y in ("views", "forwards", "replies"))
register("correlation", f"SELECT channel_username, {_corr} FROM messages GROUP BY ALL")(
    lambda s, sf: people.correlation(msgs(s, sf)))
_avg_eng = ", ".join(f"{sql_round(f'avg(coalesce({c}, 0))', 2)} AS avg_{c}" for c in ("views", "forwards", "replies"))
register("engagement_by_type", f"""
SELECT channel_username, dimension, value, count(*) AS messages, {_avg_eng} FROM (
  SELECT channel_username, 'media_type' AS dimension, media_type AS value, views, forwards, replies FROM messages
  UNION ALL SELECT channel_username, 'extension', {SQL_EXT}, views, forwards, replies FROM messages) x
WHERE value IS NOT NULL AND value <> '' GROUP BY ALL""")(lambda s, sf: people.engagement_by_type(msgs(s, sf)))
register("popular_files_top10", f"""
SELECT channel_username, rank, message_id, file_name, file_size, views FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY views DESC NULLS LAST, message_id ASC) AS rank
  FROM messages WHERE {NAMED}) x WHERE rank <= 10""")(lambda s, sf: people.popular_files(msgs(s, sf), 10))
register("forward_edges", """
SELECT forwarded_from AS source, channel_username, count(*) AS messages, CAST(sum(coalesce(views, 0)) AS BIGINT) AS views
FROM messages WHERE is_forwarded AND forwarded_from IS NOT NULL AND forwarded_from <> '' GROUP BY ALL""")(
    lambda s, sf: people.forward_edges(msgs(s, sf)))

# ================================================================ merge (U1-U7, J1, J2) over two overlapping loads
from pyspark.sql import functions as F  # noqa: E402

from chatlens.operators import merge  # noqa: E402

LOAD1_BEFORE = "2024-09-01 00:00:00"
LOAD2_FROM = "2024-06-01 00:00:00"


def loads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping loads of the whole message table: load 1 holds messages before September
    2024 (and undated ones), load 2 those from June 2024 on, re-collected with higher view counts.
    Together they cover every message; the overlap is three months."""
    m = msgs(spark, sf).select("channel_username", "message_id", "date", "views", "text")
    l1 = (m.where(F.coalesce(F.col("date") < F.lit(LOAD1_BEFORE).cast("timestamp_ntz"), F.lit(True)))
           .withColumn("load_seq", F.lit(1).cast("bigint")))
    l2 = (m.where(F.col("date") >= F.lit(LOAD2_FROM).cast("timestamp_ntz"))
           .withColumn("views", F.col("views") + 1000).withColumn("load_seq", F.lit(2).cast("bigint")))
    return l1, l2


SQL_LOADS = f"""l1 AS (SELECT channel_username, message_id, date, views, text, CAST(1 AS BIGINT) AS load_seq FROM messages
       WHERE coalesce(date < TIMESTAMP '{LOAD1_BEFORE}', true)),
l2 AS (SELECT channel_username, message_id, date, views + 1000 AS views, text, CAST(2 AS BIGINT) AS load_seq FROM messages
       WHERE date >= TIMESTAMP '{LOAD2_FROM}'),
comb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_username, message_id
         ORDER BY load_seq DESC, message_id DESC) AS rn FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) u) q WHERE rn = 1)"""


def _combined(spark, sf, *columns: str):
    """The two loads combined; ``columns``: those that the caller reads besides the key, so that texts only move where they are read."""
    both = merge.union_loads(*loads(spark, sf)).select(*merge.KEY, *columns, "load_seq")
    return merge.keep_latest(both, ["load_seq", "message_id"])


register("combine_keep_latest", f"""WITH {SQL_LOADS}
SELECT channel_username, message_id, date, views, load_seq FROM comb""")(
    lambda s, sf: _combined(s, sf, "date", "views").select("channel_username", "message_id", "date", "views", "load_seq"))


def _combine_summary(spark, sf):
    l1, l2 = loads(spark, sf)
    return merge.combine_summary(l1, l2, _combined(spark, sf))


register("combine_summary", f"""WITH {SQL_LOADS},
e AS (SELECT channel_username, count(*) AS existing_messages FROM l1 GROUP BY ALL),
n AS (SELECT channel_username, count(*) AS new_rows FROM l2 GROUP BY ALL),
c AS (SELECT channel_username, count(*) AS total_messages FROM comb GROUP BY ALL),
a AS (SELECT channel_username, count(*) AS new_messages_added FROM (SELECT DISTINCT channel_username, message_id FROM l2) x
      WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.channel_username = x.channel_username AND l1.message_id = x.message_id)
      GROUP BY ALL)
SELECT c.channel_username, total_messages, coalesce(existing_messages, 0) AS existing_messages,
  coalesce(new_rows, 0) AS new_rows, coalesce(new_messages_added, 0) AS new_messages_added,
  coalesce(existing_messages, 0) + coalesce(new_rows, 0) - total_messages AS duplicates_removed,
  CASE WHEN coalesce(existing_messages, 0) = 0 THEN 'created' WHEN coalesce(new_rows, 0) > 0 THEN 'updated'
       ELSE 'no_new_files' END AS status
FROM c LEFT JOIN e ON c.channel_username = e.channel_username LEFT JOIN n ON c.channel_username = n.channel_username
LEFT JOIN a ON c.channel_username = a.channel_username""")(_combine_summary)


def _unit(col_seq, col_date):
    return F.concat(F.lit("L"), col_seq.cast("string"), F.lit("_"),
                    F.coalesce(F.date_format(col_date, "yyyy-MM"), F.lit("undated")))


def _id_range_overlaps(spark, sf):
    l1, l2 = loads(spark, sf)
    u = merge.union_loads(l1, l2).withColumn("source_file", _unit(F.col("load_seq"), F.col("date")))
    return merge.range_overlaps(merge.id_ranges(u))


register("id_range_overlaps", f"""WITH {SQL_LOADS},
r AS (SELECT channel_username, 'L' || CAST(load_seq AS VARCHAR) || '_' || coalesce(strftime(date, '%Y-%m'), 'undated') AS source_file,
        min(message_id) AS min_id, max(message_id) AS max_id, count(*) AS messages
      FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) u GROUP BY ALL),
w AS (SELECT *, max(max_id) OVER (PARTITION BY channel_username ORDER BY min_id, max_id, source_file
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max_id FROM r),
x AS (SELECT *, CASE WHEN prev_max_id IS NULL THEN 'first' WHEN min_id <= prev_max_id THEN 'overlap'
        WHEN min_id > prev_max_id + 1 THEN 'gap' ELSE 'contiguous' END AS relation FROM w)
SELECT channel_username, source_file, min_id, max_id, messages, prev_max_id, relation,
  CASE WHEN relation = 'overlap' THEN least(max_id, prev_max_id) - min_id + 1 ELSE 0 END AS overlap_ids,
  CASE WHEN relation = 'gap' THEN min_id - prev_max_id - 1 ELSE 0 END AS gap_ids FROM x""")(_id_range_overlaps)


def _skip(spark, sf):
    l1, l2 = loads(spark, sf)
    return merge.skip_existing(l2, l1).select("channel_username", "message_id", "views")


register("skip_duplicates", f"""WITH {SQL_LOADS}
SELECT channel_username, message_id, views FROM l2 WHERE NOT EXISTS (
  SELECT 1 FROM l1 WHERE l1.channel_username = l2.channel_username AND l1.message_id = l2.message_id)""")(_skip)


def _diff(spark, sf):
    l1, l2 = loads(spark, sf)
    d = merge.source_diff(l1.select(*merge.KEY, "views", "text"), l2.select(*merge.KEY, "views", "text"))
    return d.groupBy("channel_username", "status").agg(F.count(F.lit(1)).alias("count"))


register("source_diff", f"""WITH {SQL_LOADS}
SELECT channel_username, status, count(*) AS count FROM (
  SELECT coalesce(l1.channel_username, l2.channel_username) AS channel_username,
    CASE WHEN l2.message_id IS NULL THEN 'only_left' WHEN l1.message_id IS NULL THEN 'only_right'
         WHEN l1.views IS NOT DISTINCT FROM l2.views AND l1.text IS NOT DISTINCT FROM l2.text THEN 'same' ELSE 'changed' END AS status
  FROM l1 FULL OUTER JOIN l2 ON l1.channel_username = l2.channel_username AND l1.message_id = l2.message_id) x
GROUP BY ALL""")(_diff)

# ================================================================ language
from chatlens.operators import language  # noqa: E402


def sql_charfreq(src: str) -> str:
    """DuckDB twin of ``language.charfreq`` over ``src`` (which has a ``text`` column)."""
    scores = []
    for lang, markers in language.CHAR_MARKERS.items():
        parts = [f"((length(low) - length(replace(low, '{m}', ''))) // {len(m)})" for m in markers]
        scores.append(f"CAST({' + '.join(parts)} AS BIGINT) AS s_{lang}")
    names = list(language.CHAR_MARKERS)
    mx = f"greatest({', '.join('s_' + n for n in names)})"
    tot = " + ".join("s_" + n for n in names)
    best = "CASE " + " ".join(f"WHEN s_{n} = {mx} THEN '{n}'" for n in names) + " END"
    return f"""SELECT *,
  CASE WHEN text IS NULL OR trimmed < 3 THEN 'unknown' WHEN {mx} > 0 THEN {best}
       WHEN non_ascii > len_t * 0.1 THEN 'non_english' ELSE 'english' END AS language,
  CASE WHEN text IS NULL OR trimmed < 3 THEN 0.0 WHEN {mx} > 0 THEN CAST({mx} AS DOUBLE) / CAST({tot} AS DOUBLE)
       WHEN non_ascii > len_t * 0.1 THEN CAST(non_ascii AS DOUBLE) / CAST(len_t AS DOUBLE)
       ELSE 1.0 - CAST(non_ascii AS DOUBLE) / CAST(len_t AS DOUBLE) END AS confidence
FROM (SELECT *, {', '.join(scores)},
        length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS non_ascii, length(text) AS len_t,
        length(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS trimmed
      FROM (SELECT *, lower(text) AS low FROM ({src}) s0) s1) s2"""


SQL_MSG_LANG = sql_charfreq(f"SELECT channel_username, message_id, text FROM messages WHERE {_has_text}")
SQL_FILE_LANG = sql_charfreq(
    f"SELECT channel_username, message_id, trim(concat_ws(' ', file_name, coalesce(caption, ''))) AS text "
    f"FROM messages WHERE {NAMED}")


def _msg_lang(s, sf):
    return language.detect_messages(msgs(s, sf))


register("lang_charfreq", f"""
WITH c AS (SELECT channel_username, language, count(*) AS count FROM ({SQL_MSG_LANG}) d GROUP BY ALL)
SELECT channel_username, language, count,
  coalesce({sql_round("count * 100.0 / sum(count) OVER (PARTITION BY channel_username)", 2)}, 0.0) AS percentage FROM c""")(
    lambda s, sf: language.language_counts(_msg_lang(s, sf)))
register("lang_profile", f"""
WITH c AS (SELECT channel_username, language, count(*) AS count FROM ({SQL_MSG_LANG}) d GROUP BY ALL),
p AS (SELECT channel_username, language AS primary_language FROM (SELECT *, row_number() OVER (
        PARTITION BY channel_username ORDER BY count DESC, language ASC) AS rn FROM c WHERE language <> 'unknown') x WHERE rn = 1),
a AS (SELECT channel_username, CAST(sum(count) AS BIGINT) AS messages_analyzed, count_if(language <> 'unknown') AS total_languages_detected,
        coalesce(sum(CASE WHEN language = 'unknown' THEN count END), 0) AS unknown FROM c GROUP BY ALL)
SELECT a.channel_username, coalesce(primary_language, 'unknown') AS primary_language, total_languages_detected, messages_analyzed,
  {sql_round("(messages_analyzed - unknown) * 1.0 / messages_analyzed", 3)} AS detection_coverage
FROM a LEFT JOIN p ON a.channel_username = p.channel_username""")(
    lambda s, sf: language.language_profile(_msg_lang(s, sf)))
register("lang_file_profile", f"""
WITH f AS (SELECT *, length(text) AS n FROM ({SQL_FILE_LANG}) d),
tot AS (SELECT channel_username, count(*) AS total_files FROM f GROUP BY ALL),
det AS (SELECT * FROM f WHERE n >= 3 AND language <> 'unknown'),
pl AS (SELECT channel_username, language, count(*) AS count, avg(confidence) AS mean_conf FROM det GROUP BY ALL),
pr AS (SELECT channel_username, language AS primary_language, {sql_round("mean_conf", 3)} AS language_confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY count DESC, language ASC) AS rn FROM pl) x WHERE rn = 1),
st AS (SELECT channel_username, count(*) AS detected_files, {sql_round("avg(confidence)", 3)} AS average_confidence,
        {sql_round("min(confidence)", 3)} AS min_confidence, {sql_round("max(confidence)", 3)} AS max_confidence,
        count_if(confidence < 0.5) AS low_confidence_files FROM det GROUP BY ALL),
nl AS (SELECT channel_username, count(*) AS total_languages_detected FROM pl GROUP BY ALL)
SELECT tot.channel_username, coalesce(primary_language, 'Unknown') AS primary_language,
  coalesce(language_confidence, 0.0) AS language_confidence, coalesce(total_languages_detected, 0) AS total_languages_detected,
  coalesce({sql_round("detected_files * 100.0 / total_files", 2)}, 0.0) AS language_coverage,
  CAST(0 AS BIGINT) AS multilingual_files, coalesce(average_confidence, 0.0) AS average_confidence,
  coalesce(min_confidence, 0.0) AS min_confidence, coalesce(max_confidence, 0.0) AS max_confidence,
  coalesce(low_confidence_files, 0) AS low_confidence_files
FROM tot LEFT JOIN st ON tot.channel_username = st.channel_username LEFT JOIN pr ON tot.channel_username = pr.channel_username
LEFT JOIN nl ON tot.channel_username = nl.channel_username""")(lambda s, sf: language.file_language_profile(msgs(s, sf)))
register("lang_file_top10", f"""
WITH det AS (SELECT * FROM ({SQL_FILE_LANG}) d WHERE length(text) >= 3 AND language <> 'unknown'),
c AS (SELECT channel_username, language, count(*) AS count FROM det GROUP BY ALL),
t AS (SELECT channel_username, sum(count) AS total FROM c GROUP BY ALL)
SELECT r.channel_username, rank, language, count, coalesce({sql_round("count * 100.0 / total", 2)}, 0.0) AS percentage
FROM ({sql_top("SELECT * FROM c", "language", 10)}) r JOIN t ON r.channel_username = t.channel_username""")(
    lambda s, sf: language.file_language_distribution(msgs(s, sf), 10))


def _lang_ngram(spark, sf):
    """L3: train on every labelled document, classify every message; counts per channel."""
    model = language.NgramModel.train(view.table(spark, sf, "documents"))
    det = language.detect_messages(msgs(spark, sf), language.ngram_detector(model))
    return language.language_counts(det)


def _sql_grams(src: str, keys: str) -> str:
    """Trigrams of the letters of lower-cased texts, other runs as one space, with a space at both ends."""
    return rf"""SELECT {keys}, c[i] || c[i + 1] || c[i + 2] AS gram FROM (SELECT {keys}, c, unnest(range(1, len(c) - 1)) AS i FROM (
      SELECT {keys}, regexp_extract_all(' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ', '(?s).') AS c FROM ({src}) s))"""


register("lang_ngram", rf"""
WITH docs AS (SELECT doc_id, lang, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT lang, gram, count(*) AS c FROM ({_sql_grams("SELECT * FROM docs", "lang")}) GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS v FROM counts),
langs AS (SELECT lang, sum(c) + max(v) AS denom, max(p) AS prior FROM counts, v JOIN (SELECT lang AS l, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM docs)) AS p FROM docs GROUP BY lang) ON true
  WHERE l = lang GROUP BY lang),
m AS (SELECT channel_username, message_id, text, length(trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'))) >= 3 AS ok FROM messages WHERE text IS NOT NULL AND text <> ''),
g AS (SELECT message_id, gram, count(*) AS n FROM ({_sql_grams("SELECT * FROM m WHERE ok", "message_id")}) GROUP BY ALL),
known AS (SELECT message_id, lang, sum(n * ln(c + 1)) AS s FROM g JOIN counts USING (gram) GROUP BY ALL),
sizes AS (SELECT message_id, sum(n) AS n FROM g GROUP BY ALL),
scored AS (SELECT sizes.message_id, langs.lang, coalesce(s, 0) + prior - n * ln(denom) AS s FROM sizes CROSS JOIN langs LEFT JOIN known ON known.message_id = sizes.message_id AND known.lang = langs.lang),
best AS (SELECT message_id, arg_max(lang, (s, lang)) AS language FROM scored GROUP BY message_id),
d AS (SELECT channel_username, coalesce(language, 'unknown') AS language, count(*) AS count FROM m LEFT JOIN best ON best.message_id = m.message_id GROUP BY ALL)
SELECT channel_username, language, count, coalesce({sql_round("count * 100.0 / sum(count) OVER (PARTITION BY channel_username)", 2)}, 0.0) AS percentage FROM d""")(_lang_ngram)

# ================================================================ reports and charts
from chatlens.operators import clean, report  # noqa: E402

register("channel_rollup", """
WITH per AS (SELECT channel_username, count(*) AS messages, count_if(file_size > 0) AS files,
               coalesce(sum(CASE WHEN file_size > 0 THEN file_size END), 0) AS bytes FROM messages GROUP BY ALL)
SELECT channel_username, CAST(sum(messages) AS BIGINT) AS total_messages, CAST(sum(files) AS BIGINT) AS total_files,
  CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS channels, CAST(grouping(channel_username) AS BIGINT) AS level
FROM per GROUP BY ROLLUP (channel_username)""")(lambda s, sf: report.channel_rollup(msgs(s, sf)))
register("source_breakdown", """
WITH c AS (SELECT channel_username, 'file' AS source, count(*) AS messages, count_if(file_size > 0) AS files FROM messages GROUP BY ALL),
sp AS (SELECT DISTINCT channel_username FROM messages),
t AS (SELECT * FROM (VALUES ('file'), ('db'), ('diff')) v(source))
SELECT sp.channel_username, t.source, coalesce(c.messages, 0) AS messages, coalesce(c.files, 0) AS files
FROM sp CROSS JOIN t LEFT JOIN c ON c.channel_username = sp.channel_username AND c.source = t.source""")(
    lambda s, sf: report.source_breakdown(msgs(s, sf)))

_METRICS = ["total_messages", "messages_with_text", "media_messages", "total_files", "total_bytes", "total_views"]


def _sql_metrics(src: str) -> str:
    wide = (f"SELECT channel_username, count(*) AS total_messages, count_if(text IS NOT NULL AND text <> '') AS messages_with_text, "
            f"count_if(media_type IS NOT NULL AND media_type <> '') AS media_messages, count_if(file_size > 0) AS total_files, "
            f"coalesce(sum(CASE WHEN file_size > 0 THEN file_size END), 0) AS total_bytes, coalesce(sum(views), 0) AS total_views "
            f"FROM ({src}) z GROUP BY ALL")
    return " UNION ALL ".join(f"SELECT channel_username, '{m}' AS metric, CAST({m} AS BIGINT) AS value FROM ({wide}) w{i}"
                              for i, m in enumerate(_METRICS))


def _run_compare(spark, sf):
    """The metrics ask of a text only whether it is there and not empty, which its first character tells."""
    first = F.left(F.col("text"), F.lit(1)).alias("text")
    l1, l2 = (load.select(*merge.KEY, "views", first, "load_seq") for load in loads(spark, sf))
    cur = merge.keep_latest(merge.union_loads(l1, l2), ["load_seq", "message_id"])
    base = msgs(spark, sf).select("channel_username", "message_id", "media_type", "file_size")
    return report.run_compare(cur.join(base, ["channel_username", "message_id"], "left"),
                              l1.join(base, ["channel_username", "message_id"], "left"))


register("run_compare", f"""WITH {SQL_LOADS},
base AS (SELECT channel_username, message_id, media_type, file_size FROM messages),
cur AS (SELECT comb.*, base.media_type, base.file_size FROM comb LEFT JOIN base USING (channel_username, message_id)),
prev AS (SELECT l1.*, base.media_type, base.file_size FROM l1 LEFT JOIN base USING (channel_username, message_id)),
c AS ({_sql_metrics("SELECT * FROM cur")}),
p AS ({_sql_metrics("SELECT * FROM prev")})
SELECT coalesce(c.channel_username, p.channel_username) AS channel_username, coalesce(c.metric, p.metric) AS metric,
  coalesce(c.value, 0) AS current, coalesce(p.value, 0) AS previous, coalesce(c.value, 0) - coalesce(p.value, 0) AS difference
FROM c FULL OUTER JOIN p ON c.channel_username = p.channel_username AND c.metric = p.metric""")(_run_compare)

register("media_breakdown", "SELECT channel_username, media_type, count(*) AS count FROM messages "
                            "WHERE media_type IS NOT NULL AND media_type <> '' GROUP BY ALL")(
    lambda s, sf: report.media_breakdown(msgs(s, sf)))
register("media_summary", f"""
SELECT channel_username, count(*) AS total_messages,
  count_if(media_type IS NOT NULL AND media_type <> '' AND media_type <> 'text') AS total_media,
  {sql_round("coalesce(sum(file_size), 0) / 1048576.0", 2)} AS storage_mb,
  coalesce({sql_round("count_if(media_type IS NOT NULL AND media_type <> '' AND media_type <> 'text') * 100.0 / count(*)", 2)}, 0.0)
    AS media_percentage
FROM messages GROUP BY ALL""")(lambda s, sf: report.media_summary(msgs(s, sf)))
register("channel_overview", f"""
WITH sp AS (SELECT DISTINCT channel_username FROM messages),
cs AS (SELECT channel_username, count(*) AS total_messages, count_if(text IS NOT NULL AND text <> '') AS messages_with_text,
         count_if(media_type IS NOT NULL AND media_type <> '') AS media_messages FROM messages GROUP BY ALL),
fs AS (SELECT channel_username, count(*) AS total_files, {sql_round("sum(file_size) / 1048576.0", 2)} AS total_storage_mb
         FROM messages WHERE file_size IS NOT NULL GROUP BY ALL),
en AS (SELECT channel_username, CAST(sum(coalesce(views, 0)) AS BIGINT) AS total_views,
         CAST(sum(coalesce(forwards, 0)) AS BIGINT) AS total_forwards, CAST(sum(coalesce(replies, 0)) AS BIGINT) AS total_replies
         FROM messages GROUP BY ALL),
cr AS (SELECT channel_username, count(DISTINCT creator_username) AS total_creators FROM messages
         WHERE creator_username IS NOT NULL GROUP BY ALL),
ht AS (SELECT channel_username, count(*) AS total_unique_hashtags FROM ({sql_token_counts(P.HASHTAG, 'hashtag')}) h GROUP BY ALL)
SELECT sp.channel_username, total_messages, messages_with_text, media_messages, coalesce(total_files, 0) AS total_files,
  coalesce(total_storage_mb, 0.0) AS total_storage_mb, total_views, total_forwards, total_replies,
  coalesce(total_creators, 0) AS total_creators, coalesce(total_unique_hashtags, 0) AS total_unique_hashtags
FROM sp LEFT JOIN cs USING (channel_username) LEFT JOIN fs USING (channel_username) LEFT JOIN en USING (channel_username)
LEFT JOIN cr USING (channel_username) LEFT JOIN ht USING (channel_username)""")(lambda s, sf: report.channel_overview(msgs(s, sf)))


def _requested(spark, sf):
    """Channels asked for: every source named in the documents table, plus one that has no data."""
    docs = view.table(spark, sf, "documents")
    known = docs.select(F.concat(F.lit("@"), F.col("source")).alias("channel_username")).distinct()
    return known.unionByName(spark.createDataFrame([("@no_such_channel",)], "channel_username string"))


register("report_status", """
WITH req AS (SELECT DISTINCT '@' || source AS channel_username FROM documents UNION SELECT '@no_such_channel'),
c AS (SELECT channel_username, count(*) AS messages FROM messages GROUP BY ALL)
SELECT req.channel_username, coalesce(messages, 0) AS messages,
  CASE WHEN messages > 0 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN messages IS NULL THEN 'no messages found' END AS reason
FROM req LEFT JOIN c ON req.channel_username = c.channel_username""")(
    lambda s, sf: report.report_status(msgs(s, sf), _requested(s, sf)))

register("clean_values", """
SELECT message_id, channel_username,
  CASE WHEN date IS NULL THEN NULL WHEN microsecond(date) % 1000000 = 0 THEN strftime(date, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(date, '%Y-%m-%dT%H:%M:%S.%f') END AS date,
  text, creator_username, media_type, file_name, file_size, mime_type, caption, views, forwards, replies,
  CASE WHEN is_forwarded IS NULL THEN NULL WHEN is_forwarded THEN 'true' ELSE 'false' END AS is_forwarded, forwarded_from
FROM messages""")(lambda s, sf: clean.store_values(msgs(s, sf)))
register("human_size", f"""
SELECT channel_username, message_id, file_size, {sql_human("file_size")} AS size_human FROM messages WHERE file_size IS NOT NULL""")(
    lambda s, sf: msgs(s, sf).where(F.col("file_size").isNotNull())
    .select("channel_username", "message_id", "file_size", files.human_size("file_size").alias("size_human")))


def _c(body: str, chart: str, ord_: str, label: str, value: str) -> str:
    return (f"SELECT channel_username, '{chart}' AS chart, CAST({ord_} AS BIGINT) AS ord, CAST({label} AS VARCHAR) AS label, "
            f"CAST({value} AS DOUBLE) AS value FROM ({body}) x_{chart}")


_R = RAW_SQL
_SQL_CREATORS15 = sql_top(SQL_CREATOR_COUNTS, "username", 15, "message_count")
_SQL_LANG10 = sql_top(f"SELECT channel_username, language, count(*) AS count FROM ({SQL_MSG_LANG}) d GROUP BY ALL", "language", 10)
_SQL_HASHTAG_CHART = f"""
WITH h AS ({_R['hashtags_top10']}), e AS ({_R['emojis_top10']}),
hc AS (SELECT DISTINCT channel_username FROM h), ec AS (SELECT DISTINCT channel_username FROM e)
SELECT channel_username, rank, hashtag AS label, count FROM h
UNION ALL SELECT channel_username, rank, emoji, count FROM e WHERE channel_username NOT IN (SELECT channel_username FROM hc)
UNION ALL SELECT channel_username, 1, 'No Data', 0 FROM (SELECT DISTINCT channel_username FROM messages) s
  WHERE channel_username NOT IN (SELECT channel_username FROM hc) AND channel_username NOT IN (SELECT channel_username FROM ec)"""
_SQL_SOURCES_CHART = f"""
SELECT channel_username, series * 10 + CASE source WHEN 'file' THEN 0 WHEN 'db' THEN 1 ELSE 2 END AS o,
  upper(substr(source, 1, 1)) || lower(substr(source, 2)) || ' ' || upper(substr(kind, 1, 1)) || lower(substr(kind, 2)) AS l, v
FROM (SELECT channel_username, source, 0 AS series, 'messages' AS kind, messages AS v FROM ({_R['source_breakdown']}) a
      UNION ALL SELECT channel_username, source, 1, 'files', files FROM ({_R['source_breakdown']}) b) s"""

_CHART_SQL = " UNION ALL ".join([
    _c(f"SELECT channel_username, 0 AS o, 'Unique Files' AS l, total_files - files_with_duplicate_names AS v "
       f"FROM ({_R['filename_duplicates']}) a UNION ALL SELECT channel_username, 1, 'Duplicate Files', files_with_duplicate_names "
       f"FROM ({_R['filename_duplicates']}) b", "file_uniqueness", "o", "l", "v"),
    _c(_R["lang_file_top10"], "file_languages", "rank", "language", "count"),
    _c(_R["emojis_top10"], "emojis", "rank", "emoji", "count"),
    _c(_R["filesize_histogram"], "file_sizes", "ord", "bin", "count"),
    _c(_R["extensions_top10"], "file_types", "rank", "ext", "count"),
    _c(_SQL_HASHTAG_CHART, "hashtags", "rank", "label", "count"),
    _c(f"SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY day) AS o FROM ({_R['timeline_sampled']}) t",
       "timeline", "o", "day", "count"),
    _c(_R["monthly_histogram"], "monthly", "month", "label", "count"),
    _c(_SQL_SOURCES_CHART, "sources", "o", "l", "v"),
    _c(_R["mentions_top10"], "mentions", "rank", "mention", "count"),
    _c(_R["urls_top15"], "urls", "rank", "url", "count"),
    _c(_SQL_LANG10, "languages", "rank", "language", "count"),
    _c(_SQL_CREATORS15, "contributors", "rank", "username", "message_count"),
])
register("charts_long", _CHART_SQL)(lambda s, sf: report.charts_long(msgs(s, sf)))

# ================================================================ remaining slices (V6, X4 words, X19 comparison)
register("latest_messages", """
SELECT channel_username, message_id, date FROM (SELECT *, row_number() OVER (PARTITION BY channel_username
  ORDER BY message_id DESC) AS rn FROM messages) x WHERE rn <= 10""")(
    lambda s, sf: validate.latest_messages(msgs(s, sf), 10).select("channel_username", "message_id", "date"))
register("word_count_stats", f"""
SELECT channel_username, min(wc) AS min_words, max(wc) AS max_words, {sql_round("avg(wc)", 2)} AS mean_words,
  CAST(floor(median(wc)) AS BIGINT) AS median_words
FROM (SELECT channel_username, CASE WHEN text IS NOT NULL AND text <> '' THEN
        CAST(len(regexp_extract_all(text, {lit(WORD_TOKEN)})) AS BIGINT) END AS wc FROM messages) x GROUP BY ALL""")(
    lambda s, sf: content.word_count_stats(msgs(s, sf)))
register("channel_comparison", """
SELECT *, CAST(rank() OVER (ORDER BY messages DESC) AS BIGINT) AS rank_messages,
  CAST(rank() OVER (ORDER BY views DESC) AS BIGINT) AS rank_views, CAST(rank() OVER (ORDER BY files DESC) AS BIGINT) AS rank_files
FROM (SELECT channel_username, count(*) AS messages, CAST(coalesce(sum(views), 0) AS BIGINT) AS views,
        count_if(file_size > 0) AS files FROM messages GROUP BY ALL) p""")(lambda s, sf: report.channel_comparison(msgs(s, sf)))

# ================================================================ K1 manifest, U6 distinct channels
from chatlens.sinks import writers as _writers  # noqa: E402

register("collection_manifest", """
SELECT channel, min_id, max_id, total_messages,
  'tg_' || coalesce(channel, 'unknown') || '_' || coalesce(CAST(min_id AS VARCHAR), 'none') || '_' ||
  coalesce(CAST(max_id AS VARCHAR), 'none') || '.json' AS file_name
FROM (SELECT regexp_replace(channel_username, '^@', '') AS channel, min(message_id) AS min_id, max(message_id) AS max_id,
        count(*) AS total_messages FROM messages GROUP BY ALL) x""")(
    lambda s, sf: _writers.collection_manifest(msgs(s, sf)))
register("distinct_channels", "SELECT DISTINCT regexp_replace(channel_username, '^@', '') AS channel FROM messages")(
    lambda s, sf: msgs(s, sf).select(F.regexp_replace("channel_username", "^@", "").alias("channel")).distinct())

from chatlens.plans import catalog_ingest, catalog_report  # noqa: E402, F401 - register their queries here

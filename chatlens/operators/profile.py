"""One pass over the messages for everything that is counted: a (channel, kind, token, n) table, and reports and charts from it alone.

``token_table`` explodes every message into what it holds (its hashtags, mentions, URLs, emojis, file name, size, creator, day, languages, text length
and so on, each under a kind) and counts them; partial counts are summed before the shuffle, so texts never move and a hot channel or token is no
hot task. The table is small next to the messages: whoever needs several profiles writes it once (``profile``) and takes them from it.
Sums, means and medians come from the counted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions import patterns as P
from chatlens.functions.expr import ANALYSIS_BINS, MONTH_NAMES, extension, non_blank, pct, ratio, round_half_even, size_bin_analysis, size_mb, url_domain
from chatlens.operators import content, language
from chatlens.operators.topk import BY, every_nth, top_k, top_k_by_count
from chatlens.session import cut_lineage

SOURCE_TYPES = ("file", "db", "diff")


def token_table(df: DataFrame, *, by: Sequence[str] = BY, languages: bool = True) -> DataFrame:
    """``channel, kind, token, n`` of all messages."""
    named = non_blank("file_name")
    base = df.select(*by, "text", "media_type", "file_name", "file_size", "creator_username", "date", "views", "forwards", "replies", "is_forwarded", "caption")
    if languages:
        base = language.charfreq(base, "text").withColumnRenamed("language", "text_language").drop("confidence")
        base = base.withColumn("_file_text", F.trim(F.concat_ws(" ", F.col("file_name"), F.coalesce(F.col("caption"), F.lit("")))))
        base = language.charfreq(base, "_file_text").withColumnRenamed("language", "file_language")
    has_text = non_blank("text")

    def one(kind: str, token: Column, when: Column | None = None) -> Column:
        token = token.cast("string")
        return F.when((when & token.isNotNull()) if when is not None else token.isNotNull(), F.struct(F.lit(kind).alias("kind"), token.alias("token")))

    def many(kind: str) -> Column:
        found = F.when(has_text, content.extract_all(content.scan_text(kind), content.PATTERNS[kind])).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))

    single = [one("message", F.lit("")), one("with_text", F.lit(""), has_text), one("text_length", F.length("text"), has_text),
              one("media", F.lit(""), non_blank("media_type")), one("forwarded", F.lit(""), F.coalesce("is_forwarded", F.lit(False))),
              one("file", F.col("file_name"), named), one("size", F.col("file_size"), F.col("file_size") > 0), one("any_size", F.col("file_size")),
              one("creator", F.col("creator_username")), one("day", F.date_format("date", "yyyy-MM-dd")),
              one("views", F.col("views")), one("forwards", F.col("forwards")), one("replies", F.col("replies"))]
    if languages:
        single.append(one("language", F.col("text_language"), has_text))
        known = named & (F.length("_file_text") >= language.MIN_TEXT) & (F.col("file_language") != language.UNKNOWN)
        single.append(one("file_language", F.col("file_language"), known))
    every = F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), *[many(k) for k in content.PATTERNS])
    return (base.select(*by, F.explode(every).alias("x")).groupBy(*by, F.col("x.kind").alias("kind"), F.col("x.token").alias("token"))
            .agg(F.count(F.lit(1)).alias("n")))


def profile(df: DataFrame, *, by: Sequence[str] = BY, languages: bool = True) -> DataFrame:
    """The token table, written once."""
    return cut_lineage(token_table(df, by=by, languages=languages), "profile")


def of(counts: DataFrame, kind: str, name: str = "token", count: str = "count") -> DataFrame:
    by = [c for c in counts.columns if c not in ("kind", "token", "n")]
    return counts.where(F.col("kind") == kind).select(*by, F.col("token").alias(name), F.col("n").alias(count))


def top(counts: DataFrame, kind: str, k: int, name: str, count: str = "count", *, by: Sequence[str] = BY) -> DataFrame:
    return top_k_by_count(of(counts, kind, name, count), k, key=name, count_col=count, by=by).select(*by, "rank", name, count)


def extensions(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    rows = of(counts, "file").select(*by, extension("token").alias("ext"), "count").where("ext is not null")
    return rows.groupBy(*by, "ext").agg(F.sum("count").alias("count"))


def domains(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    rows = of(counts, "url").select(*by, url_domain("token").alias("domain"), "count").where("domain is not null")
    return rows.groupBy(*by, "domain").agg(F.sum("count").alias("count"))


# ------------------------------------------------------------------------------- sections of the report
def _lists(rows: DataFrame, name: str, fields: Sequence[str], *, by: Sequence[str] = BY) -> DataFrame:
    """Ranked rows (at most k a channel) as one sorted array of structs."""
    item = F.struct("rank", F.struct(*fields).alias("item"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))


def _spread(counts: DataFrame, kind: str, *, by: Sequence[str] = BY) -> DataFrame:
    """Count, least, greatest, mean and median of a counted number."""
    v, n = F.col("v"), F.col("count")
    rows = of(counts, kind).withColumn("v", F.col("token").cast("bigint"))
    return rows.groupBy(*by).agg(F.sum(n).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
                                 round_half_even(F.sum(v * n).cast("double") / F.sum(n).cast("double"), 2).alias("mean"),
                                 F.floor(F.percentile(v, 0.5, n)).alias("median"))


def _duplicates(rows: DataFrame, what: str, *, by: Sequence[str] = BY) -> DataFrame:
    return (rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias(f"files_with_duplicate_{what}s"),
                                  F.count(F.lit(1)).alias(f"total_unique_file{what}s"), F.sum("count").alias("total_files"))
            .withColumn("duplicate_ratio", ratio(f"files_with_duplicate_{what}s", "total_files", 3)))


def _totals(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """One row a channel: messages, texts, media, forwarded, sums of engagement, distinct tokens of each kind."""
    def n(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    def total(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("token").try_cast("bigint") * F.col("n"))), F.lit(0))

    def distinct(kind):
        return F.count_if(F.col("kind") == kind)

    return counts.groupBy(*by).agg(
        n("message").alias("total_messages"), n("with_text").alias("messages_with_text"), n("media").alias("media_messages"), n("forwarded").alias("forwarded_messages"),
        *[total(k).alias(f"total_{k}") for k in ("views", "forwards", "replies")], total("size").alias("total_bytes"), n("size").alias("sized_files"), n("file").alias("named_files"),
        *[distinct(k).alias(f"total_unique_{k}s") for k in content.PATTERNS], *[n(k).alias(f"total_{k}s") for k in content.PATTERNS],
        distinct("creator").alias("total_creators"), n("creator").alias("creator_messages"))


def report(counts: DataFrame, *, by: Sequence[str] = BY, source_type: str = "file") -> DataFrame:
    """One nested report a channel with all sections of a comprehensive result: ``analysis_type, data_summary, analysis_results``
    (filename_analysis, filesize_analysis, message_analysis). Lists are bounded by their k."""
    names, sizes = of(counts, "file", "filename"), of(counts, "size").withColumn("size_bytes", F.col("token").cast("bigint"))
    lang = of(counts, "file_language", "language")
    file_langs = top_k_by_count(lang, 10, key="language", by=by)
    lang_total = lang.groupBy(*by).agg(F.sum("count").alias("detected_files"), F.count(F.lit(1)).alias("total_languages_detected"))
    texts = of(counts, "language", "language")
    known = texts.where(F.col("language") != language.UNKNOWN)
    repeated = top_k(sizes.where("count > 1"), 10, by=by, order=[F.col("size_bytes").desc()])
    tables = [
        (_duplicates(names, "name", by=by), "names"),
        (_lists(top_k_by_count(names, 10, key="filename", by=by), "most_common_filenames", ["filename", "count"], by=by), None),
        (names.withColumn("v", F.length("filename").cast("bigint")).groupBy(*by).agg(
            F.sum("count").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
            round_half_even(F.sum(F.col("v") * F.col("count")).cast("double") / F.sum("count").cast("double"), 2).alias("mean"),
            F.floor(F.percentile("v", 0.5, F.col("count"))).alias("median")), "filename_length"),
        (names.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("filename").rlike(P.SPECIAL_CHAR), F.col("count"))), F.lit(0)).alias("files_with_special_chars"),
                                F.coalesce(F.sum(F.when(F.col("filename").contains(" "), F.col("count"))), F.lit(0)).alias("files_with_spaces")), "chars"),
        (_lists(top_k_by_count(extensions(counts, by=by), 10, key="ext", by=by).withColumn("ext", F.concat(F.lit("."), "ext")), "common_extensions", ["ext", "count"], by=by), None),
        (_lists(file_langs.join(lang_total.select(*by, "detected_files"), list(by)).withColumn("percentage", pct("count", "detected_files", 2)), "detected_languages",
                ["language", "count", "percentage"], by=by), None),
        (lang_total.join(top_k_by_count(lang, 1, key="language", by=by).select(*by, F.col("language").alias("primary_language")), list(by)), "file_languages"),
        (_duplicates(sizes, "size", by=by), "sizes"),
        (_lists(top_k_by_count(sizes, 10, key="size_bytes", by=by).withColumn("size_mb", size_mb("size_bytes")), "most_common_filesizes", ["size_bytes", "count", "size_mb"], by=by), None),
        (_bins(counts, by=by).groupBy(*by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bin", "count"))), lambda x: F.struct(x["bin"], x["count"]))).alias("size_frequency_distribution")), None),
        (_lists(repeated, "potential_duplicates_by_size", ["size_bytes", "count"], by=by), None),
        (_totals(counts, by=by), "totals"),
        (_spread(counts, "text_length", by=by), "text_length_stats"),
        *[(_lists(top(counts, k, 10, k, by=by), f"top_{k}s", [k, "count"], by=by), None) for k in ("hashtag", "mention", "emoji", "url")],
        (_lists(top_k_by_count(domains(counts, by=by), 5, key="domain", by=by), "top_domains", ["domain", "count"], by=by), None),
        (domains(counts, by=by).groupBy(*by).agg(F.count(F.lit(1)).alias("total_unique_domains")), "domains"),
        (_lists(top(counts, "creator", 10, "username", "message_count", by=by), "most_active_creators", ["username", "message_count"], by=by), None),
        (_lists(top_k_by_count(texts, 10, key="language", by=by), "languages", ["language", "count"], by=by), None),
        (top_k_by_count(known, 1, key="language", by=by).select(*by, F.col("language").alias("primary_language")), "text_language"),
    ]
    out = counts.select(*by).distinct()
    for table, name in tables:
        columns = [c for c in table.columns if c not in by]
        out = out.join(table.select(*by, F.struct(*columns).alias(name)) if name else table, list(by), "left")
        if not name:
            empty = F.array_compact(F.array(F.lit(None).cast(table.schema[columns[0]].dataType.elementType))) if table.schema[columns[0]].dataType.typeName() == "array" else None
            if empty is not None:
                out = out.withColumn(columns[0], F.coalesce(F.col(columns[0]), empty))

    def number(path: str, default: object = 0) -> Column:
        return F.coalesce(F.col(path), F.lit(default)).alias(path.split(".")[-1])

    def group(name: str, fields: Sequence[str], *lists: str) -> Column:
        return F.struct(*[number(f"{name}.{f}", 0.0 if f == "duplicate_ratio" else 0) for f in fields], *lists)

    filename = F.struct(
        group("names", ["files_with_duplicate_names", "total_unique_filenames", "total_files", "duplicate_ratio"], "most_common_filenames").alias("duplicate_filename_detection"),
        F.struct("filename_length", "common_extensions", number("chars.files_with_special_chars"), number("chars.files_with_spaces")).alias("filename_pattern_analysis"),
        F.struct(number("file_languages.primary_language", "Unknown"), number("file_languages.total_languages_detected"), "detected_languages",
                 pct("file_languages.detected_files", "names.total_files", 2).alias("language_coverage")).alias("filename_language_analysis"))
    filesize = F.struct(
        group("sizes", ["files_with_duplicate_sizes", "total_unique_filesizes", "total_files", "duplicate_ratio"], "most_common_filesizes").alias("duplicate_filesize_detection"),
        F.struct("size_frequency_distribution", "potential_duplicates_by_size").alias("filesize_distribution_analysis"))
    message = F.struct(
        F.struct(number("totals.total_messages"), number("totals.messages_with_text"), "text_length_stats", number("totals.media_messages"),
                 number("totals.forwarded_messages")).alias("content_statistics"),
        F.struct(F.struct("top_hashtags", number("totals.total_unique_hashtags")).alias("hashtags"), F.struct("top_mentions", number("totals.total_unique_mentions")).alias("mentions"),
                 F.struct("top_domains", "top_urls", number("totals.total_urls"), number("totals.total_unique_urls"), number("domains.total_unique_domains")).alias("urls"),
                 F.struct("top_emojis", number("totals.total_unique_emojis")).alias("emojis")).alias("pattern_recognition"),
        F.struct(number("totals.total_creators"), number("totals.creator_messages"), ratio("totals.creator_messages", "totals.total_creators", 2).alias("avg_messages_per_creator"),
                 "most_active_creators").alias("creator_message_stats"),
        F.struct(number("text_language.primary_language", "unknown"), F.col("languages").alias("detected_languages")).alias("language_detection"))
    body = F.struct(F.regexp_replace(F.col(by[0]), "^@", "").alias("channel_name"), F.lit("comprehensive").alias("analysis_type"),
                    F.struct(number("totals.total_messages").alias("total_records"), F.lit(source_type).alias("source_type")).alias("data_summary"),
                    F.struct(filename.alias("filename_analysis"), filesize.alias("filesize_analysis"), message.alias("message_analysis")).alias("analysis_results"))
    return out.select(*by, body.alias("report"), F.to_json(body, {"ignoreNullFields": "false"}).alias("report_json"))


# What a section must hold, as the per-type rules of the result reader have it: any of these.
REQUIRED_SECTIONS = {"filename_analysis": ("duplicate_filename_detection", "common_extensions"),
                     "filesize_analysis": ("filesize_distribution_analysis", "size_frequency_distribution"),
                     "message_analysis": ("total_messages", "content_statistics")}
MAX_REPORT_CHARS = 1_000_000


def validate_report(reports: DataFrame, *, by: str = "channel_username", max_chars: int = MAX_REPORT_CHARS) -> DataFrame:
    """V8: for each section of every report its length as JSON, whether that is within the limit and whether required fields are there."""
    rows = []
    for name, keys in REQUIRED_SECTIONS.items():
        section = F.col(f"report.analysis_results.{name}")
        fields = reports.schema["report"].dataType["analysis_results"].dataType[name].dataType.names
        present = F.lit(False)
        for k in keys:
            if k in fields:
                present = present | section[k].isNotNull()
        rows.append(F.struct(F.lit(name).alias("report_type"), F.length(F.to_json(section, {"ignoreNullFields": "false"})).cast("bigint").alias("json_chars"), present.alias("has_required")))
    return (reports.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.*")
            .withColumn("within_limit", F.col("json_chars") <= max_chars).withColumn("valid", F.col("within_limit") & F.col("has_required")))


def _bins(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Files for each size bin, all bins of every channel that has sized files."""
    rows = of(counts, "size").select(*by, size_bin_analysis(F.col("token").cast("bigint")).alias("bin"), "count").groupBy(*by, "bin").agg(F.sum("count").alias("count"))
    spine = rows.select(*by).distinct().select(*by, F.posexplode(F.array(*map(F.lit, ANALYSIS_BINS))).alias("ord", "bin"))
    return spine.join(rows, [*by, "bin"], "left").select(*by, F.col("ord").cast("bigint").alias("ord"), "bin", F.coalesce("count", F.lit(0)).alias("count"))


# ------------------------------------------------------------------------------- charts
def charts(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """G1-G13 from the token table: ``channel, chart, ord, label, value``."""
    def chart(rows: DataFrame, name: str, ord_: str | Column, label: str | Column, value: str | Column) -> DataFrame:
        c = [F.col(x) if isinstance(x, str) else x for x in (ord_, label, value)]
        return rows.select(*by, F.lit(name).alias("chart"), c[0].cast("bigint").alias("ord"), c[1].cast("string").alias("label"), c[2].cast("double").alias("value"))

    def pairs(rows: DataFrame, *items: tuple) -> DataFrame:
        return rows.select(*by, F.inline(F.array(*[F.struct(F.lit(o).alias("o"), lab.alias("l"), v.cast("bigint").alias("v")) for o, lab, v in items])))

    spine = counts.select(*by).distinct()
    names = _duplicates(of(counts, "file"), "name", by=by)
    days = of(counts, "day", "day")
    sampled = every_nth(days, "day", max_points=100, by=by)
    sampled = sampled.withColumn("o", F.row_number().over(Window.partitionBy(*by).orderBy("day")))
    months = days.select(*by, F.substring("day", 6, 2).cast("int").alias("month"), "count").groupBy(*by, "month").agg(F.sum("count").alias("count"))
    year = days.select(*by).distinct().select(*by, F.posexplode(F.array(*map(F.lit, MONTH_NAMES))).alias("pos", "label")).withColumn("month", F.col("pos") + 1)
    year = year.join(months, [*by, "month"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    totals = _totals(counts, by=by)
    sources = pairs(totals, *[(10 * k + i, F.lit(f"{s.title()} {kind}"), v if s == "file" else F.lit(0))
                              for k, (kind, v) in enumerate((("Messages", F.col("total_messages")), ("Files", F.col("sized_files")))) for i, s in enumerate(SOURCE_TYPES)])
    tags, emojis = top(counts, "hashtag", 10, "label", by=by), top(counts, "emoji", 10, "label", by=by)
    instead = emojis.join(tags.select(*by).distinct(), list(by), "left_anti")
    nothing = (spine.join(tags.unionByName(emojis).select(*by).distinct(), list(by), "left_anti")
               .select(*by, F.lit(1).cast("bigint").alias("rank"), F.lit("No Data").alias("label"), F.lit(0).cast("bigint").alias("count")))
    parts = [
        chart(pairs(names, (0, F.lit("Unique Files"), F.col("total_files") - F.col("files_with_duplicate_names")), (1, F.lit("Duplicate Files"), F.col("files_with_duplicate_names"))),
              "file_uniqueness", "o", "l", "v"),
        chart(top(counts, "file_language", 10, "language", by=by), "file_languages", "rank", "language", "count"),
        chart(emojis, "emojis", "rank", "label", "count"),
        chart(_bins(counts, by=by), "file_sizes", "ord", "bin", "count"),
        chart(top_k_by_count(extensions(counts, by=by), 10, key="ext", by=by), "file_types", "rank", F.concat(F.lit("."), F.col("ext")), "count"),
        chart(tags.unionByName(instead).unionByName(nothing), "hashtags", "rank", "label", "count"),
        chart(sampled, "timeline", "o", "day", "count"),
        chart(year, "monthly", "month", "label", "count"),
        chart(sources, "sources", "o", "l", "v"),
        chart(top(counts, "mention", 10, "mention", by=by), "mentions", "rank", "mention", "count"),
        chart(top(counts, "url", 15, "url", by=by), "urls", "rank", "url", "count"),
        chart(top(counts, "language", 10, "language", by=by), "languages", "rank", "language", "count"),
        chart(top(counts, "creator", 15, "username", by=by), "contributors", "rank", "username", "count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dashboard(counts: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """K6: the dashboard as one row of JSON texts a part: ``part, channel_username, json`` with the metadata and summary of all channels
    and one entry for each channel (its totals and its chart datasets, labels and values in order)."""
    totals = _totals(counts, by=by)
    rows = charts(counts, by=by)
    data = rows.groupBy(*by, "chart").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "value"))).alias("x")).select(
        *by, "chart", F.struct(F.transform("x", lambda i: i["label"]).alias("labels"), F.transform("x", lambda i: i["value"]).alias("data")).alias("dataset"))
    per = data.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chart", "dataset")))).alias("charts"))
    channel = totals.join(per, list(by), "left").select(*by, F.to_json(F.struct(F.col("total_messages").alias("messages"), F.col("named_files").alias("files"),
                                                                              F.col("total_bytes").alias("total_data_size_bytes"), "charts")).alias("json"))
    whole = totals.agg(F.count(F.lit(1)).alias("channels"), F.coalesce(F.sum("total_messages"), F.lit(0)).alias("m"), F.coalesce(F.sum("named_files"), F.lit(0)).alias("f"),
                       F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("b"))
    summary = whole.select(F.to_json(F.struct(F.col("m").alias("total_messages"), F.col("f").alias("total_files"), F.col("channels").alias("channels_count"),
                                              F.col("b").alias("total_data_size_bytes"))).alias("json"))
    return (summary.select(F.lit("summary").alias("part"), F.lit(None).cast("string").alias(by[0]), "json")
            .unionByName(channel.select(F.lit("channel").alias("part"), *by, "json")))

"""Registered queries of nested reports and the dashboard; imported by ``catalog``, which holds the registry.

The statements build the same JSON texts from the statements of the single profiles.
"""

from __future__ import annotations


from chatlens.functions.expr import sql_round
from chatlens.operators import profile
from chatlens.plans.catalog import RAW_SQL, SQL_FILE_LANG, SQL_MSG_LANG, msgs, register


def sql_list(key: str, fields: dict[str, str], order: str = "rank", sql: str | None = None) -> str:
    """(channel, list of structs) of a ranked table."""
    packed = ", ".join(f"{k} := {v}" for k, v in fields.items())
    return f"SELECT channel_username, list(struct_pack({packed}) ORDER BY {order}) AS l FROM ({sql or RAW_SQL[key]}) q GROUP BY channel_username"


_LISTS = {
    "names": sql_list("filename_top10", {"filename": "filename", "count": "count"}), "exts": sql_list("extensions_top10", {"ext": "ext", "count": "count"}),
    "flangs": sql_list("lang_file_top10", {"language": "language", "count": "count", "percentage": "percentage"}),
    "sizes": sql_list("filesize_top10", {"size_bytes": "size_bytes", "count": "count", "size_mb": "size_mb"}),
    "dups": sql_list("", {"size_bytes": "size_bytes", "count": "n"}, "size_bytes DESC", """SELECT channel_username, size_bytes, n FROM (
      SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY size_bytes DESC) AS k FROM (
        SELECT channel_username, file_size AS size_bytes, count(*) AS n FROM messages WHERE file_size > 0 GROUP BY ALL HAVING count(*) > 1)) WHERE k <= 10"""),
    "tags": sql_list("hashtags_top10", {"hashtag": "hashtag", "count": "count"}), "ments": sql_list("mentions_top10", {"mention": "mention", "count": "count"}),
    "emos": sql_list("emojis_top10", {"emoji": "emoji", "count": "count"}),
    "urls": sql_list("", {"url": "url", "count": "count"}, sql=f"SELECT * FROM ({RAW_SQL['urls_top15']}) WHERE rank <= 10"),
    "doms": sql_list("url_domains_top5", {"domain": "domain", "count": "count"}),
    "makers": sql_list("creators_top10", {"username": "username", "message_count": "message_count"}),
    "langs": sql_list("", {"language": "language", "count": "count"}, "count DESC, language", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_username ORDER BY count DESC, language) AS k
      FROM (SELECT channel_username, language, count(*) AS count FROM ({SQL_MSG_LANG}) d GROUP BY ALL)) WHERE k <= 10"""),
}
_TABLES = {
    "dn": RAW_SQL["filename_duplicates"], "fl": RAW_SQL["filename_length_stats"], "fc": RAW_SQL["filename_char_flags"], "ds": RAW_SQL["filesize_duplicates"],
    "bins": f"SELECT channel_username, map_from_entries(list(struct_pack(k := bin, v := count) ORDER BY ord)) AS m FROM ({RAW_SQL['filesize_histogram']}) GROUP BY ALL",
    "cs": RAW_SQL["content_stats"], "ht": RAW_SQL["hashtag_totals"], "mt": RAW_SQL["mention_totals"], "et": RAW_SQL["emoji_totals"], "ut": RAW_SQL["url_totals"],
    "cr": RAW_SQL["creator_stats"], "lp": RAW_SQL["lang_profile"],
    "det": f"""SELECT channel_username, count(*) AS detected, count(DISTINCT language) AS languages, arg_max(language, (n, -ord)) AS best FROM (
      SELECT *, count(*) OVER (PARTITION BY channel_username, language) AS n, dense_rank() OVER (ORDER BY language) AS ord FROM ({SQL_FILE_LANG}) d
      WHERE length(text) >= 3 AND language <> 'unknown') GROUP BY ALL""",
}


def _l(name: str) -> str:
    return f"coalesce({name}.l, [])"


_SECTIONS = {
    "filename_analysis": f"""struct_pack(
      duplicate_filename_detection := struct_pack(files_with_duplicate_names := coalesce(dn.files_with_duplicate_names, 0), total_unique_filenames := coalesce(dn.total_unique_filenames, 0),
        total_files := coalesce(dn.total_files, 0), duplicate_ratio := coalesce(dn.duplicate_ratio, 0.0::DOUBLE), most_common_filenames := {_l('names')}),
      filename_pattern_analysis := struct_pack(filename_length := CASE WHEN fl.count IS NOT NULL THEN struct_pack(count := fl.count, min := fl.min, max := fl.max, mean := fl.mean, median := fl.median) END,
        common_extensions := {_l('exts')}, files_with_special_chars := coalesce(fc.files_with_special_chars, 0), files_with_spaces := coalesce(fc.files_with_spaces, 0)),
      filename_language_analysis := struct_pack(primary_language := coalesce(det.best, 'Unknown'), total_languages_detected := coalesce(det.languages, 0), detected_languages := {_l('flangs')},
        language_coverage := coalesce({sql_round("det.detected * 100.0 / dn.total_files", 2)}, 0.0::DOUBLE)))""",
    "filesize_analysis": f"""struct_pack(
      duplicate_filesize_detection := struct_pack(files_with_duplicate_sizes := coalesce(ds.files_with_duplicate_sizes, 0), total_unique_filesizes := coalesce(ds.total_unique_filesizes, 0),
        total_files := coalesce(ds.total_files, 0), duplicate_ratio := coalesce(ds.duplicate_ratio, 0.0::DOUBLE), most_common_filesizes := {_l('sizes')}),
      filesize_distribution_analysis := struct_pack(size_frequency_distribution := bins.m, potential_duplicates_by_size := {_l('dups')}))""",
    "message_analysis": f"""struct_pack(
      content_statistics := struct_pack(total_messages := cs.total_messages, messages_with_text := cs.messages_with_text, text_length_stats := CASE WHEN cs.text_length_count > 0 THEN
        struct_pack(count := cs.text_length_count, min := cs.text_length_min, max := cs.text_length_max, mean := cs.text_length_mean, median := cs.text_length_median) END,
        media_messages := cs.media_messages, forwarded_messages := cs.forwarded_messages),
      pattern_recognition := struct_pack(hashtags := struct_pack(top_hashtags := {_l('tags')}, total_unique_hashtags := coalesce(ht.total_unique_hashtags, 0)),
        mentions := struct_pack(top_mentions := {_l('ments')}, total_unique_mentions := coalesce(mt.total_unique_mentions, 0)),
        urls := struct_pack(top_domains := {_l('doms')}, top_urls := {_l('urls')}, total_urls := coalesce(ut.total_urls, 0), total_unique_urls := coalesce(ut.total_unique_urls, 0),
          total_unique_domains := coalesce(ut.total_unique_domains, 0)),
        emojis := struct_pack(top_emojis := {_l('emos')}, total_unique_emojis := coalesce(et.total_unique_emojis, 0))),
      creator_message_stats := struct_pack(total_creators := coalesce(cr.total_creators, 0), creator_messages := coalesce(cr.total_messages, 0),
        avg_messages_per_creator := coalesce(cr.avg_messages_per_creator, 0.0::DOUBLE), most_active_creators := {_l('makers')}),
      language_detection := struct_pack(primary_language := coalesce(lp.primary_language, 'unknown'), detected_languages := {_l('langs')}))""",
}
_FROM = ("FROM (SELECT DISTINCT channel_username FROM messages) sp "
         + " ".join(f"LEFT JOIN ({sql}) {name} ON {name}.channel_username IS NOT DISTINCT FROM sp.channel_username" for name, sql in {**_LISTS, **_TABLES}.items()))

register("report_json", f"""
SELECT sp.channel_username, CAST(to_json(struct_pack(channel_name := regexp_replace(sp.channel_username, '^@', ''), analysis_type := 'comprehensive',
  data_summary := struct_pack(total_records := cs.total_messages, source_type := 'file'),
  analysis_results := struct_pack({", ".join(f"{k} := {v}" for k, v in _SECTIONS.items())}))) AS VARCHAR) AS report_json
{_FROM}""")(lambda s, sf: profile.report(profile.profile(msgs(s, sf))).select("channel_username", "report_json"))

register("report_validation", f"""
SELECT channel_username, report_type, CAST(length(j) AS BIGINT) AS json_chars, true AS has_required, length(j) <= 1000000 AS within_limit, length(j) <= 1000000 AS valid FROM (
  {" UNION ALL ".join(f"SELECT sp.channel_username, '{k}' AS report_type, CAST(to_json({v}) AS VARCHAR) AS j {_FROM}" for k, v in _SECTIONS.items())})""")(
    lambda s, sf: profile.validate_report(profile.report(profile.profile(msgs(s, sf)))))

register("dashboard_json", f"""
WITH ch AS (SELECT * FROM ({RAW_SQL['charts_long']})),
d AS (SELECT channel_username, chart, struct_pack(labels := list(label ORDER BY ord, label), data := list(value ORDER BY ord, label)) AS dataset FROM ch GROUP BY ALL),
p AS (SELECT channel_username, map_from_entries(list(struct_pack(k := chart, v := dataset) ORDER BY chart)) AS charts FROM d GROUP BY ALL),
t AS (SELECT channel_username, count(*) AS m, count_if(file_name IS NOT NULL AND file_name <> '') AS f, CAST(coalesce(sum(CASE WHEN file_size > 0 THEN file_size END), 0) AS BIGINT) AS b FROM messages GROUP BY ALL)
SELECT 'summary' AS part, NULL AS channel_username, CAST(to_json(struct_pack(total_messages := CAST(sum(m) AS BIGINT), total_files := CAST(sum(f) AS BIGINT), channels_count := count(*),
  total_data_size_bytes := CAST(sum(b) AS BIGINT))) AS VARCHAR) AS json FROM t
UNION ALL
SELECT 'channel', t.channel_username, CAST(to_json(struct_pack(messages := m, files := f, total_data_size_bytes := b, charts := charts)) AS VARCHAR)
FROM t LEFT JOIN p ON p.channel_username IS NOT DISTINCT FROM t.channel_username""")(lambda s, sf: profile.dashboard(profile.profile(msgs(s, sf))))

"""Registered queries of ingest, values, lineage and search; imported by ``catalog``, which holds the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlens.operators import clean
from chatlens.plans import archive
from chatlens.plans.catalog import register
from chatlens.sources import collections, view

# ================================================================ S1-S3, S5: collection files of every shape, read by blocks
register("ingest_envelopes", f"""
SELECT {archive.SQL_ID} AS message_id, {archive.SQL_CHANNEL} AS channel_username, date, text, creator_username, media_type, file_name, file_size, views, forwards,
  is_forwarded, CASE WHEN {archive.SQL_SHAPE} = 0 THEN '{archive.COLLECTED}' END AS loaded_at
FROM messages""")(lambda s, sf: collections.read_messages(s, archive.archive(s, sf)).select(*archive.FIELDS, "loaded_at"))


def _ingest_rejects(spark, sf):
    _, rejects = collections.read_collection_files(spark, archive.archive(spark, sf))
    return rejects.groupBy("code", "detail").agg(F.count(F.lit(1)).alias("count"))


register("ingest_rejects", f"SELECT code, detail, count(*) AS count FROM ({archive.SQL_REJECTS}) r GROUP BY ALL")(_ingest_rejects)


# ================================================================ C4: values of unknown type
# JSON documents from the view's columns, one SQL text for both engines; every branch of the rule occurs.
SQL_DOCUMENT = """concat('{"caption": ', CASE WHEN message_id % 5 = 0 THEN '["a", 2, null, {"k": 1}]' WHEN message_id % 5 = 1 THEN '{"a": 1, "b": [true]}' WHEN message_id % 5 = 2 THEN '[]'
    WHEN message_id % 5 = 3 THEN '"Bool"' ELSE 'null' END,
  ', "file_size": ', CASE WHEN file_size IS NULL THEN '"15"' WHEN message_id % 3 = 0 THEN concat(CAST(file_size AS VARCHAR(20)), '.7') WHEN message_id % 3 = 1 THEN CAST(file_size AS VARCHAR(20)) ELSE '-0.9' END,
  ', "forwards": "', CAST(forwards AS VARCHAR(20)), '", "is_forwarded": ', CASE WHEN is_forwarded THEN 'true' WHEN message_id % 2 = 0 THEN 'false' ELSE '"TRUE"' END,
  ', "media_type": ', CASE WHEN media_type IS NULL THEN '"nan"' WHEN message_id % 4 = 0 THEN '"bool"' ELSE concat('"', media_type, '"') END,
  ', "replies": ', CASE WHEN message_id % 4 = 0 THEN '"x1"' WHEN message_id % 4 = 1 THEN '1.5e2' WHEN message_id % 4 = 2 THEN '"-3"' ELSE CAST(replies AS VARCHAR(20)) END,
  ', "score": ', CASE WHEN message_id % 2 = 0 THEN '0.25' ELSE '7' END, ', "views": ', CASE WHEN views IS NULL THEN '"NaT"' WHEN message_id % 2 = 0 THEN concat('"', CAST(views AS VARCHAR(20)), '"') ELSE concat(CAST(views AS VARCHAR(20)), '.999') END, '}')"""

register("value_normalisation", f"""
WITH d AS (SELECT message_id, {SQL_DOCUMENT} AS document FROM messages),
e AS (SELECT d.message_id, j.key AS field, j.type AS t, j.value AS v, j.value ->> '$' AS s FROM d, json_each(d.document) j),
r AS (SELECT *, t = 'NULL' OR (t = 'VARCHAR' AND s IN ('NaN', 'NaT', 'nan', 'nat')) AS missing, t IN ('BIGINT', 'UBIGINT', 'DOUBLE') AS is_number,
  field IN ('views', 'forwards', 'replies') AS is_count, t = 'VARCHAR' AND regexp_full_match(s, '[0-9]+') AS digits FROM e),
x AS (SELECT *, (is_number AND (is_count OR field = 'file_size')) OR (digits AND is_count) AS is_integer FROM r)
SELECT message_id, field,
  CASE WHEN missing THEN 'null' WHEN is_integer THEN 'integer' WHEN is_number THEN 'number' WHEN t IN ('ARRAY', 'OBJECT') THEN 'json' ELSE 'string' END AS kind,
  CASE WHEN missing THEN NULL WHEN is_integer THEN CAST(CAST(trunc(CAST(s AS DECIMAL(38, 6))) AS BIGINT) AS VARCHAR) WHEN t = 'BOOLEAN' THEN s
       WHEN t = 'VARCHAR' THEN CASE WHEN lower(s) = 'bool' THEN 'false' WHEN lower(s) IN ('true', 'false') THEN lower(s) ELSE s END
       WHEN t = 'ARRAY' THEN '{{' || array_to_string(list_transform(range(0, CAST(json_array_length(v) AS BIGINT)), lambda i: '"' || i || '":' || CAST(json_extract(v, '$[' || i || ']') AS VARCHAR)), ',') || '}}'
       WHEN t = 'OBJECT' THEN '[' || CAST(v AS VARCHAR) || ']' ELSE s END AS value
FROM x""")(lambda s, sf: clean.normal_values(view.messages(s, sf).select("message_id", F.expr(SQL_DOCUMENT).alias("document")), keep=("message_id",)))


# ================================================================ S8, S9: results in a folder tree
def _result_tree(spark, sf):
    """Nested results of every channel below each source type, some of no known kind; returns the folder."""
    import uuid

    from chatlens.session import scratch_path
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    per = (view.messages(spark, sf).groupBy(F.regexp_replace("channel_username", "^@", "").alias("channel"))
           .agg(F.count(F.lit(1)).alias("n"), F.count("file_name").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")))
    no = F.lit(None)
    kinds = {
        "names": {"duplicate_filename_detection": F.struct(F.col("files").alias("total_files"))},
        "sizes": {"filesize_distribution_analysis": F.struct(F.col("bytes").alias("total_bytes"))},
        "texts": {"content_statistics": F.struct(F.col("n").alias("total_messages")), "total_messages": F.col("n")},
        "all": {"channel_name": F.col("channel"), "analysis_type": F.lit("analysis_summary"), "total_messages_analyzed": F.col("n"), "total_files_analyzed": F.col("files")},
        "other": {"note": F.lit("no report")},
    }
    fields = {k: c for columns in kinds.values() for k, c in columns.items()}
    types = per.select(*[c.alias(k) for k, c in fields.items()]).schema
    out = None
    for kind, columns in kinds.items():
        row = per.select("channel", F.lit(kind).alias("kind"), *[columns.get(f.name, no).cast(f.dataType).alias(f.name) for f in types])
        out = row if out is None else out.unionByName(row)
    spread = out.select("*", F.explode(F.array(F.lit("file_messages"), F.lit("db_messages"))).alias("source_type")).withColumn("folder", F.col("channel"))
    spread.drop("channel").repartition("source_type", "folder", "kind").write.partitionBy("source_type", "folder", "kind").json(path)
    return path


def _result_types(spark, sf):
    from chatlens.sources import results
    reports, rejects = results.read_reports(spark, _result_tree(spark, sf))
    total = F.coalesce(*[F.try_variant_get("report", p, "bigint") for p in (
        "$.duplicate_filename_detection.total_files", "$.filesize_distribution_analysis.total_bytes", "$.content_statistics.total_messages", "$.total_messages_analyzed")])
    bad = rejects.groupBy("code").agg(F.count(F.lit(1)).alias("total"))
    return reports.select("source_type", "channel", "analysis_type", "valid", total.alias("total")).unionByName(
        bad.select(F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("channel"), F.col("code").alias("analysis_type"),
                   F.lit(False).alias("valid"), "total"))


register("result_types", """
WITH per AS (SELECT regexp_replace(channel_username, '^@', '') AS channel, count(*) AS n, count(file_name) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes
  FROM messages GROUP BY ALL),
s AS (SELECT unnest(['file_messages', 'db_messages']) AS source_type)
SELECT source_type, channel, 'filename_analysis' AS analysis_type, true AS valid, files AS total FROM per, s
UNION ALL SELECT source_type, channel, 'filesize_analysis', true, bytes FROM per, s
UNION ALL SELECT source_type, channel, 'message_analysis', true, n FROM per, s
UNION ALL SELECT source_type, channel, 'analysis_summary', true, n FROM per, s
UNION ALL SELECT NULL, NULL, 'VALIDATION_MISSING_FIELD', false, count(*) FROM per, s""")(_result_types)


# ================================================================ U3, U4, U5: combine into a store, its log and its ledger
def _combined_store(spark, sf):
    """Two loads combined into a new store: the archive of all messages, then every third message again with more views. (store path, second summary)"""
    import os
    import uuid

    from chatlens.plans import jobs
    from chatlens.session import scratch_path
    store = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    jobs.combine(spark, archive.archive(spark, sf), store, glob="*.txt", lines_glob=None)
    again = scratch_path(spark, f"again-{uuid.uuid4().hex}")
    later = view.messages(spark, sf).where("message_id % 3 = 0").withColumn("views", F.col("views") + 1000)
    archive.write_archive(later, again)
    summary, _ = jobs.combine(spark, again, os.path.join(store), glob="*.txt", lines_glob=None)
    return store, summary


SQL_STORE = f"""SELECT {archive.SQL_ID} AS message_id, {archive.SQL_CHANNEL} AS channel_username, CASE WHEN message_id % 3 = 0 THEN views + 1000 ELSE views END AS views,
  text, message_id % 3 = 0 AS again FROM messages
UNION ALL SELECT 1, NULL, NULL, NULL, false WHERE false"""


def _combine_job(spark, sf):
    from chatlens.plans import jobs
    store, _ = _combined_store(spark, sf)
    return spark.read.schema(jobs.stored_schema(True)).parquet(store).select("message_id", "channel_username", "views", F.md5(F.col("text").cast("binary")).alias("text_md5"))


register("combine_job", f"SELECT message_id, channel_username, views, md5(text) AS text_md5 FROM ({SQL_STORE}) s")(_combine_job)


def _combine_job_summary(spark, sf):
    _, summary = _combined_store(spark, sf)
    return summary.select("channel_username", "existing_messages", "new_rows", "new_messages_added", "total_messages", "duplicates_removed", "status", "overall_range")


register("combine_job_summary", f"""
SELECT channel_username, count(*) AS existing_messages, count_if(again) AS new_rows, CAST(0 AS BIGINT) AS new_messages_added, count(*) AS total_messages,
  count_if(again) AS duplicates_removed, CASE WHEN count_if(again) > 0 THEN 'updated' ELSE 'no_new_files' END AS status,
  CAST(min(message_id) AS VARCHAR) || '-' || CAST(max(message_id) AS VARCHAR) AS overall_range
FROM ({SQL_STORE}) s GROUP BY channel_username""")(_combine_job_summary)


def _lineage_ledger(spark, sf):
    """Three loads of the message table, each in units of a hundred ids, in one append-only ledger; its islands of ids."""
    import uuid

    from chatlens.plans import jobs
    from chatlens.plans.catalog import loads
    from chatlens.session import scratch_path
    store = scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    first, second = loads(spark, sf)
    third = view.messages(spark, sf).where("message_id % 100 >= 90").select("channel_username", "message_id", "date")
    for seq, rows in enumerate((first, second, third), 1):
        # what a load lacks (by date, by id) leaves gaps between units; units of different loads overlap
        ranges = (rows.withColumn("source_file", F.floor(F.col("message_id") / 100).cast("string"))
                  .groupBy("channel_username", "source_file").agg(F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"), F.count(F.lit(1)).alias("messages")))
        (ranges.select(F.lit(seq).cast("long").alias("load"), F.current_timestamp().alias("combined_at"), "channel_username", "source_file", "min_id", "max_id", "messages")
         .write.mode("append").parquet(f"{store}/{jobs.LEDGER}"))
    return jobs.lineage_ledger(spark, store)


from chatlens.plans.catalog import SQL_LOADS  # noqa: E402

register("lineage_ledger", f"""WITH {SQL_LOADS},
all_loads AS (SELECT channel_username, message_id, date, 1 AS load FROM l1 UNION ALL SELECT channel_username, message_id, date, 2 FROM l2
  UNION ALL SELECT channel_username, message_id, date, 3 FROM messages WHERE message_id % 100 >= 90),
r AS (SELECT channel_username, load, CAST(message_id // 100 AS VARCHAR) AS source_file,
  min(message_id) AS min_id, max(message_id) AS max_id, count(*) AS messages FROM all_loads GROUP BY ALL),
w AS (SELECT *, coalesce(min_id > max(max_id) OVER (PARTITION BY channel_username ORDER BY min_id, max_id, load, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS starts FROM r),
i AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY channel_username ORDER BY min_id, max_id, load, source_file ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT channel_username, min(min_id) AS min_id, max(max_id) AS max_id, count(*) AS ranges, CAST(sum(messages) AS BIGINT) AS messages,
  CAST(min(load) AS BIGINT) AS first_load, CAST(max(load) AS BIGINT) AS last_load FROM i GROUP BY channel_username, island""")(_lineage_ledger)


# ================================================================ A26: files, store and their difference as sources
def _source_cube(spark, sf):
    """Texts are only compared, so a hash of each goes through the joins in its place."""
    from chatlens.operators import report
    from chatlens.plans.catalog import loads
    base = view.messages(spark, sf).select("channel_username", "message_id", "file_size")
    text_md5 = F.md5(F.col("text").cast("binary")).alias("text_md5")
    files, store = (load.select(*merge.KEY, "views", text_md5).join(base, ["channel_username", "message_id"], "left") for load in loads(spark, sf))
    return report.source_cube({"file": files, "db": store, "diff": merge.changed_rows(files, store, compare=["views", "text_md5"])})


from chatlens.operators import merge  # noqa: E402

register("source_cube", f"""WITH {SQL_LOADS},
base AS (SELECT channel_username, message_id, file_size FROM messages),
f AS (SELECT l1.*, file_size FROM l1 LEFT JOIN base USING (channel_username, message_id)),
d AS (SELECT l2.*, file_size FROM l2 LEFT JOIN base USING (channel_username, message_id)),
x AS (SELECT coalesce(f.channel_username, d.channel_username) AS channel_username, coalesce(f.file_size, d.file_size) AS file_size
  FROM f FULL OUTER JOIN d ON f.channel_username = d.channel_username AND f.message_id = d.message_id
  WHERE f.message_id IS NULL OR d.message_id IS NULL OR f.views IS DISTINCT FROM d.views OR f.text IS DISTINCT FROM d.text),
s AS (SELECT channel_username, 'file' AS source, file_size FROM f UNION ALL SELECT channel_username, 'db', file_size FROM d UNION ALL SELECT channel_username, 'diff', file_size FROM x),
c AS (SELECT channel_username, source, count(*) AS messages, count_if(file_size > 0) AS files, CAST(grouping(channel_username) * 2 + grouping(source) AS BIGINT) AS level
  FROM s GROUP BY CUBE (channel_username, source)),
spine AS (SELECT * FROM (SELECT DISTINCT channel_username FROM s), (VALUES ('file'), ('db'), ('diff')) v(source))
SELECT coalesce(c.channel_username, spine.channel_username) AS channel_username, coalesce(c.source, spine.source) AS source, coalesce(messages, 0) AS messages,
  coalesce(files, 0) AS files, coalesce(level, 0) AS level
FROM c FULL OUTER JOIN spine ON c.channel_username = spine.channel_username AND c.source = spine.source AND c.level = 0""")(_source_cube)


# ================================================================ X19: word search over an inverted index
def _search_index(spark, sf):
    """Messages that hold an event type and a language as words, for every pair that a document and its event have, through the index of all messages."""
    import uuid

    from chatlens.operators import search
    from chatlens.session import scratch_path
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    search.build_index(view.messages(spark, sf), path)
    events = view.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    docs = view.table(spark, sf, "documents").select((F.col("doc_id") * 5).alias("event_id"), "lang")
    kinds = docs.join(events, "event_id").select("kind", "lang").where("kind is not null and lang is not null").distinct()
    queries = kinds.select(F.concat_ws(" ", "kind", "lang").alias("query")).withColumn("text", F.col("query"))
    return search.search_many(spark, path, queries).groupBy("query", "channel_username").agg(F.count(F.lit(1)).alias("messages"), F.min("message_id").alias("first_id"))


register("search_index", r"""
WITH w AS (SELECT channel_username, message_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM messages WHERE message_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT event_type || ' ' || lang AS query, list_distinct(regexp_extract_all(lower(event_type || ' ' || lang), '[\p{L}\p{N}_]+')) AS asked
  FROM (SELECT DISTINCT event_type, lang FROM documents JOIN events ON event_id = doc_id * 5 WHERE event_type IS NOT NULL AND lang IS NOT NULL))
SELECT query, channel_username, count(DISTINCT message_id) AS messages, min(message_id) AS first_id FROM w JOIN q ON list_has_all(w.w, q.asked) GROUP BY ALL""")(_search_index)

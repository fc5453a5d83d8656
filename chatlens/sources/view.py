"""Message view derived from the driver's tables.

The driver tables carry prose documents, events, parts and pages but no chat messages. This view
maps them onto the canonical message row (one message per document, the whole document text,
with hashtags, mentions, URLs and emojis appended deterministically) so that every operator
runs on data whose size grows with the tables. The SQL text below is the same definition for
DuckDB (the oracle); ``messages()`` builds it with the DataFrame API.

Scale notes: what ``events``, ``part`` and ``pages`` tell of a document is joined to the document ids first (narrow rows, whichever joins
Spark takes). Texts then meet it in one hash join on ``doc_id``, so they are shuffled once whatever the number of tables, never sorted, and a
query that reads the view several times can use the same shuffle. Left joins keep every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEW_SQL = """
SELECT d.doc_id AS message_id,
  concat('@', d.source) AS channel_username,
  e.ts + (d.doc_id % 400) * INTERVAL '1' DAY AS date,
  concat(d.text,
    CASE WHEN d.doc_id % 3 = 0 THEN concat(' #', e.event_type, ' #', d.lang) ELSE '' END,
    CASE WHEN d.doc_id % 4 = 0 THEN concat(' @user', CAST(e.user_id % 40 AS VARCHAR)) ELSE '' END,
    CASE WHEN d.doc_id % 5 = 0 THEN concat(' ', p.url) ELSE '' END,
    CASE WHEN d.doc_id % 7 = 0 THEN ' 😀' WHEN d.doc_id % 7 = 3 THEN ' 📚 👍🏽' WHEN d.doc_id % 7 = 5 THEN ' 🏴󠁧󠁢󠁥󠁮󠁧󠁿 © ⌀ ‼️ 👨‍👩‍👧 3️⃣ 🇩🇪🇫🇷' ELSE '' END) AS text,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat('user_', CAST(e.user_id AS VARCHAR)) END AS creator_username,
  CASE WHEN d.doc_id % 2 = 0 THEN 'document' WHEN d.doc_id % 9 = 1 THEN 'photo' END AS media_type,
  CASE WHEN d.doc_id % 2 = 0 THEN concat(t.p_name, CASE WHEN d.doc_id % 8 = 0 THEN ' (1)' ELSE '' END,
       CASE WHEN d.doc_id % 10 = 0 THEN '' WHEN d.doc_id % 6 = 0 THEN '.PDF' WHEN d.doc_id % 6 = 2 THEN '.epub' ELSE '.mp3' END) END AS file_name,
  CASE WHEN d.doc_id % 2 = 0 THEN CAST(t.p_size AS BIGINT) * 524288 WHEN d.doc_id % 9 = 1 THEN 0 END AS file_size,
  CASE WHEN d.doc_id % 4 = 2 THEN d.text END AS caption,
  CAST(floor(e.value) AS BIGINT) AS views,
  d.doc_id % 13 AS forwards,
  d.doc_id % 6 AS replies,
  d.doc_id % 5 = 1 AS is_forwarded,
  CASE WHEN d.doc_id % 5 = 1 THEN concat('@', e.event_type) END AS forwarded_from,
  CASE WHEN d.doc_id % 2 = 0 THEN CASE WHEN d.doc_id % 6 = 0 THEN 'application/pdf' WHEN d.doc_id % 6 = 2 THEN 'application/epub+zip' ELSE 'audio/mpeg' END
       WHEN d.doc_id % 9 = 1 THEN 'image/jpeg' END AS mime_type
FROM (SELECT *, doc_id // 2 % (SELECT greatest(count(*), 1) FROM part) AS part_key,
        doc_id // 5 % (SELECT greatest(count(*), 1) FROM pages) AS page_key FROM documents) d
LEFT JOIN events e ON e.event_id = d.doc_id * 5
LEFT JOIN part t ON t.p_partkey = d.part_key
LEFT JOIN pages p ON p.page_id = d.page_key
"""


def _null_safe_count_if(sql: str) -> str:
    """DuckDB's count_if returns NULL when every input is NULL and a HUGEINT otherwise; Spark's
    returns a BIGINT 0. Rewrite each ``count_if(p)`` to ``CAST(count_if(coalesce(p, false)) AS
    BIGINT)`` (matching parentheses)."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(token), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _null_safe_count_if(sql[j + len(token):k - 1])
        out.append(sql[i:j] + f"CAST(count_if(coalesce({inner}, false)) AS BIGINT)")
        i = k


def oracle_with(sql: str) -> str:
    """Prefix an oracle query with the message view as a CTE named ``messages``."""
    body = _null_safe_count_if(sql.strip())
    if body[:4].upper() == "WITH":
        return f"WITH messages AS ({VIEW_SQL}),\n{body[4:]}"
    return f"WITH messages AS ({VIEW_SQL})\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    out = None
    for cond, val in pairs:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if otherwise is not None:
        out = out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return out


def _rows(df: DataFrame) -> Column:
    """Number of rows (at least 1) as a scalar subquery; documents spread over all of the table's keys."""
    return df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical message table over the driver's tables (all documents, whole texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    p = table(spark, sf_dir, "pages").select("page_id", "url")

    # every second document carries a file and every fifth a URL, so that each part and page comes up
    ids = d.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    ids = ids.withColumns({"part_key": F.floor(F.col("id") / 2) % _rows(t), "page_key": F.floor(F.col("id") / 5) % _rows(p)})
    facts = (ids.join(e, e.event_id == ids.id * 5, "left")
             .join(t, t.p_partkey == ids.part_key, "left")
             .join(p, p.page_id == ids.page_key, "left")
             .select("id", "ts", "user_id", "event_type", "value", "p_name", "p_size", "url"))
    j = d.join(facts.hint("shuffle_hash"), d.doc_id == facts.id, "left")
    i = F.col("doc_id")
    tags = F.when(i % 3 == 0, F.concat(F.lit(" #"), F.col("event_type"), F.lit(" #"), F.col("lang"))).otherwise("")
    ment = F.when(i % 4 == 0, F.concat(F.lit(" @user"), (F.col("user_id") % 40).cast("string"))).otherwise("")
    url = F.when(i % 5 == 0, F.concat(F.lit(" "), F.col("url"))).otherwise("")
    emo = _case((i % 7 == 0, " 😀"), (i % 7 == 3, " 📚 👍🏽"), (i % 7 == 5, " 🏴󠁧󠁢󠁥󠁮󠁧󠁿 © ⌀ ‼️ 👨‍👩‍👧 3️⃣ 🇩🇪🇫🇷"), otherwise="")
    ext = _case((i % 10 == 0, ""), (i % 6 == 0, ".PDF"), (i % 6 == 2, ".epub"), otherwise=".mp3")
    mime = _case((i % 6 == 0, "application/pdf"), (i % 6 == 2, "application/epub+zip"), otherwise="audio/mpeg")
    return j.select(
        i.alias("message_id"),
        F.concat(F.lit("@"), F.col("source")).alias("channel_username"),
        (F.col("ts") + F.make_dt_interval(days=i % 400)).alias("date"),
        F.concat(F.col("text"), tags, ment, url, emo).alias("text"),
        F.when(i % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("creator_username"),
        _case((i % 2 == 0, "document"), (i % 9 == 1, "photo")).alias("media_type"),
        F.when(i % 2 == 0, F.concat(F.col("p_name"), F.when(i % 8 == 0, F.lit(" (1)")).otherwise(""), ext)
               ).alias("file_name"),
        _case((i % 2 == 0, F.col("p_size").cast("bigint") * 524288), (i % 9 == 1, F.lit(0).cast("bigint"))
              ).alias("file_size"),
        F.when(i % 4 == 2, F.col("text")).alias("caption"),
        F.floor(F.col("value")).cast("bigint").alias("views"),
        (i % 13).alias("forwards"),
        (i % 6).alias("replies"),
        (i % 5 == 1).alias("is_forwarded"),
        F.when(i % 5 == 1, F.concat(F.lit("@"), F.col("event_type"))).alias("forwarded_from"),
        _case((i % 2 == 0, mime), (i % 9 == 1, "image/jpeg")).alias("mime_type"),
    )

"""A raw archive derived from the message view: collection files of every accepted shape, with bad elements, for the ingest queries.

The files grow in size and number with the tables. Each message lies in one file; what is wrong in the archive follows from the message ids, so that
the expected rows and rejects can be told from the view alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.session import scratch_path
from chatlens.sources import view

FIELDS = ["message_id", "channel_username", "date", "text", "creator_username", "media_type", "file_name", "file_size", "views", "forwards", "is_forwarded"]
FILE_ROWS = 40_000  # messages of one file
SHAPES = 4  # envelope in an array, API page, bare array, JSON lines
COLLECTED = "2024-01-01T00:00:00"

# What the archive holds of message m (view column names), in SQL that Spark and DuckDB read alike.
SQL_SHAPE = "message_id % 4"
SQL_ID = "CASE WHEN message_id % 37 = 0 THEN message_id + 1000000000000 ELSE message_id END"  # far ids
SQL_CHANNEL = "CASE WHEN message_id % 31 <> 0 THEN channel_username END"  # some without a channel
BAD_ELEMENTS = {7: '"not_a_dict"', 11: "42", 13: "null"}  # by message_id % 50, written behind the message
BAD_OBJECT = 17  # likewise: an object that does not parse


def _bad(message_id: Column) -> Column:
    """Array of the elements that lie behind a message: itself no messages, or broken ones."""
    k = message_id % 50
    extra = F.when(k == BAD_OBJECT, F.array(F.concat(F.lit('{"message_id": '), message_id.cast("string"), F.lit(', "views": }'))))
    for r, text in BAD_ELEMENTS.items():
        extra = extra.when(k == r, F.array(F.lit(text)))
    return extra.otherwise(F.array().cast("array<string>"))


def archive_lines(messages: DataFrame) -> DataFrame:
    """Lines (file, value) of the archive of ``messages``, each file's in order: a file for each shape and ``FILE_ROWS`` messages, one that breaks off, one blank."""
    spark = messages.sparkSession
    files = max(1, -(-messages.count() // (FILE_ROWS * SHAPES)))
    i = F.col("message_id")
    shape = i % SHAPES
    file = shape * files + F.pmod(F.xxhash64("message_id"), F.lit(files))
    lines = (messages.select("message_id", *[F.col(c) for c in FIELDS if c != "message_id"])
             .withColumns({"shape": shape, "file": file, "at": i, "bad": _bad(i)})
             .withColumns({"message_id": F.expr(SQL_ID), "channel_username": F.expr(SQL_CHANNEL), "date": F.col("date").cast("string")})  # all from the columns before
             .select("shape", "file", "at", F.posexplode(F.concat(F.array(F.to_json(F.struct(*FIELDS))), "bad")).alias("n", "value")))
    body = lines.select("file", F.lit(1).alias("section"), "at", "n", "value", (F.col("shape") == 3).alias("bare"))
    ends = spark.createDataFrame([(0, f'[{{"metadata": {{"collected_at": "{COLLECTED}", "data_format": "structured_dataframe"}}, "messages": [', '], "total": "}"}]'),
                                  (1, '{"page": 1, "data": [', '], "has_more": false}'), (2, "[", "]")], "shape long, head string, foot string")
    used = messages.select(shape.alias("shape"), file.alias("file")).distinct().join(F.broadcast(ends), "shape")
    frame = used.select("file", F.inline(F.array(F.struct(F.lit(0).alias("section"), F.col("head").alias("value")), F.struct(F.lit(2).alias("section"), F.col("foot").alias("value")))))
    odd = spark.createDataFrame([(-1, 0, '{"messages": [{"message_id": 1}'), (-2, 0, " ")], "file long, section int, value string")
    others = frame.unionByName(odd).select("*", F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.lit(True).alias("bare"))
    # one shuffle and one sort, which the writer needs too: a line goes without a comma where the line before it is the head
    behind = F.lag("section").over(Window.partitionBy("file").orderBy("section", "at", "n")) == 1
    comma = F.when(F.col("bare") | ~behind, F.lit("")).otherwise(F.lit(", "))
    return body.unionByName(others).select("file", F.concat(comma, "value").alias("value"))


def write_archive(messages: DataFrame, path: str) -> None:
    """Write the archive of ``messages`` below ``path``."""
    archive_lines(messages).write.mode("overwrite").partitionBy("file").text(path)


def archive(spark: SparkSession, sf_dir: str) -> str:
    """Path of the archive of the whole message view, written anew for every call."""
    import uuid
    path = scratch_path(spark, f"archive-{uuid.uuid4().hex}")
    write_archive(view.messages(spark, sf_dir), path)
    return path


_SHOWN = {'"not_a_dict"': "'not_a_dict'", "42": "'42'", "null": "NULL"}
SQL_REJECTS = " UNION ALL ".join([
    *(f"SELECT 'VALIDATION_INVALID_FORMAT' AS code, CASE WHEN {SQL_SHAPE} = 3 THEN '{t}' ELSE {_SHOWN[t]} END AS detail FROM messages WHERE message_id % 50 = {r}"
      for r, t in BAD_ELEMENTS.items()),
    f"""SELECT CASE WHEN {SQL_SHAPE} < 2 THEN 'VALIDATION_INVALID_FORMAT' ELSE 'FILE_CORRUPTED' END, '{{"message_id": ' || CAST(message_id AS VARCHAR) || ', "views": }}'
    FROM messages WHERE message_id % 50 = {BAD_OBJECT}""",
    "SELECT 'FILE_CORRUPTED', '2 brackets open at the end'", "SELECT 'FILE_EMPTY', NULL"])

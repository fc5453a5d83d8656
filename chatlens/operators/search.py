"""Search by words over an inverted index.

``build_index`` writes, for every word, the ids of the messages that hold it: ``token, channel_username, block, offsets``, the ids of a channel in blocks
of ``BLOCK`` ids and inside a block as sorted 16-bit offsets. A word that every message holds is so many bounded rows, not one list. The table is dealt
out by ranges of the word and sorted, so the files' statistics let a search read the row groups of its words alone. Each task first groups the ids of
``POSTINGS`` words at a time, so lists of ids are shuffled, not a row for each word of each message. ``search`` intersects
offsets block by block; texts are not read.

Words are runs of letters, digits and underscores, lower-cased. Messages without an id can't be named and are left out; rows that repeat an id
count once with the words of all of them; a search without words finds nothing.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions import patterns as P
from chatlens.session import cut_lineage, share_library

BLOCK = 1 << 16
POSTINGS = 1_000_000  # words of messages that a task groups at once
INDEX_SCHEMA = "token string, channel_username string, block long, offsets array<int>"


def words(text: str = "text"):
    """Distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{P.WORD}+"), F.lit(0)))


def task_postings(df: DataFrame) -> DataFrame:
    """Rows of ``INDEX_SCHEMA`` of all messages, grouped inside each task only: a word's ids in one block may come in several rows."""
    share_library(df.sparkSession)

    def group(batches):
        held, n = [], 0
        for b in batches:
            of = pc.list_parent_indices(b.column("words"))
            held.append(pa.table({"token": pc.list_flatten(b.column("words")), **{k: b.column(k).take(of) for k in ("channel_username", "block", "offset")}}))
            n += len(of)
            if n >= POSTINGS:
                yield from grouped(held)
                held, n = [], 0
        yield from grouped(held)

    def grouped(tables):
        if tables:
            rows = pa.concat_tables(tables).group_by(["token", "channel_username", "block"]).aggregate([("offset", "list")])
            yield from rows.select(["token", "channel_username", "block", "offset_list"]).rename_columns(["token", "channel_username", "block", "offsets"]).to_batches(max_chunksize=50_000)

    block = F.floor(F.col("message_id") / BLOCK).cast("bigint")
    rows = df.where("message_id is not null and text is not null").select(
        "channel_username", block.alias("block"), (F.col("message_id") - block * BLOCK).cast("int").alias("offset"), words().alias("words"))
    return rows.mapInArrow(group, INDEX_SCHEMA)


def _merged(rows: DataFrame) -> DataFrame:
    offsets = F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets"))))
    return rows.groupBy("token", "channel_username", "block").agg(offsets.alias("offsets"))


def postings(df: DataFrame) -> DataFrame:
    """``INDEX_SCHEMA`` of all messages; a group is a word's ids in one block, at most ``BLOCK`` of them."""
    return _merged(task_postings(df))


def build_index(df: DataFrame, path: str) -> None:
    """Write the index of ``df``, dealt out by ranges of the word. Ranges are drawn from the written lists, so that messages are read once, and the
    lists of a group meet in the same shuffle."""
    order = ["token", "channel_username", "block"]
    lists = cut_lineage(task_postings(df), "search-postings")
    _merged(lists.repartitionByRange(*order)).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """``channel_username, message_id`` of the messages that hold all words of ``text``."""
    query = spark.createDataFrame([(0, text)], "query long, text string")
    asked = [r.w for r in query.select(F.explode(words()).alias("w")).collect()]  # the words of one search
    index = spark.read.schema(INDEX_SCHEMA).parquet(path).where(F.col("token").isin(*asked))  # pushed to the files
    return _meet(index.withColumns({"query": F.lit(0), "need": F.lit(len(asked))})).select("channel_username", "message_id")


def search_many(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``query, channel_username, message_id`` for each row of ``queries`` (``query, text``); searches share one pass over the index."""
    asked = queries.select("query", words().alias("w"))
    each = asked.select("query", F.size("w").alias("need"), F.explode("w").alias("token"))
    index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    return _meet(index.join(each, "token")).select("query", "channel_username", "message_id")


def _meet(rows: DataFrame) -> DataFrame:
    """Ids that all words of a query share, block by block (as many lists as the query has words)."""
    found = rows.groupBy("query", "channel_username", "block").agg(F.collect_list("offsets").alias("lists"), F.max("need").alias("need"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return (found.where(F.size("lists") == F.col("need")).select("query", "channel_username", "block", F.explode(both).alias("offset"))
            .withColumn("message_id", F.col("block") * BLOCK + F.col("offset")))

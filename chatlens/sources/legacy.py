"""Legacy collections whose messages are Python ``repr`` text rows (S10, K7 counts).

``TelegramMessage(message_id=1, text='a, b (c)', date=datetime.datetime(2024, 1, 1, 10, 0, 5), ...)``
is parsed with column expressions only: the argument list is tokenised by one regex whose
alternatives consume quoted strings and ``datetime.datetime(...)`` calls whole (so commas and
parentheses inside them do not split fields), then each known field is decoded (quoted text,
None/True/False, numbers, datetimes -> ISO seconds; microseconds and time zones are dropped as
the reference's fallback path does). Nothing is evaluated. Rows that do not parse are counted
and returned as rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.clean import typed_messages
from chatlens.operators.validate import FILE_CORRUPTED, VALIDATION_INVALID_FORMAT
from chatlens.schema import COLLECTION_METADATA, RAW_MESSAGE

WRAPPER = r"^\s*[A-Za-z_][A-Za-z0-9_]*\((.*)\)\s*$"
KV = (r"([A-Za-z_][A-Za-z0-9_]*)=("
      r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
      r"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
      r"|datetime\.datetime\([^()]*(?:\([^()]*\)[^()]*)*\)"
      r"|[^,()]+(?:\([^()]*\))?)")
DATETIME = r"^datetime\.datetime\((\d+),\s*(\d+),\s*(\d+)(?:,\s*(\d+))?(?:,\s*(\d+))?(?:,\s*(\d+))?"

LEGACY_FILE = T.StructType([T.StructField("metadata", COLLECTION_METADATA),
                            T.StructField("messages", T.ArrayType(T.StringType()))])


def decode_value(v: Column) -> Column:
    """Python literal text -> string value (null for None)."""
    sq = v.startswith("'") & v.endswith("'")
    dq = v.startswith('"') & v.endswith('"')
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    unescaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\\n", "\n"), r"\\'", "'"), r"\\\\", r"\\")
    part = [F.regexp_extract(v, DATETIME, i) for i in range(1, 7)]
    num = [F.when(p == "", F.lit(0)).otherwise(p.cast("int")) for p in part]
    iso = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", *num)
    t = F.trim(v)
    return (F.when(v.isNull() | (t == "None"), F.lit(None).cast("string"))
             .when(sq | dq, unescaped)
             .when(t == "True", F.lit("true")).when(t == "False", F.lit("false"))
             .when(t.startswith("datetime.datetime("), F.when(part[0] != "", iso))
             .otherwise(t))


def parse_rows(rows: DataFrame, text: str = "row") -> DataFrame:
    """String rows -> raw message rows (all RAW_MESSAGE fields as strings) plus ``parsed`` flag."""
    inner = F.regexp_extract(F.col(text), WRAPPER, 1)
    keys = F.regexp_extract_all(inner, F.lit(KV), F.lit(1))
    vals = F.regexp_extract_all(inner, F.lit(KV), F.lit(2))
    kv = F.arrays_zip(keys.alias("k"), vals.alias("v"))
    staged = rows.withColumn("_kv", kv).withColumn("_ok", (inner != "") & (F.size(keys) > 0))

    def field(name: str) -> Column:
        return decode_value(F.get(F.filter(F.col("_kv"), lambda x: x["k"] == name), 0)["v"])

    cols = [field(f.name).alias(f.name) for f in RAW_MESSAGE.fields]
    return staged.select("*", *cols).withColumn("parsed", F.col("_ok") & F.col("message_id").isNotNull()) \
                 .drop("_kv", "_ok")


def read_legacy(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Legacy files (``{metadata, messages:[str]}`` or a bare array of strings) ->
    (typed messages, rejected rows, counts per file: success / failed)."""
    paths = path if isinstance(path, list) else [path]
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    as_obj = F.from_json("value", LEGACY_FILE)
    as_arr = F.from_json("value", T.ArrayType(T.StringType()))
    strings = F.coalesce(as_obj["messages"], as_arr)
    rows = raw.select("source_file", F.posexplode(strings).alias("msg_pos", "row"))
    parsed = parse_rows(rows)
    good = typed_messages(parsed.where("parsed").drop("parsed", "row"))
    bad = parsed.where(~F.col("parsed")).select("source_file", "msg_pos", "row",
                                                F.lit(VALIDATION_INVALID_FORMAT).alias("code"))
    bad = bad.unionByName(raw.where(strings.isNull()).select("source_file", F.lit(None).cast("int").alias("msg_pos"),
                                                             F.col("value").alias("row"), F.lit(FILE_CORRUPTED).alias("code")))
    counts = parsed.groupBy("source_file").agg(F.count_if("parsed").alias("success"),
                                               F.count_if(~F.col("parsed")).alias("failed"))
    return good, bad, counts

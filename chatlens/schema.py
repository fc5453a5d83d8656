"""Declared schemas. Nothing in the package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical flat message row (one row per message).
MESSAGE_FIELDS = [
    ("message_id", T.LongType()),
    ("channel_username", T.StringType()),
    ("date", T.TimestampNTZType()),  # UTC wall-clock time
    ("text", T.StringType()),
    ("creator_username", T.StringType()),
    ("creator_first_name", T.StringType()),
    ("creator_last_name", T.StringType()),
    ("media_type", T.StringType()),
    ("file_name", T.StringType()),
    ("file_size", T.LongType()),
    ("mime_type", T.StringType()),
    ("caption", T.StringType()),
    ("views", T.LongType()),
    ("forwards", T.LongType()),
    ("replies", T.LongType()),
    ("is_forwarded", T.BooleanType()),
    ("forwarded_from", T.StringType()),
]
MESSAGE = T.StructType([T.StructField(n, t, True) for n, t in MESSAGE_FIELDS])
MESSAGE_COLUMNS = [n for n, _ in MESSAGE_FIELDS]

# Raw message as it appears inside a JSON collection. Every value is read as a string so that
# malformed values ("NaN", "nat", "12abc", booleans as text) survive the scan and are typed by
# the cleaning step with try_cast; a typed read would null the whole record instead.
RAW_MESSAGE = T.StructType(
    [T.StructField(n, T.StringType(), True) for n in MESSAGE_COLUMNS]
    + [T.StructField("edit_date", T.StringType(), True), T.StructField("source", T.StringType(), True)]
)

COLLECTION_METADATA = T.StructType([
    T.StructField("collected_at", T.StringType()),
    T.StructField("combined_at", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("channels", T.ArrayType(T.StringType())),
    T.StructField("data_format", T.StringType()),
    T.StructField("total_messages", T.LongType()),
    T.StructField("source_files", T.ArrayType(T.StringType())),
    T.StructField("message_id_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("overall_range", T.StringType()),
    T.StructField("source_directory", T.StringType()),
    T.StructField("previous_combined_at", T.StringType()),
    T.StructField("new_messages_added", T.LongType()),
    T.StructField("existing_messages", T.LongType()),
])

# One JSON document of any accepted shape: {metadata, messages}, {data: [...]} (API page),
# or a bare message object (bare arrays / JSONL lines are split into such objects by the reader).
# Messages are read as JSON text and parsed one by one, so a bad element costs only itself.
ENVELOPE = T.StructType(
    [
        T.StructField("metadata", COLLECTION_METADATA),
        T.StructField("messages", T.ArrayType(T.StringType())),
        T.StructField("data", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
    + list(RAW_MESSAGE.fields)
)
MESSAGE_ELEMENT = T.StructType(list(RAW_MESSAGE.fields) + [T.StructField("_corrupt_record", T.StringType())])

# Nested message object as produced by a chat client (projection C6-C10).
NESTED_MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.TimestampNTZType()),  # UTC wall-clock time
    T.StructField("text", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("media", T.StructType([
        T.StructField("document", T.StructType([
            T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("file_name", T.StringType())]))),
            T.StructField("size", T.LongType()),
            T.StructField("mime_type", T.StringType()),
        ])),
        T.StructField("photo", T.StructType([T.StructField("id", T.LongType())])),
    ])),
    T.StructField("sender", T.StructType([
        T.StructField("username", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
    ])),
    T.StructField("sender_id", T.LongType()),
    T.StructField("replies", T.StructType([T.StructField("replies", T.LongType())])),
    T.StructField("views", T.LongType()),
    T.StructField("forwards", T.LongType()),
    T.StructField("forward", T.StructType([
        T.StructField("chat", T.StructType([T.StructField("username", T.StringType())])),
    ])),
])

"""Cleaning and projection (C1-C13). All column expressions; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions import patterns as P
from chatlens.functions.expr import non_blank
from chatlens.schema import MESSAGE, MESSAGE_COLUMNS

NUMERIC = ("message_id", "file_size", "views", "forwards", "replies")
LINEAGE = ("source_file", "file_channel", "file_min_id", "file_max_id", "loaded_at", "split_pos", "doc_pos", "msg_pos")


def null_if_missing(c: Column) -> Column:
    """The strings NaN, NaT, nan, nat (and blank) become null."""
    return F.when(~F.trim(c).isin(*P.NULL_STRINGS) & (F.trim(c) != ""), c)


def to_long(c: Column) -> Column:
    """Integer coercion accepting integral numbers written as text or as floats ('12', '12.0');
    anything else (NaN, inf, '12abc') is null."""
    s = null_if_missing(c.cast("string"))
    d = s.try_cast("double")
    whole = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) & (d == F.floor(d))
    return F.coalesce(s.try_cast("bigint"), F.when(whole, d.try_cast("bigint")))


def to_count(c: Column) -> Column:
    """C4: a count as an integer, fractions cut towards zero ('12.7' -> 12); what is no finite number is null."""
    s = null_if_missing(c.cast("string"))
    d = s.try_cast("double")
    return F.coalesce(s.try_cast("bigint"), F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d.try_cast("bigint")))


def normal_string(c: Column) -> Column:
    """C4: a string value as the store receives it: missing markers null, 'bool' 'false', 'true' and 'false' in any case lower-cased."""
    low = F.lower(c)
    return (F.when(c.isin(*P.NULL_STRINGS), F.lit(None).cast("string")).when(low == "bool", F.lit("false"))
             .when(low.isin("true", "false"), low).otherwise(c))


def to_timestamp_utc(c: Column) -> Column:
    """ISO ('T') or space separated timestamps with optional offset -> UTC wall clock; bad -> null."""
    s = null_if_missing(c.cast("string"))
    return F.try_to_timestamp(s).cast("timestamp_ntz")


def to_bool(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes"), True).when(s.isin("false", "0", "no", "bool"), False)


def typed_messages(raw: DataFrame) -> DataFrame:
    """Raw (string) rows -> canonical types; lineage columns are carried through."""
    cols = []
    for f in MESSAGE.fields:
        c = F.col(f.name) if f.name in raw.columns else F.lit(None)
        if f.name in NUMERIC:
            c = to_long(c) if f.name == "message_id" else to_count(c)
        elif f.name == "date":
            c = to_timestamp_utc(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = to_bool(c)
        else:
            c = null_if_missing(c.cast("string")) if f.name not in ("text", "caption") else c.cast("string")
        cols.append(c.cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in raw.columns if c not in MESSAGE_COLUMNS and c not in ("edit_date",)]
    if "edit_date" in raw.columns:
        extra.append(to_timestamp_utc(F.col("edit_date")).alias("edit_date"))
    return raw.select(*cols, *extra)


def loader_clean(df: DataFrame, *, fill_defaults: bool = False) -> DataFrame:
    """Drop rows whose message columns are all null; optionally fill the reference's defaults
    ('' for text columns, 0 for counts, false for is_forwarded). Defaults stay off by default so
    that 'missing' remains distinguishable (Q1)."""
    present = [c for c in MESSAGE_COLUMNS if c in df.columns]
    out = df.na.drop("all", subset=present)
    if fill_defaults:
        out = (out.na.fill("", [c for c in ("media_type", "file_name", "forwarded_from") if c in present])
                  .na.fill(0, [c for c in ("file_size", "views", "forwards", "replies") if c in present])
                  .na.fill(False, [c for c in ("is_forwarded",) if c in present]))
    return out


# ---- FIXED VALUES: store projection of the reference -------------------------------------------
STORE_BASE = ["message_id", "channel_username", "date", "text", "creator_username", "creator_first_name",
              "creator_last_name", "media_type", "file_name"]
STORE_OPTIONAL = ["file_size", "mime_type", "caption", "views", "forwards", "replies", "is_forwarded",
                  "forwarded_from"]
STORE_DROPPED = ["id", "created_at", "updated_at", "deleted_at", "is_deleted", "text_length", "has_media",
                 "uuid", "duration", "width", "height", "forwarded_message_id", "edit_date"]
# ------------------------------------------------------------------------------------------------


def store_projection(df: DataFrame) -> DataFrame:
    """Whitelist of stored columns (the dropped internal columns never reach the store)."""
    return df.select(*[c for c in STORE_BASE + STORE_OPTIONAL if c in df.columns])


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text like Python's isoformat (microseconds only when non-zero)."""
    micros = F.unix_micros(c.cast("timestamp")) % 1_000_000
    return F.when(c.isNull(), None).when(
        micros == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def import_strings(df: DataFrame) -> DataFrame:
    """C4 on the string columns of typed rows, as the import stores them."""
    return df.withColumns({c: normal_string(F.col(c)) for c in STORE_BASE + STORE_OPTIONAL
                           if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)})


def store_values(df: DataFrame) -> DataFrame:
    """C4 + C5: values as the message store receives them: dates as ISO text, booleans as 'true'/'false', counts as integers
    (fractions cut, non-finite -> null), strings by ``normal_string``, lists and objects as JSON text."""
    out = []
    for c in store_projection(df).columns:
        dt = df.schema[c].dataType
        col = F.col(c)
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            col = iso_timestamp(col)
        elif isinstance(dt, T.BooleanType):
            col = F.when(col.isNull(), None).when(col, "true").otherwise("false")
        elif c in NUMERIC:
            col = to_long(col) if c == "message_id" else to_count(col)
        elif isinstance(dt, T.StringType):
            col = normal_string(col)
        elif isinstance(dt, T.ArrayType):
            col = F.when(col.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(col, _keyed), ","), F.lit("}")))
        elif isinstance(dt, (T.MapType, T.StructType)):
            col = F.when(col.isNotNull(), F.concat(F.lit("["), F.to_json(col), F.lit("]")))
        elif isinstance(dt, T.DayTimeIntervalType):
            col = interval_seconds(col)
        out.append(col.alias(c))
    return df.select(*out)


def _json_value(x: Column) -> Column:
    """JSON text of any value: what a one-field object of it holds behind its key."""
    whole = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _keyed(x: Column, i: Column) -> Column:
    return F.concat(F.lit('"'), i.cast("string"), F.lit('":'), _json_value(x))


def normal_values(df: DataFrame, document: str = "document", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """C4 for values of unknown type: ``keep``, ``field, kind, value`` for every field of the JSON objects in ``document``.

    The object is read as VARIANT, so no schema is declared or inferred and every value keeps the type it came with:

    * null, and the strings that mark missing values: kind ``null``, value null; so are numbers that are not finite;
    * booleans, and the strings ``bool`` (false), ``true`` and ``false`` in any case: kind ``string``, ``true`` or ``false``;
    * counts (``file_size, views, forwards, replies``) that are numbers: kind ``integer``, cut towards zero; digit strings too, but for ``file_size``;
    * other numbers: kind ``number``; other strings: kind ``string``;
    * lists: kind ``json``, an object from place to element; objects: kind ``json``, an array of the one object (keys in order).

    Documents that are null, no objects or do not parse give no rows here; ``bad_documents`` has them.
    """
    parsed = df.select(*keep, F.try_parse_json(F.col(document)).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    v = F.col("value")
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    is_text = kind == "STRING"
    count = F.col("key").isin("views", "forwards", "replies")
    cut = F.coalesce(F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")), F.try_variant_get(v, "$", "decimal(38,18)").try_cast("bigint"), number.try_cast("bigint"))
    digits = is_text & text.rlike("^[0-9]+$")
    missing = kind.isNull() | (kind == "VOID") | (is_text & text.isin(*P.NULL_STRINGS)) | (is_number & (F.isnan(number) | (F.abs(number) == float("inf"))))
    integer = (is_number & (count | (F.col("key") == "file_size"))) | (digits & count)
    listed = F.concat(F.lit("{"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), F.to_json(x))), ","), F.lit("}"))
    value = (F.when(missing, F.lit(None).cast("string"))
              .when(integer, F.when(digits, text.try_cast("bigint")).otherwise(cut).cast("string"))
              .when(kind == "BOOLEAN", text).when(is_text, normal_string(text)).when(kind.startswith("ARRAY"), listed)
              .when(kind.startswith("OBJECT"), F.concat(F.lit("["), F.to_json(v), F.lit("]"))).otherwise(F.to_json(v)))
    label = (F.when(missing, "null").when(integer, "integer").when(is_number, "number")
              .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), "json").otherwise("string"))
    return fields.select(*keep, F.col("key").alias("field"), label.alias("kind"), value.alias("value"))


def bad_documents(df: DataFrame, document: str = "document", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``document`` is null, no JSON object or does not parse."""
    is_object = F.schema_of_variant(F.try_parse_json(F.col(document))).startswith("OBJECT")
    return df.where(~F.coalesce(is_object, F.lit(False))).select(*keep, document)


def interval_seconds(c: Column) -> Column:
    """Day-time interval -> total seconds (double)."""
    c = c.cast("interval day to second")
    return (F.extract(F.lit("DAY"), c) * 86400.0 + F.extract(F.lit("HOUR"), c) * 3600.0
            + F.extract(F.lit("MINUTE"), c) * 60.0 + F.extract(F.lit("SECOND"), c).cast("double"))


def text_placeholder(c: Column, placeholder: str = "[No text content]") -> Column:
    """Blank or missing text -> placeholder."""
    return F.when(c.isNull() | ~c.rlike(r"(?U)\S"), F.lit(placeholder)).otherwise(c)


def from_nested(df: DataFrame, msg: str = "m", channel: str | Column = "channel_username",
                now: Column | None = None) -> DataFrame:
    """Nested client message objects (struct column ``msg``) -> flat message rows.

    C6 null id dropped, missing date -> now; C7 media (document: first non-empty attribute file
    name, size, mime; photo: size 0); C8 text placeholder; C9 engagement / forward; C10 creator
    username with ``user_<sender_id>`` fallback.
    """
    m = F.col(msg)
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    doc = m["media"]["document"]
    photo = m["media"]["photo"]
    first_name = F.get(F.filter(doc["attributes"], lambda a: F.coalesce(a["file_name"], F.lit("")) != ""), 0)["file_name"]
    media_type = F.when(doc.isNotNull(), "document").when(photo.isNotNull(), "photo")
    ch = F.col(channel) if isinstance(channel, str) else channel
    return (df.where(m["id"].isNotNull()).select(
        m["id"].alias("message_id"),
        ch.alias("channel_username"),
        F.coalesce(m["date"], now).alias("date"),
        text_placeholder(m["text"]).alias("text"),
        F.coalesce(F.nullif(m["sender"]["username"], F.lit("")),
                   F.concat(F.lit("user_"), m["sender_id"].cast("string"))).alias("creator_username"),
        m["sender"]["first_name"].alias("creator_first_name"),
        m["sender"]["last_name"].alias("creator_last_name"),
        media_type.alias("media_type"),
        F.when(doc.isNotNull(), first_name).alias("file_name"),
        F.when(doc.isNotNull(), doc["size"]).when(photo.isNotNull(), F.lit(0).cast("bigint")).alias("file_size"),
        F.when(doc.isNotNull(), doc["mime_type"]).alias("mime_type"),
        m["caption"].alias("caption"),
        m["views"].alias("views"),
        m["forwards"].alias("forwards"),
        m["replies"]["replies"].alias("replies"),
        m["forward"].isNotNull().alias("is_forwarded"),
        m["forward"]["chat"]["username"].alias("forwarded_from")))


def has_media(df: DataFrame) -> Column:
    return non_blank("media_type")

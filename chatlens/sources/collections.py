"""JSON message collections.

Every accepted shape: ``{metadata, messages}``, ``[{metadata, messages}]``, bare ``[message, ...]``, API pages
``{data: [...]}``, and JSON-lines content. Batch jobs read files by blocks (``json_splits``), so a file of many blocks is read by
many tasks; JSON lines go to the line reader. There is no schema inference and no per-file exception: what does not parse
becomes a row of the rejects table (FILE_CORRUPTED / FILE_EMPTY / VALIDATION_INVALID_FORMAT) and everything else still loads.

Streams parse each new file as one text row (``wholetext``, ``parse_files``), since a micro-batch's files come as a DataFrame.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions import patterns as P
from chatlens.operators.validate import FILE_CORRUPTED, FILE_EMPTY, VALIDATION_INVALID_FORMAT
from chatlens.schema import ENVELOPE, MESSAGE_COLUMNS, MESSAGE_ELEMENT, RAW_MESSAGE
from chatlens.session import cut_lineage
from chatlens.sources import json_splits

RAW_FIELDS = [f.name for f in RAW_MESSAGE.fields]


def _lines(value: Column) -> Column:
    return F.filter(F.split(value, r"\r?\n"), lambda x: F.trim(x) != "")


def _docs(value: Column) -> Column:
    """Array of document texts of one file, or null when the file does not parse.

    JSON lines are told by their first line, a whole object; a bad later line is one bad document."""
    lines = _lines(value)
    first = F.trim(F.get(lines, 0))
    is_jsonl = (F.size(lines) >= 2) & first.startswith("{") & first.endswith("}")
    is_object = F.regexp_like(value, F.lit(r"^\s*\{"))
    return (F.when(is_jsonl, lines).when(is_object, F.array(value))
             .otherwise(F.from_json(value, T.ArrayType(T.StringType()))))


def _doc_messages(doc: Column, text: Column) -> Column:
    """Message texts of one document: ``messages``, else ``data``, else the document itself when it
    is a bare message (has any message field)."""
    is_bare = F.coalesce(*[doc[c] for c in RAW_FIELDS]).isNotNull()
    return F.coalesce(doc["messages"], doc["data"], F.when(is_bare, F.array(text)), F.array().cast(T.ArrayType(T.StringType())))


def _scan(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = path if isinstance(path, list) else [path]
    # text() sets wholetext itself (default False), so it must be passed here, not as an option
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"),
                                     F.col("_metadata.file_name").alias("file_name_src"), "value")


def file_name_columns(name: Column) -> list[Column]:
    """Channel and id range from ``tg_<channel>_<min>_<max>.json`` (channel may hold '_');
    ``tg_<channel>_combined.json``; otherwise tokens up to the first integer, else the 2nd token."""
    ch = F.coalesce(
        F.nullif(F.regexp_extract(name, P.COLLECTION_FILE, 1), F.lit("")),
        F.nullif(F.regexp_extract(name, P.COMBINED_FILE, 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"^tg_(.+?)_\d+(?:_.*)?\.jsonl?$", 1), F.lit("")),
        F.nullif(F.try_element_at(F.split(name, "_"), F.lit(2)), F.lit("")))
    lo = F.regexp_extract(name, P.COLLECTION_FILE, 2).try_cast("bigint")
    hi = F.regexp_extract(name, P.COLLECTION_FILE, 3).try_cast("bigint")
    return [F.regexp_replace(ch, r"\.jsonl?$", "").alias("file_channel"), lo.alias("file_min_id"),
            hi.alias("file_max_id")]


def read_collection_files(spark: SparkSession, path: str | list[str], *, glob: str | None = None
                          ) -> tuple[DataFrame, DataFrame]:
    """S1+S2+S3+S7: (raw message rows, rejected files, documents and elements).

    Files are read by blocks (``json_splits``); nothing holds a whole file. Raw rows keep every value as a string plus lineage: ``source_file``,
    ``file_channel``, ``file_min_id``, ``file_max_id``, ``loaded_at`` (collected_at / combined_at of the envelope) and ``split_pos``,
    ``doc_pos``, ``msg_pos``, which grow inside the file (for keep-latest ordering).
    """
    paths = path if isinstance(path, list) else [path]
    frags = json_splits.fragments(spark, paths, glob)
    states = json_splits.split_states(frags)
    raw, rejects = parse_units(json_splits.whole_units(cut_lineage(json_splits.units(frags, states), "json-units")))
    files = states.select("source_file", "bad", "lines", "blank").distinct()
    rejects = rejects.unionByName(files.where("blank").select("source_file", F.lit(FILE_EMPTY).alias("code"), F.lit(None).cast("string").alias("detail")))
    rejects = rejects.unionByName(files.where("bad <> '' and not lines and not blank").select("source_file", F.lit(FILE_CORRUPTED).alias("code"), F.col("bad").alias("detail")))
    by_line = files.where("lines").select("source_file")
    if not by_line.isEmpty():
        lines, bad_lines = read_jsonl(spark, path, glob=glob, only=by_line)
        raw, rejects = raw.unionByName(lines), rejects.unionByName(bad_lines)
    return raw, rejects


def parse_units(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse the units of ``json_splits`` -> (raw message rows, rejects).

    A document that is no object or does not parse, and text outside all documents, are rejected; an element of a message array that is no object or does
    not parse is VALIDATION_INVALID_FORMAT. Elements of ``data`` count only where the document has no ``messages``."""
    docs = units.where("kind = 'doc'").withColumn("doc", F.from_json("text", ENVELOPE))
    is_object = F.col("text").startswith("{")
    good = is_object & F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull()
    once = F.col("doc_seq") >= 0  # a document in several splits comes under two names
    is_array = F.col("doc.messages").isNotNull() | F.col("doc.data").isNotNull()
    is_bare = ~is_array & F.coalesce(*[F.col(f"doc.{c}") for c in RAW_FIELDS]).isNotNull()
    loaded = F.coalesce(F.col("doc.metadata.combined_at"), F.col("doc.metadata.collected_at")).alias("loaded_at")
    envelopes = cut_lineage(docs.where(good & is_array).select("source_file", "doc_split", "doc_seq", loaded, F.col("doc.messages").isNotNull().alias("has_messages")),
                            "json-envelopes")
    place = [F.col("split_pos"), F.col("seq").alias("doc_pos")]
    gaps = units.where("kind = 'gap' and array is not null").select("*", F.posexplode(json_splits.scalars("text")).alias("msg_pos", "scalar"))
    bare_text = F.get(F.from_json(F.concat(F.lit("["), F.col("scalar"), F.lit("]")), "array<string>"), 0)
    keys = ["source_file", "file_name_src", "array", "doc_split", "doc_seq"]
    elements = (units.where("kind = 'element'").select(*keys, *place, F.lit(0).alias("msg_pos"), F.col("text").alias("m_text"), is_object.alias("is_object"))
                .unionByName(gaps.select(*keys, *place, "msg_pos", F.when(F.col("scalar") != "null", F.coalesce(bare_text, "scalar")).alias("m_text"), F.lit(False).alias("is_object"))))
    in_top = F.col("array") == json_splits.TOP
    elements = (elements.join(envelopes, ["source_file", "doc_split", "doc_seq"], "left")
                .where(in_top | (F.col("array") == "messages") | ~F.coalesce("has_messages", F.lit(False)))
                .withColumn("m", F.when(F.col("is_object"), F.from_json("m_text", MESSAGE_ELEMENT))))
    loads = F.col("m").isNotNull() & F.col("m._corrupt_record").isNull()
    bare = (docs.where(good & is_bare & once)
            .select("source_file", "file_name_src", *place, F.lit(0).alias("msg_pos"), loaded, F.from_json("text", MESSAGE_ELEMENT).alias("m")))
    found = bare.unionByName(elements.where(loads).select(*bare.columns))
    raw = found.select(*[F.col(f"m.{c}").alias(c) for c in RAW_FIELDS], "source_file", *file_name_columns(F.col("file_name_src")), "loaded_at", "split_pos", "doc_pos",
                       F.col("msg_pos").cast("bigint").alias("msg_pos"))
    invalid = F.lit(VALIDATION_INVALID_FORMAT).alias("code")
    rejects = (docs.where(~good & once).select("source_file", F.when(is_object, FILE_CORRUPTED).otherwise(VALIDATION_INVALID_FORMAT).alias("code"), F.col("text").alias("detail"))
               .unionByName(elements.where(~loads).select("source_file", invalid, F.col("m_text").alias("detail")))
               .unionByName(units.where("kind = 'gap' and array is null").select("source_file", F.lit(FILE_CORRUPTED).alias("code"), F.col("text").alias("detail"))))
    return raw, rejects


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse (source_file, file_name_src, value) file rows -> (raw message rows, rejects).
    Shared by the batch reader and the streaming combine's micro-batches."""
    files = files.withColumn("docs", _docs(F.col("value")))
    docs = files.where(F.col("docs").isNotNull()).select("source_file", "file_name_src", F.posexplode("docs").alias("doc_pos", "doc_text"))
    blank = ~F.col("value").rlike(r"(?U)\S")
    unread = (files.where(F.col("docs").isNull())
                   .select("source_file", F.when(blank, F.lit(FILE_EMPTY)).otherwise(F.lit(FILE_CORRUPTED)).alias("code"),
                           F.col("value").alias("detail")))
    raw, rejects = parse_docs(docs.withColumns({"split_pos": F.lit(0).cast("bigint"), "doc_pos": F.col("doc_pos").cast("bigint")}))
    return raw, unread.unionByName(rejects)


def parse_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse (source_file, file_name_src, split_pos, doc_pos, doc_text) rows -> (raw message rows, rejects).

    An object that does not parse is FILE_CORRUPTED; an element that is no object (text, number, null) is
    VALIDATION_INVALID_FORMAT. Every other element still loads."""
    docs = docs.withColumn("doc", F.from_json("doc_text", ENVELOPE))
    good = F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull()
    msgs = docs.where(good).select(
        "source_file", "file_name_src", "split_pos", "doc_pos",
        F.coalesce(F.col("doc.metadata.combined_at"), F.col("doc.metadata.collected_at")).alias("loaded_at"),
        F.posexplode(_doc_messages(F.col("doc"), F.col("doc_text"))).alias("msg_pos", "m_text"))
    msgs = msgs.withColumn("m", F.from_json("m_text", MESSAGE_ELEMENT))
    loads = F.col("m").isNotNull() & F.col("m._corrupt_record").isNull()
    raw = msgs.where(loads).select(
        *[F.col(f"m.{c}").alias(c) for c in RAW_FIELDS], "source_file", *file_name_columns(F.col("file_name_src")),
        "loaded_at", "split_pos", "doc_pos", F.col("msg_pos").cast("bigint").alias("msg_pos"))
    is_object = F.coalesce(F.col("doc_text").rlike(r"^\s*\{"), F.lit(False))
    rejects = (docs.where(~good)
                   .select("source_file", F.when(is_object, FILE_CORRUPTED).otherwise(VALIDATION_INVALID_FORMAT).alias("code"),
                           F.col("doc_text").alias("detail"))
               .unionByName(msgs.where(~loads).select("source_file", F.lit(VALIDATION_INVALID_FORMAT).alias("code"),
                                                      F.col("m_text").alias("detail"))))
    return raw, rejects


def empty_files(spark: SparkSession, path: str | list[str], *, glob: str | None = None) -> DataFrame:
    """FILE_EMPTY rejects for zero-byte files. File scans skip such files entirely, so they are
    found from the file-system listing (metadata only; the same listing every scan performs)."""
    import fnmatch
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in (path if isinstance(path, list) else [path]):
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            continue
        it = fs.listFiles(hp, True)
        while it.hasNext():
            st = it.next()
            name = st.getPath().getName()
            if st.getLen() == 0 and not name.startswith((".", "_")) and (not glob or fnmatch.fnmatch(name, glob)):
                found.append((st.getPath().toString(),))
    return (spark.createDataFrame(found, "source_file string")
                 .select("source_file", F.lit(FILE_EMPTY).alias("code"), F.lit(None).cast("string").alias("detail")))


def read_jsonl(spark: SparkSession, path: str | list[str], *, glob: str | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splittable reader for large JSON-lines collections, one message (or envelope) per line: (raw message rows, rejects).
    ``only``: the ``source_file`` names to read, if not all.

    ``split_pos`` is where the line's split starts in the file and ``doc_pos`` grows inside the split, so the later line
    wins as in a file read whole."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path if isinstance(path, list) else [path]).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name_src"),
        F.col("_metadata.file_block_start").alias("split_pos"), F.monotonically_increasing_id().alias("doc_pos"), F.col("value").alias("doc_text"))
    if only is not None:
        lines = lines.join(only, "source_file", "left_semi")
    return parse_docs(lines.where(F.col("doc_text").rlike(r"(?U)\S")))


def read_messages(spark: SparkSession, path: str | list[str], *, glob: str | None = None,
                  fill_defaults: bool = False) -> DataFrame:
    """Collections -> typed, cleaned message rows (C1 + C2) with lineage columns."""
    from chatlens.operators.clean import loader_clean, typed_messages
    raw, _ = read_collection_files(spark, path, glob=glob)
    return loader_clean(typed_messages(raw), fill_defaults=fill_defaults)


def discover_channels(raw_or_files: DataFrame) -> DataFrame:
    """Distinct channels found in file names, sorted."""
    return raw_or_files.select(F.col("file_channel").alias("channel")).where(F.col("channel").isNotNull()) \
        .distinct().orderBy("channel")


def select_sources(df: DataFrame, channels: str | list[str] = "all") -> DataFrame:
    """Keep the channels asked for (file-name channel, '@' optional)."""
    if isinstance(channels, str) and channels.strip().lower() == "all":
        return df
    names = channels.split(",") if isinstance(channels, str) else channels
    wanted = [c.strip().lstrip("@") for c in names if c.strip()]
    return df.where(F.regexp_replace("file_channel", "^@", "").isin(*wanted))


def read_table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored results / messages table, or an empty frame of the schema when absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def canonical(df: DataFrame) -> DataFrame:
    """Project onto the canonical message columns (missing ones as typed nulls)."""
    from chatlens.schema import MESSAGE
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in MESSAGE.fields])


__all__ = ["read_collection_files", "read_messages", "read_jsonl", "empty_files", "discover_channels",
           "select_sources", "read_table_or_empty", "canonical", "file_name_columns", "MESSAGE_COLUMNS"]


def normalize(df: DataFrame, record_path: str = "messages", meta: list[str] | None = None) -> DataFrame:
    """Nested records -> rows, each child carrying the listed parent fields (like a
    record-path / meta normalisation): ``select(meta..., inline(record_path))``."""
    meta = meta or [c for c in df.columns if c != record_path]
    return df.select(*[F.col(m).alias(m.replace(".", "_")) for m in meta], F.inline(F.col(record_path)))


# ---- FIXED VALUES: keys that identify an analysis result type ----------------------------------
RESULT_TYPES = {
    "filename": ["files_with_duplicate_names", "filename", "ext", "files_with_special_chars"],
    "filesize": ["files_with_duplicate_sizes", "size_bytes", "bin"],
    "message": ["total_messages", "hashtag", "mention", "emoji", "url", "username", "domain"],
}
# ------------------------------------------------------------------------------------------------


def result_type(columns: list[str]) -> str | None:
    """Classify a result table by the keys it carries (first type that matches)."""
    for kind, keys in RESULT_TYPES.items():
        if any(k in columns for k in keys):
            return kind
    return None


def discover_results(spark: SparkSession, path: str) -> list[str]:
    """Result tables under ``path`` (one sub-folder per table, as written by K3).
    Reads the folder listing only."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hp):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(hp)
                  if st.isDirectory() and not st.getPath().getName().startswith(("_", ".")))


def read_results(spark: SparkSession, path: str, *, fmt: str = "parquet") -> dict[str, tuple[str | None, DataFrame]]:
    """Every result table under ``path`` with its classified type; the channel comes from
    the partition folder (``channel=<name>``) written by K3."""
    out = {}
    for name in discover_results(spark, path):
        df = spark.read.format(fmt).load(f"{path}/{name}")
        out[name] = (result_type(df.columns), df)
    return out

"""Analysis results as other tools leave them: nested JSON files in a folder tree.

``discover`` finds the files: a folder for each source type, else a folder for each channel, else the top folder; the first of these levels that has files
wins. ``read_reports`` reads them as VARIANT, so no schema is declared or inferred: a report is classified by the keys it holds, its channel comes
from its path, and files that are no known report are rejected with a code. Folders may be written as ``name`` or ``key=name`` (as Spark writes partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators.validate import FILE_CORRUPTED, FILE_EMPTY, VALIDATION_MISSING_FIELD

# ---- FIXED VALUES: source types, the keys that tell a report's type (first that fits), name endings, required keys and size of a report ----
SOURCE_TYPES = ("file_messages", "db_messages", "diff_messages")
TYPE_KEYS = {
    "filename_analysis": ("duplicate_filename_detection", "common_extensions"),
    "filesize_analysis": ("filesize_distribution_analysis", "size_frequency_distribution"),
    "message_analysis": ("content_statistics", "pattern_recognition"),
}
RAW_KEYS = ("duplicate_filename_detection", "filesize_distribution_analysis", "content_statistics")
NAME_ENDINGS = ("_filename_analysis", "_filesize_analysis", "_message_analysis", "_analysis")
REQUIRED = {  # any key of any of the groups, all keys of the group
    "filename_analysis": (("duplicate_filename_detection",), ("common_extensions",), ("total_files",), ("unique_filenames",), ("duplicate_filenames",)),
    "filesize_analysis": (("filesize_distribution_analysis",), ("size_frequency_distribution",), ("total_size_bytes",), ("total_size_mb",), ("avg_file_size_mb",)),
    "message_analysis": (("total_messages",), ("text_messages",), ("media_messages",)),
    "analysis_summary": (("total_messages", "total_files"), ("total_messages_analyzed", "total_files_analyzed")),
}
MAX_REPORT_CHARS = 1_000_000
# ------------------------------------------------------------------------------------------------


def _depth(spark: SparkSession, root: str) -> int:
    """Number of folders down to and with ``root``, as the file system names it."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    qualified = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hp)
    return qualified.depth()


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``source_file, source_type, level, folders, name, value`` of the JSON files of the first level that has any.

    Level 1: below a source type's folder, at any depth; 2: in a folder (not hidden) below ``root``; 3: in ``root``."""
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
             .select(F.col("_metadata.file_path").alias("source_file"), "value"))
    path = F.regexp_replace("source_file", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), _depth(spark, root) + 1, 1000)
    plain = F.transform(parts, lambda p: F.regexp_replace(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), "^[A-Za-z_]+=", ""))
    files = files.withColumn("parts", plain).withColumn("folders", F.slice("parts", 1, F.size("parts") - 1)).withColumn("name", F.element_at("parts", -1))
    level = (F.when(F.get("folders", 0).isin(*SOURCE_TYPES), 1)
              .when((F.size("folders") == 1) & ~F.get("folders", 0).startswith("."), 2).when(F.size("folders") == 0, 3))
    files = files.withColumn("level", level).where("level is not null")
    wins = files.agg(F.min("level")).scalar()
    return (files.where(F.col("level") == wins)
            .withColumn("source_type", F.when(F.col("level") == 1, F.get("folders", 0)).otherwise(SOURCE_TYPES[0]))
            .select("source_file", "source_type", "level", "folders", "name", "value"))


def channel_of() -> Column:
    """The channel folder below a source type; else, for the file of one analysis, its folder; else the file's name without its ending."""
    stem = F.regexp_replace("name", r"\.json$", "")
    ending = "(" + "|".join(NAME_ENDINGS) + ")$"
    base = F.regexp_replace(stem, ending, "")
    single = stem.rlike("(" + "|".join(NAME_ENDINGS[:3]) + ")$")
    return (F.when((F.col("level") == 1) & (F.size("folders") > 1), F.get("folders", 1))
             .when((F.col("level") == 2) & single, F.get("folders", 0)).otherwise(base))


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _any(v: Column, keys) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | _has(v, k)
    return out


def read_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(``source_file, source_type, channel, analysis_type, valid, report`` with the report as VARIANT, rejects).

    An array of one element stands for the element. A report names its type itself (``channel_name`` and ``analysis_type``, or ``report_type`` and ``generated_at``)
    or is told by its keys. ``valid``: the report is not too long and has the keys that its type requires (V8)."""
    files = discover(spark, root).withColumn("channel", channel_of()).withColumn("_v", F.try_parse_json("value"))
    kind = F.schema_of_variant("_v")
    lone = kind.startswith("ARRAY") & F.try_variant_get("_v", "$[0]", "variant").isNotNull() & F.try_variant_get("_v", "$[1]", "variant").isNull()
    files = files.withColumn("report", F.when(lone, F.try_variant_get("_v", "$[0]", "variant")).otherwise(F.col("_v")))
    v = F.col("report")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    inferred = F.lit(None).cast("string")
    for name, keys in reversed(TYPE_KEYS.items()):
        inferred = F.when(_any(v, keys), F.lit(name)).otherwise(inferred)
    own = F.when(_has(v, "channel_name") & _has(v, "analysis_type"), F.try_variant_get(v, "$.analysis_type", "string"))
    old = F.when(_has(v, "report_type") & _has(v, "generated_at"), F.try_variant_get(v, "$.report_type", "string"))
    told = F.when(is_object, F.coalesce(own, old, F.when(_any(v, RAW_KEYS), inferred)))
    required = F.lit(True)
    for name, groups in REQUIRED.items():
        fits = F.lit(False)
        for group in groups:
            whole = F.lit(True)
            for k in group:
                whole = whole & _has(v, k)
            fits = fits | whole
        required = F.when(F.col("analysis_type") == name, fits).otherwise(required)
    files = files.withColumn("analysis_type", told)
    good = F.col("analysis_type").isNotNull()
    code = (F.when(~F.col("value").rlike(r"(?U)\S"), FILE_EMPTY).when(F.col("_v").isNull(), FILE_CORRUPTED).otherwise(VALIDATION_MISSING_FIELD))
    reports = files.where(good).select("source_file", "source_type", "channel", "analysis_type",
                                       (required & (F.length(F.to_json(v)) <= MAX_REPORT_CHARS)).alias("valid"), "report")
    return reports, files.where(~good).select("source_file", code.alias("code"), F.col("value").alias("detail"))

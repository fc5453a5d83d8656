"""File profiles: names (A1-A6), sizes (A7-A9, A20, A21), storage and formats.

Counts of (channel, name) and (channel, size) are built once with partial aggregation; every
uniqueness / duplicate statistic is a second, much smaller aggregation over those counts
(no ``countDistinct`` Expand, no value list per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions import patterns as P
from chatlens.functions.expr import (ANALYSIS_BINS, COLLECTION_BINS, MIB, extension, human_size, non_blank,
                                     ratio, round_half_even, size_bin_analysis, size_bin_collection, size_mb)
from chatlens.operators.quantile import exact_quantiles
from chatlens.operators.topk import BY, key_counts, top_k, top_k_by_count


def named_files(df: DataFrame) -> DataFrame:
    """Rows with a file name (not null, not empty): the reference's filename-analysis input."""
    return df.where(non_blank("file_name"))


def sized_files(df: DataFrame) -> DataFrame:
    """Rows with file_size > 0: the reference's filesize-analysis input."""
    return df.where(F.col("file_size") > 0)


def _dup_summary(counts: DataFrame, by: Sequence[str], what: str) -> DataFrame:
    return (counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias(f"files_with_duplicate_{what}s"),
        F.count(F.lit(1)).alias(f"total_unique_file{what}s"),
        F.sum("count").alias("total_files"))
        .withColumn("duplicate_ratio", ratio(f"files_with_duplicate_{what}s", "total_files", 3)))


def filename_counts(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return key_counts(named_files(df), "file_name", by=by, name="filename")


def filename_duplicates(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A1: files_with_duplicate_names = sum of counts > 1, distinct names, files, ratio (3 dp)."""
    return _dup_summary(filename_counts(df, by=by), by, "name")


def filename_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """A1 most common file names."""
    return top_k_by_count(filename_counts(df, by=by), k, key="filename", by=by).select(*by, "rank", "filename", "count")


def filename_length_stats(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A2: count, min, max, mean (2 dp), median (truncated). Median buffer is per distinct length."""
    ln = F.length("file_name")
    return named_files(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min(ln).cast("bigint").alias("min"), F.max(ln).cast("bigint").alias("max"),
        round_half_even(F.avg(ln), 2).alias("mean"), F.floor(F.median(ln)).alias("median"))


def extensions_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """A3: lower-cased extension after the last dot (names without one are excluded), '.ext'."""
    c = key_counts(named_files(df), extension("file_name"), by=by, name="ext")
    return (top_k_by_count(c, k, key="ext", by=by)
            .select(*by, "rank", F.concat(F.lit("."), F.col("ext")).alias("ext"), "count"))


def filename_char_flags(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A4/A5: names with special characters (Unicode-aware class) and names with spaces."""
    return named_files(df).groupBy(*by).agg(
        F.count_if(F.col("file_name").rlike(P.SPECIAL_CHAR)).alias("files_with_special_chars"),
        F.count_if(F.col("file_name").contains(" ")).alias("files_with_spaces"))


def filename_length_buckets(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """File-name length ranges 1-10, 11-20, 21-30, 31-40, 41-50, 50+ (zero-filled)."""
    labels = ["1-10", "11-20", "21-30", "31-40", "41-50", "50+"]
    ln = F.length("file_name")
    b = (F.when(ln <= 10, labels[0]).when(ln <= 20, labels[1]).when(ln <= 30, labels[2])
         .when(ln <= 40, labels[3]).when(ln <= 50, labels[4]).otherwise(labels[5]))
    return zero_filled(named_files(df).select(*by, b.alias("bucket")), "bucket", labels, by=by)


def zero_filled(rows: DataFrame, label_col: str, labels: Sequence[str], *, by: Sequence[str] = BY,
                count_col: str = "count") -> DataFrame:
    """Count rows per (group, label) and emit every label of every group that has rows, with 0s.
    The spine is the distinct groups exploded by a literal label array (no data cross join)."""
    counts = rows.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias(count_col))
    spine = (rows.select(*by).distinct()
                 .select(*by, F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("ord", label_col)))
    return (spine.join(counts, list(by) + [label_col], "left")
                 .select(*by, F.col("ord").cast("bigint").alias("ord"), label_col,
                         F.coalesce(F.col(count_col), F.lit(0)).alias(count_col)))


# ------------------------------------------------------------------------------------------ sizes
def filesize_counts(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return key_counts(sized_files(df), "file_size", by=by, name="size_bytes")


def filesize_duplicates(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """As A1 over file sizes > 0."""
    return _dup_summary(filesize_counts(df, by=by), by, "size")


def filesize_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """A7 most common sizes with size in MiB (2 dp)."""
    return (top_k_by_count(filesize_counts(df, by=by), k, key="size_bytes", by=by)
            .select(*by, "rank", "size_bytes", "count", size_mb("size_bytes").alias("size_mb")))


def filesize_histogram(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Right-closed MiB bins, every label present."""
    return zero_filled(sized_files(df).select(*by, size_bin_analysis("file_size").alias("bin")), "bin",
                       ANALYSIS_BINS, by=by)


def filesize_potential_dups(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """The k largest sizes shared by more than one file, with the names that carry them.

    Tidy instead of a list per size: one row per (size, name) with its occurrences, so a size
    shared by millions of files never becomes one array in one task. Null names are kept
    (the reference lists them too) under ``file_name = NULL``.
    """
    sized = sized_files(df)
    sizes = (filesize_counts(df, by=by).where(F.col("count") > 1)
             .withColumnRenamed("count", "n_files"))
    top = top_k(sizes, k, by=by, order=[F.col("size_bytes").desc()])
    names = (sized.groupBy(*by, F.col("file_size").alias("size_bytes"), "file_name")
                  .agg(F.count(F.lit(1)).alias("occurrences")))
    return (top.join(names, list(by) + ["size_bytes"])
               .select(*by, "rank", "size_bytes", "n_files", "file_name", "occurrences"))


def total_data_size(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Bytes and files with size > 0, plus the human-readable total."""
    s = sized_files(df)
    return (s.groupBy(*by).agg(F.sum("file_size").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))
             .withColumn("total_human", human_size("total_bytes")))


def file_uniqueness_singletons(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """A21 (collection view, Q8): 'unique' = values that occur exactly once.

    files_with_duplicate_sizes_reported counts *distinct repeated sizes* as the reference does;
    files_with_duplicate_names = total files - singleton names (falls back to sizes when no file
    carries a name); duplicate_ratio is unrounded.
    """
    s = sized_files(df)
    sc = (s.groupBy(*by, "file_size").agg(F.count(F.lit(1)).alias("n"))
           .groupBy(*by).agg(F.sum("n").alias("total_files"),
                             F.count_if(F.col("n") == 1).alias("unique_sizes"),
                             F.count_if(F.col("n") > 1).alias("duplicate_sizes")))
    nc = (s.where(non_blank("file_name")).groupBy(*by, "file_name").agg(F.count(F.lit(1)).alias("n"))
           .groupBy(*by).agg(F.count_if(F.col("n") == 1).alias("unique_filenames"),
                             F.count_if(F.col("n") > 1).alias("duplicate_filenames")))
    j = sc.join(nc, list(by), "left")
    has_names = F.col("unique_filenames").isNotNull()
    uniq = F.when(has_names, F.col("unique_filenames")).otherwise(F.col("unique_sizes"))
    dup_names = F.col("total_files") - uniq
    return j.select(
        *by, "total_files", "unique_sizes", "duplicate_sizes",
        (F.col("total_files") - F.col("unique_sizes")).alias("files_with_duplicate_sizes"),
        uniq.alias("total_unique_filenames"),
        dup_names.alias("files_with_duplicate_names"),
        (dup_names.cast("double") / F.col("total_files").cast("double")).alias("duplicate_ratio"))


def filesize_histogram_wide(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Left-closed five-bin histogram, every label present."""
    return zero_filled(sized_files(df).select(*by, size_bin_collection("file_size").alias("bin")), "bin",
                       COLLECTION_BINS, by=by)


def extensions_wide_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """Extensions by the last '.'-separated token (names containing a dot), lower-cased."""
    s = sized_files(df).where(non_blank("file_name") & F.col("file_name").contains("."))
    c = key_counts(s, F.lower(F.element_at(F.split("file_name", r"\.", -1), -1)), by=by, name="extension")
    return top_k_by_count(c, k, key="extension", by=by).select(*by, "rank", "extension", "count")


# ------------------------------------------------------------------------------ storage / formats
def file_summary(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Files with a known size, storage (bytes, MiB 2 dp), average size."""
    f = df.where(F.col("file_size").isNotNull())
    return f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("file_size").alias("total_storage_bytes"),
        round_half_even(F.sum("file_size") / float(MIB), 2).alias("total_storage_mb"),
        round_half_even(F.avg("file_size"), 2).alias("average_file_size_bytes"),
        round_half_even(F.avg("file_size") / float(MIB), 2).alias("average_file_size_mb"))


def mime_top(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """Most common MIME types."""
    c = key_counts(df.where(non_blank("mime_type")), "mime_type", by=by, name="mime_type")
    return top_k_by_count(c, k, key="mime_type", by=by).select(*by, "rank", "mime_type", "count")


def size_percentiles(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Exact 50/75/90th percentiles of sizes > 0 and small (<1 MiB) / medium / large (>10 MiB)."""
    s = sized_files(df)
    q = exact_quantiles(s, "file_size", [0.5, 0.75, 0.9], by=by)
    cats = s.groupBy(*by).agg(
        F.count_if(F.col("file_size") < MIB).alias("small"),
        F.count_if((F.col("file_size") >= MIB) & (F.col("file_size") <= 10 * MIB)).alias("medium"),
        F.count_if(F.col("file_size") > 10 * MIB).alias("large"))
    return cats.join(q, list(by), "left")


def largest_files(df: DataFrame, k: int = 10, *, by: Sequence[str] = BY) -> DataFrame:
    """The k largest files (size desc, message_id asc)."""
    s = sized_files(df).select(*by, "message_id", "file_name", "file_size")
    return top_k(s, k, by=by, order=[F.col("file_size").desc(), F.col("message_id").asc()]) \
        .select(*by, "rank", "message_id", "file_name", "file_size")


# ---- FIXED VALUES: format families of the design documents -------------------------------------
FORMAT_FAMILIES = {
    "documents": ["pdf", "doc", "docx", "txt", "ppt", "pptx", "xls", "xlsx", "epub", "mobi", "djvu", "rtf", "odt"],
    "images": ["jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "tiff"],
    "videos": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "m4a", "wma"],
    "archives": ["zip", "rar", "7z", "tar", "gz"],
}
# ------------------------------------------------------------------------------------------------


def format_family(ext_col) -> F.Column:
    out = None
    for fam, exts in FORMAT_FAMILIES.items():
        cond = ext_col.isin(*exts)
        out = F.when(cond, fam) if out is None else out.when(cond, fam)
    return out.otherwise("other")


def format_families(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """X11: files per (family, extension) with the average size per extension."""
    f = named_files(df).select(*by, extension("file_name").alias("ext"), "file_size").where(F.col("ext").isNotNull())
    return (f.groupBy(*by, format_family(F.col("ext")).alias("family"), F.upper("ext").alias("format"))
             .agg(F.count(F.lit(1)).alias("count"),
                  round_half_even(F.avg("file_size"), 2).alias("avg_size_bytes")))

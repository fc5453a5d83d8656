"""Column expressions (all JVM-side, codegen-friendly) used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions import patterns as P


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, digits: int) -> Column:
    """Round like numpy/pandas: scale, round half to even, unscale (exactly rint(x*10^d)/10^d)."""
    scale = float(10 ** digits)
    return F.bround(col_(c).cast("double") * scale, 0) / scale


def sql_round(expr: str, digits: int) -> str:
    """Oracle-side twin of :func:`round_half_even`."""
    scale = float(10 ** digits)
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale})"


def pct(part: str | Column, whole: str | Column, digits: int = 2) -> Column:
    """part / whole * 100 rounded; 0.0 when whole is 0 (the reference's division guard)."""
    ratio = F.try_divide(col_(part).cast("double"), col_(whole).cast("double"))
    return F.coalesce(round_half_even(ratio * 100.0, digits), F.lit(0.0))


def ratio(part: str | Column, whole: str | Column, digits: int = 3) -> Column:
    r = F.try_divide(col_(part).cast("double"), col_(whole).cast("double"))
    return F.coalesce(round_half_even(r, digits), F.lit(0.0))


def non_blank(c: str | Column) -> Column:
    """Not null and not the empty string (the reference's has-value predicate)."""
    return col_(c).isNotNull() & (col_(c) != F.lit(""))


def channel_key(c: str | Column = "channel_username") -> Column:
    """Normalised channel name for matching: leading '@' removed (C11 safe name)."""
    return F.regexp_replace(col_(c), r"^@", "")


def sanitize_channel(c: str | Column, max_len: int = 50) -> Column:
    """Channel name for paths: '@' -> 'at_', space -> '_', other signs but '_' and '-' dropped, cut."""
    x = F.regexp_replace(F.regexp_replace(col_(c), "@", "at_"), " ", "_")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "")
    return F.substring(x, 1, max_len)


def extension(c: str | Column) -> Column:
    """Lower-case extension after the last dot; null when there is none (pandas NaN)."""
    return F.lower(F.nullif(F.regexp_extract(col_(c), P.EXTENSION, 1), F.lit("")))


def url_domain(url: str | Column) -> Column:
    """Network location of a matched URL; null when empty or when brackets are unbalanced
    (the reference's URL parser rejects those and skips them)."""
    net = F.regexp_extract(col_(url), P.URL_NETLOC, 1)
    bad = net.contains("[") != net.contains("]")
    return F.when((net != "") & ~bad, net)


MIB = 1024 * 1024


def size_bin_analysis(size: str | Column) -> Column:
    """Right-closed bins (0,1], (1,5], (5,10], (10,inf) MiB; sizes <= 0 have no bin."""
    s = col_(size)
    return (F.when(s <= 0, F.lit(None).cast("string"))
            .when(s <= MIB, "0-1MB").when(s <= 5 * MIB, "1-5MB")
            .when(s <= 10 * MIB, "5-10MB").otherwise("10MB+"))


# ---- FIXED VALUES: histogram labels of the reference, in order --------------------------------
ANALYSIS_BINS = ["0-1MB", "1-5MB", "5-10MB", "10MB+"]
COLLECTION_BINS = ["0-1MB", "1-10MB", "10-100MB", "100MB-1GB", "1GB+"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# ------------------------------------------------------------------------------------------------


def size_bin_collection(size: str | Column) -> Column:
    """Left-closed bins <1 MiB, <10 MiB, <100 MiB, <1 GiB, >= 1 GiB."""
    s = col_(size)
    return (F.when(s < MIB, "0-1MB").when(s < 10 * MIB, "1-10MB").when(s < 100 * MIB, "10-100MB")
            .when(s < 1024 * MIB, "100MB-1GB").otherwise("1GB+"))


def human_size(size: str | Column) -> Column:
    """'0 B' for null/0; else the first unit where the value is < 1024, one decimal (half-even)."""
    s = col_(size).cast("double")
    out = None
    for k, unit in enumerate(SIZE_UNITS):
        v = s / float(1024 ** k)
        txt = F.concat(F.format_string("%.1f", F.bround(v, 1)), F.lit(" " + unit))
        out = F.when(v < 1024.0, txt) if out is None else out.when(v < 1024.0, txt)
    pb = F.concat(F.format_string("%.1f", F.bround(s / float(1024 ** 5), 1)), F.lit(" PB"))
    return F.when(s.isNull() | (s == 0), F.lit("0 B")).otherwise(out.otherwise(pb))


def size_mb(size: str | Column, digits: int = 2) -> Column:
    return round_half_even(col_(size) / float(MIB), digits)

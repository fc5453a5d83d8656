"""Helpers shared by the training-data operators: table access, Arrow slices, word ids, id filters."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.session import cut_lineage

SLICE_BYTES = 4 << 20  # text handled at once inside a task; a longer single text is its own slice
BATCH_BYTES = 1 << 20  # text of one Arrow batch in jobs of many steps; a longer single text is its own batch
ID_BITS = 1 << 20  # slots of the id bitmap, 128 KB whatever the input


def share_library(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it; a cluster without that path ships it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    env.setdefault("OMP_NUM_THREADS", "1")  # Spark has a Python worker for every core already


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (survives lost executors)."""
    return cut_lineage(df, name)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Hand texts to Python workers in batches of about ``size`` bytes, so that neither side holds 10,000 rows at once. Holds for what runs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def give_back_memory() -> None:
    """Return what a finished task held to the system: Spark keeps its Python workers for later tasks."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of bounded text; null texts come as empty bytes. At the end the worker gives back what the task's texts took."""
    batch = raw = size = block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(column).cast(pa.large_binary())
        size = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in raw), np.int64, len(raw)) \
            if raw.null_count else np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1])
        block = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(raw)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), [x or b"" for x in raw.slice(a, b - a).to_pylist()]
    del batch, raw, size, block
    give_back_memory()


class Hashes(dict):
    """Word to 64-bit hash, kept for words seen lately; emptied when it holds ``most`` words."""

    def __init__(self, mask: int = (1 << 64) - 1, most: int = 400_000):
        super().__init__()
        self.mask, self.most = mask, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & self.mask
        return h

    def of(self, words: list[bytes], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift), elementwise."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap over ``ID_BITS`` hash slots of a column, built by a grouped OR; at most 16,384 rows reach the driver."""
    slot = F.pmod(F.xxhash64(column), F.lit(ID_BITS))
    rows = (ids.where(F.col(column).isNotNull()).select(slot.alias("s"))
            .groupBy(F.shiftright("s", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).collect())
    words = np.zeros(ID_BITS // 64, np.uint64)
    for r in rows:
        words[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    return words


def maybe_in(rows: DataFrame, bitmap: np.ndarray, column: str, inside: bool = True) -> DataFrame:
    """Rows with an id of the bitmap and, by hash collision, some others; without ``inside`` all the other rows, null ids among them.

    The bitmap's words that hold a bit (at most 16,384 rows) are joined by broadcast: rows pass no Python worker.
    """
    full = np.flatnonzero(bitmap)
    words = rows.sparkSession.createDataFrame(pa.table({"_word": pa.array(full, pa.int64()), "_bits": pa.array(bitmap[full].view(np.int64))}))
    slot = F.pmod(F.xxhash64(rows[column]), F.lit(ID_BITS))
    held = ((F.shiftright(slot, 6) == words["_word"]) & (F.getbit(words["_bits"], slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
            & rows[column].isNotNull())
    return rows.join(F.broadcast(words), held, "left_semi" if inside else "left_anti")


def without_ids(rows: DataFrame, drop: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not in ``drop``; rows with a null id stay.

    A bounded bitmap lets most rows pass without a shuffle; only rows that may be in ``drop``
    go through the exact anti join, so texts of kept rows hardly move.
    """
    drop = drop.select(column).distinct()
    bitmap = id_bitmap(drop, column)
    return maybe_in(rows, bitmap, column, inside=False).unionByName(maybe_in(rows, bitmap, column).join(drop, column, "left_anti").select(*rows.columns))

"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Windows of ``WINDOW`` consecutive benchmark words (a shorter item is one window) are the test strings, over
word ids. Windows of one length form a search: for every block of two words a shift table says
how far the search may jump; where the shift is 0 the block's hash names a bucket of windows
and each is compared word by word. One-word windows have no block and are found by their id.

The window tables are broadcast in chunks of at most ``CHUNK_WORDS`` benchmark words; a larger benchmark
takes several chunks, each scanned over all documents, so the broadcast is bounded and
nothing is dropped. Windows of a chunk that repeat are stored once.

Defined cases: null texts and texts without words have no words and no hit; items without words
occur nowhere; null item ids are ignored; rows that repeat a doc_id are judged one by one; equal item texts count as items
of their own; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint, text_slices

WINDOW = 10
CHUNK_WORDS = 2_000_000  # bound of what is broadcast at once: about 50 MB of tables
TABLE_BITS = 18
# Bytes that make words: a-z (A-Z lower-cased), digits, and everything outside ASCII.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(KEEP).split()


class WuManber:
    """Search tables for windows of equal length ``m`` >= 2 over word ids."""

    def __init__(self, windows: dict[tuple[int, ...], list], m: int):
        self.m, self.mask = m, (1 << TABLE_BITS) - 1
        self.shift = np.full(self.mask + 1, m - 1, np.int64)
        self.buckets: dict[int, list[tuple[int, ...]]] = {}
        for window in windows:
            slots = self.slots(np.array(window, np.int64)).tolist()
            for j, s in enumerate(slots):
                self.shift[s] = min(self.shift[s], m - 2 - j)
            self.buckets.setdefault(slots[-1], []).append(window)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        return ((ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA77) >> 7) & self.mask

    def find(self, ids: np.ndarray):
        """Yield (first word, window) of every occurrence."""
        m = self.m
        if len(ids) < m:
            return
        slots = self.slots(ids)
        jump = self.shift[slots].tolist()
        i, end = m - 2, len(jump)
        while i < end:
            step = jump[i]
            if step:
                i += step
                continue
            first = i - m + 2
            here = None
            for window in self.buckets.get(int(slots[i]), ()):
                here = here or tuple(ids[first:i + 2].tolist())
                if here == window:
                    yield first, window
            i += 1


class Benchmark:
    """Word ids, window tables and the items behind every window of one chunk."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                mine = self.owners.setdefault(tuple(w[i:i + WINDOW]), [])
                if not mine or mine[-1] != item:
                    mine.append(item)
        lengths = {len(w) for w in self.owners}
        self.search = [WuManber({w: 0 for w in self.owners if len(w) == m}, m) for m in sorted(lengths - {1})]
        self.single = {w[0] for w in self.owners if len(w) == 1}

    def scan(self, texts: list[bytes]):
        """Per text: number of words, [first, end) spans of hit words, item ids."""
        get, each, ids = self.ids.get, [], []
        for t in texts:
            w = words_of(t)
            each.append(len(w))
            ids += [get(x, 0) for x in w]
            ids += [0] * WINDOW  # no window spans two texts
        ids = np.array(ids, np.int64)
        begin = np.concatenate([[0], np.cumsum(np.array(each, np.int64) + WINDOW)])
        found = [(p, w) for s in self.search for p, w in s.find(ids)]
        if self.single:
            found += [(int(p), (int(ids[p]),)) for p in np.flatnonzero(np.isin(ids, list(self.single)))]
        spans, items = [[] for _ in texts], [set() for _ in texts]
        for (p, w), k in zip(found, (np.searchsorted(begin, [p for p, _ in found], "right") - 1).tolist()):
            first = p - int(begin[k])
            spans[k].append((first, first + len(w)))
            items[k].update(self.owners[w])
        return zip(each, map(merge, spans), items)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [first, end) spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def chunks(benchmark: DataFrame):
    """Items in chunks of bounded size, in a stable order; one chunk at a time is on the driver."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
             .where("i is not null and t is not null").orderBy("i", "t"))
    now, size = [], 0
    for r in items.toLocalIterator():
        n = 1 + r.t.count(" ")
        if now and size + n > CHUNK_WORDS:
            yield now
            now, size = [], 0
        now.append((r.i, r.t.encode()))
        size += n
    yield now


def scan_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Return ``row, doc_id, n_words, spans, items`` for every row; several chunks are put together by row."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = [spark.sparkContext.broadcast(Benchmark(c)) for c in chunks(benchmark)]
    schema = f"row long, doc_id {kind}, n_words long, spans array<struct<first:int,end:int>>, items array<string>"

    def one(tables):
        def scan(batches):
            for b, texts in text_slices(batches, "text"):
                n, spans, items = zip(*tables.value.scan(texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()),
                     pa.array([[{"first": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                     pa.array([sorted(i) for i in items], pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])
        return scan

    if len(parts) == 1:
        return docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text").mapInArrow(one(parts[0]), schema)
    numbered = checkpoint(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate-docs")
    scans = [numbered.mapInArrow(one(p), schema) for p in parts]
    whole = scans[0]
    for s in scans[1:]:
        whole = whole.unionByName(s)

    def join_spans(lists):
        import pandas as pd
        return pd.Series([merge([(x["first"], x["end"]) for x in s]) for s in lists])

    put = F.pandas_udf(join_spans, "array<struct<first:int,end:int>>")
    return (whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                     F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumn("spans", put("spans")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan_documents``: word, hit and item counts, hash of the items, verdict."""
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]).cast("long")
    return scan_documents(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window; each chunk filters what the one before has left, with no shuffle."""
    out = docs
    for c in chunks(benchmark):
        tables = docs.sparkSession.sparkContext.broadcast(Benchmark(c))

        def scan(batches, tables=tables):
            for b, texts in text_slices(batches, "text"):
                yield b.filter(pa.array([not spans for _, spans, _ in tables.value.scan(texts)], pa.bool_()))

        out = out.mapInArrow(scan, out.schema)
    return out

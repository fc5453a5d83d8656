"""Importance resampling towards a target distribution, with exact ranks from parallel sorting by regular sampling.

Features are the runs of one to three consecutive words, hashed into ``BUCKETS`` buckets. Every task sums its texts' buckets in one array, a grouped sum
adds the arrays' entries, and the two smoothed distributions (of the documents and of the target texts) give each bucket a gain.
The gains are one array of ``BUCKETS`` numbers; a document's weight is the sum of the array at its features' buckets. Adding
Gumbel noise drawn from a hash of the id and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

The ranks come from parallel sorting by regular sampling: rows that can be drawn are sorted inside their partitions (runs, written once with their places); every run gives the
rows at regular places; these samples, sorted, give splitters at regular places; rows go to the segment between their two splitters,
each segment is sorted where it arrives, and the counts of the segments before it make its places global ranks. Keys end with the place in the
run, so no two are equal and copies of one row can't swell a segment. With p runs sampled every t rows a segment holds at most
``rows / segments + p * t`` rows. Segments wholly behind the last rank drawn are counted but not moved.

Bounds: the driver holds the gains and about ``SAMPLES`` samples for each segment (and at most one for each run); segments grow with the square root of the rows.

Defined cases: null texts and texts without words have no features, weight 0 and are never drawn while ``min_words`` is positive; a null id hashes as the empty string and
sorts before all others; rows that repeat an id are drawn one by one, in order of score, id, weight and number of features, rows equal in all of these in any order;
without target texts the target is the smoothing alone; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint, text_slices

BUCKETS = 10_000
LONGEST = 3  # words of the longest feature
SCALE = 1000  # scores are whole thousandths
SAMPLES = 16  # samples behind each splitter
# Bytes that make words: a-z (A-Z lower-cased), digits, and everything outside ASCII.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> tuple[int, list[int]]:
    """Number of words and the hashes of all features; a longer run's hash goes on from that of the run one word shorter."""
    words = text.translate(KEEP).split()
    hashes = list(map(crc32, words))
    out, more = hashes, [b" " + w for w in words]
    for n in range(1, LONGEST):
        hashes = list(map(crc32, more[n:], hashes))
        out = out + hashes
    return len(words), out


def _buckets(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket; every task sends at most ``BUCKETS`` rows."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, slice_texts in text_slices(batches, "text"):
            for t in slice_texts:
                total += np.bincount(_buckets(features(t)[1]), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket in thousandths: how much likelier it is in the target than in the documents, both smoothed by one."""
    counted = []
    for texts in (docs, target):
        n = [0] * BUCKETS
        for r in bucket_counts(texts).collect():  # at most BUCKETS rows
            n[r.bucket] = r.n
        counted.append((n, sum(n)))
    (s, all_s), (t, all_t) = counted
    return np.array([math.floor(SCALE * math.log(float(y + 1) * float(all_s + BUCKETS) / (float(x + 1) * float(all_t + BUCKETS)))) for x, y in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        gain = shared.value
        for b, texts in text_slices(batches, "text"):
            rows = [(n, len(f), int(gain[_buckets(f)].sum())) for n, f in map(features, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["doc_id", "n_words", "n_features", "weight"])

    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long"))


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of seed and id, the same wherever the row lies."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


class Splitters:
    """Sorted keys that cut all keys into segments; nulls among the ids come first."""

    COLUMNS = ("score", "doc_id", "weight", "n_features", "place")

    def __init__(self, keys: list[tuple]):
        self.keys = keys

    @staticmethod
    def key(score, doc_id, weight, n_features, place) -> tuple:
        return (-score, doc_id is not None, doc_id, weight, n_features, place)

    def segments(self, batch: pa.RecordBatch) -> pa.Array:
        columns = [batch.column(c).to_pylist() for c in self.COLUMNS]
        return pa.array([bisect.bisect_right(self.keys, self.key(*row)) for row in zip(*columns)], pa.int32())


def order() -> list:
    return [F.col("score").desc(), "doc_id", "weight", "n_features"]


def regular_splitters(runs: DataFrame, rows: int) -> list[tuple]:
    """Keys that cut the ``rows`` rows of ``runs`` into segments, from the rows at regular places of every run."""
    segments = max(2, math.isqrt(rows) // 8)
    step = max(1, rows // (segments * SAMPLES))
    in_run = F.col("place").bitwiseAND((1 << 33) - 1)
    samples = sorted(Splitters.key(*r) for r in runs.where(in_run % step == step // 2).select(*Splitters.COLUMNS).collect())
    return [samples[len(samples) * k // segments] for k in range(1, segments)] if samples else []


def with_rank(runs: DataFrame, rows: int, drawn: int) -> DataFrame:
    """All rows of ``runs`` with their exact ``rank`` (from 1, in ``order``) where it is at most ``drawn``, else null."""
    spark = runs.sparkSession
    shared = spark.sparkContext.broadcast(Splitters(regular_splitters(runs, rows)))

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, shared.value.segments(b)], [*b.schema.names, "segment"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    dealt = checkpoint(runs.mapInArrow(deal, f"{fields}, segment int"), "resample-dealt")
    before, offsets = 0, []  # prefix counts: a number for each segment, up to the last that is needed
    for k, n in sorted(map(tuple, dealt.groupBy("segment").count().collect())):
        if before < drawn:
            offsets.append((k, before))
        before += n
    last = offsets[-1][0] if offsets else -1
    table = F.broadcast(spark.createDataFrame(offsets, "segment int, before long"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*order(), "place")) + F.col("before")
    needed = dealt.where(F.col("segment") <= last).join(table, "segment").withColumn("rank", place.cast("long"))
    nothing = F.lit(None).cast("long")
    return (needed.select(*runs.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(dealt.where(F.col("segment") > last).select(*runs.columns, nothing.alias("rank"))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row; ``rank`` is null unless the row is among the drawn
    ``percent`` hundredths of the rows with at least ``min_words`` words."""
    weighed = weigh(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(seed))
    fit = F.col("n_words") >= min_words
    runs = checkpoint(weighed.sortWithinPartitions(fit.desc(), *order()).withColumn("place", F.monotonically_increasing_id()), "resample-runs")
    rows = runs.where(fit).count()
    done = with_rank(runs.where(fit), rows, percent * rows // 100)
    return done.unionByName(runs.where(~fit).withColumn("rank", F.lit(None).cast("long"))).drop("place")

"""Document quality by random indexing and a small network.

Words and runs of signs are hashed to ``BUCKETS`` ids. Every id owns a sparse random index vector;
its word vector is the sum of the index vectors of its neighbours (two on each side) over all
documents. A document is pooled to the mean and spread of its word vectors and the mean product of
adjacent ones. A two-layer numpy network is fitted on at most ``FIT_ROWS`` labelled rows (the
bounded sample; word vectors cover all rows) and its temperature is set on a fifth of them.

Defined cases: null or empty texts pool to zeros and get the score of that; labels of a doc_id that
disagree, and null labels or ids, teach nothing; without any usable label every score is 0.5.
Repeated rows are scored alike, each with a row of its own. Only doc_id and text are read, so
extra columns and clashing names do not matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import Hashes, checkpoint, text_slices

BUCKETS, DIM, NONZERO, REACH = 8192, 32, 4, 2
POOL_WORDS = 1 << 15  # words whose vectors are in memory at once
FIT_ROWS = 20_000  # documented bound of the labelled sample that fits the network
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 32, 30, 3e-3, 128, 1e-4
THRESHOLD = 0.3
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every id's random index vector."""
    rng = np.random.default_rng(17)
    return (np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO],
            rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO)))


def _words(texts: list[bytes], ids: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row, and where each text begins (one more entry than texts)."""
    each = [WORD.findall(t) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
    return ids.of([x for w in each for x in w], np.int64), begin


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all ids (``BUCKETS`` x ``DIM``, a fixed size), from all rows."""

    def gather(batches):
        place, sign = index_vectors()
        ids, total = Hashes(BUCKETS - 1), np.zeros(BUCKETS * DIM)
        for _, texts in text_slices(batches, "text"):
            w, begin = _words(texts, ids)
            doc = np.repeat(np.arange(len(texts)), np.diff(begin))
            for reach in range(1, REACH + 1):
                same = doc[reach:] == doc[:-reach]
                left, right = w[:-reach][same], w[reach:][same]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIM + place[b, k], sign[b, k], BUCKETS * DIM)
        m = total.reshape(BUCKETS, DIM).astype(np.int64)
        k = np.flatnonzero(m.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *[pa.array(m[k, i]) for i in range(DIM)]], ["slot", *[f"v{i}" for i in range(DIM)]])

    schema = "slot int, " + ", ".join(f"v{i} long" for i in range(DIM))
    sums = docs.select("text").mapInArrow(gather, schema).groupBy("slot").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    for r in sums.collect():  # at most BUCKETS rows
        out[r[0]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray, ids: Hashes) -> np.ndarray:
    """Mean, spread and mean adjacent product of the word vectors of each whole text, ``POOL_WORDS`` words at a time."""
    w, begin = _words(texts, ids)
    n = np.diff(begin)
    sums = np.zeros((3, len(texts), DIM))
    inner = begin[1:-1]
    for lo in range(0, len(w), POOL_WORDS):
        hi = min(len(w), lo + POOL_WORDS)
        at = np.unique(np.concatenate([[lo], inner[(inner > lo) & (inner < hi)]]))
        doc = np.searchsorted(begin, at, "right") - 1
        v = vectors[w[lo:hi + 1]]
        here = v[:hi - lo]
        sums[0, doc] += np.add.reduceat(here, at - lo)
        sums[1, doc] += np.add.reduceat(here * here, at - lo)
        beside = np.zeros_like(here)
        beside[:len(v) - 1] = v[:-1] * v[1:]
        last = begin[1:][(begin[1:] > lo) & (begin[1:] <= hi)] - 1 - lo
        beside[last] = 0  # no product across two texts
        sums[2, doc] += np.add.reduceat(beside, at - lo)
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    some = np.flatnonzero(n)
    m = n[some][:, None]
    mean = sums[0, some] / m
    out[some, :DIM] = mean
    out[some, DIM:2 * DIM] = np.sqrt(np.maximum(sums[1, some] / m - mean * mean, 0))
    out[some, 2 * DIM:] = sums[2, some] / np.maximum(m - 1, 1)
    return out


class Network:
    """Two layers (ReLU, one logit) on standardised inputs, fitted with Adam; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        order = rng.permutation(len(x))
        rest, held = order[len(x) // 5:], order[:len(x) // 5]
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, s, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(rest)
            for i in range(0, len(order), BATCH):
                k, t = order[i:i + BATCH], t + 1
                h = np.maximum(z[k] @ self.p[0] + self.p[1], 0)
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[k]) / len(k)
                back = np.outer(d, self.p[2]) * (h > 0)
                for j, g in enumerate((z[k].T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                    g = g + DECAY * self.p[j]
                    m[j], s[j] = 0.9 * m[j] + 0.1 * g, 0.999 * s[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - RATE * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(s[j] / (1 - 0.999 ** t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            logit, choices = self.logit(x[held]), np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, logit / c) - y[held] * logit / c) for c in choices]
            self.temperature = float(choices[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -50, 50)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def usable_labels(labels: DataFrame) -> DataFrame:
    """One quality label per doc_id outside the held-out fold."""
    return (labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
            .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
            .where("label = other").select("doc_id", "label"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted``, one row per input row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def features(batches):
        ids = Hashes(BUCKETS - 1)
        for b, texts in text_slices(batches, "text"):
            x = pool(texts, vectors.value, ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 3 * DIM).cast(pa.list_(pa.float32()))],
                                             ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pooled = checkpoint(docs.mapInArrow(features, f"doc_id {kind}, x array<float>"), "quality-pooled")
    taught = usable_labels(labels)
    share = min(1.0, FIT_ROWS / max(1, taught.count()))
    few = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # one row per doc_id, and the same rows in every run
    one = pooled.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min_by("x", F.struct(F.xxhash64("x"), "x")).alias("x"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS + FIT_ROWS // 10).collect()
    net = None
    if rows:
        rows.sort(key=lambda r: (r.doc_id, r.x))
        net = spark.sparkContext.broadcast(Network(np.array([r.x for r in rows], np.float64), np.array([r.label for r in rows], np.float64)))

    def score(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten(), np.float32).reshape(b.num_rows, -1)
                y = net.value(x) if net else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(y, pa.float64()), pa.array((y >= THRESHOLD).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    return (pooled.mapInArrow(score, f"doc_id {kind}, score double, predicted int")
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"))

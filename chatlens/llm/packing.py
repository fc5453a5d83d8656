"""Sequence packing into optimal length buckets with token-budget batches.

Documents are tokenised whole; those longer than ``MAX_LEN`` tokens are cut into consecutive pieces. The
global histogram of piece lengths (at most ``MAX_LEN`` rows) goes to the driver, where dynamic
programming picks the bucket boundaries that minimise the padding over all pieces. Inside a bucket
pieces are dealt over shards of a size that follows the input, numbered in a window per shard, and
shifted by the sizes of the shards before; ``BUDGET // boundary`` consecutive pieces form a batch. So
every batch but the last of a bucket is full and no bucket is gathered in one task.

Defined cases: null and empty texts give one piece of 0 tokens with null bucket, batch and place;
repeated rows are packed one by one; an empty table gives an empty result; other columns are ignored. Numbering follows a hash of
(doc_id, piece), ties broken by length; equal rows may swap places, which changes nothing.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint, text_slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_LEN = 2048
BUCKETS = 8
BUDGET = 65_536  # tokens of a batch, padding included
SHARD_ROWS, MAX_SHARDS = 64, 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TokenCounter:
    """Token counts of whole texts. Pieces that start at a space are counted once and kept.

    A space followed by a non-space always begins a pre-token, so without double spaces a text is
    the sum of its pieces; other texts are encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        import tiktoken
        self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

        class Known(dict):
            def __missing__(known, piece):
                if len(known) >= self.most:
                    known.clear()
                known[piece] = n = len(self.encode(" " + piece))
                return n

        self.known = Known()

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return (len(self.encode(first)) if first else 0) + sum(map(self.known.__getitem__, rest))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Return ``doc_id, n_tokens`` for every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        counter = TokenCounter(ranks.value)
        for b, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter.count(t.decode()) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (at most ``buckets``) that minimise the padding of a histogram; exact dynamic programming."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), np.concatenate([[0], np.cumsum(counts[order])]).astype(np.float64)
    m = len(x)
    best = np.concatenate([[0.0], x * c[1:]])  # padded tokens of the first j lengths in one bucket
    back: list[np.ndarray] = []
    for _ in range(min(buckets, m) - 1):
        new, came = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (c[j] - c[:j])
            k = int(cost.argmin())
            if cost[k] < new[j]:
                new[j], came[j] = cost[k], k
        back.append(came)
        best = new
    out, j = [], m
    for came in reversed(back):
        if j and came[j] >= 0:
            out.append(int(x[j - 1]))
            j = int(came[j])
    return sorted({*out, *([int(x[j - 1])] if j else [])})


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Return ``doc_id, piece, first_token, n_tokens, bucket, padded, batch, place``, one row per piece.

    ``bucket`` is the bucket's upper bound in tokens, ``batch`` counts from 0 in each bucket and
    ``place`` is the row of the piece in its batch.
    """
    spark = docs.sparkSession
    n = F.col("n_tokens")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / max_len), F.lit(0).cast("long")))
    pieces = checkpoint(token_counts(docs, tokenizer).withColumn("piece", F.explode(cut))
                        .select("doc_id", "piece", (F.col("piece") * max_len).alias("first_token"),
                                F.least(n - F.col("piece") * max_len, F.lit(max_len).cast("long")).alias("n_tokens")), "packing-pieces")
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most max_len rows
    empty = pieces.where("n_tokens = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "padded", "batch", "place")])
    if not histogram:
        return empty
    lengths, counts = (np.array([r[i] for r in histogram]) for i in (0, 1))
    bounds = optimal_boundaries(lengths, counts, buckets)
    sizes = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([0, *bounds], bounds)]
    rows = max(SHARD_ROWS, -(-sum(sizes) // MAX_SHARDS))
    plan = spark.createDataFrame(pa.table({"bucket": pa.array(bounds, pa.int64()), "shards": pa.array([max(1, s // rows) for s in sizes], pa.int64()),
                                           "room": pa.array([max(1, budget // b) for b in bounds], pa.int64())}))  # from Arrow: starts no Python worker
    bucket = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")), 1)
    dealt = (pieces.where("n_tokens > 0").withColumn("bucket", bucket).join(F.broadcast(plan), "bucket")
             .withColumn("key", F.xxhash64("doc_id", "piece")).withColumn("shard", F.pmod(F.xxhash64("key", "n_tokens"), "shards")))
    in_shard = Window.partitionBy("bucket", "shard").orderBy("key", "doc_id", "piece", "n_tokens")
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = (dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))  # at most MAX_SHARDS rows and a few
             .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    at = F.col("start") + F.col("number") - 1
    return (dealt.withColumn("number", F.row_number().over(in_shard)).join(F.broadcast(start), ["bucket", "shard"])
            .select("doc_id", "piece", "first_token", "n_tokens", "bucket", F.col("bucket").alias("padded"), F.floor(at / F.col("room")).alias("batch"),
                    (at % F.col("room")).alias("place")).unionByName(empty))

"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Equal vectors form a class; the graph is over classes. It starts from brute force inside small blocks (``BLOCK`` nodes) of a few random
projections, dealt out in one pass, and is improved by joins of neighbours of neighbours until a round changes hardly any edge (``CHANGED``): every node hands its
neighbours (its own and those that point to it) to one another, and each keeps its ``K`` best. Edges are flagged: only pairs with an edge that the round before
brought are compared, nodes without such an edge take no part, and a pair is passed on only if it beats the worst edge that its node has. So the work falls from round to round.
Searches start at the query's own graph neighbours and expand the best nodes of a beam until no unexpanded node is left in it. Candidates of a
query are scored again in double precision on the original vectors, scaled by a power of two (which changes no digit) so that no square overflows.

``REVERSE`` bounds the pointing nodes that take part in one join (best first among new and old ones, as in the published algorithm); it bounds work, not
results: the forward lists keep all of them reachable. Recall against brute force is tested (0.9 or more).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, rows without a vec_id, and vectors
whose length is not the most common one take no part; repeated vec_ids with equal vectors count once, and of those with different vectors
the smallest vector counts; fewer candidates than asked for are all returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint

K, REVERSE = 32, 16  # graph degree; pointing nodes that join
TREES, BLOCK = 8, 4 * K  # starting projections, nodes of a block
BEAM, EXPAND = 96, 24
CHANGED = 0.001  # the graph is done when a round changes at most this share of its edges
GIVE = 6  # candidates that a node gets from one local join


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) with double vectors that take part, one per vec_id."""
    v = F.col(vec_col).cast("array<double>")
    limit = float(np.finfo(np.float64).max)
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > limit)) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(good)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (top.d if top else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _scaled(v: str) -> Column:
    """The vector times the power of two that brings its largest component near one."""
    power = F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x))))).cast("double"))
    return F.transform(v, lambda x: x * power)


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _halves(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary half-precision vectors."""
    h = np.ascontiguousarray(x, np.float16)
    return pa.array([r.tobytes() for r in h], pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    d = len(column[0].as_buffer()) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, d).astype(np.float32)


def whole_groups(batches, key: str):
    """Tables of sorted batches cut so that no group of equal keys spans two."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        k = np.asarray(t.column(key))
        cut = int(np.searchsorted(k, k[-1]))
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def best_per_key(key: np.ndarray, other: np.ndarray, s: np.ndarray, k: int, last: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k largest s per key over distinct others, ties to the smaller other; of equal pairs the row with the smallest ``last`` stays."""
    by = np.lexsort((-s, np.zeros(len(s)) if last is None else last, other, key))
    first = np.ones(len(by), bool)
    first[1:] = (key[by][1:] != key[by][:-1]) | (other[by][1:] != other[by][:-1])
    by = by[first]
    by = by[np.lexsort((other[by], -s[by], key[by]))]
    start = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])) if len(by) else np.zeros(0, int)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[rank < k]


EDGE = "u long, v long, s float, fresh boolean"


def _edges(u, v, s, fresh=None) -> pa.RecordBatch:
    fresh = np.ones(len(u), bool) if fresh is None else fresh
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32()), pa.array(fresh, pa.bool_())], ["u", "v", "s", "fresh"])


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of every u, first inside the tasks, then after one shuffle; an edge known before stays as it was."""
    def part(batches):
        for b in batches:
            if b.num_rows:
                u, v, s, fresh = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "s", "fresh"))
                take = best_per_key(u, v, s, k, fresh)
                yield _edges(u[take], v[take], s[take], fresh[take])

    def whole(batches):
        for t in whole_groups(batches, "u"):
            yield from part(t.to_batches())

    return edges.mapInArrow(part, EDGE).repartition("u").sortWithinPartitions("u").mapInArrow(whole, EDGE)


def start_graph(nodes: DataFrame, n: int) -> DataFrame:
    """Edges from brute force inside blocks: sign patterns of ``TREES`` random projections, large ones dealt into parts by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))

    def sign(batches):
        planes = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"))
                if planes is None:
                    planes = np.random.default_rng(1).normal(size=(x.shape[1], TREES, max(1, bits))).astype(np.float32)
                above = np.einsum("nd,dtb->ntb", x, planes) > 0
                code = (above @ (1 << np.arange(bits))) if bits else np.zeros((len(x), TREES), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(code.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["id", "vec", "codes"])

    coded = nodes.mapInArrow(sign, "id long, vec binary, codes array<long>").select("id", "vec", F.posexplode("codes").alias("tree", "code"))
    sizes = coded.groupBy("tree", "code").agg(F.count("*").alias("n"))  # at most TREES * 2 * n / BLOCK rows of three numbers
    parts = F.ceil(F.col("n") / (2 * BLOCK)).cast("long")
    blocks = (coded.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), parts))
              .select(F.xxhash64("tree", "code", "part").alias("block"), "id", "vec"))

    def brute(batches):
        for t in whole_groups(batches, "block"):
            key, ids = np.asarray(t.column("block")), np.asarray(t.column("id"))
            x = _matrix(t.column("vec").combine_chunks())
            begin = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
            for a, e in zip(begin, begin[1:]):
                for lo in range(a, e, 1024):  # rows against their block, a bounded matrix at a time
                    hi = min(e, lo + 1024)
                    s = x[lo:hi] @ x[a:e].T
                    s[np.arange(hi - lo), np.arange(lo - a, hi - a)] = -2
                    k = min(K, e - a - 1)
                    if k > 0:
                        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        yield _edges(np.repeat(ids[lo:hi], k), ids[a:e][top].ravel(), np.take_along_axis(s, top, 1).ravel())

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(brute, EDGE)


def improve(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: the neighbours of each node that has a new edge, both ways, meet where one of the two is new; all keep their best K."""
    low = graph.groupBy("u").agg(F.when(F.count("*") >= K, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("low"))
    known = nodes.join(low.withColumnRenamed("u", "id"), "id", "left").select(F.col("id").alias("v"), "vec", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))
    best = Window.partitionBy("u", "fresh").orderBy(F.desc("s"), "v")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh").withColumn("k", F.row_number().over(best)).where(F.col("k") <= REVERSE)
    meet = graph.select("u", "v", "fresh").unionByName(back.select("u", "v", "fresh")).unionByName(nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(False).alias("fresh")))
    active = graph.where("fresh").select(F.explode(F.array("u", "v")).alias("u")).distinct()
    meet = meet.join(active, "u", "left_semi").join(known, "v").select("u", "v", "fresh", "low", "vec")

    def local_join(batches):
        for t in whole_groups(batches, "u"):
            u, v, fresh, low = (t.column(c).to_numpy() for c in ("u", "v", "fresh", "low"))
            x = _matrix(t.column("vec").combine_chunks())
            begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            size = np.diff(np.append(begin, len(u)))
            for lo in range(0, len(begin), 256):
                b, n = begin[lo:lo + 256], size[lo:lo + 256]
                width = int(n.max())
                at = np.minimum(b[:, None] + np.arange(width), len(u) - 1)
                real = np.arange(width) < n[:, None]
                y, ids, new = x[at], v[at], fresh[at] & real
                s = y @ y.transpose(0, 2, 1)
                ok = (new[:, :, None] | new[:, None, :]) & real[:, None, :] & real[:, :, None] & (ids[:, :, None] != ids[:, None, :]) & (s > low[at][:, :, None])
                s[~ok] = -3
                k = min(GIVE, width - 1)
                if k < 1:
                    continue
                top = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                val = np.take_along_axis(s, top, 2)
                good = val > -2.5
                to = np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), top, 2)
                a, c, d = np.broadcast_to(ids[:, :, None], top.shape)[good], to[good], val[good]
                if len(a):
                    take = best_per_key(a, c, d, K)
                    yield _edges(a[take], c[take], d[take])

    found = meet.repartition("u").sortWithinPartitions("u").mapInArrow(local_join, EDGE)
    return _keep_best(graph.withColumn("fresh", F.lit(False)).unionByName(found), K)


OPEN, DONE = 1, 2  # states of a beam's nodes: in turn to be expanded, expanded; 0 is neither
BEAM_ROW = "q long, v long, s float, state int"


def _beam(q, v, s, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32()), pa.array(state, pa.int32())], ["q", "v", "s", "state"])


def greedy_search(graph: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Best classes (q, v, s) of every query node, q itself among them, by expanding a beam."""
    links = checkpoint(graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))), "neighbours-links")
    queries = checkpoint(starts.join(nodes, starts["q"] == nodes["id"]).select("q", F.col("vec").alias("qvec")), "neighbours-queries")
    beam = checkpoint(starts.select("q", F.col("q").alias("v"), F.lit(1.0).cast("float").alias("s"), F.lit(OPEN).alias("state")), "neighbours-beam")

    def score(batches):
        for b in batches:
            if b.num_rows:
                s = (_matrix(b.column("vec")) * _matrix(b.column("qvec"))).sum(1)
                q, v = np.asarray(b.column("q")), np.asarray(b.column("v"))
                take = best_per_key(q, v, s, BEAM)  # no more can enter the beam
                yield _beam(q[take], v[take], s[take], np.zeros(len(take)))

    def narrow(batches):
        for t in whole_groups(batches, "q"):
            q, v, s, state = (np.asarray(t.column(c)) for c in ("q", "v", "s", "state"))
            take = best_per_key(q, v, s, BEAM, -state)  # of repeated rows the expanded one stays
            q, v, s, state = q[take], v[take], s[take], np.where(state[take] == OPEN, DONE, state[take])
            waiting = np.flatnonzero(state == 0)
            state[waiting[best_per_key(q[waiting], v[waiting], s[waiting], EXPAND)]] = OPEN
            yield _beam(q, v, s, state)

    while True:  # the beam only gets better, and a node that left it can't come back
        open_ = beam.where(F.col("state") == OPEN).select("q", "v")
        if open_.isEmpty():
            break
        reached = open_.join(links.withColumnRenamed("v", "x"), F.col("v") == F.col("u")).select("q", F.col("x").alias("v"))
        scored = reached.join(nodes.withColumnRenamed("id", "v"), "v").join(queries, "q").select("q", "v", "vec", "qvec").mapInArrow(score, BEAM_ROW)
        beam = checkpoint(beam.unionByName(scored).repartition("q").sortWithinPartitions("q").mapInArrow(narrow, BEAM_ROW), "neighbours-beam")
    return beam.select("q", "v", "s")


def build_graph(nodes: DataFrame, n: int) -> DataFrame:
    graph = checkpoint(_keep_best(start_graph(nodes, n), K), "neighbours-graph")
    while True:  # edges only get better
        graph = checkpoint(improve(graph, nodes), "neighbours-graph")
        if graph.where("fresh").count() <= CHANGED * graph.count():
            return graph


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: the k nearest found of every row of ``queries(query_id)`` among all others."""
    vectors = checkpoint(usable_vectors(rows).withColumn("h", F.xxhash64("v")), "neighbours-vectors")
    reps = checkpoint(vectors.groupBy("h", "v").agg(F.min("vec_id").alias("id")), "neighbours-classes")

    def unit(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), _halves(_unit(b.column("v")))], ["id", "vec"])

    nodes = checkpoint(reps.select("id", "v").mapInArrow(unit, "id long, vec binary"), "neighbours-nodes")
    n = nodes.count()
    graph = build_graph(nodes, n)
    named = checkpoint(vectors.join(reps.select("h", F.col("v").alias("w"), "id"), "h").where("v = w").select("vec_id", "id"), "neighbours-named")
    asked = checkpoint(queries.select(F.col("query_id").cast("long").alias("vec_id")).distinct().join(named, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")),
                       "neighbours-asked")
    found = checkpoint(greedy_search(graph, nodes, asked.select("q").distinct()), "neighbours-found")
    # the smallest k + 1 vec_ids stand for a class: more of them can't be among k nearest
    few = named.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("i") <= k + 1).select("id", "vec_id")
    exact = reps.select("id", _scaled("v").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = (found.select("q", F.col("v").alias("id")).join(exact, "id").join(exact.select(F.col("id").alias("q"), F.col("y").alias("x")), "q")
             .select("q", "id", (dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))).alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    pairs = checkpoint(pairs.withColumn("i", F.row_number().over(best)).where(F.col("i") <= 2 * k + 2).drop("i"), "neighbours-pairs")
    near = (asked.join(pairs, "q").join(few, "id").where("vec_id != query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

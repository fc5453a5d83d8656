"""Exact similarity join of documents on word shingles, with filters from several token orders.

A document's set: its distinct five-word shingles (64-bit hashes). If two sets have a
Jaccard similarity of 3/4 or more, then under *every* global order of the tokens their prefixes
(the first n - ceil(3n/4) + 1 tokens) share a token. So:

1. Equal sets form a class; everything later runs on classes, named by their hash.
2. Order A puts tokens by how full their counting slot is over the whole corpus (rare first), then by hash. Classes
   that share a prefix token under A meet after one shuffle by token, in sorted runs.
3. Orders B and C are two other hash orders. A pair stays a candidate only if the sizes allow the threshold and its
   prefixes under B, and then under C, share tokens too. Under A the place of the shared token must also leave
   enough tokens behind it on both sides.
4. The sets of the remaining pairs are intersected exactly; sets are only built and moved for pairs that B has left.

Groups of copies never become all pairs. Each token's classes are first compared with the token's
leader (the first class in one of a few orders); links found are contracted to components; only tokens whose classes still
lie in several components give further pairs, and only across components. No link that
joins two components can be missed, so components are exact. Tokens with very full slots
are salted: each salt has a leader, and all are compared with one leader of the token too.

Defined cases: texts with fewer than five words have the whole sequence as one shingle; null texts and texts
without words have an empty set and link with nothing. Rows of one doc_id with the same set
give one row; rows of one doc_id with different sets give one row each, and all of them the
doc_id's smallest component. Null doc_ids are their own component (null). Other columns are ignored. The probability that two different sets share
their 64-bit hash and their size is below 1e-6 for 30 million documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chatlens.llm.base import Hashes, checkpoint, give_back_memory, id_bitmap, maybe_in, mix, text_slices, without_ids
from chatlens.llm.components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # threshold 3/4
LEADERS = 8  # orders that pick a token's leader
SLOT_BITS = 22  # of a token: its counting slot in order A
SLOTS = 1 << SLOT_BITS  # 16 MB broadcast, whatever the input
HOT = 1000  # occurrences above the mean slot from which a token is salted, one salt for each so many
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
ORDER_B, ORDER_C = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)


def shingle_set(text: bytes, words: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (A-Z lower-cased, ASCII white space)."""
    w = words.of(text.lower().split())
    n = len(w)
    if not n:
        return w
    if n < WORDS:
        return mix((w * WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n))
    h = w[: n - WORDS + 1] * WEIGHTS[0]
    for k in range(1, WORDS):
        h = h + w[k:n - WORDS + 1 + k] * WEIGHTS[k]
    return np.unique(mix(h))


def set_hash(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def prefix(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Prefix of a sorted set, in ascending order; equal order values go by token, so the order is total."""
    return s[np.argsort(order, kind="stable")[:prefix_size(len(s))]]


def shingle_classes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, class, n, b: prefix under order B) and the occurrences in each counting slot, in one scan of the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        words, slots = Hashes(), np.zeros(SLOTS, np.int32)  # occurrences in one task
        for b, texts in text_slices(batches, "text"):
            sets = [shingle_set(t, words) for t in texts]
            slot, n = np.unique((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
            slots[slot] += n.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([low_words(s, ORDER_B) for s in sets], pa.list_(pa.int32())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.list_(pa.int32()))], names)
        wide = slots.reshape(-1, 256)
        block = np.flatnonzero(wide.any(1))
        wide = wide[block]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(wide), pa_kind), pa.nulls(len(wide), pa.int64()), pa.nulls(len(wide), pa.int64()), pa.nulls(len(wide), pa.list_(pa.int32())),
                                          pa.array(block.astype(np.int32)), pa.array(list(wide), pa.list_(pa.int32()))], names)
        del words, slots, wide
        give_back_memory()

    from pyspark.sql.pandas.types import to_arrow_type
    pa_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "class", "n", "b", "block", "slots"]
    both = checkpoint(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                      .mapInArrow(scan, f"doc_id {kind}, class long, n long, b array<int>, block int, slots array<int>"), "jaccard-classes")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("slots")):
                v = np.asarray(v.values, np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "slots"])

    counts = np.zeros((SLOTS // 256, 256), np.int64)
    blocks = both.where("block is not null").select("block", "slots").mapInArrow(add, "block int, slots array<long>")
    for r in blocks.repartition(64, "block").mapInArrow(add, "block int, slots array<long>").toLocalIterator():
        counts[r.block] += np.array(r.slots)
    return both.where("block is null").select("doc_id", "class", "n", "b"), counts.ravel()


def _leader_order(column: str, n: str, rest: str):
    """One of ``LEADERS`` orders of classes, by token: fewest tokens before this one first, or a hash order.

    Rare tokens come first under order A, so a near copy with few tokens before a shared one has few words of its own: it is near
    the middle of its group, and similar to the most others. The hash orders give other leaders.
    """
    kind = F.pmod("token", F.lit(LEADERS))
    return F.when(kind < LEADERS // 2, (F.col(n) - F.col(rest)).cast("long")).otherwise(F.xxhash64(column, kind))


def shared_tokens(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Rows (token, salt, class, n, rest, leader, leader_n, leader_rest) for prefix tokens under order A that several classes have.

    ``rest`` is how many tokens of the set stand at or after this one under order A.
    """
    spark = docs.sparkSession
    full = spark.sparkContext.broadcast(np.minimum(slots, (1 << 31) - 1).astype(np.int32))
    step = max(HOT, int(6 * slots.mean() ** 0.5))
    hot_from = int(slots.mean()) + step

    def emit(batches):
        words, seen = Hashes(), set()
        for _, texts in text_slices(batches, "text"):
            tokens, owners, sizes, rests = [], [], [], []
            for t in texts:
                s = shingle_set(t, words)
                if not len(s):
                    continue
                c = set_hash(s)
                if (c, len(s)) in seen:  # copies in this task count once
                    continue
                seen.add((c, len(s)))
                slot = full.value[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                # slot counts above the hash bits: below 2**24 they order exactly, above they tie
                order = (np.minimum(slot, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (mix(s) >> np.uint64(24))
                p = prefix(s, order)
                tokens.append(p)
                owners.append(np.full(len(p), c, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
                rests.append(np.arange(len(s), len(s) - len(p), -1, dtype=np.int32))
            if tokens:
                token, owner = np.concatenate(tokens), np.concatenate(owners)
                over = full.value[(token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64) - hot_from
                salts = np.where(over > 0, 2 + over // step, 1)
                salt = np.where(salts > 1, 1 + (owner & 0x7FFFFFFF) % salts, 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(owner),
                                                  pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rests))], ["token", "salt", "class", "n", "rest"])
        del words, seen
        give_back_memory()

    def runs(batches):
        """Rows sorted by (token, salt, leader order): keep runs of several classes and all salted ones, with the run's first class.

        Of a run that may go on in the next batch, only its first and last row are held.
        """
        held, skip = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            a = [b.column(k).to_numpy(zero_copy_only=False) for k in ("token", "salt", "n", "class", "rest")]
            if held is not None:
                a = [np.concatenate(x) for x in zip(held, a)]
            new = np.ones(len(a[0]), bool)  # rows that copies have repeated
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in a])
            a = [x[new] for x in a]
            last = len(a[0]) - 1
            while last and a[0][last - 1] == a[0][last] and a[1][last - 1] == a[1][last]:
                last -= 1
            several = len(a[0]) - last > 1
            yield from kept(a, skip, len(a[0]) if several else last)
            held, skip = ([x[[last, -1]] for x in a], 2) if several else ([x[last:] for x in a], 0)
        if held is not None and not skip:
            yield from kept(held, 0, 1)

    def kept(a, begin, end):
        start = np.ones(len(a[0]), bool)
        start[1:] = (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1])
        first, run = np.flatnonzero(start), np.cumsum(start) - 1
        keep = (np.diff(np.append(first, len(start)))[run] > 1) | (a[1] > 0)
        keep[:begin] = False
        keep[end:] = False
        if keep.any():
            at = first[run][keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[0][keep], a[1][keep], a[3][keep], a[2][keep], a[4][keep], a[3][at], a[2][at], a[4][at])],
                                             ["token", "salt", "class", "n", "rest", "leader", "leader_n", "leader_rest"])

    postings = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "token long, salt int, class long, n int, rest int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (postings.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", _leader_order("class", "n", "rest"), "n", "class")
           .mapInArrow(runs, "token long, salt int, class long, n int, rest int, leader long, leader_n int, leader_rest int"))
    return checkpoint(met, "jaccard-tokens")


def low_words(s: np.ndarray, order: np.uint64) -> np.ndarray:
    """Prefix of a set under a hash order, as 32-bit words (equal tokens give equal words, so no shared token is missed)."""
    return (mix(prefix(s, mix(s ^ order))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _may_reach():
    """Whether sets x and y that share a token can reach the threshold.

    If it is their first common token under order A, they have at most the smaller ``rest`` in common. At any later common token
    ``rest`` is smaller, so a pair that can reach the threshold passes at its first one. Sizes that do not fit fail too.
    """
    return F.least("x_rest", "y_rest") * (DENOMINATOR + NUMERATOR) >= (F.col("x_n") + F.col("y_n")) * NUMERATOR


def class_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows (class, n, tokens, c): the sets of the needed classes and their prefixes under order C.

    ``needed`` has doc_id, class, n (one document per class). A bitmap lets other documents pass unread. The sets lie in the shuffle by class and
    are not written besides: both sides of the pairs read that shuffle.
    """
    bitmap = id_bitmap(needed, "doc_id")

    def build(batches):
        words, seen = Hashes(), set()
        for _, texts in text_slices(batches, "text"):
            sets = {}
            for t in texts:
                s = shingle_set(t, words)
                key = (set_hash(s), len(s)) if len(s) else None
                if key and key not in seen:
                    seen.add(key)
                    sets[key] = s
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in sets], pa.int64()), pa.array([k[1] for k in sets], pa.int32()),
                     pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64())),
                     pa.array([low_words(s, ORDER_C) for s in sets.values()], pa.list_(pa.int32()))], ["class", "n", "tokens", "c"])
        del words, seen
        give_back_memory()

    sets = maybe_in(docs, bitmap, "doc_id").select(F.col("text").cast("string").alias("text")).mapInArrow(build, "class long, n int, tokens array<long>, c array<int>")
    wanted = needed.select("class", F.col("n").cast("int").alias("n"))
    return sets.join(wanted, ["class", "n"], "left_semi").dropDuplicates(["class", "n"])


def verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (x, x_n, y, y_n) whose prefixes meet under B and under C and whose sets reach the threshold.

    Sets are only built and moved for classes of pairs that order B has left.
    """
    def side(rows: DataFrame, k: str, *columns: str) -> DataFrame:
        return rows.select(F.col("class").alias(k), F.col("n").alias(f"{k}_n"), *[F.col(c).alias(f"{k}_{c}") for c in columns])

    key_x, key_y = ["x", "x_n"], ["y", "y_n"]
    near = checkpoint(pairs.join(side(prefixes, "x", "b"), key_x).join(side(prefixes, "y", "b"), key_y)
                      .where(F.arrays_overlap("x_b", "y_b")).select(*key_x, *key_y), "jaccard-near")
    both_sides = near.select(F.col("x").alias("class"), F.col("x_n").alias("n")).unionByName(near.select(F.col("y").alias("class"), F.col("y_n").alias("n")))
    sets = class_sets(docs, checkpoint(both_sides.distinct().join(named, ["class", "n"]).select("doc_id", "class", "n"), "jaccard-needed"))
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return (near.join(side(sets, "x", "tokens", "c"), key_x).join(side(sets, "y", "tokens", "c"), key_y).where(F.arrays_overlap("x_c", "y_c"))
            .where(common * (DENOMINATOR + NUMERATOR) >= (F.col("x_n") + F.col("y_n")) * NUMERATOR).select(*key_x, *key_y))


def similar_documents(docs: DataFrame) -> DataFrame:
    """Return ``doc_id, n_shingles, class_id, component_id``; class_id is the smallest doc_id with an equal set."""
    classes, slots = shingle_classes(docs)
    members = classes.where("doc_id is not null and n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("rep"))
    members = checkpoint(members, "jaccard-members")
    tokens = shared_tokens(docs, slots)
    named = (tokens.select("class", "n").unionByName(tokens.select(F.col("leader").alias("class"), F.col("leader_n").alias("n"))).distinct()
             .join(members, ["class", "n"]).select(F.col("rep").alias("doc_id"), "class", "n"))
    named = checkpoint(named, "jaccard-named")
    prefixes = classes.join(named.select("doc_id", "class", "n"), ["doc_id", "class", "n"], "left_semi")
    prefixes = checkpoint(prefixes.dropDuplicates(["class", "n"]).select("class", F.col("n").cast("int").alias("n"), "b"), "jaccard-prefixes")

    # every class with its run's leader, and those of salted tokens also with one leader of the token
    x = [F.col("class").alias("x"), F.col("n").alias("x_n"), F.col("rest").alias("x_rest")]
    first = tokens.select(*x, F.col("leader").alias("y"), F.col("leader_n").alias("y_n"), F.col("leader_rest").alias("y_rest"))
    salted = tokens.where("salt > 0")
    top = salted.groupBy("token").agg(F.min_by(F.struct("leader_n", "leader", "leader_rest"), F.struct(_leader_order("leader", "leader_n", "leader_rest"), "leader_n", "leader")).alias("top"))
    second = (salted.join(checkpoint(top, "jaccard-top"), "token")
              .select(*x, F.col("top.leader").alias("y"), F.col("top.leader_n").alias("y_n"), F.col("top.leader_rest").alias("y_rest")))
    star = (first.unionByName(second).where(_may_reach() & ((F.col("x") != F.col("y")) | (F.col("x_n") != F.col("y_n"))))
            .select("x", "x_n", "y", "y_n").distinct())
    star = checkpoint(star, "jaccard-star")
    links = checkpoint(verified(star, prefixes, docs, named), "jaccard-links")

    reps = named.select("class", F.col("n").cast("int").alias("n"), F.col("doc_id").alias("rep"))

    def as_edges(pairs: DataFrame) -> DataFrame:
        x = reps.select(F.col("class").alias("x"), F.col("n").alias("x_n"), F.col("rep").alias("u"))
        y = reps.select(F.col("class").alias("y"), F.col("n").alias("y_n"), F.col("rep").alias("v"))
        return pairs.join(x, ["x", "x_n"]).join(y, ["y", "y_n"]).select("u", "v")

    edges = as_edges(links)
    near = components(edges)
    # tokens whose classes still lie in several components
    part = (reps.join(near.withColumnRenamed("node", "rep"), "rep", "left")
            .select("class", "n", "rep", F.coalesce("component", "rep").alias("part")))
    placed = checkpoint(tokens.select("token", "class", "n", "rest").join(part, ["class", "n"]), "jaccard-placed")
    split = placed.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("token")
    open_ = placed.join(split, "token", "left_semi")
    x = open_.select("token", F.col("class").alias("x"), F.col("n").alias("x_n"), F.col("rest").alias("x_rest"), F.col("part").alias("x_part"))
    y = open_.select("token", F.col("class").alias("y"), F.col("n").alias("y_n"), F.col("rest").alias("y_rest"), F.col("part").alias("y_part"))
    across = x.join(y, "token").where((F.col("x_part") < F.col("y_part")) & _may_reach()).select("x", "x_n", "y", "y_n").distinct()
    more = as_edges(checkpoint(verified(across.join(star, ["x", "x_n", "y", "y_n"], "left_anti"), prefixes, docs, named), "jaccard-links"))
    rows = checkpoint(classes.select("doc_id", "class", "n").distinct().join(members, ["class", "n"], "left"), "jaccard-rows")
    repeated = rows.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v != w").select("doc_id", "v")
    same_id = rows.join(repeated, "doc_id").select(F.col("rep").alias("u"), "v").where("u is not null")
    whole = components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(same_id))
    named_id = F.col("doc_id").isNotNull()
    return (rows.join(whole.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(named_id, F.coalesce("rep", "doc_id")).alias("class_id"),
                    F.when(named_id, F.coalesce("component", "rep", "doc_id")).alias("component_id")))


def with_sets(docs: DataFrame) -> DataFrame:
    """Documents with their class and size of set as ``_class`` and ``_n``."""
    def scan(batches):
        words = Hashes()
        for b, texts in text_slices(batches, "text"):
            sets = [shingle_set(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                                             [*b.schema.names, "_class", "_n"])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField("_class", LongType()), StructField("_n", LongType())]))


def first_rows(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the smallest text that is not null, then the smallest other columns."""
    order = F.struct(F.col("text").isNull().alias("_none"), "text", *[c for c in columns if c != "text"])
    return rows.groupBy(*keys).agg(F.min(order).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of the smallest doc_id of each component.

    Of rows that repeat a doc_id, that of ``first_rows`` stays; only ids that may be repeated go through a shuffle. Of rows without a doc_id
    one stays for each set of shingles that no row with a doc_id has; those with an empty set link with nothing and all stay.
    """
    found = checkpoint(similar_documents(docs).select("doc_id", "component_id"), "jaccard-found")
    kept = without_ids(docs, found.where("doc_id != component_id"), "doc_id")
    repeated = checkpoint(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "jaccard-repeated")
    bitmap = id_bitmap(repeated, "doc_id")
    named = F.col("doc_id").isNotNull()
    out = maybe_in(kept.where(named), bitmap, "doc_id", inside=False).unionByName(first_rows(maybe_in(kept, bitmap, "doc_id"), ["doc_id"], docs.columns))
    if docs.where(~named).isEmpty():
        return out
    nameless = checkpoint(with_sets(docs.where(~named)), "jaccard-nameless")
    taken = with_sets(docs.where(named).select("text")).select("_class", "_n").distinct()
    fresh = nameless.where("_n > 0").join(taken, ["_class", "_n"], "left_anti")
    return (out.unionByName(first_rows(fresh, ["_class", "_n"], docs.columns))
            .unionByName(nameless.where("_n = 0").select(*docs.columns)))

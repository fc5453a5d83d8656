"""Merkle manifest of a dataset: leaf, subtree root, root and proof of every row, from SQL functions alone.

A row's leaf hashes its fields, each as length and value. Leaves of one group (language) ascend by id and are numbered without a gap; every ``WIDTH``
neighbours have their joined digests hashed into a parent until one node remains, the group's subroot; subroots, ordered by group, form the last tree.

A row for each aligned block of ``WIDTH ** LEVELS`` nodes holds the block's digests as one hex string. Fixed-width substrings of a level are
hashed into the next level's string, so that ``LEVELS`` levels of a tree come from one grouping; the blocks' tops are the nodes of the next grouping, until each group
has one (``grow``). On the way back a node's siblings are the two substrings that flank it in its run, on every level of its block, followed by
those of the block's own top (``descend``). Blocks are aligned to powers of the width, so no run crosses a block.

Numbers come from one range exchange by group, id and leaf: the place in the sorted range minus the range's first place in the group plus the counts of the
group's earlier ranges. Rows equal in all of these are spread by where they lay, so copies can't fill one range; ranges grow in number with the rows.
Blocks are of bounded size, and only per-level maxima and the number of rows reach the driver.

Defined cases: a null field is hashed as ``-``; rows without an id come first in their group; rows that repeat an id are leaves of their own, in
order of their digests; null languages form a group of their own, before all others; an empty table gives an empty table; columns other than ``FIELDS`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 8  # nodes under a parent; the shifts below take three bits for a level
LEVELS = 3  # levels that one grouping builds
BLOCK = WIDTH ** LEVELS
RANGE_ROWS = 1 << 15  # rows of a range while leaves are numbered
DIGEST = 64  # hex digits of a digest
RUN = WIDTH * DIGEST


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as its UTF-8 length, a colon and the value; null as a hyphen."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row of ``FIELDS``, with some fields replaced."""
    return digest(F.concat(*(field(changed.get(f, F.col(f))) for f in FIELDS)))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in ``grp`` by ``order``, from 0) and ``total`` (rows of the group)."""
    rows = rows.withColumn("_spread", F.monotonically_increasing_id())
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = checkpoint(
        rows.repartitionByRange(parts, "grp", *order, "_spread").sortWithinPartitions("grp", *order, "_spread")
        .withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()).drop("_spread"), "merkle-ranged")
    counts = ranged.groupBy("grp", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    mine = Window.partitionBy("grp")
    earlier = F.sum("_n").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("grp", "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_n").over(mine).alias("total"))
    return ranged.join(starts, ["grp", "_part"]).withColumn("pos", F.col("_place") - F.col("_first") + F.col("_before")).drop("_part", "_place", "_first", "_before")


def _parents(level: str) -> str:
    """The next level's string: the digest of each fixed-width substring."""
    return (f"cast(array_join(transform(sequence(0, (octet_length({level}) - 1) div {RUN}), "
            f"r -> sha2(substring({level}, r * {RUN} + 1, {RUN}), 256)), '') as binary)")


def grow(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes ``grp, pos, total, node`` and the nodes of the next grouping.

    A block has ``levels``, the strings of its levels that have siblings, and ``members``, its nodes in order with their payload.
    """
    item = F.struct("pos", "node", *payload)
    blocks = (nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
              .agg(F.array_sort(F.collect_list(item)).alias("members"), F.max("total").alias("total")))
    blocks = blocks.withColumn("_l0", F.expr("cast(array_join(transform(members, m -> m.node), '') as binary)"))
    # A group's levels end where one node remains, so a group of few rows has fewer levels than its block could hold.
    for k in range(LEVELS):
        more = F.col("total") > WIDTH ** k
        blocks = blocks.withColumn(f"_l{k + 1}", F.when(more, F.expr(_parents(f"_l{k}"))).otherwise(F.col(f"_l{k}")))
    levels = F.filter(F.array(*(F.when(F.col("total") > WIDTH ** k, F.col(f"_l{k}")) for k in range(LEVELS))), lambda x: x.isNotNull())
    blocks = checkpoint(blocks.select("grp", "block", "total", "members", levels.alias("levels"), F.col(f"_l{LEVELS}").cast("string").alias("top")), "merkle-blocks")
    tops = blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("top").alias("node"))
    return blocks, tops


def grow_all(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every grouping, first to last, and the one node that remains of each group."""
    rounds, most = [], None
    while most is None or most > 1:
        blocks, nodes = grow(nodes, payload if not rounds else [])
        rounds.append(blocks)
        most = nodes.agg(F.max("total")).first()[0] or 0
    return rounds, nodes.select("grp", "node")


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Every node of ``blocks`` with ``siblings`` (left and right of it, level by level, then those that ``above`` has for its block).

    ``above``: ``grp, pos, siblings`` and any further columns, which the block's nodes take over.
    """
    flank = """transform(levels, (s, k) -> named_struct(
        'l', cast(substring(s, (shiftright(i, 3 * k) div 8) * {run} + 1, (shiftright(i, 3 * k) % 8) * {digest}) as string),
        'r', cast(substring(s, (shiftright(i, 3 * k) div 8) * {run} + (shiftright(i, 3 * k) % 8 + 1) * {digest} + 1, (7 - shiftright(i, 3 * k) % 8) * {digest}) as string)))"""
    members = F.expr(f"transform(members, (m, i) -> named_struct('m', m, 'near', {flank.format(run=RUN, digest=DIGEST)}))")
    kept = [c for c in above.columns if c not in ("grp", "pos", "node", "siblings")]
    joined = blocks.select("grp", "block", "levels", "members").join(above.withColumnRenamed("pos", "block"), ["grp", "block"])
    out = joined.select("grp", "siblings", *kept, F.inline(members))
    return out.select("grp", "m.*", F.concat("near", "siblings").alias("siblings"), *kept)


def fold(node: Column, siblings: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(siblings, node, lambda a, s: digest(F.concat(s["l"], a, s["r"])))


def proof(siblings: Column) -> Column:
    """All siblings' digests, level by level and from left to right, as one string."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(leaves: DataFrame) -> DataFrame:
    """Tree over ``grp, doc_id, leaf`` and payload: every row with ``subroot``, ``root`` and ``siblings array<struct<l,r>>``.

    ``grp`` is a string without nulls; groups are ordered bytewise.
    """
    payload = [c for c in leaves.columns if c != "grp"]
    nodes = numbered(leaves, ["doc_id", "leaf"]).withColumn("node", F.col("leaf"))
    rounds, subroots = grow_all(nodes, payload)
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    top_rounds, root = grow_all(tops, ["name"])
    above = root.select("grp", F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("siblings"), F.col("node").alias("root"))
    for blocks in reversed(top_rounds):
        above = descend(blocks, above)
    above = above.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "siblings", F.col("node").alias("subroot"), "root")
    for blocks in reversed(rounds):
        above = descend(blocks, above)
    return above.select(*payload, "subroot", "root", "siblings")


def language_group(lang: Column) -> Column:
    """A group's name, without nulls: null sorts before the empty string and all else, the rest bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def tampered(docs: DataFrame) -> Column:
    """Whether a row's text counts as tampered with: a third of the ids, by their checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def verify(docs: DataFrame) -> DataFrame:
    """Build the manifest of ``docs``, tamper with some texts and check every row against the root."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = leaf()
    leaves = checkpoint(docs.select(*FIELDS).select("doc_id", language_group(F.col("lang")).alias("grp"), whole.alias("leaf"),
                                                    F.when(tampered(docs), leaf(text=lower)).otherwise(whole).alias("found")), "merkle-leaves")
    tree = manifest(leaves)
    return (tree.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("siblings"))).alias("proof_sha256"),
                        fold(F.col("found"), F.col("siblings")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

"""Merkle manifest of a table: stored every few levels, proofs by computing the levels between again.

Rows are leaves. The leaves of one group (a source), in the order of their keys, are a tree: every ``fan`` consecutive nodes
make one node above, until one is left, the subroot. The subroots, in the order of their groups, are a tree again; what
is left there is the root.

Only every ``stride``-th level is stored, as blocks: one row holds the ``fan ** stride`` nodes of a level that lie under
one node of the next stored level, an aligned subtree. Building hashes a block up to that node and keeps nothing between.
A proof needs a node's siblings on all levels: the blocks of a stored level compute their inner nodes again, hand on
the siblings together with those that the block's own node got from above, and drop the inner nodes.

Positions come from ranges of (group, key): the table of digests, without texts, is cut by range, written, and numbered
within every pair of group and range, so a group with a third of all rows is spread like the others. A level of a
tree holds a ``fan ** stride``-th of the level below it; each task holds one block of bounded size at a time. Only the root,
the greatest number of nodes and the number of rows come to the driver.

A digest is lower-case hex of sha256; a leaf's input is, per value, ``-`` for null, else the number of its UTF-8 bytes,
``:`` and the value. Null keys come first, rows that repeat a key are ordered by their leaves; equal rows are leaves like any
other. The null group comes first, others follow by their UTF-8 bytes. An empty table has no root and gives no rows. Other columns
of the input are not read, so they cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import settle

# Rows in a range, about: the lesser bound for tables of up to 200 ranges, the greater beyond.
RANGE_ROWS = (20_000, 2_000_000)


@dataclass(frozen=True)
class Shape:
    fan: int = 16
    stride: int = 2  # levels from one stored level to the next

    @property
    def block(self) -> int:
        return self.fan**self.stride


@dataclass
class Levels:
    """Stored levels of many trees. ``blocks[i]``: (tree, block, size, nodes), where ``size`` counts the tree's nodes on that
    level; ``tops``: (tree, level, digest) with the stored level from whose blocks the tree's top is computed."""

    shape: Shape
    blocks: list[DataFrame]
    tops: DataFrame


@dataclass
class Manifest:
    groups: Levels
    whole: Levels
    root: str | None


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    texts = [value.cast("string") for value in values]
    return digest(F.concat(*[F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]))


def tree_of(group: Column) -> Column:
    """A name of the group's tree that is never null and keeps the order of groups."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def manifest(docs: DataFrame, values: list[str], key: str = "doc_id", group: str = "source", claim: Column | None = None,
             shape: Shape = Shape()) -> Manifest:
    """Store the trees of a table. ``claim`` is another digest that each leaf carries along, to be verified."""
    claim = F.lit(None).cast("string") if claim is None else claim
    rows = docs.select(tree_of(F.col(group)).alias("tree"), F.col(key).alias("key"),
                       leaf(*[F.col(name) for name in values]).alias("digest"), claim.alias("claim"))
    groups = build(rows, ["key", "claim"], ["key", "digest"], shape)
    tops = groups.tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    whole = build(tops, ["key"], ["key"], shape)
    root = whole.tops.first()
    return Manifest(groups, whole, root and root["digest"])


def build(rows: DataFrame, carried: list[str], order: list[str], shape: Shape) -> Levels:
    """Stored levels over (tree, digest, carried columns)."""
    blocks = [_blocks(_placed(rows, carried, order), ["digest", *carried], shape)]
    tops, done = [], False
    while not done:
        level = _inside(blocks[-1], shape, shape.stride).select(
            "tree", "block", "size", F.col(f"inner{shape.stride}")[0].alias("digest"))
        tops.append(level.filter(F.col("size") <= shape.block).select(
            "tree", F.lit(len(blocks) - 1).alias("level"), "digest"))
        more = level.filter(F.col("size") > shape.block)
        done = more.isEmpty()
        if not done:
            above = more.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / shape.block).alias("size"), "digest")
            blocks.append(_blocks(above, ["digest"], shape))
    whole = tops[0]
    for other in tops[1:]:
        whole = whole.unionByName(other)
    return Levels(shape, blocks, settle(whole, "tops"))


def _placed(rows: DataFrame, carried: list[str], order: list[str]) -> DataFrame:
    """Adds each row's place ``at`` in its tree and the tree's ``size``."""
    # The turn spreads rows that are equal in all else; written, it stays the same for them.
    rows = settle(rows.withColumn("turn", F.monotonically_increasing_id()), "leaves")
    n = rows.count()
    few, many = RANGE_ROWS
    parts = max(1, min(ceil(n / few), max(200, ceil(n / many))))
    order = [*order, "turn"]
    ranged = settle(rows.repartitionByRange(parts, "tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows"))
              .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
              .withColumn("size", F.sum("rows").over(Window.partitionBy("tree"))))
    place = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(counts, ["tree", "range"]).select(
        "tree", (F.col("place") + F.col("offset")).alias("at"), "size", "digest", *carried)


def _blocks(placed: DataFrame, columns: list[str], shape: Shape) -> DataFrame:
    """One row per aligned subtree, its nodes in order."""
    node = F.struct("at", *columns)
    found = placed.groupBy("tree", F.floor(F.col("at") / shape.block).alias("block")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(node)).alias("nodes"))
    return settle(found, "level")


def _inside(blocks: DataFrame, shape: Shape, levels: int) -> DataFrame:
    """Adds ``inner0``, the digests of the block's nodes, and those of ``levels`` levels above. A level of one node has none
    above. Each column is used more than once by the next, so Catalyst computes it once."""
    blocks = blocks.withColumn("inner0", F.col("nodes.digest"))
    for i in range(levels):
        name = f"inner{i}"
        runs = F.ceil(F.size(name) / shape.fan).cast("int")
        above = F.transform(F.sequence(F.lit(0), runs - 1), _run(name, shape.fan))
        alone = F.ceil(F.col("size") / shape.fan**i) == 1
        blocks = blocks.withColumn(f"inner{i + 1}", F.when(alone, F.col(name)).otherwise(above))
    return blocks


def _run(name: str, fan: int):
    return lambda run: digest(F.array_join(F.slice(F.col(name), run * fan + 1, fan), ""))


def _proofs(blocks: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """Every node of a stored level with its proof: its siblings below the next stored level, then ``above``'s."""
    above = above.withColumnRenamed("at", "block")
    rows = _inside(blocks, shape, shape.stride - 1).join(above, ["tree", "block"])

    def siblings(place: Column) -> Column:
        steps = []
        for i in range(shape.stride):
            spot = F.floor(place / shape.fan**i).cast("int")
            start = (F.floor(spot / shape.fan) * shape.fan).cast("int")
            left = F.array_join(F.slice(F.col(f"inner{i}"), start + 1, spot - start), "")
            right = F.array_join(F.slice(F.col(f"inner{i}"), spot + 2, start + shape.fan - spot - 1), "")
            steps.append(F.when(F.ceil(F.col("size") / shape.fan**i) > 1, F.struct(left.alias("left"), right.alias("right"))))
        return F.array_compact(F.array(*steps))

    each = F.transform("nodes", lambda node, place: F.struct(node.alias("node"), siblings(place).alias("own")))
    held = [c for c in above.columns if c not in ("tree", "block", "proof")]
    rows = rows.select("tree", *held, F.col("proof").alias("upper"), F.explode(each).alias("each"))
    return rows.select("tree", "each.node.*", F.concat("each.own", "upper").alias("proof"), *held)


def _down(levels: Levels, tops: DataFrame) -> DataFrame:
    """Proofs of all leaves. ``tops``: (tree, level, proof, ...) of every tree's top, whose other columns leaves get too."""
    found = None
    for at in reversed(range(len(levels.blocks))):
        above = tops.filter(F.col("level") == at).drop("level").withColumn("at", F.lit(0).cast("bigint"))
        if found is not None:
            above = above.unionByName(settle(found.drop("digest"), "proofs"))  # so that its size is known to joins
        found = _proofs(levels.blocks[at], above, levels.shape)
    return found


def prove(stored: Manifest, group: str = "source") -> DataFrame:
    """(key, group, claim, leaf, subroot, root, proof) of every leaf. A proof has one entry per level with the digests ``left``
    and ``right`` of the node, concatenated; `fold` makes the root from a leaf and its proof."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = _down(stored.whole, stored.whole.tops.select("tree", "level", empty.alias("proof")))
    top = top.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "proof")
    tops = stored.groups.tops.select("tree", "level").join(top, "tree")
    found = _down(stored.groups, tops)
    source = F.when(F.col("tree") != "0", F.substr("tree", F.lit(2)))
    return found.select("key", source.alias(group), "claim", F.col("digest").alias("leaf"), "subroot",
                        F.lit(stored.root).cast("string").alias("root"), "proof")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))

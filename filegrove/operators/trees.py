"""Metadata as trees: rows of nodes, canonical digests from the leaves up, and the limits that a tree must keep to be looked at.

Nodes are (tree, node, parent, name, block, value): parent is null for the root, which is a block; a leaf has a value (binary or
null), a block has children. Children have no order of their own, and names may repeat."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.operators.tables import Scratch, stored


@dataclass(frozen=True)
class Limits:
    """Blocks below each other, nodes (a block within another counts twice, as an item and as a block), bytes of a leaf, and
    bytes of all leaves and of what blocks list (fixed values)."""

    depth: int = 16
    nodes: int = 4096
    leaf_bytes: int = 16 << 20
    total_bytes: int = 32 << 20


#: What can be wrong with a tree, in the order in which it is told; each with its message (fixed values).
FAULTS = {
    "cycle": "The metadata hierarchy contains a cycle.",
    "depth": "The metadata hierarchy exceeds the supported depth.",
    "nodes": "The metadata hierarchy contains too many nodes.",
    "leaf": "A metadata value exceeds the supported size.",
    "bytes": "The metadata hierarchy exceeds the supported size.",
}
#: Bytes that a block lists of a child beside its name: two lengths, a kind and a digest.
_LISTED = 4 + 4 + 1 + 32


def depths(nodes: DataFrame, keep: Scratch) -> DataFrame:
    """(tree, node, depth), a table: how many parents a node has, or null where they lead to no root. Each round doubles the
    parents that are looked back over, so a tree of any shape takes rounds by the logarithm of its depth; rows that have
    reached a root wait."""
    up = F.col("parent")
    now = keep(nodes.select("tree", "node", up.alias("up"), up.isNotNull().cast("long").alias("depth")), "up")
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        further = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("there"))
        moved = now.join(further, ["tree", "up"], "left")
        lost = F.col("up").isNotNull() & F.col("there").isNull()  # a parent that isn't there
        after = keep(moved.select("tree", "node", F.when(lost, F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "up")
        keep.drop(now)
        now = after
        if now.where("up IS NOT NULL").isEmpty():
            break
    return keep(now.select("tree", "node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth")), "depths")


def faults(placed: DataFrame, limits: Limits) -> DataFrame:
    """(tree, fault): the first of FAULTS that holds for a tree of nodes with their depth, or null."""
    block, size = F.col("block"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    listed = F.when(F.col("parent").isNotNull(), F.octet_length(F.coalesce("name", F.lit(""))) + _LISTED).otherwise(0)
    sums = placed.groupBy("tree").agg(
        F.max(F.col("depth").isNull()).alias("cycle"),
        F.max(F.when(block, F.col("depth"))).alias("depth"),
        F.sum(F.when(block & F.col("parent").isNotNull(), 2).otherwise(1)).alias("nodes"),
        F.max(F.when(~block, size)).alias("leaf"),
        F.sum(F.when(block, 0).otherwise(size) + listed).alias("bytes"),
    )
    told = F.when(F.col("cycle"), "cycle").when(F.col("depth") > limits.depth, "depth").when(F.col("nodes") > limits.nodes, "nodes")
    return sums.select("tree", told.when(F.col("leaf") > limits.leaf_bytes, "leaf").when(F.col("bytes") > limits.total_bytes, "bytes").alias("fault"))


def tree_digests(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(tree, fault, digest): what is wrong with each tree, or the digest of its root, which equal trees have in common and no
    others.

    A leaf's digest is that of its value; a block's that of its children's names, kinds and digests, in that order. A level
    is an aggregate over the children of one block, of which a tree within its limits has few."""
    with Scratch("trees") as keep:
        placed = keep(nodes.join(depths(nodes, keep), ["tree", "node"]), "placed")
        judged = keep(faults(placed, limits), "judged")
        sound = placed.join(judged.where("fault IS NULL").select("tree"), "tree", "left_semi")
        leaf = F.sha2(F.coalesce(F.col("value"), F.lit(b"")), 256)
        rows = keep(sound.select("tree", "node", "parent", F.coalesce("name", F.lit("")).alias("name"), "block", "depth", F.when(~F.col("block"), leaf).alias("digest")), "rows")
        deepest = rows.agg(F.max("depth")).first()[0]
        below = None  # digests of the blocks one level down
        for level in range(deepest if deepest is not None else -1, -1, -1):
            here = rows.where(F.col("depth") == level)
            if below is not None:
                listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "block", "digest"))), lambda x: F.concat(F.octet_length(x["name"]).cast("string"), F.lit(":"), x["name"], F.when(x["block"], "B").otherwise("V"), x["digest"])), "")
                made = below.groupBy("tree", F.col("parent").alias("node")).agg(F.sha2(listed, 256).alias("made"))
                here = here.join(made, ["tree", "node"], "left").withColumn("digest", F.when(F.col("block"), F.coalesce("made", F.lit(_EMPTY))).otherwise(F.col("digest"))).drop("made")
            else:
                here = here.withColumn("digest", F.coalesce("digest", F.lit(_EMPTY)))
            below = keep(here.select("tree", "node", "parent", "name", "block", "digest"), "level")
        digests = below.where("parent IS NULL").select("tree", "digest") if below is not None else rows.select("tree", "digest")
        return stored(judged.join(digests, "tree", "left"), "tree-digests")


#: The digest of a block without children: that of nothing.
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def same_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree, same) of two tables of tree_digests(): whether both have a tree, and it is the same; null where either has a fault."""
    one, other = (x.select("tree", F.struct("fault", "digest").alias(side)) for x, side in ((a, "a"), (b, "b")))
    both = one.join(other, "tree", "full")
    sound = F.col("a.fault").isNull() & F.col("b.fault").isNull()
    return both.select("tree", F.when(sound, F.coalesce(F.col("a.digest") == F.col("b.digest"), F.lit(False))).alias("same"))

"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.operators.tables import Scratch, stored

#: Edges that a task contracts at once.
CONTRACTED = 200_000


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b) has one b and no b is an a: then every b is its component's least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: each node but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (further := label[label] != label).any():
            label[further] = label[label[further]]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, as stars of some edges each: a task takes CONTRACTED of its own at a time."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CONTRACTED:
                yield contract(held)
                held, n = [], 0
        if n:
            yield contract(held)

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _least(table["a"].to_numpy(), table["b"].to_numpy())], ["a", "b"])

    return edges.mapInArrow(stars, "a long, b long")


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of edges (a, b), a table: label is the least node that can be reached. Nodes without another are left out.

    Where nodes are numbers, tasks first make stars of some edges each. Large-star and small-star steps in turn, each an aggregate to the least neighbour and a join, until all components are
    stars. Every step is written to the shared folder, so no plan grows and a lost executor costs one step; no list of
    neighbours is gathered anywhere, and the neighbours of one node may spread over tasks.
    """
    with Scratch(name) as keep:
        both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if dict(edges.dtypes)["a"] == dict(edges.dtypes)["b"] == "bigint":
            # those of few edges are done then; of many, each part's nodes have one edge
            both = _contracted(both.coalesce(max(1, -(-edges.count() // CONTRACTED))))
        now = keep(both.distinct(), "edges")
        rows = now.count()
        while not _stars(now):
            # nodes without a lesser neighbour stay as they are, so a hub's edges only wait for those of others
            lesser = keep(now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "lesser", rows)
            large = keep(now.withColumnRenamed("b", "u").join(lesser, "u", "left").select("a", F.coalesce("m", "u").alias("b")).distinct(), "large", rows)
            least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least", rows)
            moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            small = keep(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small", 2 * rows)
            keep.drop(now, lesser, large, least)
            now, rows = small, small.count()
        roots = now.select(F.col("b").alias("node")).distinct()
        found = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
        return stored(found, name, 2 * rows)


def without_nodes(edges: DataFrame, labels: DataFrame, gone: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of connected(edges) after nodes went, from labels, its result before: edges (a, b), gone (node).

    Components that lost nothing keep their rows as they are. Of the others the edges between nodes that are left are taken,
    found by their ends, and joined anew; so the work goes by the size of what was touched, apart from one look at the
    edges. Nodes left without another are left out, nodes that no component has are passed over."""
    with Scratch(name) as keep:
        gone = keep(gone.select("node").distinct(), "gone")
        touched = keep(labels.join(gone, "node", "left_semi").select("label").distinct(), "touched")
        left = keep(labels.join(touched, "label", "left_semi").join(gone, "node", "left_anti").select("node"), "left")
        some = edges.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi")
        again = connected(some.select("a", "b"), name)
        return stored(labels.join(touched, "label", "left_anti").select("node", "label").unionByName(again), name)

"""Canonical trees against plain recursion, and their limits."""

import hashlib
import random

import pytest

from filegrove.operators import trees
from filegrove.operators.trees import Limits, same_trees, tree_digests

NODE = "tree string, node long, parent long, name string, block boolean, value binary"


def digest(node, rows):
    _, name, block, value = rows[node]
    if not block:
        return hashlib.sha256(value or b"").hexdigest()
    children = sorted((rows[k][1] or "", rows[k][2], digest(k, rows)) for k in rows if rows[k][0] == node)
    return hashlib.sha256("".join(f"{len(n.encode())}:{n}{'B' if b else 'V'}{d}" for n, b, d in children).encode()).hexdigest()


def some(rng, n):
    """A tree of n nodes: {node: (parent, name, block, value)}, numbers shuffled."""
    rows, blocks = {0: (None, None, True, None)}, [0]
    for i in range(1, n):
        block = rng.random() < 0.3
        rows[i] = (rng.choice(blocks), rng.choice(["a", "é", "b:1", "", "a"]), block, None if block or rng.random() < 0.1 else rng.randbytes(rng.randint(0, 9)))
        blocks += [i] * block
    to = dict(zip(rows, rng.sample(range(1000), n), strict=True))
    return {to[k]: (None if p is None else to[p], *rest) for k, (p, *rest) in rows.items()}


def table(spark, named):
    return spark.createDataFrame([(t, k, *v) for t, rows in named.items() for k, v in rows.items()], NODE)


def test_digests_are_those_of_recursion(spark):
    rng = random.Random(1)
    named = {str(i): some(rng, rng.choice([1, 2, 5, 30, 120])) for i in range(25)} | {"chain": {i: (i - 1 if i else None, "x", True, None) for i in range(17)}}
    got = {r["tree"]: r for r in tree_digests(table(spark, named)).collect()}
    for t, rows in named.items():
        root = next(k for k, v in rows.items() if v[0] is None)
        assert (got[t]["fault"], got[t]["digest"]) == (None, digest(root, rows))
    # the same trees under other numbers, and one that differs in a value
    again = {t: {k + 5: (None if p is None else p + 5, *rest) for k, (p, *rest) in rows.items()} for t, rows in named.items()}
    leaf = next(k for k, v in again["3"].items() if not v[2]) if any(not v[2] for v in again["3"].values()) else None
    if leaf is not None:
        again["3"][leaf] = (*again["3"][leaf][:3], b"other value")
    del again["4"]
    same = {r["tree"]: r["same"] for r in same_trees(tree_digests(table(spark, named)), tree_digests(table(spark, again))).collect()}
    assert same == {t: (t != "3" or leaf is None) and t != "4" for t in named}


@pytest.mark.parametrize("fault", [None, *trees.FAULTS])
def test_the_first_limit_that_a_tree_breaks(spark, fault):
    rows = {0: (None, None, True, None), 1: (0, "b", True, None), 2: (1, "leaf", False, b"12345"), 3: (0, "x", False, b"1")}
    limits = {"depth": 1, "nodes": 5, "leaf_bytes": 5, "total_bytes": 6 + 1 + 4 + 1 + 3 * 41}
    if fault == "cycle":
        rows |= {7: (8, "c", True, None), 8: (7, "c", True, None)}
        limits = dict.fromkeys(limits, 0)
    elif fault:
        limits[{"depth": "depth", "nodes": "nodes", "leaf": "leaf_bytes", "bytes": "total_bytes"}[fault]] -= 1
    found = tree_digests(table(spark, {"t": rows, "sound": {0: (None, None, True, None)}}), Limits(**limits) if fault != "cycle" else Limits(depth=0, nodes=1, leaf_bytes=0, total_bytes=0))
    got = {r["tree"]: (r["fault"], r["digest"]) for r in found.collect()}
    assert got["t"] == (fault, None if fault else digest(0, rows)) and got["sound"] == (None, hashlib.sha256(b"").hexdigest())


def test_lost_parents_and_no_trees(spark):
    got = tree_digests(table(spark, {"t": {1: (9, "x", False, b"1"), 0: (None, None, True, None)}})).collect()
    assert [(r["fault"], r["digest"]) for r in got] == [("cycle", None)]
    assert tree_digests(spark.createDataFrame([], NODE)).count() == 0

"""Windows by sorted ranges, and what is built on them, each against plain loops; keys that hold nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from filegrove.operators import actions, exact, ranges, similarity


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_carried_and_ranked(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice("hhhhhhhhxyz"), i, rng.choice([None, None, None, i])) for i in rng.sample(range(10_000), 3000)]
    rows += [("w", i, None) for i in range(400)]  # ranges without any value
    df = spark.createDataFrame(rows, "k string, at int, v int")
    up = {(r["k"], r["at"]): r["o"] for r in ranges.carried(df, ["k"], [F.col("at")], F.col("v"), "o").collect()}
    down = {(r["k"], r["at"]): r["o"] for r in ranges.carried(df, ["k"], [F.col("at")], F.col("v"), "o", forward=False).collect()}
    place = {(r["k"], r["at"]): r["o"] for r in ranges.ranked(df, ["k"], [F.col("at")], "o").collect()}
    assert len(up) == len(down) == len(place) == len(rows)
    for key in "hxyzw":
        own = sorted((at, v) for k, at, v in rows if k == key)
        last = None
        for i, (at, v) in enumerate(own):
            last = v if v is not None else last
            assert up[key, at] == last and place[key, at] == i + 1
        last = None
        for at, v in reversed(own):
            last = v if v is not None else last
            assert down[key, at] == last


def anchors(values, most):
    out, anchor = {}, None
    for v in sorted(values):
        anchor = v if anchor is None or v - anchor > most else anchor
        out[v] = anchor
    return out


@pytest.mark.parametrize("folded", [0, 50, 10**6])
def test_anchored_clusters_of_small_and_large_keys(spark, many_ranges, monkeypatch, folded):
    monkeypatch.setattr(similarity, "FOLDED", folded)
    rng = random.Random(2)
    rows = [("hot", v) for v in rng.choices(range(20_000), k=3000)] + [(k, rng.randrange(200)) for k in "abcdef" for _ in range(rng.randint(1, 40))] + [("one", 5), (None, 3), ("null", None)]
    df = spark.createDataFrame(rows, "k string, d long")
    for most in (0, 7, 300):
        got = similarity.anchored_clusters(df, ["k"], "d", most).collect()
        want = {k: anchors([d for x, d in rows if x == k and d is not None], most) for k, _ in rows if k}
        assert sorted((r["k"], r["d"], r["cluster"]) for r in got) == sorted((k, d, want[k][d]) for k, d in rows if k and d is not None)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_exclusions(spark, many_ranges, monkeypatch, limit):
    monkeypatch.setattr(exact, "BROADCAST_EXCLUSIONS", limit)
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "B", "b", "c d", "a.b", "a!", "é", "É", "x0", "a/"[:1]])
    some = ["/" + "/".join(part() for _ in range(rng.randint(1, 5))) for _ in range(400)] + ["relative/a", "relative", "/"]
    for excluded in ([], ["/"], ["/a/", "/A/b", "/b//"], ["relative"], ["/É/a.b", "/c d"], rng.sample(some, 25), [None, "/a!"]):
        files = spark.createDataFrame([(p, i) for i, p in enumerate([*some, None])], "full_path string, at int").withColumn("_place", F.lit("x"))
        got = sorted(r["at"] for r in exact.excluded(files, spark.createDataFrame([(e,) for e in excluded], "excluded_path string")).collect())
        tops = [(e.rstrip("/") or "/").upper() for e in excluded if e is not None]
        out = lambda p: p is not None and any(p.upper() == t or p.upper().startswith(t.rstrip("/") + "/") for t in tops)  # noqa: B023, E731
        assert got == [i for i, p in enumerate([*some, None]) if not out(p)], excluded


def sequential(names, taken, naming):
    """One by one in path order, as the rule says it."""
    given, out, tried = {t.upper() for t in taken}, {}, {}
    for path, name in sorted(names, key=lambda r: (r[0].upper(), r[0])):
        head, tail = naming.parts(name)
        n = tried.get((head.upper(), tail.upper()), 1)
        while (new := f"{head}{f' ({n})' if n > 1 else ''}{tail}").upper() in given:
            n += 1
        given.add(new.upper())
        out[path], tried[head.upper(), tail.upper()] = new, n
    return out


@pytest.mark.parametrize("naming", [actions.MOVED, actions.OPTIMIZED, actions.CLEANED])
def test_names_by_ranges_are_those_one_by_one(spark, many_ranges, monkeypatch, naming):
    monkeypatch.setattr(actions, "SETTLED", 1)
    for seed in (0, 3, 5):
        rng = random.Random(seed)
        stem = lambda: rng.choice(["a", "A", "b"]) + "".join(f" ({rng.choice([2, 2, 3, 4, 7, 1, '02', 12])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))  # noqa: B023, E731
        name = lambda: stem() + rng.choice(["", ".optimized", ".clean", ".clean"] if naming is not actions.MOVED and rng.random() < 0.3 else [""]) + rng.choice([".txt", ".TXT", ".mp4", "", ".t (2)"])  # noqa: B023, E731
        rows = [(f"/{rng.randrange(10**6)}/{i}", name()) for i in range(rng.choice([5, 40, 150]))]
        taken = [name() for _ in range(rng.choice([0, 3, 20]))] + [sequential([("/x", name())], [], naming)["/x"] for _ in range(10)]
        df = spark.createDataFrame(rows, "full_path string, file_name string").withColumn("to", F.lit("/To"))
        used = spark.createDataFrame([("/TO", t) for t in taken] + [("/else", "a.txt")], "folder string, name string")
        got = {r["full_path"]: r["new_name"] for r in actions.free_names(df, used, "to", naming).collect()}
        assert got == sequential(rows, taken, naming), seed


def test_very_many_files_of_one_name(spark, many_ranges):
    n = 60_000
    rows = spark.range(n).select(F.format_string("/%07d/a.txt", F.col("id") * 7919 % n).alias("full_path"), F.when(F.col("id") % 20_000 == 7, "A (30000).txt").otherwise("a.txt").alias("file_name"), F.lit("/to").alias("to"))
    used = spark.createDataFrame([("/to", f"a ({k}).TXT") for k in range(2, 500, 3)] + [("/to", "A.txt")], "folder string, name string")
    got = {r["full_path"]: r["new_name"] for r in actions.free_names(rows, used, "to", actions.MOVED).collect()}
    assert got == sequential([tuple(r) for r in rows.select("full_path", "file_name").collect()], [f"a ({k}).TXT" for k in range(2, 500, 3)] + ["A.txt"], actions.MOVED)

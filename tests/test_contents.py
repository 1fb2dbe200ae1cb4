"""Contents range by range: trees of digests, waves, comparisons, files that change or can't be read, files of any size."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from filegrove.operators import exact
from filegrove.sources import contents
from filegrove.sources.filesystem import inventory, with_content


def tree(data, size, fan):
    nodes = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(len(data), 1), size)]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


def listed(spark, tmp_path, **named):
    for name, data in named.items():
        (tmp_path / name).write_bytes(data)
    return inventory(spark, [str(tmp_path)])["files"]


def names(rows):
    return sorted(r[0].rsplit("/", 1)[1] for r in rows.select("full_path").collect())


def test_trees_of_files(spark, tmp_path):
    rng = random.Random(1)
    data = {f"f{n}": rng.randbytes(n) for n in (0, 1, 9, 10, 11, 99, 100, 101, 395, 1000)}
    files = listed(spark, tmp_path, **data)
    for fan in (2, 3, 1024):
        got = {r["full_path"].rsplit("/", 1)[1]: r["digest"] for r in exact.tree_digests(contents.digests(files, range_bytes=10), fan=fan).collect()}
        assert got == {name: tree(d, 10, fan) for name, d in data.items()}


def test_a_tree_with_a_missing_part_has_no_digest(spark):
    parts = spark.createDataFrame([(f, p, 9, None if (f, p) == ("b", 8) else str(p)) for f in "abc" for p in range(9) if (f, p) not in (("c", 8), ("c", 7), ("c", 6))], "full_path string, part long, n long, digest string")
    got = {r["full_path"]: r["digest"] for r in exact.tree_digests(parts, fan=3).collect()}
    assert got["a"] and got["b"] is None and got["c"] is None


@pytest.mark.parametrize("verify", [False, True])
def test_groups_of_files_of_several_ranges(spark, tmp_path, verify):
    rng = random.Random(2)
    base = rng.randbytes(1000)
    files = listed(
        spark, tmp_path, a=base, b=base, late=base[:-1] + b"x", early=b"x" + base[1:], c=base[:999], d=base[:999], only=base[:500], zero=b"", none=b"", small=b"s", same=b"s", middle=base[:500] + b"y" + base[501:], twin=base[:500] + b"y" + base[501:]
    )
    os.link(tmp_path / "a", tmp_path / "hard")
    files = inventory(spark, [str(tmp_path)])["files"]
    members, skipped = contents.duplicate_files(files, verify, range_bytes=16)
    groups = {}
    for r in members.collect():
        groups.setdefault((r["size_bytes"], r["digest"]), []).append(r["full_path"].rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["c", "d"], ["middle", "twin"], ["none", "zero"], ["same", "small"]]
    assert skipped.count() == 0


def test_digests_that_collide_are_told_apart(spark, tmp_path):
    files = listed(spark, tmp_path, a1=b"a" * 50, a2=b"a" * 50, b1=b"b" * 50, b2=b"b" * 50, c=b"c" * 50, late=b"a" * 49 + b"z")
    parts = lambda size: F.greatest(F.ceil(size / 7), F.lit(1))
    members, skipped = exact.verified(files.withColumn("digest", F.lit("one")), lambda p, a, b: contents.comparisons(p, a, b, 7), parts)
    groups = {}
    for r in members.collect():
        groups.setdefault(r["digest"], []).append(r["full_path"].rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == [["a1", "a2"], ["b1", "b2"]] and skipped.count() == 0
    empty, none = exact.verified(files.limit(0).withColumn("digest", F.lit("one")), lambda p, a, b: contents.comparisons(p, a, b, 7), parts)
    assert empty.count() == none.count() == 0


def test_many_contents_of_one_digest_take_few_rounds(spark, tmp_path):
    files = listed(spark, tmp_path, **{f"f{i}{x}": bytes([i]) * 50 for i in range(12) for x in "ab"}, **{f"late{i}": b"z" * 49 + bytes([i]) for i in range(9)})
    parts, rounds = (lambda size: F.greatest(F.ceil(size / 7), F.lit(1))), []

    def compare(pairs, first, last):
        rounds.extend([1] if first == 0 else [])
        return contents.comparisons(pairs, first, last, 7)

    members, skipped = exact.verified(files.withColumn("digest", F.lit("one")), compare, parts, lambda f, a, b: contents.digests(f, a, b, 7))
    groups = {}
    for r in members.collect():
        groups.setdefault(r["digest"], []).append(r["full_path"].rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == sorted([f"f{i}a", f"f{i}b"] for i in range(12)) and skipped.count() == 0
    assert len(rounds) == 1


def test_files_that_change_or_cannot_be_read_are_skipped_with_a_reason(spark, tmp_path):
    files = listed(spark, tmp_path, a=b"1" * 40, b=b"1" * 40, c=b"1" * 40, gone=b"1" * 40, grown=b"1" * 40)
    files = spark.createDataFrame(files.collect(), files.schema)  # as they were listed
    os.remove(tmp_path / "gone")
    (tmp_path / "grown").write_bytes(b"1" * 41)
    members, skipped = contents.duplicate_files(files, range_bytes=16)
    assert names(members) == ["a", "b", "c"]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in skipped.collect()} == {"gone": "No such file or directory", "grown": contents.CHANGED}
    # found gone only when bytes are compared: as a reference, the others start anew; as another file, it alone is left out
    parts = lambda size: F.greatest(F.ceil(size / 16), F.lit(1))
    compare = lambda p, a, b: contents.comparisons(p, a, b, 16)
    for first in ("a", "c"):
        (tmp_path / first).rename(tmp_path / "away")
        left = files.where(~F.col("full_path").endswith("/gone") & ~F.col("full_path").endswith("/grown")).withColumn("digest", F.lit("d"))
        members, skipped = exact.verified(left, compare, parts)
        assert names(members) == [n for n in "abc" if n != first] and names(skipped.withColumnRenamed("path", "full_path")) == [first]
        (tmp_path / "away").rename(tmp_path / first)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    for name, last in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        with open(tmp_path / name, "wb") as f:  # sparse
            f.truncate(size - 1)
            f.seek(size - 1)
            f.write(last)
    files = inventory(spark, [str(tmp_path)])["files"]
    members, skipped = contents.duplicate_files(files, range_bytes=128 << 20)
    assert names(members) == ["a", "b"] and skipped.count() == 0
    assert with_content(files).where("content IS NULL").count() == 3  # no single value, and no crash
    assert with_content(files, 3).where("length(content) = 3").count() == 3


def test_only_what_may_still_agree_is_read_on(spark, tmp_path):
    rng = random.Random(3)
    head = rng.randbytes(16)
    files = listed(spark, tmp_path, a=head + b"1" * 4000, b=head + b"1" * 4000, early=rng.randbytes(4016), **{f"x{i}": rng.randbytes(4016) for i in range(5)})
    asked = []

    def digests(rows, first, last):
        asked.append((first, names(rows)))
        return contents.digests(rows, first, last, 16)

    members, _ = exact.same_contents(files, digests, lambda size: F.greatest(F.ceil(size / 16), F.lit(1)))
    assert names(members) == ["a", "b"]
    assert [first for first, _ in asked] == [0, 1, 8, 64] and len(asked[0][1]) == 8 and all(read == ["a", "b"] for _, read in asked[1:])

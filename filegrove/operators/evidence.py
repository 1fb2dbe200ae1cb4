"""A side table of fingerprints by snapshot: what is known of a file as long as it doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.operators.generations import Generations
from filegrove.operators.tables import stored

KEY = ("full_path", "size_bytes", "modified_ticks")


def accepted(cache: DataFrame, version: int, sound: Column | None = None) -> DataFrame:
    """The cache's entries of this version whose evidence is sound (a boolean over its columns), one a snapshot: of several
    the one whose evidence is the least."""
    rows = cache.where(F.col("version") == version).drop("version")
    rows = rows if sound is None else rows.where(sound)
    rest = [c for c in rows.columns if c not in KEY]
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_best"))
    return best.select(*KEY, *[F.col(f"_best.{c}").alias(c) for c in rest])


def known(files: DataFrame, cache: DataFrame, version: int, sound: Column | None = None) -> DataFrame:
    """files with what the cache (KEY, version, evidence columns) has of their present snapshot, nulls where nothing."""
    return files.join(accepted(cache, version, sound), list(KEY), "left")


def missing(files: DataFrame, cache: DataFrame, version: int, sound: Column | None = None) -> DataFrame:
    """files whose present snapshot the cache doesn't have."""
    return files.join(accepted(cache, version, sound).select(*KEY), list(KEY), "left_anti")


def refreshed(files: DataFrame, cache: DataFrame, version: int, compute: Callable[[DataFrame], DataFrame], sound: Column | None = None) -> DataFrame:
    """The cache for files: entries that still hold, and compute(files without one). Entries of files that changed or are
    gone, of other versions and of unsound evidence are dropped."""
    held = accepted(cache, version, sound).join(files.select(*KEY), list(KEY), "left_semi")
    return held.unionByName(compute(missing(files, cache, version, sound))).withColumn("version", F.lit(version))


def refresh(store: Generations, files: DataFrame, version: int, compute: Callable[[DataFrame], DataFrame], sound: Column | None = None) -> tuple[DataFrame, bool]:
    """(files with their evidence, whether what was computed is in the store): what the store (KEY, evidence columns, version)
    has of the files' present snapshots, and compute() of the others, which is committed.

    The store may be cleared or written to meanwhile: entries of other writers stay, and evidence that was based on a cleared
    generation is used but not kept."""
    since = store.head()
    cache = store.read(since)
    new = stored(compute(missing(files, cache, version, sound)), "evidence")
    kept = True if new.isEmpty() else store.append(new.withColumn("version", F.lit(version)), since)
    every = accepted(cache, version, sound).join(files.select(*KEY), list(KEY), "left_semi").unionByName(new)
    return files.join(every, list(KEY)), kept

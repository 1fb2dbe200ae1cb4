"""Findings and similarity groups as one list: search, the three orders, and totals of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.operators.tables import numbered

#: Orders of a list by the option's number: by path, by size, by time of change (fixed values).
BY_PATH, BY_SIZE, BY_TIME = 0, 1, 2


def metadata_text(entries: Column) -> Column:
    """A map as lines "key: value"."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def _holds(needle: str, *texts: Column) -> Column:
    out = F.lit(False)
    for text in texts:
        out |= F.upper(F.coalesce(text, F.lit(""))).contains(F.upper(F.lit(needle)))
    return out


def search_findings(findings: DataFrame, text: str) -> DataFrame:
    """findings whose path, reason, suggestion or metadata hold a text, without regard to case; all for a blank text."""
    needle = text.strip()
    return findings.where(_holds(needle, F.col("full_path"), F.col("reason"), F.col("suggestion"), metadata_text(F.col("metadata")))) if needle else findings


def search_items(items: DataFrame, text: str) -> DataFrame:
    """All items of similarity groups whose id or metadata, or an item's path or metadata, hold a text."""
    needle = text.strip()
    if not needle:
        return items
    hit = _holds(needle, F.col("group_id"), F.col("full_path"), metadata_text(F.col("metadata")), metadata_text(F.col("group_metadata")))
    return items.join(items.where(hit).select("group_id").distinct(), "group_id", "left_semi")


def listed(findings: DataFrame, items: DataFrame) -> DataFrame:
    """(row_type, group_id, full_path, size_bytes, modified_ticks): a row for each finding and for each group of items, which
    has its reference's path and time and the sizes of all its items."""
    one = findings.select(F.lit("finding").alias("row_type"), F.lit(None).cast("string").alias("group_id"), "full_path", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("modified_ticks").cast("long").alias("modified_ticks"))
    reference = lambda c: F.max(F.when(F.col("is_reference"), F.col(c)))
    groups = items.groupBy("group_id").agg(reference("full_path").alias("full_path"), F.sum("size_bytes").alias("size_bytes"), reference("modified_ticks").cast("long").alias("modified_ticks"))
    return one.unionByName(groups.withColumn("row_type", F.lit("group")))


def ordered(rows: DataFrame, option: int = BY_PATH) -> DataFrame:
    """listed() rows with their place: by path, by size (largest first) or by time of change (latest first, none last); ties
    by path."""
    tail = [F.upper("full_path"), F.col("full_path"), F.col("row_type"), F.col("group_id")]
    lead = {BY_PATH: [], BY_SIZE: [F.desc("size_bytes")], BY_TIME: [F.desc_nulls_last("modified_ticks")]}
    return numbered(rows, [*lead[option], *tail])


def bytes_done(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """One row of progress: attempts so far, their bytes as far as the inventory knows their paths (without regard to case),
    and all files and bytes of it."""
    sizes = files.groupBy(F.upper("full_path").alias("_u")).agg(F.max("size_bytes").alias("_size"))
    done = attempts.select(F.upper("path").alias("_u")).join(sizes, "_u", "left").agg(F.count("*").alias("n_done"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes_done"))
    return done.crossJoin(files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total")))  # one row each

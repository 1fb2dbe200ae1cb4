"""What windows over one key would do, where a key may hold any share of the rows: sorted ranges instead of one task a key.

Rows are dealt to sorted ranges of about the same size and written; what a range hands on to the next ones is one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filegrove.operators.tables import stored


def _dealt(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with _part, the number of their range in the order of by and order, as a table: ranges are sampled, so they must
    not be computed twice."""
    return stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _key(by: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in by])


def carried(rows: DataFrame, by: list[str], order: list[Column], value: Column, out: str, forward: bool = True) -> DataFrame:
    """rows with out: the last value that isn't null up to this row among those of its key, in this order; with forward=False
    the first one from this row on. Columns of by must not be null; order is ascending, its ties are settled by chance."""
    dealt = _dealt(rows.withColumn("_value", value), by, order)
    window = Window.partitionBy("_part", *by).orderBy(*order)
    if forward:
        within = F.last("_value", True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        within = F.first("_value", True).over(window.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = dealt.where("_value IS NOT NULL")
    # the key next to the following (preceding) ranges, and its value that is nearest to them
    edge = seen.groupBy(F.col("_part").alias("_of")).agg((F.max if forward else F.min)(_key(by)).alias("_at"))
    at_edge = seen.join(F.broadcast(edge), (F.col("_part") == F.col("_of")) & (_key(by) == F.col("_at")))
    near = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("_value").alias("v"))
    edges = at_edge.groupBy("_part", "_at").agg((F.max if forward else F.min)(near).alias("_near")).select("_part", F.struct("_at", F.col("_near.v").alias("v")).alias("_edge"))
    parts = dealt.select("_part").distinct().join(edges, "_part", "left")  # a row a range
    beside = Window.orderBy("_part")
    if forward:
        handed = F.last("_edge", True).over(beside.rowsBetween(Window.unboundedPreceding, -1))
    else:
        handed = F.first("_edge", True).over(beside.rowsBetween(1, Window.unboundedFollowing))
    parts = parts.select(F.col("_part").alias("_of"), handed.alias("_handed"))
    found = dealt.withColumn("_within", within).join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return found.withColumn(out, F.coalesce("_within", F.when(F.col("_handed._at") == _key(by), F.col("_handed.v")))).drop("_value", "_within", "_part", "_of", "_handed")


def ranked(rows: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """rows with out: their place among those of their key, from 1, in this order. Columns of by must not be null."""
    dealt = _dealt(rows, by, order)
    within = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    ends = dealt.groupBy("_part").agg(F.min(_key(by)).alias("_first"), F.max(_key(by)).alias("_last"))
    sizes = dealt.join(F.broadcast(ends.select(F.col("_part").alias("_of"), "_last")), (F.col("_part") == F.col("_of")) & (_key(by) == F.col("_last"))).groupBy("_of").agg(F.count("*").alias("_n"))
    parts = ends.join(sizes, F.col("_part") == F.col("_of")).select("_part", "_first", "_last", "_n")  # a row a range
    upto = F.sum("_n").over(Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = parts.select("_part", "_first", "_last", upto.alias("_upto"))
    # rows of a range's first key that lie in ranges before: the last of those that end with this key has counted them
    before = sums.select(F.col("_last").alias("_key"), F.col("_part").alias("_earlier"), "_upto")
    starts = sums.select(F.col("_part").alias("_of"), F.col("_first").alias("_key")).join(before, "_key").where("_earlier < _of").groupBy("_of", "_key").agg(F.max("_upto").alias("_before"))
    found = dealt.withColumn("_within", within).join(F.broadcast(starts), (F.col("_part") == F.col("_of")) & (_key(by) == F.col("_key")), "left")
    return found.withColumn(out, (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_of", "_key", "_before", "_within")

"""Tables in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import itertools
import shutil
import tempfile
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one file where the number of rows is known. Small tables go to few files: each costs a task, and on a local file
#: system also two processes that set its permissions.
FILE_ROWS = 50_000
#: Tables after which the driver's garbage is collected.
COLLECT_AFTER = 8
_WRITTEN = itertools.count(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; on a cluster
    that would lose data, so there it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="filegrove-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        context.setCheckpointDir(found)
    return found


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder; a session that has ended leaves it to the folder's owner."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone
        pass


def shuffles_released(spark: SparkSession) -> None:
    """Lets the cluster delete the shuffle files of queries that have ended. Spark does so once the driver has collected their
    garbage, which a driver with little to do may put off until long after the disks are full."""
    gc.collect()  # what Python refers to in the driver
    for _ in range(2):  # plans refer to shuffles by way of each other
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def garbage_collected(spark: SparkSession) -> None:
    """Collects the garbage of plans that have run. A computation of many small queries leaves so much that the driver's heap
    would otherwise grow to its limit, and the rest of its memory (code, classes, stacks) comes on top; a full collection
    gives back what the heap doesn't need."""
    gc.collect()  # what Python refers to in the driver
    spark.sparkContext._jvm.System.gc()


def _write(df: DataFrame, name: str, rows: int | None, compression: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    if next(_WRITTEN) % COLLECT_AFTER == 0:
        garbage_collected(spark)
    return spark.read.schema(df.schema).parquet(path), path


_SCOPES = threading.local()


def _left_to(scopes: list[Scope], frame: DataFrame, path: str) -> None:
    if scopes:
        scopes[-1].tables.append((frame, path))
    else:
        atexit.register(removed, frame.sparkSession, path)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written as Parquet and read again; removed at the end of the Scope that it is made in, else when the program ends
    (a driver that dies leaves it to the folder's owner). rows: about so many are read to make it (large or costly ones count
    several times), if known; there is a file for each FILE_ROWS at most."""
    out, path = _write(df, name, rows)
    _left_to(getattr(_SCOPES, "open", []), out, path)
    return out


class Scope:
    """with Scope() as scope: tables that stored() makes in this thread are removed at the end, but for those that are kept()
    for the scope around it. What is read from the others must have been written by then."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []
        self.keep: list[DataFrame] = []

    def __enter__(self) -> Scope:
        _SCOPES.open = [*getattr(_SCOPES, "open", []), self]
        return self

    def kept(self, table: DataFrame) -> DataFrame:
        self.keep.append(table)
        return table

    def drop(self, table: DataFrame) -> None:
        """Removes a table now; one that isn't of this scope stays."""
        for frame, path in [x for x in self.tables if x[0] is table]:
            removed(frame.sparkSession, path)
            self.tables = [x for x in self.tables if x[0] is not frame]

    def __exit__(self, *error) -> None:
        _SCOPES.open = _SCOPES.open[:-1]
        for frame, path in self.tables:
            if any(frame is k for k in self.keep):
                _left_to(_SCOPES.open, frame, path)
            else:
                removed(frame.sparkSession, path)


class Scratch:
    """Tables of one computation: with Scratch("name") as keep: table = keep(df, "what"). All are removed at the end of the
    block, so what leaves it must have been stored() from them."""

    def __init__(self, name: str) -> None:
        self.name, self.tables = name, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, what: str, rows: int | None = None, compression: str | None = None) -> DataFrame:
        out, path = _write(df, f"{self.name}-{what}", rows, compression)
        self.tables.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for table, path in [x for x in self.tables if any(x[0] is f for f in frames)]:
            removed(table.sparkSession, path)
            self.tables = [x for x in self.tables if x[0] is not table]

    def __exit__(self, *error) -> None:
        self.drop(*[table for table, _ in self.tables])


def placed(ordered: DataFrame, place: str = "place") -> DataFrame:
    """The rows of a sorted table with their places from 1. A sort leaves ranges, which are counted one by one, so no task
    sees all rows; what is broadcast is one number a range."""
    dealt = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(starts), part == F.col("_part")).withColumn(place, at.cast("long")).drop("_at", "_part", "_before")


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in this order."""
    return placed(df.orderBy(*order), place)

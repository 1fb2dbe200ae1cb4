"""Identical files as they arrive: each batch tells the groups that it touches, over all files so far."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.operators import exact
from filegrove.operators.generations import Generations
from filegrove.operators.tables import Scope, stored

KEPT = ("full_path", "file_name", "size_bytes", "modified_ticks", "identity", "digest")


def watch_groups(stream: DataFrame, folder: str, report: Callable[[DataFrame, int], None]):
    """A writer for a stream of files (as exact.funnel takes): start() it with a checkpoint location.

    Digests go to a table of generations in folder, one commit a batch; a batch that is run again replaces its own, so every
    file counts once. Parts are merged as they get many, so batches read some FAN log(batches) of them, and in each, dealt by the
    first two digits of the digest (256 at most), only the files that the batch touches. report gets the members of all
    groups of two or more physical files that the batch touched, and the batch's number.
    """

    def one(batch: DataFrame, number: int) -> None:
        digest = F.sha2(F.col("content").cast("binary"), 256)
        with Scope():
            hashed = batch.where("content IS NOT NULL").withColumn("digest", digest).select(*KEPT).withColumn("part", F.substring("digest", 1, 2))
            new = stored(hashed, "batch")
            seen = Generations(batch.sparkSession, folder, new.schema, ("part",))
            seen.append(new, tag=number)
            parts = [r["part"] for r in new.select("part").distinct().collect()]  # 256 at most
            keys = ["size_bytes", "digest"]
            touched = seen.read().where(F.col("part").isin(parts)).drop("part").join(new.select(*keys).distinct(), keys, "left_semi")
            first = touched.groupBy(*keys, "identity").agg(F.min(F.struct(F.upper("full_path").alias("u"), F.col("full_path").alias("p"))).alias("f")).select(*keys, F.col("f.p").alias("full_path"))
            report(exact.several(first, keys).join(touched, [*keys, "full_path"]), number)
            if seen.merge():
                seen.vacuum()

    return stream.writeStream.foreachBatch(one)


class Throttle:
    """Lets a report through at most once in a while; the last one always."""

    def __init__(self, report: Callable, seconds: float = 0.1, clock: Callable[[], float] = time.monotonic) -> None:
        self.report, self.seconds, self.clock, self.last = report, seconds, clock, float("-inf")

    def __call__(self, event, final: bool = False) -> None:
        now = self.clock()
        if final or now - self.last >= self.seconds:
            self.last = now
            self.report(event)

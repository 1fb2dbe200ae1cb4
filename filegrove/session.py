"""A session with the settings that the engine's plans assume."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.config(map=SETTINGS).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Busy(RuntimeError):
    """Another operation runs."""


class Operations:
    """One operation at a time on a session, which another thread may cancel: with operations.run("scan"): ..."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock, self._tag = spark, threading.Lock(), None
        self.active: str | None = None
        self.cancelled = False

    @contextmanager
    def run(self, name: str) -> Iterator[str]:
        """Holds the session for an operation; its jobs carry a tag. Raises Busy while another one holds it."""
        with self._lock:
            if self.active is not None:
                raise Busy(self.active)
            self.active, self.cancelled, self._tag = name, False, f"{name}-{uuid.uuid4().hex}"
        tag = self._tag
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield tag
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            with self._lock:
                self.active = self._tag = None

    def cancel(self) -> bool:
        """Stops the jobs of the running operation; whether there was one."""
        with self._lock:
            tag, self.cancelled = self._tag, self._tag is not None
        if tag:
            self.spark.sparkContext.cancelJobsWithTag(tag)
        return tag is not None

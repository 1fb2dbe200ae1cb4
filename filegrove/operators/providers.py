"""Where decoders plug in: functions from a path to what they found there, run on the executors."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.functions.text import UNIX_TICKS

#: What a provider returns: whether it worked, the values by column, and what went wrong.
Attempt = tuple[bool, dict | None, str | None]


def _snapshot(path: str) -> tuple[int | None, int | None]:
    try:
        status = os.stat(path)
    except OSError:
        return None, None
    return status.st_size, UNIX_TICKS + status.st_mtime_ns // 100


def attempted(files: DataFrame, provider: Callable[[str], Attempt], schema: str) -> DataFrame:
    """files with the provider's columns (schema, as DDL), ok, error, and size and ticks of each file before and after, as
    review.sampled() takes them. What a provider may fail with (OSError, ValueError) becomes an error of that row; anything
    else ends the job. Null values where it failed."""
    columns = [part.split()[0] for part in schema.split(", ")]

    def one(path: str) -> dict:
        before = _snapshot(path)
        try:
            ok, values, error = provider(path)
        except (OSError, ValueError) as e:
            ok, values, error = False, None, str(e)
        after = _snapshot(path)
        found = {c: (values or {}).get(c) if ok else None for c in columns}
        return {**found, "ok": bool(ok), "error": error, "before_size": before[0], "before_ticks": before[1], "after_size": after[0], "after_ticks": after[1]}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):  # samples may be large
                rows = part.iloc[at : at + 64].reset_index(drop=True)
                yield pd.concat([rows, pd.DataFrame([one(p) for p in rows["full_path"]], dtype=object)], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    more = "ok boolean, error string, before_size long, before_ticks long, after_size long, after_ticks long"
    return files.mapInPandas(run, f"{own}, {schema}, {more}")


def with_skips(rows: DataFrame, failed: str) -> tuple[DataFrame, DataFrame]:
    """(usable, skipped: path, reason) of attempted() rows: failures are skipped with one reason."""
    return rows.where("ok").drop("ok", "error"), rows.where("NOT ok").select(F.col("full_path").alias("path"), F.lit(failed).alias("reason"))

"""Contents of files of any size: ranges are rows, dealt to tasks by file and place, and are read, digested and compared on the
executors. No file is ever one value."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.operators import exact

#: Bytes of a range, and of a file that are in memory at once.
RANGE_BYTES, BUFFER_BYTES = 64 << 20, 1 << 20
CHANGED = "File changed during scan."
#: How a range compares; the greatest of a file's ranges counts.
SAME, DIFFERENT, UNREADABLE, REFERENCE_UNREADABLE = range(4)


def ranges(files: DataFrame, first: int = 0, last: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files with part, at and length of each of their ranges from the first to before the last; an empty file has one."""
    n = F.greatest(F.ceil(F.col("size_bytes") / range_bytes), F.lit(1))
    upto = n if last is None else F.least(n, F.lit(last))
    part = F.explode(F.when(upto > first, F.sequence(F.lit(first).cast("long"), upto - 1)).otherwise(F.array().cast("array<long>")))
    rows = files.withColumn("part", part).withColumn("at", F.col("part") * range_bytes)
    rows = rows.withColumn("length", F.least(F.lit(range_bytes), F.col("size_bytes") - F.col("at")))
    return rows.repartition("full_path", "part")


def _open(path: str, size: int):
    """A file that has this size, else an error."""
    f = open(path, "rb", buffering=0)  # noqa: SIM115 - the caller closes it
    if os.fstat(f.fileno()).st_size != size:
        f.close()
        raise OSError(CHANGED)
    return f


def _pieces(f, at: int, length: int, size: int) -> Iterator[bytes]:
    """A range of an open file, piece by piece; an error if the file's size is another one afterwards."""
    f.seek(at)
    while length:
        piece = f.read(min(BUFFER_BYTES, length))
        if not piece:
            raise OSError(CHANGED)
        length -= len(piece)
        yield piece
    if os.fstat(f.fileno()).st_size != size:
        raise OSError(CHANGED)


def _said(error: OSError) -> str:
    return error.strerror or str(error)


def digests(files: DataFrame, first: int = 0, last: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(full_path, part, n, digest, reason) of ranges of files (full_path, size_bytes): the SHA-256 of each range, or null and
    why it can't be read. n: ranges of the file that were asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, reasons = [], []
            for path, size, at, length in zip(*(batch.column(c).to_pylist() for c in ("full_path", "size_bytes", "at", "length")), strict=True):
                try:
                    with _open(path, size) as f:
                        digest = hashlib.sha256()
                        for piece in _pieces(f, at, length, size):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                    reasons.append(None)
                except OSError as e:
                    found.append(None)
                    reasons.append(_said(e))
            yield pa.RecordBatch.from_arrays([batch.column("full_path"), batch.column("part"), batch.column("n"), pa.array(found, pa.string()), pa.array(reasons, pa.string())], names=["full_path", "part", "n", "digest", "reason"])

    n = F.greatest(F.ceil(F.col("size_bytes") / range_bytes), F.lit(1))
    asked = n - first if last is None else F.least(n, F.lit(last)) - first
    rows = ranges(files.select("full_path", "size_bytes", asked.alias("n")), first, last, range_bytes)
    return rows.mapInArrow(read, "full_path string, part long, n long, digest string, reason string")


def comparisons(pairs: DataFrame, first: int = 0, last: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(full_path, part, state, reason) of ranges of pairs (full_path, ref_path, size_bytes): whether both files have the same
    bytes there. A file that can't be read is told from a reference that can't."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, reasons = [], []
            for path, reference, size, at, length in zip(*(batch.column(c).to_pylist() for c in ("full_path", "ref_path", "size_bytes", "at", "length")), strict=True):
                state, reason = SAME, None
                blame = REFERENCE_UNREADABLE
                try:
                    with _open(reference, size) as left:
                        blame = UNREADABLE
                        with _open(path, size) as right:
                            others = _pieces(right, at, length, size)
                            mine = _pieces(left, at, length, size)
                            while state == SAME:
                                blame = REFERENCE_UNREADABLE
                                a = next(mine, None)
                                blame = UNREADABLE
                                b = next(others, None)
                                if a is None and b is None:
                                    break
                                state = SAME if a == b else DIFFERENT
                except OSError as e:
                    state, reason = blame, _said(e)
                states.append(state)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("full_path"), batch.column("part"), pa.array(states, pa.int32()), pa.array(reasons, pa.string())], names=["full_path", "part", "state", "reason"])

    rows = ranges(pairs.select("full_path", "ref_path", "size_bytes"), first, last, range_bytes)
    return rows.mapInArrow(read, "full_path string, part long, state int, reason string")


def duplicate_files(files: DataFrame, verify: bool = True, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members, skipped: path, reason): groups of files (full_path, size_bytes, identity, ...) with identical contents, read from
    where full_path leads. verify: bytes are compared as well, as digests might agree by chance."""
    parts = lambda size: F.greatest(F.ceil(size / range_bytes), F.lit(1))
    members, skipped = exact.same_contents(files, lambda rows, first, last: digests(rows, first, last, range_bytes), parts)
    if verify:
        members, more = exact.verified(members, lambda pairs, first, last: comparisons(pairs, first, last, range_bytes), parts)
        skipped = skipped.unionByName(more)
    return members, skipped.distinct()

"""What several operators share: Arrow batches of bounded size and words as hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.operators.tables import stored as written  # noqa: F401 - the operators' tables

#: Rows and bytes that Spark puts into one Arrow batch at most, and bytes that a kernel takes at once (or one row).
BATCH_ROWS, BATCH_BYTES, CHUNK_BYTES = 1000, 16 << 20, 1 << 20


def bounded(df: DataFrame) -> None:
    """Lowers the session's limits of Arrow batches to ours. Python workers read these settings when a plan runs, so they
    can't be given to one plan alone; what is lower already stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow with a kernel from a record batch to one or several, in batches small enough for long texts. At the end of each task finish
    is called and what the worker holds is given back: idle workers live on beside those of other operators."""
    bounded(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = kernel(piece)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
        if finish:
            finish()
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives scratch tables and unused Arrow memory back to the system."""
    global _UP, _DOWN
    if len(_UP) > SHORT:
        _UP, _DOWN = _UP[:SHORT].copy(), _DOWN[:SHORT].copy()
    pa.default_memory_pool().release_unused()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices whose texts, binaries and lists hold about CHUNK_BYTES together, or a single row."""
    if batch.num_rows < 2 or batch.nbytes <= CHUNK_BYTES:
        if batch.num_rows:
            yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):  # of numbers
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def arrow(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    """A record batch of lists, arrays or Arrow columns."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo: how the contracts hold rows out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- words as hashes -------------------------------------------------------------------------------------------------

#: Bytes of words: digits, small letters, and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Bytes of text for which powers are kept between tasks.
SHORT = 1 << 16
_UP, _DOWN = _powers(_BASE, SHORT), _powers(_BASE_INVERSE, SHORT)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        n = max(n, CHUNK_BYTES + 1024)
        _UP, _DOWN = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _UP, _DOWN


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased UTF-8 texts, in order, and the number of words of each text.

    Works through at most CHUNK_BYTES at a time (more only for one longer word), whatever the texts' lengths.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    joined, ends = b"\n".join(texts) + b"\n", np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    data = np.frombuffer(joined, np.uint8)
    at = 0
    while at < len(data):
        stop = min(len(data), at + CHUNK_BYTES)
        while stop < len(data) and WORD_BYTE[data[stop - 1]]:  # not within a word
            stop += 1
        part = data[at:stop]
        is_word = np.concatenate(([False], WORD_BYTE[part], [False]))
        edges = np.flatnonzero(is_word[1:] != is_word[:-1])
        starts, stops = edges[::2], edges[1::2]
        up, down = _upto(len(part))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[part] * up[: len(part)], dtype=np.uint64)))
        hashes.append(mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(ends, starts + at, "right"), minlength=len(texts))[: len(texts)]
        at = stop
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty where there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out + np.uint64(k))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(column: str = "text"):
    """128 bits that stand for a whole text; null for null."""
    return F.unhex(F.md5(F.col(f"`{column}`").cast("string")))


def let(value, body):
    """body(value), with value computed once. What stands within a function over an array's elements is otherwise computed
    again for each element, even if it doesn't depend on them."""
    return F.element_at(F.transform(F.array(value), body), 1)

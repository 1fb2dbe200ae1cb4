"""Exact XXH3-64 values of contents, where they must be those of other programs. Equality needs none of this."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def xxh3(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """XXH3-64 of a binary, its 64 bits as a signed number; null for null."""
    import xxhash

    signed = lambda n: n - (1 << 64) if n >> 63 else n
    for part in parts:
        yield pd.Series([None if x is None else signed(xxhash.xxh3_64_intdigest(bytes(x))) for x in part], dtype="Int64")


def hex16(value: Column) -> Column:
    """64 bits as 16 capital hex digits."""
    return F.lpad(F.hex(value), 16, "0")

"""What a ZIP file's directory says: sound, encrypted, or not to be read.

Records are laid out as in the ZIP application note: they are decoded into fields first, and judged afterwards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signatures and layouts of a ZIP's records, and the marks that send a reader to the 64-bit record (fixed values).
LAYOUTS = {
    "end": (b"PK\x05\x06", "<4sHHHHIIH", ("disk", "first_disk", "entries_here", "entries", "size", "offset", "comment")),
    "locator": (b"PK\x06\x07", "<4sIQI", ("disk", "offset", "disks")),
    "wide_end": (b"PK\x06\x06", "<4sQHHIIQQQQ", ("length", "made_by", "needed", "disk", "first_disk", "entries_here", "entries", "size", "offset")),
    "entry": (b"PK\x01\x02", "<4sHHHHHHIIIHHHHHII", ("made_by", "needed", "flags", "method", "time", "date", "crc", "packed", "plain", "name", "extra", "comment", "disk", "inner", "outer", "offset")),
}
ELSEWHERE = {"entries": 0xFFFF, "size": 0xFFFFFFFF, "offset": 0xFFFFFFFF}
ENCRYPTED = 1
SOUND, LOCKED, SPLIT, BROKEN = ("Valid", None), ("UnsupportedOrProtected", "PasswordProtected"), ("UnsupportedOrProtected", "UnsupportedContainer"), ("Invalid", "ZipCentralDirectoryFailure")


def _length(kind: str) -> int:
    return struct.calcsize(LAYOUTS[kind][1])


def record(data: bytes, at: int, kind: str) -> dict[str, int] | None:
    """The fields of the record of this kind at this place; None if there is none or it is cut."""
    signature, layout, names = LAYOUTS[kind]
    if at < 0 or not data.startswith(signature, at) or at + _length(kind) > len(data):
        return None
    return dict(zip(names, struct.unpack_from(layout, data, at)[1:], strict=True))


@dataclass
class Directory:
    """The central directory as the end records describe it: entries, and the bytes [start, stop), which must lie before
    limit; split where it spreads over several disks."""

    entries: int
    start: int
    stop: int
    limit: int
    split: bool


def find_end(data: bytes) -> int:
    """Where the end record stands whose comment ends the file, or -1."""
    signature, size = LAYOUTS["end"][0], _length("end")
    before = len(data)
    while (at := data.rfind(signature, max(0, len(data) - size - 0xFFFF), before)) >= 0:
        fields = record(data, at, "end")
        if fields and at + size + fields["comment"] == len(data):
            return at
        before = at + len(signature) - 1
    return -1


def directory(data: bytes) -> Directory | None:
    """The central directory, None where no sound end record tells of it."""
    limit = find_end(data)
    if limit < 0:
        return None
    fields = record(data, limit, "end")
    split = _spread(fields)
    if not split and any(fields[name] == mark for name, mark in ELSEWHERE.items()):
        place = limit - _length("locator")
        locator = record(data, place, "locator")
        if locator is None:
            return None
        split, limit = locator["disk"] != 0 or locator["disks"] != 1, locator["offset"]
        if not split:
            fields = record(data, limit, "wide_end")
            # the length counts what follows its own field, and the record reaches up to the locator
            if fields is None or fields["length"] < _length("wide_end") - 12 or limit + 12 + fields["length"] != place:
                return None
            split = _spread(fields)
    return Directory(fields["entries"], fields["offset"], fields["offset"] + fields["size"], limit, split)


def _spread(fields: dict[str, int]) -> bool:
    return bool(fields["disk"] or fields["first_disk"]) or fields["entries_here"] != fields["entries"]


def entries(data: bytes, start: int, stop: int) -> Iterator[tuple[dict[str, int], int]]:
    """The entries of a central directory, each with the place where it ends, until one doesn't fit."""
    while (fields := record(data, start, "entry")) is not None:
        start += _length("entry") + fields["name"] + fields["extra"] + fields["comment"]
        if start > stop:
            return
        yield fields, start


def probe_zip(data: bytes | None) -> tuple[str, str | None]:
    """(status, error type): Valid; UnsupportedOrProtected with PasswordProtected or UnsupportedContainer; or Invalid."""
    data = bytes(data or b"")
    found = directory(data)
    if found is None:
        return BROKEN
    if found.split:
        return SPLIT
    if found.stop > found.limit:
        return BROKEN
    body = data[found.start : found.stop]
    n, end, locked = 0, 0, False
    for fields, end in entries(body, 0, len(body)):
        n, locked = n + 1, locked or bool(fields["flags"] & ENCRYPTED)
        if n > found.entries:
            break
    if n != found.entries or end != len(body):
        return BROKEN
    return LOCKED if locked else SOUND


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("error_type", T.StringType())]))
def zip_status(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([probe_zip(x) for x in part], columns=["status", "error_type"])

"""Results as export rows, and as CSV or JSON files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.functions import text

#: The columns of an export, in order (fixed values).
HEADER = ("record_type", "tool", "generated_utc", "scope_summary", "path", "kind", "reason", "suggestion", "group_id", "similarity_percent", "size_bytes", "created_utc", "modified_utc", "metadata", "skipped_reason")
_ITEM = ("path", "kind", "reason", "suggestion", "group_id", "similarity_percent", "size_bytes", "created_ticks", "modified_ticks", "metadata")


def exact_items(members: DataFrame) -> DataFrame:
    """Members of exact groups as items; the group id is the content's hash in hex."""
    none = F.lit(None)
    return members.select(
        F.col("full_path").alias("path"), F.lit("File").alias("kind"), F.lit("Byte-identical duplicate").alias("reason"), F.lit("Review manually").alias("suggestion"),
        F.upper(F.substring("digest", 1, 16)).alias("group_id"), none.cast("double").alias("similarity_percent"), F.col("size_bytes"), F.col("created_ticks"), F.col("modified_ticks"),
        F.create_map(F.lit("Extension"), F.col("extension")).alias("metadata"),
    )


def finding_items(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("full_path").alias("path"), "kind", "reason", "suggestion", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("double").alias("similarity_percent"), "size_bytes", "created_ticks", "modified_ticks", "metadata")


def group_items(items: DataFrame, metadata: Column, group_metadata: Column, music: bool = False) -> DataFrame:
    """Items of similarity groups; an item's metadata wins over its group's. Music has no percentage."""
    reason = "Music metadata and duration match" if music else "Similarity match"
    percent = F.lit(None).cast("double") if music else F.col("similarity_percent")
    kept = F.map_filter(group_metadata, lambda k, _: ~F.map_contains_key(metadata, k))
    return items.select(F.col("full_path").alias("path"), F.lit("File").alias("kind"), F.lit(reason).alias("reason"), F.lit("Review manually").alias("suggestion"), "group_id", percent.alias("similarity_percent"), "size_bytes", F.lit(None).cast("long").alias("created_ticks"), "modified_ticks", F.map_concat(kept, metadata).alias("metadata"))


def export_rows(items: DataFrame, skipped: DataFrame, tool: str, generated_ticks: int, scope: str) -> DataFrame:
    """The rows of an export, items and skipped paths (path, reason) together, by group and path."""
    said = lambda c: F.when(F.col(c).isNotNull(), text.utc_text(F.col(c)))
    fixed = {"tool": F.lit(tool), "generated_utc": text.utc_text(F.lit(generated_ticks).cast("long")), "scope_summary": F.lit(scope)}
    whole = items.select(*_ITEM).withColumns({**fixed, "record_type": F.lit("item"), "created_utc": said("created_ticks"), "modified_utc": said("modified_ticks"), "metadata": text.map_json(F.col("metadata")), "skipped_reason": F.lit(None).cast("string")})
    rest = skipped.select("path", F.col("reason").alias("skipped_reason")).withColumns({**fixed, "record_type": F.lit("skipped_path"), "metadata": F.lit("{}")})
    both = whole.unionByName(rest, allowMissingColumns=True).select(*HEADER)
    group = F.coalesce("group_id", F.lit(""))
    return both.orderBy(F.upper(group), group, F.upper("path"), "path", "record_type")


def csv_lines(rows: DataFrame) -> DataFrame:
    """One column line: the cells of export_rows, quoted where needed."""
    cells = [text.csv_cell(F.col(c).cast("string")) for c in HEADER]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def json_items(rows: DataFrame) -> DataFrame:
    """One column line: each row of export_rows as a JSON object without what it lacks."""
    return rows.select(F.to_json(F.struct(*HEADER)).alias("line"))


def _published(path: str, chunks: Iterator[bytes], overwrite: bool) -> None:
    """Writes beside the target and renames: a reader sees the old file or the whole new one."""
    folder = os.path.dirname(path)
    if not os.path.isabs(path) or not os.path.isdir(folder):
        raise ValueError("the destination must be absolute, and its folder must exist")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    handle, beside = tempfile.mkstemp(dir=folder, prefix=".export-")
    try:
        with os.fdopen(handle, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        if overwrite:
            os.replace(beside, path)
        else:
            os.link(beside, path)
            os.unlink(beside)
    except BaseException:
        if os.path.exists(beside):
            os.unlink(beside)
        raise


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file on the driver: byte order mark, header, CRLF. Rows come one partition at a time."""
    def chunks() -> Iterator[bytes]:
        yield b"\xef\xbb\xbf" + ",".join(HEADER).encode() + b"\r\n"
        for row in csv_lines(rows).toLocalIterator():
            yield row["line"].encode() + b"\r\n"

    _published(path, chunks(), overwrite)


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON file on the driver: metadata, items, skippedPaths; rows come one partition at a time."""
    def section(kind: str) -> Iterator[bytes]:
        first = True
        for row in json_items(rows.where(F.col("record_type") == kind)).toLocalIterator():
            item = json.loads(row["line"])
            item["metadata"] = json.loads(item["metadata"])
            yield (b"" if first else b",") + b"\n    " + json.dumps(item, ensure_ascii=False).encode()
            first = False

    def chunks() -> Iterator[bytes]:
        head = rows.select("tool", "generated_utc", "scope_summary").first()
        yield b'{\n  "metadata": ' + json.dumps(head.asDict() if head else {}, ensure_ascii=False).encode() + b',\n  "items": ['
        yield from section("item")
        yield b'\n  ],\n  "skippedPaths": ['
        yield from section("skipped_path")
        yield b"\n  ]\n}\n"

    _published(path, chunks(), overwrite)


def scope_text(folders: int, files: int, excluded: int, subfolders: bool = True) -> str:
    """What a result covers: 2 folders, 1 file, 0 excluded; subfolders included"""
    several = lambda n, word: f"{n:,} {word}{'' if n == 1 else 's'}"
    return f"{several(folders, 'folder')}, {several(files, 'file')}, {excluded:,} excluded; subfolders {'included' if subfolders else 'excluded'}"

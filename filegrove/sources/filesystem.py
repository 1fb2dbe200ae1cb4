"""File systems as a Spark data source: format "inventory" lists folders, files, links and what could not be read.

    spark.dataSource.register(Inventory)
    spark.read.format("inventory").option("roots", json.dumps(["/data"])).load()

The driver opens folders level by level until it has enough for all tasks, so a deep or lopsided tree spreads as well over
executors that see the same file system. Rows have a kind: root, directory, file, link or skipped. In the mode "scan" only
files are listed, filtered as they are read, and folders that can't be opened are passed over in silence.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filegrove.functions import paths
from filegrove.functions.text import UNIX_TICKS

SCHEMA = (
    "kind string, full_path string, file_name string, extension string, directory_path string, size_bytes long, created_ticks long, modified_ticks long, "
    "attributes int, identity string, depth int, physical_child_count int, immediate_target string, resolve_state string, is_directory boolean, reason string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_FIELDS = [(c.split()[0], _ARROW[c.split()[1]]) for c in SCHEMA.split(", ")]


class Part(InputPartition):
    """A folder to list: with all below it, or only its own entries."""

    def __init__(self, path: str, depth: int, deep: bool, root: bool = False) -> None:
        super().__init__((path, depth, deep, root))
        self.path, self.depth, self.deep, self.root = path, depth, deep, root


#: What a partition without a folder is for.
ONE_FILE, NOTHING, CHECK_EXCLUSIONS = -1, -2, -3
UNREADABLE = "Name is not valid text."


def readable(path: str) -> tuple[str, bool]:
    """A path as text that a table can hold, and whether it is the path itself: names may hold bytes that are no text."""
    plain = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return plain, plain == path


def _ticks(ns: int) -> int:
    return UNIX_TICKS + ns // 100


def attributes_of(name: str, status: os.stat_result) -> int:
    out = paths.HIDDEN if name.startswith(".") else 0
    out |= 0 if status.st_mode & 0o200 else paths.READ_ONLY
    out |= paths.DIRECTORY if stat.S_ISDIR(status.st_mode) else 0
    out |= paths.REPARSE_POINT if stat.S_ISLNK(status.st_mode) else 0
    return out | (paths.DEVICE if stat.S_ISCHR(status.st_mode) or stat.S_ISBLK(status.st_mode) else 0)


def link_state(path: str) -> tuple[str | None, str, bool]:
    """Where a link points, how following it ends (ok, missing, denied, unresolvable), and whether it leads to a folder."""
    try:
        target = os.readlink(path)
    except OSError:
        return None, "unresolvable", False
    try:
        return target, "ok", stat.S_ISDIR(os.stat(path).st_mode)
    except (FileNotFoundError, NotADirectoryError):
        return target, "missing", False
    except PermissionError:
        return target, "denied", False
    except OSError:
        return target, "unresolvable", False


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [os.path.abspath(p) for p in json.loads(options.get("roots", "[]")) if p.strip()]
        self.files = [os.path.abspath(p) for p in json.loads(options.get("files", "[]")) if p.strip()]
        self.excluded = [os.path.abspath(p) for p in json.loads(options.get("excluded", "[]")) if p.strip()]
        flag = lambda name, usual: options.get(name, usual).lower() == "true"
        self.subfolders, self.scan, self.follow = flag("subfolders", "true"), flag("scan", "false"), flag("follow", "false")
        self.skip = (0 if flag("hidden", "true") else paths.HIDDEN) | (0 if flag("system", "true") else paths.SYSTEM) | paths.DEVICE
        self.least, self.most = int(options.get("min_size", "0")), int(options.get("max_size", str((1 << 63) - 1)))
        self.extensions = set(json.loads(options["extensions"])) if "extensions" in options else None
        self.parts = int(options.get("parts", "64"))

    def partitions(self) -> list[Part]:
        out = [Part("", CHECK_EXCLUSIONS, False)] if self.excluded and not self.scan else []
        ready = [Part(root, 0, True, True) for root in dict.fromkeys(self.roots)]
        while self.subfolders and ready and len(ready) < self.parts:  # a level deeper
            below = []
            for part in ready:
                out.append(Part(part.path, part.depth, False, part.root))
                if not os.path.islink(part.path) or self.scan and self.follow:
                    below += [Part(path, part.depth + 1, True) for path in self._folders(part)]
            ready = below
        return [*out, *ready, *(Part(p, ONE_FILE, False) for p in self.files)] or [Part("", NOTHING, False)]

    def _folders(self, part: Part) -> list[str]:
        """The folders below one that its own partition doesn't descend into."""
        try:
            found = [e.path for e in os.scandir(part.path) if e.is_dir(follow_symlinks=self.scan and self.follow)]
            return [p for p in found if not self._out(p) and self._descends(p)]
        except OSError:
            return []  # the folder's own partition reports it

    def _descends(self, folder: str) -> bool:
        """Whether a folder below a root is looked into: not skipped by its attributes, no link (unless links are followed,
        and then not to a folder above it)."""
        try:
            status = os.lstat(folder)
        except OSError:
            return True
        if stat.S_ISLNK(status.st_mode):
            real = os.path.realpath(folder)
            return self.scan and self.follow and not f"{os.path.realpath(os.path.dirname(folder))}/".startswith(f"{real}/")
        return not attributes_of(os.path.basename(folder), status) & self.skip

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == 4096:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], names=COLUMNS)

    def _out(self, path: str) -> bool:
        upper = path.upper()
        return any(upper == x.upper() or upper.startswith(x.upper().rstrip("/") + "/") for x in self.excluded)

    def _rows(self, part: Part) -> Iterator[dict]:
        if part.depth == CHECK_EXCLUSIONS:
            for path in dict.fromkeys(self.excluded):
                try:
                    os.lstat(path)
                except (OSError, ValueError) as e:
                    yield {"kind": "skipped", "full_path": readable(path)[0], "reason": getattr(e, "strerror", None) or str(e)}
            return
        if part.depth == NOTHING or self._out(part.path):
            return
        if part.depth == ONE_FILE:
            yield from self._entry(part.path, 0)
        elif self.scan:
            yield from self._scanned(part)
        else:
            yield from self._listed(part)

    def _scanned(self, part: Part) -> Iterator[dict]:
        pending = [part.path]
        while pending:
            folder = pending.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for entry in entries:
                if self._out(entry.path):
                    continue
                if entry.is_dir(follow_symlinks=self.follow):
                    if part.deep and self.subfolders and self._descends(entry.path):
                        pending.append(entry.path)
                else:
                    yield from self._entry(entry.path, 0)

    def _listed(self, part: Part) -> Iterator[dict]:
        if part.root:
            yield {"kind": "root", "full_path": part.path}
            try:
                status = os.lstat(part.path)
            except OSError as e:
                yield {"kind": "skipped", "full_path": part.path, "reason": e.strerror}
                return
            if stat.S_ISLNK(status.st_mode):
                yield from self._entry(part.path, 0)
                return
            if not stat.S_ISDIR(status.st_mode):
                yield {"kind": "skipped", "full_path": part.path, "reason": "Path is not a directory."}
                return
        pending = [(part.path, part.depth)]
        while pending:
            folder, depth = pending.pop()
            plain, sound = readable(folder)
            if not sound:
                yield {"kind": "skipped", "full_path": plain, "reason": UNREADABLE}
                continue
            try:
                status = os.lstat(folder)
            except OSError as e:  # gone since its parent was listed
                yield {"kind": "skipped", "full_path": folder, "reason": e.strerror}
                continue
            if attributes_of(os.path.basename(folder), status) & self.skip and not part.root:
                continue
            try:
                names = sorted(os.listdir(folder))
            except OSError as e:
                names, reason = None, e.strerror
            yield {**self._plain(folder, status, depth), "kind": "directory", "physical_child_count": -1 if names is None else len(names)}
            if names is None:
                yield {"kind": "skipped", "full_path": folder, "reason": reason}
                continue
            for name in names:
                path = os.path.join(folder, name)
                if self._out(path):
                    continue
                if os.path.isdir(path) and not os.path.islink(path):
                    if part.deep and self.subfolders:
                        pending.append((path, depth + 1))
                else:
                    yield from self._entry(path, depth + 1)

    def _plain(self, path: str, status: os.stat_result, depth: int) -> dict:
        name = os.path.basename(path)
        dot = name.rfind(".")
        return {
            "full_path": path, "file_name": name, "extension": name[dot:].lower() if 0 <= dot < len(name) - 1 else "", "directory_path": os.path.dirname(path), "size_bytes": status.st_size,
            "created_ticks": _ticks(status.st_ctime_ns), "modified_ticks": _ticks(status.st_mtime_ns), "attributes": attributes_of(name, status),
            "identity": f"{status.st_dev}:{status.st_ino}" if status.st_ino else f"path:{path.upper()}", "depth": depth,
        }

    def _entry(self, path: str, depth: int) -> Iterator[dict]:
        plain, sound = readable(path)
        if not sound:
            yield {"kind": "skipped", "full_path": plain, "reason": UNREADABLE}
            return
        try:
            status = os.lstat(path)
            linked = stat.S_ISLNK(status.st_mode)
            if self.scan and self.follow and linked:
                status = os.stat(path)
        except OSError as e:
            if not self.scan or not isinstance(e, FileNotFoundError):  # a scan passes over what isn't there
                yield {"kind": "skipped", "full_path": path, "reason": e.strerror}
            return
        row = self._plain(path, status, depth)
        if linked and not self.scan:
            target, state, folder = link_state(path)
            yield {**row, "kind": "link", "immediate_target": target, "resolve_state": state, "is_directory": folder}
        elif not row["attributes"] & self.skip and not stat.S_ISDIR(status.st_mode) and not stat.S_ISLNK(status.st_mode):
            if not self.scan or self.least <= status.st_size <= self.most and (self.extensions is None or row["extension"] in self.extensions):
                yield {**row, "kind": "file"}


class Inventory(DataSource):
    """Options, as JSON lists: roots, files, excluded, extensions; true or false: subfolders, hidden, system (whether such
    files are listed), scan, follow (links, of a scan); and min_size, max_size (of a scan), parts (folders to begin with)."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def inventory(spark: SparkSession, roots: list[str], files: list[str] = (), excluded: list[str] = (), subfolders: bool = True, hidden: bool = True) -> dict[str, DataFrame]:
    """files, directories, roots, reparse_points, links and skipped of some folders and files, each path once."""
    spark.dataSource.register(Inventory)
    options = {"roots": json.dumps(list(roots)), "files": json.dumps(list(files)), "excluded": json.dumps(list(excluded)), "subfolders": str(subfolders), "hidden": str(hidden)}
    rows = spark.read.format("inventory").options(**options).load()

    def once(kind: str) -> DataFrame:
        """Each path once, from the root that is nearest above it."""
        own = F.struct(F.col("depth"), *[F.col(c).alias(f"v_{c}") for c in COLUMNS if c != "depth"])
        best = rows.where(F.col("kind") == kind).groupBy(F.upper("full_path")).agg(F.min(own).alias("r"))
        return best.select(*[F.col("r.depth") if c == "depth" else F.col(f"r.v_{c}").alias(c) for c in COLUMNS])

    link = once("link")
    return {
        "files": once("file").select(*COLUMNS[1:10]),
        "directories": once("directory").select("full_path", F.col("file_name").alias("name"), F.col("directory_path").alias("parent_path"), "depth", "physical_child_count", "attributes"),
        "roots": once("root").select(F.col("full_path").alias("path")),
        "reparse_points": link.select(F.col("full_path").alias("path")),
        "links": link.select(F.col("full_path").alias("path"), "is_directory", "immediate_target", "resolve_state"),
        "skipped": rows.where("kind = 'skipped'").select(F.col("full_path").alias("path"), "reason"),
    }


def scan(spark: SparkSession, roots: list[str], files: list[str] = (), excluded: list[str] = (), min_size: int = 1, max_size: int | None = None, hidden: bool = False, system: bool = False, follow: bool = False, extensions: list[str] | None = None, subfolders: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of an exact scan: sizes, attributes and extensions are checked where files are listed, links are
    followed only on request, folders that can't be opened count for nothing. Each path once, without regard to case."""
    if min_size < 0 or (max_size is not None and max_size < min_size):
        raise ValueError("sizes must be 0 <= min_size <= max_size")
    spark.dataSource.register(Inventory)
    options = {"roots": json.dumps(list(roots)), "files": json.dumps(list(files)), "excluded": json.dumps(list(excluded)), "subfolders": str(subfolders), "hidden": str(hidden), "system": str(system), "scan": "true", "follow": str(follow), "min_size": str(min_size)}
    options |= {"max_size": str(max_size)} if max_size is not None else {}
    options |= {"extensions": json.dumps([e.lower() for e in extensions])} if extensions is not None else {}
    rows = spark.read.format("inventory").options(**options).load()
    found = rows.where("kind = 'file'").groupBy(F.upper("full_path")).agg(F.min(F.struct(*COLUMNS[1:10])).alias("r")).select("r.*")
    return found, rows.where("kind = 'skipped'").select(F.col("full_path").alias("path"), "reason")


#: Bytes that with_content reads of a file at most: one value holds them. Larger files: see sources.contents.
MOST_CONTENT = 1 << 30


def with_content(files: DataFrame, most: int | None = None) -> DataFrame:
    """files and their content (or the first most bytes), read on the executors; null where the file can't be read, has
    another size before or after, or where there are more than MOST_CONTENT bytes to read."""
    names = files.columns
    limit = MOST_CONTENT

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time: contents may be large
                row = batch.slice(at, 1)
                path, size = row.column("full_path")[0].as_py(), row.column("size_bytes")[0].as_py()
                wanted = size if most is None else min(most, size)
                try:
                    with open(path, "rb") as f:
                        content = f.read(wanted) if wanted <= limit and os.fstat(f.fileno()).st_size == size else None
                        content = content if os.fstat(f.fileno()).st_size == size else None
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in names), pa.array([content], pa.binary())], names=[*names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(read, f"{schema}, content binary")

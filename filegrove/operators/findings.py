"""Findings about single files and folders: large, empty, temporary, wrongly named or typed, broken, dangling.

Each function returns full_path, kind, reason, suggestion, size_bytes, created_ticks, modified_ticks, metadata (a map), in
the order of a result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filegrove.functions import paths, signatures, text
from filegrove.functions.paths import ordinary, path_order
from filegrove.operators.tables import stored
from filegrove.sources.archives import zip_status

#: Ends of names of temporary files (fixed values).
TEMPORARY = (".tmp", ".temp", ".partial", ".part", ".crdownload", ".download", ".dmp", ".chk")
TICKS_PER_DAY = 86_400 * text.TICKS_PER_SECOND


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _finding(df: DataFrame, kind: str, reason: Column, metadata: dict[str, Column], suggestion: Column | None = None, created: bool = True, size: Column | None = None, modified: bool = True) -> DataFrame:
    entries = F.map_filter(F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return df.select(
        "full_path",
        F.lit(kind).alias("kind"),
        reason.alias("reason"),
        (_none("string") if suggestion is None else suggestion).alias("suggestion"),
        (F.col("size_bytes") if size is None else size).alias("size_bytes"),
        (F.col("created_ticks") if created else _none("long")).alias("created_ticks"),
        (F.col("modified_ticks") if modified else _none("long")).alias("modified_ticks"),
        entries.alias("metadata"),
    )


def large_files(files: DataFrame, least: int) -> DataFrame:
    """Files of at least so many bytes, largest first."""
    if least < 0:
        raise ValueError("the size must not be negative")
    found = files.where((F.col("size_bytes") >= least) & ~paths.has(F.col("attributes"), paths.REPARSE_POINT))
    reason = F.concat(F.lit("At least "), text.grouped(F.lit(least).cast("long")), F.lit(" bytes"))
    return _finding(found, "File", reason, {"Extension": F.col("extension")}, created=False).orderBy(F.desc("size_bytes"), *path_order("full_path"))


def empty_files(files: DataFrame) -> DataFrame:
    found = files.where((F.col("size_bytes") == 0) & ~paths.has(F.col("attributes"), paths.REPARSE_POINT))
    return _finding(found, "File", F.lit("File is empty"), {"Extension": F.col("extension")}, created=False).orderBy(*path_order("full_path"))


def temporary_name(name: Column) -> Column:
    low = F.lower(name)
    out = low.startswith("~$") | low.endswith("~")
    for end in TEMPORARY:
        out |= low.endswith(end)
    return out


def temporary_files(files: DataFrame, now_ticks: int, age_ticks: int) -> DataFrame:
    """Files with a temporary's name that were last changed at least so long ago."""
    if not 0 <= age_ticks <= now_ticks:
        raise ValueError("the age must lie between 0 and now")
    old = F.col("modified_ticks") <= now_ticks - age_ticks
    found = files.where(temporary_name(F.col("file_name")) & old & ~paths.has(F.col("attributes"), paths.REPARSE_POINT))
    days = int(age_ticks / TICKS_PER_DAY + 0.5)
    reason = F.concat(F.lit("Temporary file at least "), text.grouped(F.lit(days).cast("long")), F.lit(" days old"))
    return _finding(found, "File", reason, {"Extension": F.col("extension")}, created=False).orderBy(*path_order("full_path"))


def empty_folders(directories: DataFrame, roots: DataFrame, reparse_points: DataFrame) -> DataFrame:
    """Folders without children, deepest first: no roots, no links (roots and reparse_points have a column path)."""
    found = directories.where((F.col("physical_child_count") == 0) & ~paths.has(F.col("attributes"), paths.REPARSE_POINT))
    for other in (roots, reparse_points):
        found = found.join(other.select(F.upper("path").alias("_u")).distinct(), F.upper("full_path") == F.col("_u"), "left_anti")
    out = _finding(found.withColumns({"size_bytes": F.lit(0).cast("long"), "created_ticks": _none("long"), "modified_ticks": _none("long")}), "Directory", F.lit("Folder is empty"), {"Depth": F.col("depth").cast("string")})
    return out.orderBy(F.desc(F.col("metadata")["Depth"].cast("int")), *path_order("full_path"))


#: What became of following a link, and the finding (null: a sound link).
LINK_REASONS = {"missing": "Link target is missing.", "denied": "Link target is inaccessible.", "unresolvable": "Link target cannot be resolved."}


def invalid_links(links: DataFrame) -> DataFrame:
    """links (path, is_directory, immediate_target, resolve_state) that lead nowhere; without a target they are no links."""
    state = F.col("resolve_state")
    reason = F.when(state == "ok", _none("string"))
    for name, said in LINK_REASONS.items():
        reason = reason.when(state == name, said)
    reason = reason.otherwise(LINK_REASONS["unresolvable"])
    found = links.withColumn("_reason", reason).where("immediate_target IS NOT NULL AND _reason IS NOT NULL")
    found = found.withColumns({"full_path": F.col("path"), "size_bytes": F.lit(0).cast("long"), "created_ticks": _none("long"), "modified_ticks": _none("long")})
    kind = F.when(F.col("is_directory"), "Directory").otherwise("File")
    return _finding(found, "Link", F.col("_reason"), {"LinkKind": kind, "ImmediateTarget": F.col("immediate_target")}).orderBy(*path_order("full_path"))


def bad_extensions(files: DataFrame, detected: Column | None = None) -> DataFrame:
    """Ordinary files whose content is of a type with a recommended extension, and whose own extension it doesn't allow."""
    detected = signatures.detect(F.col("content").cast("binary")) if detected is None else detected
    typed = files.where(ordinary(F.col("attributes"))).withColumn("_type", detected)
    typed = typed.withColumns({"_allowed": signatures.allowed_extensions(F.col("_type")), "_proper": signatures.recommended_extension(F.col("_type"))})
    found = typed.where(F.col("_proper").isNotNull() & ~F.array_contains("_allowed", F.lower("extension")))
    current = F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension"))
    metadata = {"CurrentExtension": current, "ProperExtension": F.col("_proper"), "DetectedType": F.col("_type")}
    suggestion = F.concat(paths.stem(F.col("file_name")), F.col("_proper"))
    return _finding(found, "File", F.lit("Extension does not match detected file type."), metadata, suggestion).orderBy(*path_order("full_path"))


def broken_files(files: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, skipped) of ordinary files that aren't empty, by probes: path, before_size, before_ticks, after_size,
    after_ticks, detected_type, status (Valid, Invalid, UnsupportedOrProtected, or null where the probe itself failed) and
    error_type. A file whose snapshots differ from the inventory is skipped before anything else is said of it."""
    rows = files.where(ordinary(F.col("attributes")) & (F.col("size_bytes") != 0)).join(probes.withColumnRenamed("path", "full_path"), "full_path", "left")
    same = lambda when: (F.col(f"{when}_size") == F.col("size_bytes")) & (F.col(f"{when}_ticks") == F.col("modified_ticks"))
    skip = F.when(~F.coalesce(same("before") & same("after"), F.lit(False)), "File changed since scan.").when(F.col("status").isNull(), "Could not validate file.")
    rows = rows.withColumn("_skip", skip)
    reason = F.when(F.col("status") == "Invalid", "Unreadable or malformed file.").otherwise("Unsupported or protected.")
    metadata = {"Validator": F.when(F.col("detected_type").isNull(), "Header").otherwise(signatures.validator(F.col("detected_type"))), "ErrorType": F.coalesce("error_type", F.lit("")), "DetectedType": F.col("detected_type")}
    found = _finding(rows.where("_skip IS NULL AND status <> 'Valid'"), "File", reason, metadata).orderBy(*path_order("full_path"))
    return found, rows.where("_skip IS NOT NULL").select(F.col("full_path").alias("path"), F.col("_skip").alias("reason")).orderBy(*path_order("path"))


def probed(files: DataFrame) -> DataFrame:
    """Probes, as broken_files() takes them, of files with content: their types by first bytes, and of ZIP files what the
    directory says. Other types count as valid here; their decoders are not part of Spark."""
    content = F.col("content").cast("binary")
    rows = files.select(F.col("full_path").alias("path"), *[F.col(c).alias(f"{w}_{n}") for w in ("before", "after") for c, n in (("size_bytes", "size"), ("modified_ticks", "ticks"))], signatures.detect(content).alias("detected_type"), content.alias("content"))
    rows = rows.withColumn("zip", F.when(F.col("detected_type") == "ZIP", zip_status("content")))
    return rows.select(*[c for c in rows.columns if c not in ("content", "zip")], F.coalesce("zip.status", F.lit("Valid")).alias("status"), F.col("zip.error_type").alias("error_type"))


# --- names -----------------------------------------------------------------------------------------------------------

INVALID = '"<>|:*?\\/'
REASONS = (
    "Contains control characters",
    "Contains bidirectional control characters",
    "Contains invalid Windows characters",
    "Has leading or trailing whitespace",
    "Ends with a dot",
    "Uses a reserved DOS device name",
    "Has an empty file name stem",
)
_CONTROL = {*map(chr, range(32)), "\x7f"}
_TURNS = {*map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2066, 0x206A))}
_HIDDEN, _INVALID = _CONTROL | _TURNS, {*INVALID}
_DEVICES = {*paths.DEVICES}


def _device(name: str) -> bool:
    return name.rstrip(" .").partition(".")[0].rstrip(" .").upper() in _DEVICES


def _no_stem(name: str) -> bool:
    return not name or name.rfind(".") == 0


def _strip_end(name: str) -> str:
    end = len(name)
    while end and (name[end - 1].isspace() or name[end - 1] == "."):
        end -= 1
    return name[:end]


@lru_cache(1 << 16)
def _piece(c: str) -> tuple[str, str] | None:
    """A character as written and as inspected, safe; None for controls."""
    seen = unicodedata.normalize("NFKC", c)
    if not _HIDDEN.isdisjoint(seen):
        return None
    return (c, seen) if _INVALID.isdisjoint(seen) else ("_", "_")


def _cleaned(name: str) -> list[tuple[str, str]]:
    """(as written, as inspected) pieces of a name, safe: controls go, invalid characters become "_", ends are trimmed."""
    pieces = [piece for c in name if (piece := _piece(c))]
    while pieces and pieces[0][1][:1].isspace():
        rest = pieces[0][1].lstrip()
        pieces[:1] = [(rest, rest)] if rest else []
    while pieces:
        rest = _strip_end(pieces[-1][1])
        if rest == pieces[-1][1]:
            break
        pieces[-1:] = [(rest, rest)] if rest else []
    return pieces


def name_reasons(name: str) -> list[str]:
    """What is wrong with a file name, in the order of REASONS."""
    seen = unicodedata.normalize("NFKC", name)
    chars = set(seen)
    safe = "".join(s for _, s in _cleaned(name))
    wrong = (
        bool(chars & _CONTROL),
        bool(chars & _TURNS),
        bool(chars & _INVALID),
        seen[:1].isspace() or seen[-1:].isspace(),
        seen.rstrip().endswith("."),
        _device(seen),
        _no_stem(_strip_end(seen.lstrip())) or _no_stem(safe),
    )
    return [r for r, w in zip(REASONS, wrong, strict=True) if w]


def name_suggestion(name: str) -> str:
    """A name near to this one in which nothing is wrong."""
    pieces = _cleaned(name)
    if _no_stem("".join(s for _, s in pieces)):
        pieces.insert(0, ("file", "file"))
    if _device("".join(s for _, s in pieces)):
        dot = next((i for i, (_, s) in enumerate(pieces) if "." in s), len(pieces))
        pieces.insert(dot, ("_file", "_file"))
    out = "".join(c for c, _ in pieces)
    return "file" if name_reasons(out) else out


@F.pandas_udf(T.StructType([T.StructField("reasons", T.StringType()), T.StructField("suggestion", T.StringType())]))
def _inspect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(r, name_suggestion(n)) if (r := "; ".join(name_reasons(n))) else (None, None) for n in part.fillna("")]
        yield pd.DataFrame(rows, columns=["reasons", "suggestion"])


def suspicious(name: Column) -> Column:
    """Whether a name may have a reason: all but plain ASCII names without one are looked at by the inspector."""
    first = F.upper(F.regexp_replace(F.regexp_extract(F.regexp_replace(name, "[ .]+$", ""), r"^([^.]*)", 1), " +$", ""))
    return name.rlike(r'[^\x20-\x7E]|["<>|:*?\\/]|^\s|[\s.]$|^\.') | (name == "") | first.isin(*paths.DEVICES)


def bad_names(files: DataFrame) -> DataFrame:
    """Ordinary files with a name that Windows or people stumble over, the reasons in order, and a better name.

    An expression passes over plain names; only the others go to Python. They are written before they are sifted
    and sorted: a filter is pushed down and a sort samples its rows, so each name would be inspected four times."""
    rows = files.where(ordinary(F.col("attributes")) & suspicious(F.col("file_name"))).withColumn("_seen", _inspect("file_name"))
    found = _finding(rows, "File", F.col("_seen.reasons"), {"CurrentName": F.col("file_name")}, F.col("_seen.suggestion"))
    return stored(found, "bad-names").where("reason IS NOT NULL").orderBy(*path_order("full_path"))

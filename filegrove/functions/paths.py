"""Paths as columns: order, parts, extensions, folders and leaf names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute bits of a file or directory.
READ_ONLY, HIDDEN, SYSTEM, DIRECTORY, DEVICE, REPARSE_POINT = 1, 2, 4, 16, 64, 1024
SEPARATOR = "/"
#: Extensions of each category of files (fixed values).
CATEGORIES = {
    "Images": ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "heic", "heif", "raw", "cr2", "nef", "arw", "dng", "svg", "ico", "psd"),
    "Video": ("mp4", "mkv", "mov", "avi", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "3gp", "ts"),
    "Audio": ("mp3", "flac", "wav", "aac", "ogg", "m4a", "wma", "opus", "aiff", "alac"),
    "Documents": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "odt", "ods", "odp", "epub", "md", "csv"),
    "Archives": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso", "cab"),
    "Code": ("cs", "js", "ts", "py", "java", "kt", "cpp", "h", "html", "css", "json", "xml", "yml", "sql"),
}


def path_order(path: str | Column) -> list[Column]:
    """Sort keys: without regard to case (capitals, so that "_" follows "Z"), then exactly."""
    col = F.col(path) if isinstance(path, str) else path
    return [F.upper(col), col]


def has(attributes: Column, mask: int) -> Column:
    return attributes.bitwiseAND(mask) != 0


def ordinary(attributes: Column) -> Column:
    """Neither directory nor reparse point."""
    return ~has(attributes, DIRECTORY | REPARSE_POINT)


def file_name(path: Column) -> Column:
    return F.substring_index(path, SEPARATOR, -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(name: Column) -> Column:
    """From the last dot on, in small letters; empty without one or where the dot ends the name."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    """The name without what extension() sees."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def normal_extension(text: Column) -> Column:
    """What a user types as an extension ("*.JPG", " jpg"): small letters with a leading dot, or empty."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim(text), r"^\*+", "")))
    return F.when(plain == "", "").when(plain.startswith("."), plain).otherwise(F.concat(F.lit("."), plain))


def under(path: Column, folder: Column) -> Column:
    """Whether a path lies in a folder or below, without regard to case; the root has all other paths below it."""
    trimmed = F.upper(F.regexp_replace(folder, "(.)/+$", "$1"))
    inside = F.when(trimmed.endswith(SEPARATOR), trimmed).otherwise(F.concat(trimmed, F.lit(SEPARATOR)))
    return F.upper(path).startswith(inside) & (F.length(path) > F.length(inside) - 1) & (F.upper(path) != inside)


def category_extensions(categories: list[str]) -> list[str]:
    return sorted({f".{x}" for c in categories for x in CATEGORIES[c]})


def keep_both_name(name: Column, n: Column) -> Column:
    """stem (n).ext"""
    return F.concat(stem(name), F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract(name, r"(\.[^.]*)$", 1))


#: Names that a device has (fixed values); the second list counts for new names only.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
MORE_DEVICES = [f"{p}{c}" for p in ("COM", "LPT") for c in "¹²³"]


def valid_leaf(name: Column) -> Column:
    """Whether a name can be given to a file: no separator, no character that Windows forbids, no trailing blank or dot,
    no device."""
    first = F.upper(F.regexp_replace(F.regexp_extract(name, r"^([^.]*)", 1), " +$", ""))
    return (F.trim(name) != "") & ~name.isin(".", "..") & ~name.rlike(r'[\x00-\x1F"<>|:*?\\/]') & ~name.rlike(r"[ .]$") & ~first.isin(*DEVICES, *MORE_DEVICES)

"""What stands around results: sample checks, probe verdicts, undo, totals, queues, options and settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.functions import paths
from filegrove.functions.paths import path_order
from filegrove.operators import exact
from filegrove.operators.media_policy import AUDIO_CODECS, CONTAINERS, VIDEO_CODECS, codec, display_geometry

CHANGED, FAILED_IMAGE, FAILED_VIDEO = "File changed since scan.", "Could not decode image.", "Could not decode video."
SAMPLE_BYTES = 1024


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")) & (c > 0), F.lit(False))


def sound_image() -> Column:
    """Whether a row (width, height, luminance) is a usable picture sample."""
    return _finite(F.col("width")) & _finite(F.col("height")) & F.coalesce(F.octet_length("luminance") == SAMPLE_BYTES, F.lit(False))


def sound_video() -> Column:
    """Whether a row (width, height, display_aspect, duration_ticks, fps, codec, frames) is a usable video sample."""
    frames = F.coalesce((F.size("frames") == 5) & F.forall("frames", lambda f: F.coalesce(F.octet_length(f) == SAMPLE_BYTES, F.lit(False))), F.lit(False))
    out = frames & F.coalesce(F.trim("codec") != "", F.lit(False))
    for c in ("width", "height", "display_aspect", "duration_ticks", "fps"):
        out &= _finite(F.col(c))
    return out


def sampled(rows: DataFrame, sound: Column, failed: str) -> tuple[DataFrame, DataFrame]:
    """(usable, skipped) samples of rows (full_path, size_bytes, modified_ticks, before_*, after_* and the sample). A file
    that changed while it was read is skipped as such, whatever became of its sample."""
    same = F.lit(True)
    for when in ("before", "after"):
        same &= F.coalesce((F.col(f"{when}_size") == F.col("size_bytes")) & (F.col(f"{when}_ticks") == F.col("modified_ticks")), F.lit(False))
    rows = rows.withColumn("_skip", F.when(~same, CHANGED).when(~sound, failed))
    skipped = rows.where("_skip IS NOT NULL").select(F.col("full_path").alias("path"), F.col("_skip").alias("reason")).orderBy(*path_order("path"))
    return rows.where("_skip IS NULL").drop("_skip"), skipped


#: Error codes of decoders: (status, error type) (fixed values).
_BAD, _NO = "Invalid", "UnsupportedOrProtected"
IMAGE_ERRORS = {
    (_NO, "CodecUnavailable"): ("88982F50", "88982F80"),
    (_NO, "UnsupportedContainer"): ("88982F81",),
    (_BAD, "ImageDecodeFailure"): ("88982F07", "88982F60", "88982F61", "88982F62", "88982F63", "88982F70", "88982F72", "C00D36BE"),
}
MEDIA_ERRORS = {(_NO, "CodecUnavailable"): ("C00D5212",), (_NO, "UnsupportedContainer"): ("C00D36C4",), (_NO, "PasswordProtected"): ("C00D3700", "C00D714A"), (_BAD, "MediaOpenFailure"): ("C00D36BE", "C00D3E84")}


def probe_verdict(code: Column, kind: Column, image: bool) -> dict[str, Column]:
    """status and error_type of a decoder's failure by its code (hex digits), else by its kind (data, argument, unsupported,
    platform); null for other failures."""
    table = IMAGE_ERRORS if image else MEDIA_ERRORS
    rules = [(F.upper(code).isin(*codes), verdict) for verdict, codes in table.items()]
    rules += [(kind.isin("data", "argument"), (_BAD, "ImageDecodeFailure" if image else "MediaOpenFailure")), (kind.isin("unsupported", "platform"), (_NO, "UnsupportedContainer"))]
    out = {}
    for i, name in enumerate(("status", "error_type")):
        c = None
        for when, verdict in rules:
            c = (F if c is None else c).when(when, F.lit(verdict[i]))
        out[name] = c
    return out


def video_info(rows: DataFrame) -> DataFrame:
    """rows of raw properties (coded_width, coded_height, orientation, par_n, par_d, duration_ticks, fps_n, fps_d,
    video_codec, container, audio_codec, audio_bitrate, *_tracks) with geometry, codecs in one spelling and valid."""
    c = F.col
    no_par = (c("par_n") == 0) & (c("par_d") == 0)
    par = lambda n: F.when(no_par, F.lit(None).cast("long")).otherwise(c(n))
    geometry = display_geometry(c("coded_width"), c("coded_height"), par("par_n"), par("par_d"), c("orientation"))
    audio = c("audio_tracks")
    sound = (c("duration_ticks") > 0) & (c("fps_n") > 0) & (c("fps_d") > 0) & (c("video_tracks") == 1) & audio.isin(0, 1) & (c("metadata_tracks") == 0) & ((audio == 0) | F.coalesce(F.trim("audio_codec") != "", F.lit(False)))
    one = F.lit(1).cast("long")
    return rows.withColumns({
        **geometry,
        "valid": F.coalesce(sound, F.lit(False)) & geometry["width"].isNotNull(),
        "par_n": F.when(no_par, one).otherwise(c("par_n")), "par_d": F.when(no_par, one).otherwise(c("par_d")),
        "video_codec": codec(c("video_codec"), VIDEO_CODECS), "container": codec(c("container"), CONTAINERS),
        "audio_codec": F.when(audio != 0, codec(c("audio_codec"), AUDIO_CODECS)), "audio_bitrate": F.when(audio == 0, 0).otherwise(c("audio_bitrate")),
    })


def undone(members: DataFrame, snapshot: DataFrame, by: list[str] = ("digest", "size_bytes")) -> DataFrame:
    """members with the selection of a snapshot (full_path, selected); files that it doesn't know are not selected, and a
    group of which all files were selected keeps its newest."""
    before = snapshot.select(F.upper("full_path").alias("_u"), F.col("selected").alias("_was"))
    rows = members.withColumn("_u", F.upper("full_path")).join(before, "_u", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    state = rows.groupBy(*by).agg(F.min("_was").alias("_all"))
    newest = exact.keep_one(members.drop("selected"), "newest", by=list(by)).select("full_path", F.col("selected").alias("_rule"))
    rows = rows.join(state, list(by)).join(newest, "full_path")
    return rows.withColumn("selected", F.when(F.col("_all"), F.col("_rule")).otherwise(F.col("_was"))).drop("_u", "_was", "_all", "_rule")


def findings_totals(items: DataFrame) -> DataFrame:
    """One row of items (size_bytes, selected): all, selected, bytes selected, bytes of all."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = F.coalesce("size_bytes", F.lit(0))
    return items.agg(F.count("*").alias("n_items"), F.count_if("selected").alias("n_selected"), zero(F.sum(F.when(F.col("selected"), size))).alias("selected_bytes"), zero(F.sum(size)).alias("total_bytes"))


def outcome_counts(results: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    """How often each of the outcomes came, those that never did included."""
    names = results.sparkSession.createDataFrame([(o,) for o in outcomes], "outcome string")
    return names.join(results.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def all_skipped(inventory: DataFrame, analysis: DataFrame) -> DataFrame:
    """Skipped paths (path, reason): the inventory's first, then the analysis's, each by path; source tells which."""
    return inventory.select("path", "reason", F.lit(0).alias("source")).unionByName(analysis.select("path", "reason", F.lit(1).alias("source"))).orderBy("source", *path_order("path"))


def still_same(queue: DataFrame, inventory: DataFrame) -> DataFrame:
    """queue (full_path, size_bytes, modified_ticks) with current: whether the file is ordinary and unchanged now."""
    odd = paths.DIRECTORY | paths.REPARSE_POINT | paths.DEVICE
    now = inventory.select(F.upper("full_path").alias("_u"), F.col("size_bytes").alias("_s"), F.col("modified_ticks").alias("_t"), paths.has(F.col("attributes"), odd).alias("_odd"))
    rows = queue.withColumn("_u", F.upper("full_path")).join(now, "_u", "left")
    return rows.withColumn("current", F.coalesce(~F.col("_odd") & (F.col("_s") == F.col("size_bytes")) & (F.col("_t") == F.col("modified_ticks")), F.lit(False))).drop("_u", "_s", "_t", "_odd")


def request_fault(source: Column, destination: Column, length: Column) -> Column:
    """What is wrong with a request to write a video beside another; null where nothing is."""
    absolute = lambda p: F.coalesce(p.startswith("/"), F.lit(False))
    whole = absolute(source) & absolute(destination) & (length >= 0)
    sibling = (F.upper(source) != F.upper(destination)) & (F.upper(paths.parent(source)) == F.upper(paths.parent(destination))) & (paths.extension(destination) == ".mp4")
    return F.when(~whole, "Video optimization requires fully qualified source and output paths and a valid source snapshot.").when(~sibling, "The output must be a different sibling .mp4 path.")


# --- options, settings, scope and progress: plain values on the driver -----------------------------------------------

#: What each tool takes beside the scope, with its range (fixed values).
RANGES = {"BigFiles": ("minimum_bytes", 0, None), "TemporaryFiles": ("age_ticks", 0, None), "SimilarImages": ("distance", 0, 12), "SimilarVideos": ("mean", 0, 13), "MusicDuplicates": ("difference_ticks", 0, None)}
PLAIN_TOOLS = ("EmptyFolders", "EmptyFiles", "InvalidLinks", "BrokenFiles", "BadExtensions", "BadNames")


def check_scan(min_size: int, max_size: int | None = None, workers: int | None = None) -> None:
    """Raises ValueError for sizes or a number of hashing workers (none: chosen automatically) out of range."""
    if min_size < 0 or (max_size is not None and max_size < min_size):
        raise ValueError("sizes must be 0 <= min_size <= max_size")
    if workers not in (None, 1, 2, 4, 8):
        raise ValueError("hashing workers must be 1, 2, 4, 8 or chosen automatically")


def check_options(tool: str, options: dict[str, int], media_workers: int = 1) -> None:
    """Raises ValueError for options that a tool doesn't take or that are out of range."""
    if media_workers not in (1, 2, 4):
        raise ValueError("media workers must be 1, 2 or 4")
    name, low, high = RANGES.get(tool, (None, 0, None))
    if tool not in RANGES and tool not in PLAIN_TOOLS or set(options) != ({name} if name else set()):
        raise ValueError(f"options do not match {tool}")
    if name and not (low <= options[name] and (high is None or options[name] <= high)):
        raise ValueError(f"{name} is out of range")


@dataclass(frozen=True)
class Settings:
    """Defaults of a user; normal() brings what was read from a file into range."""

    min_bytes: int = 1
    verify_bytes: bool = True
    ignore_hidden: bool = True
    ignore_system: bool = True
    subfolders: bool = True
    large_bytes: int = 1 << 30
    temporary_days: int = 7
    image_preset: str = "balanced"
    video_preset: str = "balanced"
    media_workers: int | None = None
    hashing_workers: int | None = None

    def normal(self) -> Settings:
        preset = lambda p: p if p in ("strict", "balanced", "loose") else "balanced"
        return replace(
            self, min_bytes=max(0, self.min_bytes), large_bytes=max(0, self.large_bytes), temporary_days=min(365, max(1, self.temporary_days)), image_preset=preset(self.image_preset), video_preset=preset(self.video_preset),
            media_workers=self.media_workers if self.media_workers in (1, 2, 4) else None, hashing_workers=self.hashing_workers if self.hashing_workers in (1, 2, 4, 8) else None,
        )


@dataclass(frozen=True)
class Scope:
    """Paths to look at and to leave out; a path is in one of both lists at most, without regard to case."""

    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def include(self, path: str) -> Scope:
        return self._put(path, "included", "excluded")

    def exclude(self, path: str) -> Scope:
        return self._put(path, "excluded", "included")

    def _put(self, path: str, to: str, other: str) -> Scope:
        path = path.strip()
        same = lambda p: p.rstrip("/").upper() == path.rstrip("/").upper()
        rest = tuple(p for p in getattr(self, other) if not same(p))
        own = getattr(self, to)
        return replace(self, **{other: rest, to: own if not path or any(map(same, own)) else (*own, path)})


def eta_text(done: int, total: int, elapsed_s: float) -> str:
    """The time that is left at the pace so far: -, <1s, or whole seconds rounded up."""
    if total <= 0 or done <= 0:
        return "-"
    left = elapsed_s * (total - done) / done
    return "<1s" if left < 1 else f"{-int(-left // 1):,}s"


def whole_progress(index: int, total: int, share: float, before: float = 0.0) -> float:
    """Percent of a queue of total files in the middle of one; never less than before."""
    return max(before, (index + min(1.0, max(0.0, share))) * 100 / total)

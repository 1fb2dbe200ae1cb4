"""Decisions about media: video profiles and their verification, metadata queries to remove, probe routing. All of it is
projections; nothing is transcoded or rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.functions import paths
from filegrove.functions.paths import path_order
from filegrove.functions.text import TICKS_PER_SECOND

AUDIO_CAP = 192_000
#: Limits of each preset: width, height, frames a second, bits a second (fixed values).
PRESETS = {"Smaller": (1280, 720, 30, 3_500_000), "Balanced": (1920, 1080, 60, 8_000_000), "HighQuality": (3840, 2160, 60, 20_000_000)}
#: Names of codecs in one spelling (fixed values).
CONTAINERS = {"MPEG4": "MP4", "MP4": "MP4"}
VIDEO_CODECS = {"H264": "H.264", "H264ES": "H.264", "H.264": "H.264", "HEVC": "HEVC", "HEVCES": "HEVC"}
AUDIO_CODECS = {"AAC": "AAC", "AACADTS": "AAC ADTS", "AAC ADTS": "AAC ADTS"}
#: What may become of a video, and of a picture whose metadata is cleaned (fixed values).
VIDEO_OUTCOMES = ("Succeeded", "KeptWithoutSaving", "NoSpaceSaving", "SourceChanged", "CodecNotFound", "InvalidProfile", "UnsupportedInput", "VerificationFailed", "DestinationCollision", "RecoveryRequired", "Failed")
EXIF_OUTCOMES = ("Succeeded", "SourceChanged", "UnsupportedFormat", "UnsupportedMetadataLayout", "DestinationCollision", "VerificationFailed", "RecoveryRequired", "Failed")


def codec(value: Column, names: dict[str, str]) -> Column:
    """A codec's usual name; unknown ones as they are, trimmed."""
    plain = F.trim(value)
    out = None
    for key, name in names.items():
        out = (F if out is None else out).when(F.upper(plain) == key, F.lit(name))
    return out.otherwise(plain)


def display_geometry(width: Column, height: Column, par_n: Column, par_d: Column, orientation: Column) -> dict[str, Column]:
    """Width, height, square-pixel width and height and aspect ratio, after quarter turns; a null pixel aspect is 1, and
    sizes or aspects of 0 give nulls."""
    par = F.when(par_n.isNull() | par_d.isNull(), F.lit(1.0)).when((par_n > 0) & (par_d > 0), par_n.cast("double") / par_d)
    good = (width > 0) & (height > 0) & par.isNotNull()
    turned = orientation.isin("Rotate90", "Rotate270")
    wide = width * par
    out = {
        "width": F.when(turned, height).otherwise(width),
        "height": F.when(turned, width).otherwise(height),
        "display_width": F.when(turned, height.cast("double")).otherwise(wide),
        "display_height": F.when(turned, wide).otherwise(height.cast("double")),
    }
    out["display_aspect"] = out["display_width"] / out["display_height"]
    return {k: F.when(good, v) for k, v in out.items()}


def _said(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _positive(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        c = F.col(n).cast("double")
        out &= F.coalesce((c > 0) & ~F.isnan(c) & (c != float("inf")), F.lit(False))
    return out


_SIZES = ("width", "height", "display_width", "display_height", "display_aspect", "par_n", "par_d", "duration_ticks", "fps_n", "fps_d")


def usable_video() -> Column:
    """Whether a row of video metadata is complete and of one video and at most one audio track."""
    audio = F.col("audio_tracks")
    return _positive(*_SIZES) & _said(F.col("video_codec")) & _said(F.col("container")) & (F.col("video_tracks") == 1) & audio.isin(0, 1) & (F.col("metadata_tracks") == 0) & ((audio == 0) | _said(F.col("audio_codec")))


def video_profiles(media: DataFrame, preset: str) -> DataFrame:
    """media with the profile to make of each video (t_*), or outcome UnsupportedInput and nulls.

    Pictures shrink to the preset's box, never grow, and get even sides; rates are capped; audio is kept at up to
    192 kbit/s."""
    max_w, max_h, fps_cap, bits_cap = PRESETS[preset]
    scale = F.least(F.lit(1.0), max_w / F.col("display_width"), max_h / F.col("display_height"))
    even = lambda c: (F.floor(F.col(c) * scale / 2) * 2).cast("long")
    width, height = even("display_width"), even("display_height")
    good = usable_video() & (width >= 2) & (height >= 2)
    within = F.col("fps_n").cast("long") <= F.lit(fps_cap).cast("long") * F.col("fps_d")
    rate = lambda c, cap: F.when(F.col(c) == 0, F.lit(cap)).otherwise(F.least(F.col(c), F.lit(cap))).cast("long")
    audio = F.col("audio_tracks") == 1
    made = {
        "t_width": width,
        "t_height": height,
        "t_fps_n": F.when(within, F.col("fps_n")).otherwise(fps_cap).cast("long"),
        "t_fps_d": F.when(within, F.col("fps_d")).otherwise(1).cast("long"),
        "t_video_bitrate": rate("video_bitrate", bits_cap),
        "t_audio_bitrate": F.when(audio, rate("audio_bitrate", AUDIO_CAP)).otherwise(0).cast("long"),
        "t_audio_codec": F.when(audio, F.lit("AAC")),
    }
    return media.withColumns({k: F.when(good, v) for k, v in made.items()}).withColumn("outcome", F.when(~F.coalesce(good, F.lit(False)), "UnsupportedInput"))


#: Messages of verify_video, in the order of the rules (fixed values).
VIDEO_FAULTS = (
    "The optimized output reported invalid or zero media metadata.",
    "The optimized output is not an MP4 file with H.264 video.",
    "The optimized output has an unsupported video or timed-metadata track layout.",
    "The optimized output dimensions do not match the calculated profile.",
    "The optimized output does not use square pixels.",
    "The optimized output unexpectedly upscaled the source.",
    "The optimized output aspect ratio changed beyond the even-dimension tolerance.",
    "The optimized output frame rate does not match the calculated profile.",
    "The optimized output unexpectedly added an audio track.",
    "The optimized output audio does not match the calculated AAC profile.",
    "The optimized output duration differs from the source by more than one second.",
)
VIDEO_SOUND = "The optimized output passed media verification."


def verify_video(rows: DataFrame) -> DataFrame:
    """rows of a source, its profile (t_*) and the output's metadata (o_* of the same names) with verified and detail: the
    first rule that the output breaks."""
    c = F.col
    o = lambda n: F.col(f"o_{n}")
    aspect = F.abs(o("display_aspect") - c("display_aspect")) / F.greatest(o("display_aspect"), c("display_aspect"))
    no_audio = c("audio_tracks") == 0
    audio = (o("audio_tracks") == 1) & (F.upper(o("audio_codec")) == "AAC") & (o("audio_bitrate") > 0) & (o("audio_bitrate") <= c("t_audio_bitrate"))
    broken = (
        ~(_positive(*(f"o_{n}" for n in _SIZES)) & _said(o("container")) & _said(o("video_codec"))),
        (F.upper(o("container")) != "MP4") | (F.upper(o("video_codec")) != "H.264"),
        (o("video_tracks") != 1) | (o("metadata_tracks") != 0),
        (o("width") != c("t_width")) | (o("height") != c("t_height")) | (o("display_width") != c("t_width")) | (o("display_height") != c("t_height")),
        o("par_n") != o("par_d"),
        (o("display_width") > c("display_width")) | (o("display_height") > c("display_height")),
        aspect > 2.0 / F.least(c("t_width"), c("t_height")),
        o("fps_n") * c("t_fps_d") != c("t_fps_n") * o("fps_d"),
        no_audio & (o("audio_tracks") != 0),
        ~no_audio & ~F.coalesce(audio, F.lit(False)),
        F.abs(o("duration_ticks") - c("duration_ticks")) > TICKS_PER_SECOND,
    )
    detail = None
    for wrong, said in zip(broken, VIDEO_FAULTS, strict=True):
        detail = (F if detail is None else detail).when(wrong, F.lit(said))
    detail = detail.otherwise(VIDEO_SOUND)
    return rows.withColumn("detail", detail).withColumn("verified", F.col("detail") == VIDEO_SOUND)


def size_gate(rows: DataFrame, keep_larger: bool = False) -> DataFrame:
    """rows (source_bytes, output_bytes, destination_taken) with saved_bytes and outcome."""
    saved = F.col("source_bytes") - F.col("output_bytes")
    outcome = F.when((saved <= 0) & (not keep_larger), "NoSpaceSaving").when(F.col("destination_taken"), "DestinationCollision").when(saved <= 0, "KeptWithoutSaving").otherwise("Succeeded")
    return rows.withColumns({"saved_bytes": saved, "outcome": outcome})


# --- metadata of pictures --------------------------------------------------------------------------------------------

#: Tags that each option removes: of the first directory, then of the EXIF directory (fixed values).
TAGS = {
    "device": ((271, 272), (37500, 42016, 42032, 42033, 42035, 42036, 42037)),
    "dates": ((306,), (36867, 36868, 36880, 36881, 36882, 37520, 37521, 37522)),
    "author": ((270, 315, 33432, 40091, 40092, 40093, 40094, 40095), (37510,)),
}
OPTIONS = ("gps", "device", "dates", "author", "thumbnail", "xmp")


def metadata_queries(container: str, options: tuple[str, ...] = OPTIONS) -> list[str]:
    """Paths of the metadata that these options remove from a Jpeg or Tiff, in order."""
    jpeg = container == "Jpeg"
    top = "/app1/ifd" if jpeg else "/ifd"
    out = [f"{top}/gps"] if "gps" in options else []
    for option, (first, second) in TAGS.items():
        if option in options:
            out += [f"{folder}/{{ushort={t}}}" for folder, tags in ((top, first), (f"{top}/exif", second)) for t in tags]
    if jpeg and "author" in options:
        out.append("/com")
    if "thumbnail" in options:
        out.append("/app1/thumb" if jpeg else "/ifd/thumb")
    if "xmp" in options:
        out += ["/xmp", "/app13/irb/8bimiptc/iptc"] if jpeg else ["/ifd/xmp", "/ifd/iptc", "/ifd/irb/8bimiptc/iptc"]
    return out


def selected_queries(container: Column, options: dict[str, Column]) -> Column:
    """metadata_queries() by row: options are boolean columns."""
    def of(kind: str) -> Column:
        parts = [F.when(on, F.array(*map(F.lit, metadata_queries(kind, (name,))))).otherwise(F.expr("cast(array() as array<string>)")) for name, on in options.items()]
        return F.flatten(F.array(*parts))

    return F.when(container == "Jpeg", of("Jpeg")).otherwise(of("Tiff"))


def verify_metadata(rows: DataFrame) -> DataFrame:
    """rows (container, render, metadata of a source; o_container, o_render, o_metadata of its output; selected) with
    verified: same container and render state, selected paths gone, all other known paths as they were."""
    known = F.when(F.col("container") == "Jpeg", F.array(*map(F.lit, metadata_queries("Jpeg")))).otherwise(F.array(*map(F.lit, metadata_queries("Tiff"))))
    gone = ~F.exists("selected", lambda q: F.map_contains_key("o_metadata", q))
    same = F.forall(F.array_except(known, F.col("selected")), lambda q: F.try_element_at("metadata", q).eqNullSafe(F.try_element_at("o_metadata", q)))
    return rows.withColumn("verified", (F.col("container") == F.col("o_container")) & F.col("render").eqNullSafe(F.col("o_render")) & gone & same)


# --- queues and small rules ------------------------------------------------------------------------------------------


def exif_queue(files: DataFrame) -> DataFrame:
    """Pictures whose metadata can be removed."""
    plain = ~paths.has(F.col("attributes"), paths.DIRECTORY | paths.REPARSE_POINT | paths.DEVICE)
    return files.where(F.lower("extension").isin(".jpg", ".jpeg", ".tif", ".tiff") & plain).orderBy(*path_order("full_path"))


def video_queue(files: DataFrame) -> DataFrame:
    """Videos in the order in which they are worked on."""
    plain = ~paths.has(F.col("attributes"), paths.DIRECTORY | paths.REPARSE_POINT | paths.DEVICE)
    return files.where(F.lower("extension").isin(*paths.category_extensions(["Video"])) & plain).orderBy(*path_order("full_path"))


def media_route(detected: Column, extension: Column) -> Column:
    """Whether a container is opened as Audio or Video: by its type, and where both are usual by the extension."""
    ext = F.lower(extension)
    audio = detected.isin("MP3", "FLAC", "WAV") | ((detected == "Ogg") & (ext != ".ogv")) | (detected.isin("MP4", "ISO BMFF") & (ext == ".m4a")) | (detected.isin("Matroska", "EBML") & (ext == ".mka"))
    return F.when(audio, "Audio").otherwise("Video")


def preview_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """A picture's size in a box of most by most: the longer side at most, the other rounded half up, at least 1."""
    fits = (width <= most) & (height <= most)
    scaled = lambda a, b: F.greatest(F.lit(1), F.round(a.cast("double") * most / b).cast("int"))
    wide = F.when(fits, width).when(width >= height, F.lit(most)).otherwise(scaled(width, height))
    high = F.when(fits, height).when(width >= height, scaled(height, width)).otherwise(F.lit(most))
    return wide, high

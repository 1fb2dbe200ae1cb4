"""Similar images and videos, and music by tags: lossless joins of blocks of hashes, components, references and ordinal group ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.functions import text
from filegrove.functions.paths import path_order
from filegrove.functions.perceptual import close_hashes, close_sums, hamming, percent
from filegrove.operators.graph import connected
from filegrove.operators.ranges import carried
from filegrove.operators.tables import Scratch, numbered, stored

FRAMES = 5
#: What a user's choice of closeness means (fixed values).
IMAGE_PRESETS = {"strict": 4, "balanced": 8, "loose": 12}
VIDEO_PRESETS = {"strict": 5, "balanced": 9, "loose": 13}
MUSIC_TICKS = 2 * text.TICKS_PER_SECOND


#: Rows of a block: two blocks meet in a task. At least eight blocks share the work of many rows; a task holds two.
BLOCK_LEAST, BLOCK_MOST = 1 << 14, 1 << 20


def _near(rows: DataFrame, step: Column, columns: list[str], close: Callable[[dict, dict], Iterator[tuple[np.ndarray, np.ndarray]]], keep: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of ids, a < b, of rows of the same or the next step that are close. Rows with nulls in step or
    columns are left out.

    The rows of a step are dealt to blocks, and each two blocks of it, or of it and the next one, meet in a task, whatever
    their values are. So a row is shuffled about once for each block, and no key can hold more than its share. close(x, y)
    takes the columns of two blocks as arrays and gives the places of close rows, some at a time."""
    dealt = keep(rows.select("id", *columns, step.cast("long").alias("_step")).dropna(), "dealt")
    counts = dealt.groupBy("_step").agg(F.count("*").alias("_n"))
    size = min(max(dealt.count() // 8, BLOCK_LEAST), BLOCK_MOST)
    blocks = keep(counts.select("_step", F.ceil(F.col("_n") / size).cast("long").alias("_own")), "blocks", 1)  # a row a step
    beside = lambda by, name: blocks.select((F.col("_step") + by).alias("_step"), F.col("_own").alias(name))
    blocks = blocks.join(beside(-1, "_next"), "_step", "left").join(beside(1, "_before"), "_step", "left").na.fill(0)
    tasks = blocks.agg(F.sum(F.expr("_own * (_own + 1) div 2 + _own * _next"))).first()[0] or 1

    def met(count: str, meeting: str) -> str:
        return f"if({count} > 0, transform(sequence(1, greatest({count}, 1)), x -> {meeting}), array())"

    meetings = [
        met("_own", "named_struct('step', _step, 'over', 0, 'p', least(_block, x), 'q', greatest(_block, x), 'side', if(x < _block, 1, 0))"),
        met("_next", "named_struct('step', _step, 'over', 1, 'p', _block, 'q', x, 'side', 0)"),
        met("_before", "named_struct('step', _step - 1, 'over', 1, 'p', x, 'q', _block, 'side', 1)"),
    ]
    block = F.pmod(F.xxhash64("id"), F.col("_own")) + 1
    sent = dealt.join(F.broadcast(blocks), "_step").withColumn("_block", block).select("id", *columns, F.explode(F.expr(f"concat({', '.join(meetings)})")).alias("_m"))
    key = ["step", "over", "p", "q"]
    sent = sent.select("id", *columns, "_m.*").repartition(min(3 * tasks, 4000), *key)  # few share a task by chance

    def pairs(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        held = {c: table[c].to_numpy() for c in ["id", *columns, "side"]}
        _, over, p, q = (x.as_py() for x in of)
        own = not over and p == q
        x = {c: v[held["side"] == 0] for c, v in held.items()}
        y = x if own else {c: v[held["side"] == 1] for c, v in held.items()}
        found, n = [], 0
        for i, j in close(x, y):
            a, b = x["id"][i], y["id"][j]
            if own:
                a, b = a[a < b], b[a < b]
            found.append((np.minimum(a, b), np.maximum(a, b)))
            n += len(a)
            if n > 50_000:
                yield _ids(found)
                found, n = [], 0
        yield _ids(found)

    return keep(sent.groupBy(*key).applyInArrow(pairs, "a long, b long"), "pairs")


def _ids(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = [np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["a", "b"])


def _image_edges(rows: DataFrame, distance: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of ids of rows (id, hash, width, height), a table, that are similar."""
    if not 0 <= distance <= 12:
        raise ValueError("the distance must lie between 0 and 12")

    def close(x: dict, y: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in close_hashes(x["hash"].view(np.uint64), y["hash"].view(np.uint64), distance):
            near = _within(x["ratio"][i], y["ratio"][j])
            yield i[near], j[near]

    return _near(rows.withColumn("ratio", F.col("width").cast("double") / F.col("height")), F.lit(0), ["hash", "ratio"], close, keep)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """aspect_close() of arrays."""
    with np.errstate(all="ignore"):
        return np.abs(a - b) / np.maximum(a, b) <= 0.05


def _named(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs of ids with full_path and columns of both, the lesser path as a."""
    side = lambda x: rows.select(F.col("id").alias(x), F.struct("full_path", *columns).alias(f"{x}_row"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    ordered = F.when(F.col("a_row.full_path") < F.col("b_row.full_path"), F.struct(F.col("a_row").alias("a"), F.col("b_row").alias("b"))).otherwise(F.struct(F.col("b_row").alias("a"), F.col("a_row").alias("b")))
    return both.select(ordered.alias("p")).select("p.a", "p.b")


def image_pairs(images: DataFrame, distance: int) -> DataFrame:
    """(a_path, b_path, distance) of images (full_path, hash, width, height) whose hashes differ in at most distance bits
    and whose aspect ratios differ by at most a twentieth. a_path < b_path.

    Blocks of pictures meet in tasks, which compare those that are near in a piece of the hash (see close_hashes); that loses
    no pair. All pairs of equal hashes are among the result; image_groups needs no such pairs."""
    with Scratch("images") as keep:
        rows = keep(images.select("full_path", "hash", "width", "height").withColumn("id", F.monotonically_increasing_id()), "rows")
        named = _named(_image_edges(rows, distance, keep), rows, ["hash"])
        return stored(named.select(F.col("a.full_path").alias("a_path"), F.col("b.full_path").alias("b_path"), hamming(F.col("a.hash"), F.col("b.hash")).alias("distance")), "image-pairs")


def duration_close(a: Column, b: Column) -> Column:
    """Within two seconds or a fiftieth (whole ticks) of the longer."""
    longer = F.greatest(a, b)
    return (longer - F.least(a, b) <= 2 * text.TICKS_PER_SECOND) | (longer - F.least(a, b) <= (longer - longer % 50) / 50)


def total_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, d: s + d)


def _video_edges(rows: DataFrame, mean: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of ids of rows (id, hashes, display_aspect, duration_ticks), a table, that are similar."""
    if not 0 <= mean <= 13:
        raise ValueError("the mean distance must lie between 0 and 13")
    # two rows that are close lie within 2 s or 2 %: on this scale less than one step apart
    step = F.floor(F.log(F.col("duration_ticks") / (100.0 * text.TICKS_PER_SECOND) + 1) / 0.0203).cast("int")
    frames = [f"hash{i}" for i in range(FRAMES)]
    flat = rows.select("id", "duration_ticks", "display_aspect", *[F.get("hashes", F.lit(i)).alias(c) for i, c in enumerate(frames)])

    def close(x: dict, y: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashes = lambda z: np.stack([z[c] for c in frames]).view(np.uint64)
        for i, j in close_sums(hashes(x), hashes(y), FRAMES * mean):
            longer = np.maximum(x["duration_ticks"][i], y["duration_ticks"][j])
            apart = longer - np.minimum(x["duration_ticks"][i], y["duration_ticks"][j])
            near = ((apart <= 2 * text.TICKS_PER_SECOND) | (apart <= longer // 50)) & _within(x["display_aspect"][i], y["display_aspect"][j])
            yield i[near], j[near]

    return _near(flat, step, ["duration_ticks", "display_aspect", *frames], close, keep)


def video_pairs(videos: DataFrame, mean: int) -> DataFrame:
    """(a_path, b_path, total) of videos (full_path, hashes, display_aspect, duration_ticks) whose five hashes differ in at
    most 5 x mean bits in sum, with close durations and aspect ratios. a_path < b_path.

    Durations meet by steps on a logarithmic scale, each in its own and the next, so far lengths never meet. Of what meets
    every sum is looked at, no further than two frames where these are over it (see close_sums)."""
    with Scratch("videos") as keep:
        rows = keep(videos.select("full_path", "hashes", "display_aspect", "duration_ticks").withColumn("id", F.monotonically_increasing_id()), "rows")
        named = _named(_video_edges(rows, mean, keep), rows, ["hashes"])
        return stored(named.select(F.col("a.full_path").alias("a_path"), F.col("b.full_path").alias("b_path"), total_distance(F.col("a.hashes"), F.col("b.hashes")).alias("total")), "video-pairs")


def _numbered(refs: DataFrame, prefix: str) -> DataFrame:
    """refs (ref_path, ...) with group_id by the order of reference paths."""
    return numbered(refs, [F.upper("ref_path"), F.col("ref_path")], "_number").withColumn("group_id", F.format_string(f"{prefix}-%04d", "_number")).drop("_number")


def _labelled(items: DataFrame, keys: list[str], edges, keep: Scratch) -> DataFrame:
    """items with the label of their group, those without a group left out. Items of equal evidence (keys) are one node, so
    copies cost a row each, not a pair for each two; edges(rows, keep) gives the pairs of ids."""
    ones = keep(items.select(*keys).distinct().withColumn("id", F.monotonically_increasing_id()), "ones")
    labels = connected(edges(ones, keep)).select(F.col("node").alias("id"), "label")
    members = items.join(ones, keys).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).drop("id")
    # as a table: Spark can split the join where one group has very many items
    several = keep(members.groupBy("label").agg(F.count("*").alias("_n")).where("_n > 1").select("label"), "several")
    return members.join(several, "label")


def _grouped(members: DataFrame, columns: list[str], best: list[Column], prefix: str, distance) -> DataFrame:
    """Labelled items with group_id, is_reference, distance to the reference and place in the group."""
    pick = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*best, *path_order("full_path")])], *[F.col(c).alias(f"v_{c}") for c in columns])).alias("r")
    refs = members.groupBy("label").agg(pick).select("label", *[F.col(f"r.v_{c}").alias(f"ref_{c}") for c in columns])
    refs = _numbered(refs.withColumnRenamed("ref_full_path", "ref_path"), prefix)
    rows = members.join(refs, "label").withColumn("is_reference", F.col("full_path") == F.col("ref_path"))
    return rows.withColumn("distance", distance()).drop("label")


def image_groups(images: DataFrame, distance: int) -> DataFrame:
    """Items of groups of similar images: components of image_pairs, so a member may be farther from the reference than the
    distance. The reference is the largest picture, then the largest file, then first by path; ids follow its path. An item's
    metadata and its group's say what they are."""
    with Scratch("images") as keep:
        members = stored(_labelled(images, ["hash", "width", "height"], lambda rows, keep: _image_edges(rows, distance, keep), keep), "image-members")
    best = [-(F.col("width").cast("long") * F.col("height")), -F.col("size_bytes")]
    rows = _grouped(members, images.columns, best, "image", lambda: hamming(F.col("hash"), F.col("ref_hash")))
    said = {"Width": "width", "Height": "height", "Format": "format", "HammingDistance": "distance"}
    rows = _described(rows.withColumn("similarity_percent", percent(F.col("distance"))), said, {"Type": "Image", "MaximumHammingDistance": str(distance)})
    return rows.orderBy("group_id", F.desc("is_reference"), "distance", *path_order("full_path"))


def video_groups(videos: DataFrame, mean: int) -> DataFrame:
    """Items of groups of similar videos; the reference is the largest picture, then bitrate, file and path."""
    with Scratch("videos") as keep:
        members = stored(_labelled(videos, ["hashes", "display_aspect", "duration_ticks"], lambda rows, keep: _video_edges(rows, mean, keep), keep), "video-members")
    best = [-(F.col("width").cast("long") * F.col("height")), -F.col("bitrate"), -F.col("size_bytes")]
    rows = _grouped(members, videos.columns, best, "video", lambda: total_distance(F.col("hashes"), F.col("ref_hashes")) / F.lit(float(FRAMES)))
    said = {"Width": "width", "Height": "height", "Duration": text.span_text(F.col("duration_ticks")), "Bitrate": "bitrate", "FramesPerSecond": text.number_text(F.col("fps")) if "fps" in rows.columns else "fps", "Codec": "codec", "MeanFrameDistance": text.number_text(F.col("distance"))}
    rows = _described(rows.withColumn("similarity_percent", percent(F.col("distance"))), said, {"Type": "Video", "MaximumMeanFrameDistance": str(mean)})
    return rows.orderBy("group_id", F.desc("is_reference"), "distance", *path_order("full_path"))


def _described(rows: DataFrame, said: dict[str, str | Column], group: dict[str, str]) -> DataFrame:
    """rows with metadata and group_metadata, maps of texts. What a table has no column for is left out."""
    there = {k: F.col(c) if isinstance(c, str) else c for k, c in said.items() if not isinstance(c, str) or c in rows.columns}
    own = F.create_map(*[x for k, c in there.items() for x in (F.lit(k), F.coalesce(c.cast("string"), F.lit("")))])
    return rows.withColumns({"metadata": own, "group_metadata": F.create_map(*[F.lit(x) for pair in group.items() for x in pair])})


def music_keys(tracks: DataFrame, ready: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates with title_key and artist_key, skipped: path, reason). ready: titles and artists are in compatibility
    form, so that no Python runs."""
    def keyed(some: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
        return some.withColumns({"title_key": key(F.col("title")), "_a": key(F.col("artist")), "_b": key(F.col("album_artist"))})

    as_is = lambda c: text.spelled(F.coalesce(c, F.lit("")))
    plain = F.lit(True) if ready else ~F.concat_ws("", "title", "artist", "album_artist").rlike(r"[^\x00-\x7F]")
    rows = keyed(tracks.where(plain), as_is)
    if not ready:  # a branch of an expression would send all rows to Python
        rows = rows.unionByName(keyed(tracks.where(~plain), text.search_key))
    rows = rows.withColumn("artist_key", F.when(F.col("_a") != "", F.col("_a")).otherwise(F.col("_b"))).withColumn("chosen_artist", F.when(F.col("_a") != "", F.col("artist")).otherwise(F.col("album_artist")))
    reason = F.when(~F.coalesce(F.col("duration_ticks") > 0, F.lit(False)), "Could not read music metadata.").when((F.col("title_key") == "") | (F.col("artist_key") == ""), "Required music metadata is missing.")
    rows = rows.withColumn("_reason", reason).drop("_a", "_b")
    return rows.where("_reason IS NULL").drop("_reason"), rows.where("_reason IS NOT NULL").select(F.col("full_path").alias("path"), F.col("_reason").alias("reason")).orderBy(*path_order("path"))


#: Distinct values of one key that are folded in one row; keys with more are linked instead.
FOLDED = 1000


def anchored_clusters(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """rows with cluster: runs of a key's rows, by value, that lie within most of the run's first (no chaining). Rows with
    a null key or value are left out.

    Only distinct values are looked at, and rows are joined to them, so copies of one value cost nothing. Keys of up to
    FOLDED values are settled in a row each; no row holds those of a larger one (see _anchors)."""
    values = stored(rows.select(*keys, F.col(value).cast("long").alias("v")).dropna().distinct(), "values")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > FOLDED).drop("n"), "large-keys")
    small = _folded(values.join(large, keys, "left_anti"), keys, most)
    anchors = small if large.isEmpty() else small.unionByName(_anchors(values.join(large, keys, "left_semi"), keys, most))
    return rows.join(anchors.withColumnRenamed("v", value), [*keys, value])


def _folded(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, v, cluster), each key in one fold."""
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.expr("cast(array() as array<struct<v:bigint,anchor:bigint>>)").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        anchor = F.when(acc["anchor"].isNull() | (v - acc["anchor"] > most), v).otherwise(acc["anchor"])
        return F.struct(anchor.alias("anchor"), F.array_append(acc["out"], F.struct(v.alias("v"), anchor.alias("anchor"))).alias("out"))

    each = values.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    folded = each.select(*keys, F.explode(F.aggregate("vs", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select(*keys, "x.v", F.col("x.anchor").alias("cluster"))


def _anchors(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, v, cluster) without a row or task for a key: each value is linked to the next one beyond its reach, links are
    doubled until the first value has reached all anchors, and each value looks back for the nearest anchor."""
    by = [F.col(k) for k in keys]
    points = values.select(*keys, F.col("v").alias("at"), F.col("v").alias("point"), F.lit(None).cast("long").alias("asks"))
    reaches = values.select(*keys, (F.col("v") + most).alias("at"), F.lit(None).cast("long").alias("point"), F.col("v").alias("asks"))
    # at one place, what asks stands behind the point: its next one lies beyond
    both = carried(points.unionByName(reaches), keys, [F.col("at"), F.coalesce("asks", F.lit(-(1 << 63)))], F.col("point"), "next", forward=False)
    jumps = stored(both.where("asks IS NOT NULL AND next IS NOT NULL").select(*keys, F.col("asks").alias("v"), "next"), "links")
    reached = stored(values.groupBy(*keys).agg(F.min("v").alias("v")), "anchors")
    while not jumps.isEmpty():
        new = reached.join(jumps, [*keys, "v"]).select(*keys, F.col("next").alias("v"))
        reached = stored(reached.unionByName(new).distinct(), "anchors")
        further = jumps.withColumnRenamed("next", "v2").join(jumps.select(*by, F.col("v").alias("v2"), "next"), [*keys, "v2"])
        jumps = stored(further.select(*keys, "v", "next"), "links")
    marked = values.join(reached.withColumn("cluster", F.col("v")), [*keys, "v"], "left")
    return carried(marked.withColumnRenamed("cluster", "_own"), keys, [F.col("v")], F.col("_own"), "cluster").select(*keys, "v", "cluster")


def music_groups(candidates: DataFrame, most: int = MUSIC_TICKS) -> DataFrame:
    """Items of groups of equal title and artist whose durations lie within most ticks of the group's shortest."""
    if most < 0:
        raise ValueError("the difference must not be negative")
    keys = ["title_key", "artist_key"]
    by = [*keys, "cluster"]
    rows = stored(anchored_clusters(candidates, keys, "duration_ticks", most), "music-clusters")  # read three times
    pick = F.min(F.struct((-F.col("bitrate")).alias("o0"), (-F.col("size_bytes")).alias("o1"), F.upper("full_path").alias("o2"), F.col("full_path").alias("ref_path"), F.col("duration_ticks").alias("ref_ticks")))
    refs = rows.groupBy(*by).agg(F.count("*").alias("n"), pick.alias("r")).where("n > 1").select(*by, F.col("r.ref_path").alias("ref_path"), F.col("r.ref_ticks").alias("ref_ticks"))
    out = rows.join(_numbered(refs, "music"), by).withColumn("is_reference", F.col("full_path") == F.col("ref_path"))
    out = out.withColumn("difference_ticks", F.abs(F.col("duration_ticks") - F.col("ref_ticks"))).withColumn("similarity_percent", F.lit(100.0))
    genres = F.array_join("genres", ", ") if "genres" in out.columns else "genres"
    said = {"Confidence": F.lit("High"), "Title": "title", "Artist": "artist", "AlbumArtist": "album_artist", "Album": "album", "TrackNumber": "track", "Year": "year", "Genres": genres, "Bitrate": "bitrate", "Duration": text.span_text(F.col("duration_ticks")), "DurationDifference": text.span_text(F.col("difference_ticks"))}
    out = _described(out, said, {"Type": "Music metadata", "Confidence": "High", "MaximumDurationDifference": text.span(most)})
    return out.orderBy("group_id", F.desc("is_reference"), "difference_ticks", *path_order("full_path"))


def changed(stored: DataFrame, fresh: DataFrame, evidence: list[str]) -> DataFrame:
    """Stored items whose fresh evidence (by full_path) is missing or differs in any of the columns."""
    other = fresh.select("full_path", F.struct(*evidence).alias("_fresh"))
    joined = stored.withColumn("_stored", F.struct(*evidence)).join(other, "full_path", "left")
    return joined.where(~F.col("_stored").eqNullSafe(F.col("_fresh"))).select("full_path", F.col("_fresh").isNull().alias("missing"))

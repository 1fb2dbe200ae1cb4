"""The driver's tables in the shapes that the operators take. Each adapter has a Spark and a DuckDB form of one definition."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: 2023-01-01 in ticks, and a day.
BASE, DAY = 638_081_280_000_000_000, 864_000_000_000

_EXT = "CASE doc_id % 12 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.jpg' WHEN 3 THEN '.tmp' WHEN 4 THEN '.mp4' WHEN 5 THEN '.zip' WHEN 6 THEN '' WHEN 7 THEN '.py' WHEN 8 THEN '.crdownload' WHEN 9 THEN '.mp3' WHEN 10 THEN '.bak' ELSE '.csv' END"
_NAME = f"CASE WHEN doc_id % 29 = 0 THEN concat('~$doc_', doc_id, {_EXT}) WHEN doc_id % 31 = 0 THEN concat('Doc_', doc_id, {_EXT}, '~') ELSE concat('doc_', doc_id, {_EXT}) END"
_FILES = {
    "doc_id": "doc_id",
    "full_path": f"concat('/', source, '/', lang, '/', {_NAME})",
    "file_name": _NAME,
    "extension": f"CASE WHEN doc_id % 29 <> 0 AND doc_id % 31 = 0 AND doc_id % 12 <> 6 THEN concat({_EXT}, '~') ELSE {_EXT} END",
    "directory_path": "concat('/', source, '/', lang)",
    "size_bytes": "CASE WHEN doc_id % 37 = 5 THEN CAST(0 AS BIGINT) ELSE {size} END",
    "created_ticks": f"CAST({BASE} AS BIGINT) + doc_id * 10000000",
    "modified_ticks": f"CAST({BASE} AS BIGINT) + (doc_id * 7919 % 900) * CAST({DAY} AS BIGINT) + doc_id % 3",
    "attributes": "CAST((CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 0 END) + (CASE WHEN doc_id % 41 = 0 THEN 4 ELSE 0 END) + (CASE WHEN doc_id % 43 = 0 THEN 1024 ELSE 0 END) AS INT)",
    "identity": "concat(md5(text), ':', doc_id % 3)",
    "content": "CASE WHEN doc_id % 37 = 5 THEN '' ELSE text END",
}


def _select(columns: dict[str, str], **words: str) -> list[str]:
    out = []
    for name, e in columns.items():
        for k, v in words.items():
            e = e.replace("{" + k + "}", v)
        out.append(f"{e} AS {name}")
    return out


def files(documents: DataFrame) -> DataFrame:
    """A file of each document with a text: path by source and language, content the text."""
    return documents.where("text IS NOT NULL").selectExpr(*_select(_FILES, size="CAST(octet_length(text) AS BIGINT)"))


FILES_SQL = "files AS (SELECT " + ", ".join(_select(_FILES, size="octet_length(encode(text))::BIGINT")) + " FROM documents WHERE text IS NOT NULL)"

_SIGN = {
    "spark": lambda seed: f"cast(conv(substring(md5({seed}), 1, 15), 16, 10) as bigint)",
    "duck": lambda seed: f"('0x' || substr(md5({seed}), 1, 15))::BIGINT",
}
_XOR = {"spark": lambda a, b: f"({a} ^ {b})", "duck": lambda a, b: f"xor({a}, {b})"}
_DIV = {"spark": lambda a, b: f"({a} div {b})", "duck": lambda a, b: f"({a} // {b})"}


def _images(kind: str) -> dict[str, str]:
    base = f"cast({_DIV[kind]('p_partkey', 4)} as string)" if kind == "spark" else f"({_DIV[kind]('p_partkey', 4)})::VARCHAR"
    flips = "CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 511 ELSE 1048575 END AS BIGINT)"
    return {
        "full_path": "concat('/img/', CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END, '/', p_partkey, '.jpg')",
        "hash": _XOR[kind](_SIGN[kind](base), flips),
        "width": "CAST(640 + p_partkey % 4 + CASE WHEN p_partkey % 16 = 5 THEN 300 ELSE 0 END AS INT)",
        "height": "480",
        "size_bytes": "CAST(p_size * 1000 + p_partkey % 7 AS BIGINT)",
        "modified_ticks": f"CAST({BASE} AS BIGINT) + p_partkey",
    }


def images(part: DataFrame) -> DataFrame:
    """A picture of each part; each four have hashes that differ in 3, 9 and 20 bits from the first."""
    return part.selectExpr(*_select(_images("spark")))


IMAGES_SQL = "images AS (SELECT " + ", ".join(_select(_images("duck"))) + " FROM part)"


def _videos(kind: str) -> dict[str, str]:
    base = _DIV[kind]("p_partkey", 3)
    flips = "CAST(CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN {a} ELSE {b} END AS BIGINT)"
    frames = [_XOR[kind](_SIGN[kind](f"concat({base}, ':', {f})"), flips.replace("{a}", str((1 << (2 * f + 1)) - 1)).replace("{b}", str((1 << (4 * f + 3)) - 1))) for f in range(5)]
    array = f"array({', '.join(frames)})" if kind == "spark" else f"[{', '.join(frames)}]"
    return {
        "full_path": "concat('/vid/', p_partkey, '.mp4')",
        "hashes": array,
        "width": "CAST(1280 + p_partkey % 3 AS INT)",
        "height": "720",
        "display_aspect": "CAST(1280 + (p_partkey % 9) * 10 AS DOUBLE) / 720",
        "duration_ticks": f"CAST(10000000 AS BIGINT) * (20 + {base} % 400) + (p_partkey % 3) * CAST(10000000 AS BIGINT) + CASE WHEN p_partkey % 21 = 4 THEN 10000001 ELSE 0 END",
        "bitrate": "CAST(1000 + p_partkey % 50 AS BIGINT)",
        "size_bytes": "CAST(p_size * 1000 AS BIGINT)",
    }


def videos(part: DataFrame) -> DataFrame:
    """A video of each part; each three are near each other in five hashes, duration and aspect ratio."""
    return part.selectExpr(*_select(_videos("spark")))


VIDEOS_SQL = "videos AS (SELECT " + ", ".join(_select(_videos("duck"))) + " FROM part)"


def _tracks(day: str) -> dict[str, str]:
    return {
        "full_path": "concat('/music/', event_id, '.mp3')",
        "title": "concat(' ', upper(event_type), ' - No. ', user_id % 10, '!')",
        "artist": "CASE WHEN event_id % 5 = 0 THEN '...' ELSE concat('user  ', user_id) END",
        "album_artist": "CASE WHEN event_id % 35 = 0 THEN NULL ELSE concat('USER ', user_id) END",
        "duration_ticks": f"CASE WHEN event_id % 50 = 49 THEN CAST(0 AS BIGINT) ELSE {day} END",
        "bitrate": "CAST(event_id % 4 AS BIGINT)",
        "size_bytes": "CAST(event_id % 9 AS BIGINT)",
        "modified_ticks": f"CAST({BASE} AS BIGINT) + event_id",
    }


def tracks(events: DataFrame) -> DataFrame:
    """A track of each event: by user, as long as its time of day in 100 s steps of ticks."""
    return events.selectExpr(*_select(_tracks("CAST(10000000 AS BIGINT) * (1 + (unix_seconds(cast(ts as timestamp)) % 86400) div 100)")))


TRACKS_SQL = "tracks AS (SELECT " + ", ".join(_select(_tracks("CAST(10000000 AS BIGINT) * (1 + (floor(epoch(ts))::BIGINT % 86400) // 100)"))) + " FROM events)"

#: First bytes (hex) and names that headers() deals out, by p_partkey.
HEADERS = (
    "FFD8FFE0", "89504E470D0A1A0A00", "474946383961", "424D0000", "49492A0008", "255044462D312E37", "504B030414", "526172211A0700", "377ABCAF271C", "494433030000", "FFFB9000", "664C614300", "4F67675300",
    "524946460000000057454250", "524946460000000057415645", "524946460000000041564920", "00000018667479706D703432000000006D70343269736F6D", "0000001466747970717420200000000071742020", "0000001C66747970717420200000000071742020",
    "1A45DFA3874282847765626D", "1A45DFA387428284776562", "68656C6C6F", "", "FFFFFFFF", "00000014667479706D70343200000000786D6C20",
)
_HEAD = "CASE p_partkey % 25 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADERS)) + " END"
_HEAD_EXT = "CASE p_partkey % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp3' WHEN 3 THEN '.zip' WHEN 4 THEN '.mov' WHEN 5 THEN '.MP4' ELSE '' END"
_HEADER_FILES = {
    "p_partkey": "p_partkey",
    "full_path": f"concat('/bin/', p_partkey, {_HEAD_EXT})",
    "file_name": f"concat(p_partkey, {_HEAD_EXT})",
    "extension": f"lower({_HEAD_EXT})",
    "size_bytes": "CAST(p_size AS BIGINT)",
    "created_ticks": f"CAST({BASE} AS BIGINT)",
    "modified_ticks": f"CAST({BASE} AS BIGINT) + p_partkey",
    "attributes": "CAST(CASE WHEN p_partkey % 40 = 7 THEN 1024 ELSE 0 END AS INT)",
}


def headers(part: DataFrame) -> DataFrame:
    """A file of each part with the first bytes of some type."""
    return part.selectExpr(*_select(_HEADER_FILES), f"unhex({_HEAD}) AS content")


HEADERS_SQL = "heads AS (SELECT " + ", ".join(_select(_HEADER_FILES)) + f", {_HEAD} AS digits FROM part)"

_MEDIA = {
    "p_partkey": "p_partkey",
    "width": "CAST(CASE p_partkey % 6 WHEN 0 THEN 1920 WHEN 1 THEN 3840 WHEN 2 THEN 641 WHEN 3 THEN 1280 WHEN 4 THEN 3 ELSE 7680 END AS BIGINT)",
    "height": "CAST(CASE p_partkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 479 WHEN 3 THEN 720 ELSE 4320 END AS BIGINT)",
    "par_n": "CAST(CASE WHEN p_partkey % 11 = 3 THEN 4 WHEN p_partkey % 97 = 5 THEN 0 ELSE 1 END AS BIGINT)",
    "par_d": "CAST(CASE WHEN p_partkey % 11 = 3 THEN 3 ELSE 1 END AS BIGINT)",
    "display_width": "CAST(CASE p_partkey % 6 WHEN 0 THEN 1920 WHEN 1 THEN 3840 WHEN 2 THEN 641 WHEN 3 THEN 1280 WHEN 4 THEN 3 ELSE 7680 END AS DOUBLE)",
    "display_height": "CAST(CASE p_partkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 479 WHEN 3 THEN 720 ELSE 4320 END AS DOUBLE)",
    "display_aspect": "CAST(CASE p_partkey % 6 WHEN 0 THEN 1920 WHEN 1 THEN 3840 WHEN 2 THEN 641 WHEN 3 THEN 1280 WHEN 4 THEN 3 ELSE 7680 END AS DOUBLE) / (CASE p_partkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 479 WHEN 3 THEN 720 ELSE 4320 END)",
    "duration_ticks": "CAST(10000000 AS BIGINT) * p_size",
    "fps_n": "CAST(CASE p_partkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 60000 WHEN 2 THEN 120 ELSE 24000 END AS BIGINT)",
    "fps_d": "CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1001 WHEN 2 THEN 1 ELSE 1001 END AS BIGINT)",
    "video_bitrate": "CAST((p_partkey % 13) * 1000000 AS BIGINT)",
    "audio_bitrate": "CAST((p_partkey % 5) * 64000 AS BIGINT)",
    "video_tracks": "CASE WHEN p_partkey % 89 = 1 THEN 2 ELSE 1 END",
    "audio_tracks": "CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 83 = 2 THEN 2 ELSE 1 END",
    "metadata_tracks": "CASE WHEN p_partkey % 79 = 3 THEN 1 ELSE 0 END",
    "container": "CASE WHEN p_partkey % 71 = 4 THEN ' ' ELSE 'MP4' END",
    "video_codec": "CASE WHEN p_partkey % 73 = 4 THEN NULL ELSE 'HEVC' END",
    "audio_codec": "CASE WHEN p_partkey % 67 = 4 THEN '' ELSE 'AAC' END",
}


def media(part: DataFrame) -> DataFrame:
    """A video's metadata of each part."""
    return part.selectExpr(*_select(_MEDIA))


MEDIA_SQL = "media AS (SELECT " + ", ".join(_select(_MEDIA)) + " FROM part)"

"""Operator 6: image columns. Netpbm and BMP bytes become arrays, area-resized NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import arrow, map_arrow

WHITE = b" \t\n\r\v\f"


class ImageError(ValueError):
    """Bytes that are no image of a supported kind."""


def _header(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n decimal numbers of a Netpbm header and the place after the last; comments run to the end of a line."""
    out = []
    while len(out) < n:
        while at < len(data) and (data[at] in WHITE or data[at] == 0x23):
            if data[at] == 0x23:
                while at < len(data) and data[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        start = at
        while at < len(data) and 0x30 <= data[at] <= 0x39:
            at += 1
        if at == start or at - start > 9:
            raise ImageError("no number in the header")
        out.append(int(data[start:at]))
    return out, at


def _plain_samples(raster: bytes, count: int, top: int) -> np.ndarray:
    """The first count decimal numbers of a raster, which may hold comments; none over top."""
    raster = re.sub(rb"#[^\r\n]*", b" ", raster)
    found = raster.split(None, count)[:count]
    if not all(map(bytes.isdigit, found)) or max(map(len, found), default=0) > 9:
        raise ImageError("a sample that is no number")
    out = np.array(found, dtype="S9").astype(np.int64)
    if len(out) and out.max() > top:
        raise ImageError("a sample over the maximum")
    return out


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width, channels) of uint8, or uint16 where the maximum is over 255.

    Bitmaps become 0 (black) and 1 (white).
    """
    if len(data) < 3 or data[:1] != b"P" or data[1] not in b"123456":
        raise ImageError("not Netpbm")
    kind = data[1] - 0x30
    (width, height, *top), at = _header(data, 2, 2 if kind in (1, 4) else 3)
    top = top[0] if top else 1
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if not (width and height and 0 < top < 65536):
        raise ImageError("empty image or a maximum out of range")
    if kind == 1:
        signs = np.frombuffer(data, np.uint8, offset=at)
        flat = 0x31 - signs[(signs == 0x30) | (signs == 0x31)][:count]
    elif kind in (2, 3):
        flat = _plain_samples(data[at:], count, top).astype(np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if len(raw) < row * height:
            raise ImageError("too few bytes")
        flat = 1 - np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, offset=at + 1, count=-1 if top < 256 else (len(data) - at - 1) // 2)[:count]
        flat = flat.astype(np.uint16) if top > 255 else flat
    if len(flat) < count:
        raise ImageError("too few samples")
    if flat.max() > top:
        raise ImageError("a sample over the maximum")
    return flat.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 (palette), 24 or 32 bits a pixel as (height, width, channels): 3 channels, RGB."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ImageError("not BMP")
    offset, header, width, height, _, bits, packing = struct.unpack("<10xIIiiHHI", data[:34])
    colours = struct.unpack("<I", data[46:50])[0]
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ImageError("BMP of an unsupported kind")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    if len(data) < offset + rows * stride:
        raise ImageError("too few bytes")
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    if bits == 8:
        n = colours or 256
        palette = np.zeros((256, 3), np.uint8)
        entries = np.frombuffer(data, np.uint8, min(n, 256) * 4, 14 + header).reshape(-1, 4)
        palette[: len(entries)] = entries[:, 2::-1]
        return palette[raw[:, :width]]
    pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)
    return np.ascontiguousarray(pixels[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    """An image's samples, by its first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: bytes, width: int) -> bytes:
    """Bytes as the 8-bit samples of a binary grey map of this width; their number must be a multiple of it."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box averages by an integral image, with shares of the samples that a box edge cuts; also enlarges."""
    h, w, c = image.shape

    def cuts(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        whole, rest = np.divmod(np.arange(parts + 1) * n, parts)
        return whole, rest / parts

    y, fy = cuts(h, height)
    x, fx = cuts(w, width)
    # of the integral image only the rows at the cuts are made: it would be eight times the picture
    edges = np.unique(np.concatenate((y, np.minimum(y + 1, h))))
    total = np.zeros((len(edges), w + 1, c))
    np.cumsum(np.cumsum(np.add.reduceat(image, edges[:-1], axis=0, dtype=np.float64), axis=0), axis=1, out=total[1:, 1:])
    low, high = total[np.searchsorted(edges, y)], total[np.searchsorted(edges, np.minimum(y + 1, h))]
    rows = low + fy[:, None, None] * (high - low)
    at = rows[:, x] + fx[None, :, None] * (rows[:, np.minimum(x + 1, w)] - rows[:, x])
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """size x size bits as hex digits: whether each box is darker than its right neighbour, in the mean of channels."""
    boxes = np.round(resize_area(image, size, size + 1).mean(axis=2), 6)
    return np.packbits(boxes[:, :-1] < boxes[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    """An array as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


RESULT = [("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())]


def read_image(data: bytes | None, tile: int) -> tuple:
    """One row of RESULT: samples in their own order, the NPY tile, the hash; or only an error."""
    if not data:
        return (None,) * 6 + ("no bytes",)
    try:
        image = decode(data)
    except (ImageError, struct.error, ValueError) as e:
        return (None,) * 6 + (str(e),)
    small = np.clip(np.rint(np.round(resize_area(image, tile, tile), 6)), 0, np.iinfo(image.dtype).max).astype(image.dtype)
    return (*image.shape, image.tobytes(), npy(small), difference_hash(image), None)


def decode_images(df: DataFrame, content: str, tile: int = 32) -> DataFrame:
    """df with its other columns and, for the binary column content, an image struct: height, width, channels, samples,
    tile (NPY of tile x tile, area-resized), dhash, error.

    Null, empty, cut or foreign bytes give an error text and nulls; rows are neither lost nor merged. A column of df that
    is called image is replaced.
    """
    image = "image struct<height:int,width:int,channels:int,samples:binary,tile:binary,dhash:string,error:string>"
    keep = [c for c in df.columns if c != "image"]
    fields = [f for f in df.schema.fields if f.name in keep]
    struct_type = pa.struct(RESULT)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [read_image(x, tile) for x in batch.column(content).to_pylist()]
        images = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(RESULT)], fields=list(struct_type))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), images], names=[*keep, "image"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), kernel, f"{schema}, {image}")


def text_payload(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and those bytes with zeros up to a positive multiple of unit."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def texts_as_images(docs: DataFrame, unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and content: each whole text stored losslessly as a grey map of unit columns (null: empty)."""
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("content", pa.binary())]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [text_payload(t, unit) for t in batch.column("text").to_pylist()]
        return arrow(schema, batch.column("doc_id"), [n for n, _ in made], [encode_pgm(p, unit) for _, p in made])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), kernel, "doc_id long, n_bytes long, content binary")


def text_image_features(docs: DataFrame) -> DataFrame:
    """The digest columns of operator 6: stored as images, read back by decode_images, one row per document."""

    def crc(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        images = batch.column("image").to_pylist()
        for content, image in zip(batch.column("content").to_pylist(), images, strict=True):
            payload = image["samples"]
            feature = f"{image['dhash']}:{hashlib.sha256(image['tile']).hexdigest()[:16]}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(content), hashlib.sha256(content).hexdigest(), feature))
        return arrow(DIGEST, batch.column("doc_id"), batch.column("n_bytes"), *([r[i] for r in rows] for i in range(6)))

    return map_arrow(decode_images(texts_as_images(docs), "content"), crc, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

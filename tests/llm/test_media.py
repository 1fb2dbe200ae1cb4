import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from filegrove.llm.media import decode, decode_images, difference_hash, encode_pgm, npy, read_image, resize_area, text_image_features, text_payload


def bmp(image, bits=24, up=True, palette=b""):
    h, w = image.shape[:2]
    rows = image[::-1] if up else image
    body = b"".join((row.reshape(-1).tobytes() + b"\0" * 3)[: (w * bits // 8 + 3) // 4 * 4] for row in rows)
    offset = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", offset + len(body), 0, 0, offset, 40, w, h if up else -h, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


def test_formats():
    rng = np.random.default_rng(6)
    grey, colour = rng.integers(0, 256, (3, 5), dtype=np.uint8), rng.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    assert (decode(b"P5 # c\n5 3\n255\n" + grey.tobytes())[..., 0] == grey).all()
    assert (decode(b"P6\n5 3 255\n" + colour.tobytes()) == colour).all()
    assert (decode(b"P2\n5 3\n255\n" + " ".join(map(str, grey.ravel())).encode())[..., 0] == grey).all()
    assert (decode(b"P3 5 3 255 " + " ".join(map(str, colour.ravel())).encode()) == colour).all()
    wide = rng.integers(0, 60000, (2, 2), dtype=np.uint16)
    assert (decode(b"P5 2 2 65535\n" + wide.astype(">u2").tobytes())[..., 0] == wide).all()
    assert decode(b"P1 3 2 1 0 1\n011")[..., 0].tolist() == [[0, 1, 0], [1, 0, 0]] == decode(b"P4 3 2\n\xa0\x60")[..., 0].tolist()
    for up in (True, False):
        assert (decode(bmp(colour[:, :, ::-1], up=up)) == colour).all()
    table = rng.integers(0, 256, (256, 4), dtype=np.uint8)
    assert (decode(bmp(grey, 8, palette=table.tobytes())) == table[grey][:, :, 2::-1]).all()


def test_area_means():
    rng = np.random.default_rng(7)
    image = rng.integers(0, 256, (6, 8, 1)).astype(np.uint8)
    assert np.allclose(resize_area(image, 3, 4)[..., 0], image[..., 0].reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(image, 5, 0), 7, 1)  # any box of shares is a box of whole small samples
    assert np.allclose(resize_area(image, 5, 7)[..., 0], fine[..., 0].reshape(5, 6, 7, 8).mean(axis=(1, 3)))
    assert difference_hash(np.tile(np.arange(90, dtype=np.uint8), (8, 1))[..., None]) == "f" * 16


def box_means(image, height, width):
    """Area means by shares of rows and columns, without an integral image."""
    share = lambda n, parts: np.array([[max(0.0, min((i + 1) * n / parts, r + 1) - max(i * n / parts, r)) * parts / n for r in range(n)] for i in range(parts)])
    return np.einsum("yr,rxc,ux->yuc", share(image.shape[0], height), image.astype(float), share(image.shape[1], width))


def test_features_are_those_of_plain_box_means(spark, docs):
    rng = np.random.default_rng(9)
    texts = ["a", "plain words " * 40, "".join(map(chr, rng.integers(32, 0x2FF, 5000))), "x" * 64 * 33, None]
    for r, text in zip(text_image_features(docs(*texts)).orderBy("doc_id").collect(), texts, strict=True):
        payload = text_payload(text)[1]
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 1)
        boxes = np.round(box_means(image, 8, 9)[..., 0], 6)
        bits = "".join("1" if a < b else "0" for row in boxes for a, b in zip(row, row[1:]))
        tile = np.rint(np.round(box_means(image, 32, 32), 6)).astype(np.uint8)
        assert r["feature"] == f"{int(bits, 2):016x}:{hashlib.sha256(npy(tile)).hexdigest()[:16]}"


def test_samples_over_the_maximum_are_errors():
    bad = [b"P2 1 1 255 999999999", b"P3 1 1 255 0 0 300", b"P2 1 1 65535 70000", b"P2 1 1 99999 1", b"P5 1 1 100\n\xff", b"P6 1 1 9\n\x01\x02\x10", b"P5 1 1 1000\n\xff\xff", b"P2 1 1 255 -1", b"P2 1 1 255 1_0", b"P2 1 1 255 x", b"P2 1 1 255 99999999999999999999999", b"P1 9 9 01", b"P1"]
    for data in bad:
        assert read_image(data, 4)[:6] == (None,) * 6 and read_image(data, 4)[6]
    assert read_image(b"P2 2 1 255 # c\n7 # seven\n 255", 4)[3] == b"\x07\xff"


def test_columns_and_broken_images(spark):
    good = encode_pgm(bytes(range(128)), 64)
    rows = [(1, good), (2, None), (3, b""), (4, good[:-1]), (5, b"P9"), (6, b"BM"), (7, good), (8, b"P5 0 1 255\n"), (9, b"P2 2 2 255 1 2")]
    df = spark.createDataFrame(rows, "i int, content binary").withColumn("image", F.lit(1)).withColumn("tile", F.lit("x"))
    out = {r["i"]: r for r in decode_images(df, "content", 4).collect()}
    assert [i for i, r in out.items() if r["image"]["error"] is None] == [1, 7] and out[1]["image"] == out[7]["image"] and out[1]["tile"] == "x"
    tile = np.load(io.BytesIO(out[1]["image"]["tile"]))
    assert tile.shape == (4, 4, 1) and npy(tile) == bytes(out[1]["image"]["tile"])
    assert decode_images(df.limit(0), "content").count() == 0


def test_payloads(spark, docs):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "z" * 300_000, "a"]
    rows = {r["doc_id"]: r for r in text_image_features(docs(*texts)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, (len(data) + 63) // 64 * 64) - len(data))
        media = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
        assert tuple(rows[i])[:7] == (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert rows[2]["feature"] == rows[7]["feature"] and rows[0]["feature"] == rows[1]["feature"] != rows[4]["feature"]

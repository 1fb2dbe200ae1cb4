"""Literal cases of scalar rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filegrove.functions import paths, perceptual, signatures, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_perceptual_hashes():
    ramp = np.arange(32)
    edge = np.where(ramp < 16, 0, 255)
    cases = {0: np.zeros((32, 32)), 1: np.full((32, 32), 128), 0x0100000001000001: np.repeat(edge[:, None], 32, 1), 0x89: np.repeat(edge[None], 32, 0)}
    for want, sample in cases.items():
        got = int(perceptual.phash_samples(sample.astype(np.uint8).reshape(1, -1))[0]) & ((1 << 64) - 1)
        assert got == want, hex(got)


def test_hamming(spark):
    assert values(spark, [(0xA5, 0xA5), (0, 1 << 47), (0, -1)], "a long, b long", perceptual.hamming(F.col("a"), F.col("b"))) == [(0,), (1,), (64,)]


PLANS = [(100, 0), (10_000, 4), (10**6, 4), (10**8, 4), (20_000, 8), (10**6, 8), (2_000, 12), (20_000, 12), (200_000, 12), (10**6, 12), (10**6, 13)]


def close_pairs(rng, distance, n=60):
    """Pairs of hashes at exactly this distance: bits in a row and bits all over."""
    out = []
    for i in range(n):
        a = int(rng.integers(-(1 << 63), (1 << 63) - 1))
        low = int(rng.integers(0, 64 - distance)) if distance else 0
        bits = range(low, low + distance) if i % 2 else rng.choice(64, distance, replace=False)
        b = (a ^ sum(1 << int(x) for x in bits)) & ((1 << 64) - 1)
        out.append((a, b - (1 << 64) if b >> 63 else b))
    return out


def test_close_hashes_meet_in_each_piece_that_is_close_and_once(spark):
    rng = np.random.default_rng(1)
    for rows, distance in PLANS:
        plan = perceptual.search_plan(rows, distance)
        pairs = [p for d in sorted({0, distance // 2, distance}) for p in close_pairs(rng, d, 20)]
        both = [F.size(F.array_intersect(perceptual.search_keys(F.col(x), plan), perceptual.search_keys(F.col(y), plan, True))).alias(x) for x, y in (("a", "b"), ("b", "a"))]
        for (a, b), got in zip(pairs, values(spark, pairs, "a long, b long", F.array(*both)), strict=True):
            differ = (a ^ b) & ((1 << 64) - 1)
            apart = [sum(differ >> bit & 1 for bit in low + high) for low, high in plan.pieces()]
            assert min(apart) <= plan.radius  # no pair is lost
            # equal pieces meet from either side
            assert sum(got[0]) == sum(2 if n == 0 else n <= plan.radius for n in apart), (plan, a, b)
            assert sum(sorted(len(low + high) for low, high in plan.pieces())) == 64 * math.comb(plan.blocks, plan.taken) * plan.taken / plan.blocks


def test_plans_count_their_keys_and_meetings(spark):
    rng = np.random.default_rng(2)
    for rows, distance in ((2_000, 8), (2_000, 12), (20_000, 12)):
        plan = perceptual.search_plan(rows, distance)
        some = [(int(x),) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 1500)]
        made = values(spark, some, "h long", F.array(F.size(perceptual.search_keys(F.col("h"), plan)), F.size(perceptual.search_keys(F.col("h"), plan, True))))
        assert np.allclose(np.mean([r[0] for r in made], axis=0), plan.keys(), rtol=0.03)
        hashes = np.array([h for (h,) in some])
        apart = hashes[:, None] ^ hashes[None, :]
        upper = np.triu_indices(len(some), 1)
        met = sum((np.bitwise_count((apart & perceptual._mask(low + high)).view(np.uint64)) <= plan.radius)[upper].mean() for low, high in plan.pieces())
        assert abs(met - plan.meetings()) < 0.1 * plan.meetings()


def test_work_grows_much_slower_than_pairs():
    for distance in (4, 8, 12, 13):
        work = []
        for rows in (10**3, 10**4, 10**5, 10**6, 10**7, 10**8):
            plan = perceptual.search_plan(rows, distance)
            work.append(perceptual.KEY_WORK * sum(plan.keys()) + rows / 2 * plan.meetings())
        assert work == sorted(work) and work[-1] < work[0] * 10**3.2  # a hundred-thousandfold table; all pairs would be 10**5


def test_arrays_of_hashes_meet_as_by_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    shapes = [None, *([(at * 64 // k, (at + 1) * 64 // k - at * 64 // k) for at in range(k)] for k in (4, 7, 13))]
    for distance, shape in [(d, s) for d in (4, 8, 12) for s in shapes if not s or len(s) <= d + 1]:
        if shape:
            monkeypatch.setattr(perceptual, "_pieces", lambda *_, shape=shape: shape)
        monkeypatch.setattr(perceptual, "TILE", 500)
        centres = rng.integers(0, 1 << 64, 9, dtype=np.uint64)
        a, b = (centres[rng.integers(0, 9, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (7, n), dtype=np.uint64)) for n in (150, 200))
        got = [(x, y) for i, j in perceptual.close_hashes(a, b, distance) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        want = set(map(tuple, np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= distance).tolist()))
        assert len(got) == len(set(got)) and set(got) == want
        monkeypatch.undo()
    frames = [centres[rng.integers(0, 9, (5, n))] for n in (60, 70)]
    got = {(x, y) for i, j in perceptual.close_sums(*frames, 60) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == set(map(tuple, np.argwhere(np.bitwise_count(frames[0][:, :, None] ^ frames[1][:, None, :]).sum(0) <= 60).tolist()))


def test_pieces_need_no_more_bits_than_the_distance_leaves_them(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 64, 3000, dtype=np.uint64) for _ in range(2))
    met, tiles = [], perceptual._tiles
    monkeypatch.setattr(perceptual, "_tiles", lambda rows, others: met.append(rows * others) or tiles(rows, others))
    monkeypatch.setattr(perceptual, "_pieces", lambda *_: [(at * 64 // 5, (at + 1) * 64 // 5 - at * 64 // 5) for at in range(5)])
    list(perceptual.close_hashes(a, b, 12))
    assert sum(met) < 0.048 * 3000**2  # two bits of three pieces and one of two; two bits of each piece are 6 % of all pairs


def test_bits_that_are_all_alike_are_in_no_piece(monkeypatch):
    rng = np.random.default_rng(5)
    met, tiles = [], perceptual._tiles
    monkeypatch.setattr(perceptual, "_tiles", lambda rows, others: met.append(rows * others) or tiles(rows, others))
    cut = lambda wide: [(at * wide // 4, wide // 4) for at in range(4)]
    monkeypatch.setattr(perceptual, "_pieces", lambda *of: cut(of[3] if len(of) > 3 else 64))
    for fixed in (0xFFFF << 48, 0x8421 << 20 | 0xFFF):
        a, b = (rng.integers(0, 1 << 64, 3000, dtype=np.uint64) & np.uint64(~fixed & (1 << 64) - 1) | np.uint64(fixed & 0x5555555555555555) for _ in range(2))
        b[:50] = a[:50] ^ np.uint64(0b111 << 36)
        met.clear()
        got = [(x, y) for i, j in perceptual.close_hashes(a, b, 8) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        want = set(map(tuple, np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= 8).tolist()))
        assert len(got) == len(want) >= 50 and set(got) == want and sum(met) < 0.1 * 3000**2  # a piece of such bits alone lets all meet
    monkeypatch.undo()
    same = np.full(3, 7, np.uint64)
    assert sum(len(i) for i, _ in perceptual.close_hashes(same, same[:2], 12)) == 6
    assert list(perceptual.close_hashes(same[:0], same[:0], 4)) == [] and list(perceptual.close_hashes(same, same[:0], 4)) == []


def test_spans_and_numbers(spark):
    ticks = [0, 1, -15_000_000, 864_000_000_000, 36_610_000_001]
    rows = values(spark, [(t,) for t in ticks], "t long", text.span_text(F.col("t")))
    assert [r[0] for r in rows] == [text.span(t) for t in ticks] == ["00:00:00", "00:00:00.0000001", "-00:00:01.5000000", "1.00:00:00", "01:01:01.0000001"]
    assert [r[0] for r in values(spark, [(3.0,), (1.4,), (10.0,)], "d double", text.number_text(F.col("d")))] == ["3", "1.4", "10"]


def test_luminance():
    assert perceptual.luminance(bytes([0, 0, 0, 255, 255, 255, 255, 255, 9, 9, 9, 0, 0, 0, 255, 255])) == bytes([0, 255, 255, 53])


def vint(n):
    return bytes([0x80 | n])


EBML = b"\x1a\x45\xdf\xa3"
SIGNATURES = [
    (b"\xff\xd8\xff", "JPEG"), (b"\xff\xd8\xfe", None), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"GIF87a", "GIF"), (b"GIF88a", None), (b"BM", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"%PDF-", "PDF"), (b"%PDF", None),
    (b"PK\x03\x04", "ZIP"), (b"PK\x05\x06", "ZIP"), (b"PK\x07\x08", "ZIP"), (b"Rar!\x1a\x07\0", "RAR"), (b"Rar!\x1a\x07\x01\0", "RAR"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"ID3", "MP3"), (b"\xff\xfb\x90\0", "MP3"), (b"\xff\xfb\xf0\0", None), (b"\xff\xfb\x90", None),
    (b"fLaC", "FLAC"), (b"OggS", "Ogg"), (b"RIFF0000WEBP", "WebP"), (b"RIFF0000WAVE", "WAV"), (b"RIFF0000AVI ", "AVI"), (b"RIFF0000AVI", None), (b"RIFF0000JUNK", None),
    (b"\0\0\0\x10ftypisom0000", "MP4"), (b"\0\0\0\x14ftypqt  0000qt  ", "QuickTime"), (b"\0\0\0\x14ftypqt  0000isom", "ISO BMFF"), (b"\0\0\0\x10ftypwhat0000", "ISO BMFF"), (b"\0\0\0\x11ftypisom0000x", None), (b"\0\0\0\x20ftypisom0000", None),
    (b"\0\0\0\x01ftyp\0\0\0\0\0\0\0\x18mp420000", "MP4"), (b"\0\0\0\x01ftyp\0\0\0\0\0\0\0\x19mp420000", None),
    (EBML + vint(7) + b"\x42\x82" + vint(4) + b"webm", "WebM"), (EBML + vint(11) + b"\x42\x82" + vint(8) + b"matroska", "Matroska"), (EBML + vint(6) + b"\x42\x82" + vint(3) + b"abc", "EBML"), (EBML + vint(0), "EBML"),
    (EBML + vint(12) + b"\x42\x86" + vint(1) + b"\x01" + b"\x42\x82" + vint(4) + b"webm", None), (EBML + vint(11) + b"\x42\x86" + vint(1) + b"\x01" + b"\x42\x82" + vint(4) + b"webm", "WebM"), (EBML + b"\xff", None), (EBML, None), (EBML + vint(9) + b"\x42", None),
    (b"", None), (b"hello", None), (None, None),
]


def test_signatures(spark):
    got = values(spark, [(i, h) for i, (h, _) in enumerate(SIGNATURES)], "i int, h binary", "i", signatures.detect(F.col("h")))
    assert {i: t for i, t in got} == {i: t for i, (_, t) in enumerate(SIGNATURES)}


def test_a_cut_signature_is_none(spark):
    cut = [(h[:n],) for h, t in SIGNATURES if t in ("PNG", "7z", "FLAC", "MP4", "WebM", "Matroska") for n in range(2, len(h))]
    got = [r for r in values(spark, cut, "h binary", "h", signatures.detect(F.col("h"))) if r[1]]
    assert not got


@pytest.mark.parametrize(("name", "want"), [("a.txt", True), ("", False), ("  ", False), (".", False), ("..", False), ("a ", False), ("a.", False), ("a:b", False), ("con", False), ("Con.txt", False), ("LPT¹.x", False), ("com0", True), ("a\\b", False), (".x", True), ("a\tb", False)])
def test_leaf_names(spark, name, want):
    assert values(spark, [(name,)], "n string", paths.valid_leaf(F.col("n"))) == [(want,)]


def test_paths(spark):
    rows = [("/a/B", "/A"), ("/ab", "/a"), ("/a", "/a"), ("/a/b/c", "/a/b/"), ("/x", "/"), ("/a/", "/a/")]
    assert [r[0] for r in values(spark, rows, "p string, f string", paths.under(F.col("p"), F.col("f")))] == [True, False, False, True, True, False]
    assert values(spark, [("a.tar.gz",), ("x",), (".env",), ("a.",)], "n string", paths.extension(F.col("n")), paths.stem(F.col("n"))) == [(".gz", "a.tar"), ("", "x"), (".env", ""), ("", "a")]


def test_texts(spark):
    spelled = [r[0] for r in values(spark, [("  Ｆｏｏ—Bar_baz! ‘qux’ [zap] «zip» 😀é♥ ",), ("...",), (None,), ("AC/DC",)], "t string", text.search_key(F.col("t")))]
    assert spelled == ["foo bar baz qux zap zip 😀é♥", "", "", "ac dc"]
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1 << 20, "1 MB"), ((1 << 40) * 5000, "5000 TB"), (1234567, "1.18 MB")]
    assert [r[0] for r in values(spark, [(n,) for n, _ in sizes], "n long", text.byte_text(F.col("n")))] == [t for _, t in sizes]
    spans = [(0, "00:00:00"), (10_000_000, "00:00:01"), (-15, "-00:00:00.0000015"), (864_000_000_000 * 2 + 36_000_000_000 + 1, "2.01:00:00.0000001")]
    assert [r[0] for r in values(spark, [(n,) for n, _ in spans], "n long", text.span_text(F.col("n")))] == [t for _, t in spans]
    assert values(spark, [(638_081_280_000_000_007,)], "n long", text.utc_text(F.col("n"))) == [("2023-01-01T00:00:00.0000007Z",)]
    assert [r[0] for r in values(spark, [("a",), ('a"b',), ("a,b",), ("a\nb",), (None,)], "t string", text.csv_cell(F.col("t")))] == ["a", '"a""b"', '"a,b"', '"a\nb"', ""]


def test_tables_have_a_scope(spark, tmp_path):
    import os

    from filegrove.operators import tables

    folder = lambda: sorted(os.listdir(tables.shared_folder(spark).removeprefix("file://")))
    before = folder()
    with tables.Scope() as outer:
        first = tables.stored(spark.range(3), "first")
        with tables.Scope() as inner:
            tables.stored(spark.range(4), "second")
            third = inner.kept(tables.stored(first, "third"))
        assert [n.split("-")[0] for n in folder() if n not in before] == ["first", "third"]
        outer.drop(first)
        assert third.count() == 3 and [n.split("-")[0] for n in folder() if n not in before] == ["third"]
    assert folder() == before


def test_many_tables_leave_no_garbage(spark):
    from filegrove.operators import tables

    def full() -> int:
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = full()
    with tables.Scope():
        for _ in range(2 * tables.COLLECT_AFTER):
            tables.stored(spark.range(1), "one")
    assert full() >= before + 2

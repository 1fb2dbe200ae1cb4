"""Cases that the driver's tables don't hold."""

import io
import json
import os
import struct
import unicodedata
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filegrove.operators import actions, evidence, exact, export, findings, graph, media_policy, review, similarity, tables
from filegrove.operators.providers import attempted, with_skips
from filegrove.operators.tables import numbered
from filegrove.session import Busy, Operations
from filegrove.sources.archives import probe_zip
from filegrove.sources.filesystem import inventory, scan, with_content

FILE = "full_path string, file_name string, extension string, size_bytes long, created_ticks long, modified_ticks long, attributes int, identity string, content binary"


def files(spark, *rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1], "", len(c), 1, t, 0, i, c) for p, c, t, i in rows], FILE)


def test_groups_of_copies(spark):
    big = b"x" * 128_000
    f = files(spark, ("/a", big, 1, "1"), ("/b", big, 2, "2"), ("/c", b"same text", 3, "3"), ("/d", b"same text", 4, "4"), ("/e", b"y" * 64_000, 5, "5"))
    for staged in (False, True):
        members = exact.funnel(f, staged)
        got = exact.groups(members).collect()
        assert [(r["first_path"], r["n_files"], r["wasted_bytes"]) for r in got] == [("/a", 2, 128_000), ("/c", 2, 9)]
        assert tuple(exact.summary(f, members).first()) == (5, 2, 2, 128_009)


def test_a_last_byte_and_hard_links(spark):
    tail = b"z" * 79_999
    f = files(spark, ("/a", tail + b"1", 1, "1"), ("/b", tail + b"2", 1, "2"), ("/z", b"link", 1, "9"), ("/l", b"link", 1, "9"), ("/m", b"link", 1, "8"))
    got = exact.funnel(f, True).select("full_path").collect()
    assert sorted(r[0] for r in got) == ["/l", "/m"]


def test_empty_files_need_a_minimum_of_zero(spark):
    f = files(spark, ("/a", b"", 1, "1"), ("/b", b"", 1, "2"))
    assert exact.funnel(exact.admitted(f)).count() == 0
    assert [r["wasted_bytes"] for r in exact.groups(exact.funnel(exact.admitted(f, 0))).collect()] == [0]
    with pytest.raises(ValueError):
        exact.admitted(f, 5, 4)


def test_every_rule_keeps_one(spark):
    f = files(spark, ("/x/long", b"c", 5, "1"), ("/y/a", b"c", 9, "2"), ("/Y/b", b"c", 9, "3"), ("/z", b"c", 1, "4"))
    members = exact.funnel(f)
    want = {"newest": "/y/a", "oldest": "/z", "shortest": "/z"}
    for rule, path in want.items():
        kept = exact.keep_one(members, rule)
        assert [r[0] for r in kept.where("NOT selected").select("full_path").collect()] == [path]
        assert exact.unsafe(kept).count() == 0
    assert exact.keep_one(members, "preferred", "/X").where("NOT selected").first()["full_path"] == "/x/long"
    assert exact.keep_one(members, "preferred", "/none").where("NOT selected").first()["full_path"] == "/y/a"
    left = exact.without(exact.keep_one(members, "newest"), f.where("full_path = '/y/a'").select(F.lower("full_path").alias("gone_path")))
    assert [r[0] for r in left.where("NOT selected").select("full_path").collect()] == ["/Y/b"]


def test_clusters_do_not_chain(spark):
    s = 10_000_000
    rows = [("t", "a", d, f"/{i}") for i, d in enumerate([100 * s, 102 * s, 104 * s, 200 * s, 202 * s + 1])]
    got = similarity.anchored_clusters(spark.createDataFrame(rows, "title string, artist string, d long, full_path string"), ["title", "artist"], "d", 2 * s).collect()
    assert sorted((r["full_path"], r["cluster"] // s) for r in got) == [("/0", 100), ("/1", 100), ("/2", 104), ("/3", 200), ("/4", 202)]


def test_image_thresholds_and_components(spark):
    schema = "full_path string, hash long, width int, height int, size_bytes long, modified_ticks long"
    low = lambda n: (1 << n) - 1
    make = lambda *hashes, sizes=None: spark.createDataFrame([(f"/{i}", h, *(sizes[i] if sizes else (100, 100)), 1, 1) for i, h in enumerate(hashes)], schema)
    for d in (4, 8, 12):
        assert similarity.image_pairs(make(0, low(d), sizes=None), d).count() == 1
        assert similarity.image_pairs(make(0, low(d + 1)), d).count() == 0
    assert similarity.image_pairs(make(5, 5, sizes=[(19, 19), (20, 19)]), 0).count() == 1
    assert similarity.image_pairs(make(5, 5, sizes=[(19, 19), (21, 19)]), 0).count() == 0
    got = similarity.image_groups(make(0, low(8), low(16)), 8).collect()
    assert [(r["group_id"], r["full_path"], r["distance"], r["similarity_percent"]) for r in got] == [("image-0001", "/0", 0, 100.0), ("image-0001", "/1", 8, 87.5), ("image-0001", "/2", 16, 75.0)]


def test_many_copies_of_one_picture(spark):
    schema = "full_path string, hash long, width int, height int, size_bytes long, modified_ticks long"
    rows = [(f"/{i:04}", 5, 10, 10, 1, 1) for i in range(3000)] + [("/z", 4, 10, 10, 9, 1), ("/far", -1, 10, 10, 1, 1)]
    got = similarity.image_groups(spark.createDataFrame(rows, schema), 4).collect()
    assert len(got) == 3001 and {r["group_id"] for r in got} == {"image-0001"} and got[0]["full_path"] == "/z"


def test_blocks_of_pictures_and_videos_meet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_LEAST", 1)
    monkeypatch.setattr(similarity, "BLOCK_MOST", 12)
    s = 10_000_000
    images = [(f"/{i:03}", (1 << i % 9) - 1, 100, 100) for i in range(60)]
    got = {(r[0], r[1]) for r in similarity.image_pairs(spark.createDataFrame(images, "full_path string, hash long, width int, height int"), 3).collect()}
    assert got == {(a[0], b[0]) for a in images for b in images if a[0] < b[0] and abs(images.index(a) % 9 - images.index(b) % 9) <= 3}
    videos = [(f"/{i:03}", [(1 << i % 9) - 1] * 5, 1.0, (10 + i) * s) for i in range(60)]
    close = lambda i, j: abs(i % 9 - j % 9) <= 2 and (abs(i - j) <= 2 or 50 * abs(i - j) <= 10 + max(i, j))
    found = similarity.video_pairs(spark.createDataFrame(videos, "full_path string, hashes array<long>, display_aspect double, duration_ticks long"), 2).collect()
    got = [(r[0], r[1]) for r in found]
    assert sorted(got) == sorted((f"/{i:03}", f"/{j:03}") for j in range(60) for i in range(j) if close(i, j))


def test_plain_tracks_stay_out_of_python(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: unicodedata.normalize("NFKC", t))

    monkeypatch.setattr(similarity.text, "compatible", counted)
    rows = [(f"/{i}", f"Song {i}!", None, "Who", 5) for i in range(50)] + [("/w", "Ｓｏｎｇ　１", "Ｗｈｏ", None, 5), ("/x", "é", "...", "", 5)]
    tracks = spark.createDataFrame(rows, "full_path string, title string, artist string, album_artist string, duration_ticks long").coalesce(1)
    good, skipped = similarity.music_keys(tracks)
    got = {r["full_path"]: (r["title_key"], r["artist_key"]) for r in good.collect()}
    assert len(got) == 51 and got["/1"] == got["/w"] == ("song 1", "who") and [r["path"] for r in skipped.collect()] == ["/x"]
    assert 0 < seen.value < 50


def test_names_are_inspected_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("reasons string, suggestion string")
    def inspect(names: pd.Series) -> pd.DataFrame:
        seen.add(len(names))
        return pd.DataFrame({"reasons": ["bad"] * len(names), "suggestion": names})

    monkeypatch.setattr(findings, "_inspect", inspect)
    files = spark.range(100, numPartitions=4).select(F.format_string("/%03d", "id").alias("full_path"), F.lit("a?").alias("file_name"), F.lit(0).alias("attributes"), *[F.lit(1).cast("long").alias(c) for c in ("size_bytes", "created_ticks", "modified_ticks")])
    assert tables.placed(findings.bad_names(files)).count() == 100
    assert seen.value == 100


def test_video_durations(spark):
    s = 10_000_000
    schema = "full_path string, hashes array<long>, display_aspect double, duration_ticks long"
    for a, b, want in ((1 * s, 3 * s, 1), (1 * s, 3 * s + 1, 0), (196 * s, 200 * s, 1), (196 * s - 1, 200 * s, 0)):
        df = spark.createDataFrame([("/a", [0] * 5, 1.0, a), ("/b", [1, 3, 7, 15, 31], 1.0, b)], schema)
        assert similarity.video_pairs(df, 3).count() == want
        assert similarity.video_pairs(df, 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1. :?\t\x7f‮／．ＣＯＮconNULé﷽ 　"), max_size=12))
def test_suggested_names_have_nothing_wrong(name):
    assert not findings.name_reasons(findings.name_suggestion(name)) or not findings.name_reasons(name)


def test_plain_names_are_not_inspected(spark):
    names = ["con", "CON .x", "a", "a.b", ".x", "", "é", " a", "a ", "a.", "a|b", "LPT1", "com10", "aux.", "a\tb"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", findings.suspicious(F.col("n"))).collect()}
    assert all(got[n] for n in names if findings.name_reasons(n))


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"1")
        z.writestr("b", b"2")
    good = out.getvalue()
    assert probe_zip(good) == ("Valid", None) and probe_zip(good + b"x") == ("Invalid", "ZipCentralDirectoryFailure")
    at = good.rindex(b"PK\x01\x02")
    locked = good[: at + 8] + b"\x01" + good[at + 9 :]
    assert probe_zip(locked) == ("UnsupportedOrProtected", "PasswordProtected")
    end = good.rindex(b"PK\x05\x06")
    assert probe_zip(good[: end + 4] + b"\x01" + good[end + 5 :]) == ("UnsupportedOrProtected", "UnsupportedContainer")
    assert probe_zip(None)[0] == probe_zip(b"PK")[0] == "Invalid"
    empty = good[end : end + 8] + bytes(14)
    assert probe_zip(empty) == ("Valid", None) and probe_zip(empty[:-2] + b"\x02\0hi") == ("Valid", None) and probe_zip(empty[:-2] + b"\x03\0hi")[0] == "Invalid"
    assert all(probe_zip(good[:n])[0] == "Invalid" for n in range(len(good)))
    size, offset = struct.unpack_from("<II", good, end + 12)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, size, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    marks = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert probe_zip(good[:end] + wide + locator + marks) == ("Valid", None)
    assert probe_zip(good[:end] + wide + marks)[0] == "Invalid" and probe_zip(good[:end] + wide[:-1] + locator + marks)[0] == "Invalid"
    assert probe_zip(good[:end] + wide + locator[:16] + b"\x02\0\0\0" + marks)[1] == "UnsupportedContainer"
    assert probe_zip(good[:end] + struct.pack("<4sQ", b"PK\x06\x06", 45) + wide[12:] + locator + marks)[0] == "Invalid"


def test_file_system(spark, tmp_path):
    for name in ("a.txt", "sub/b.TXT", "sub/deep/c", ".hid", "skip/x", "zero"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "zero" else b"same")
    (tmp_path / "empty").mkdir()
    os.symlink("nowhere", tmp_path / "dangling")
    os.symlink("a.txt", tmp_path / "sound")
    os.symlink("loop", tmp_path / "loop")
    os.link(tmp_path / "a.txt", tmp_path / "hard")
    found = inventory(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "none")], [str(tmp_path / "a.txt")], [str(tmp_path / "skip")])
    short = lambda rows: sorted(r[0].removeprefix(str(tmp_path)).lstrip("/") for r in rows)
    assert short(found["files"].select("full_path").collect()) == [".hid", "a.txt", "hard", "sub/b.TXT", "sub/deep/c", "zero"]
    folders = {r["full_path"].removeprefix(str(tmp_path)): (r["physical_child_count"], r["depth"]) for r in found["directories"].collect()}
    assert folders == {"": (10, 0), "/sub": (2, 0), "/sub/deep": (1, 1), "/empty": (0, 1)}
    assert short(findings.empty_folders(found["directories"], found["roots"], found["reparse_points"]).select("full_path").collect()) == ["empty"]
    links = {r["full_path"].rsplit("/", 1)[1]: r["reason"] for r in findings.invalid_links(found["links"]).collect()}
    assert links == {"dangling": "Link target is missing.", "loop": "Link target cannot be resolved."}
    assert short(found["skipped"].select("path").collect()) == ["none"]
    members = exact.funnel(exact.admitted(with_content(found["files"]), hidden=True), staged=True)
    assert short(members.select("full_path").collect()) == [".hid", "a.txt", "sub/b.TXT", "sub/deep/c"]
    assert short(inventory(spark, [str(tmp_path)], hidden=False, subfolders=False)["files"].select("full_path").collect()) == ["a.txt", "hard", "zero"]
    assert with_content(found["files"], 2).where("content = 'sa'").count() == 5


def test_names_and_folders_that_are_no_text_or_gone(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    at = tmp_path / "deep"
    for i in range(12):
        at = at / f"d{i}"
        at.mkdir()
        (at / f"f{i}").write_bytes(b"x")
    open(os.fsencode(tmp_path) + b"/bad\xff", "w").close()
    os.mkdir(os.fsencode(tmp_path) + b"/folder\xfe")
    found = inventory(spark, [str(tmp_path)], excluded=[str(tmp_path / "missing"), "/no/such/exclusion"])
    assert found["files"].count() == 12 and found["directories"].count() == 14
    skipped = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in found["skipped"].collect()}
    assert skipped["bad\ufffd"] == skipped["folder\ufffe".replace("\ufffe", "\ufffd")] == "Name is not valid text." and "missing" in skipped and "exclusion" in skipped


def test_an_exact_scan(spark, tmp_path):
    for name in ("a.txt", "sub/b.TXT", "sub/deep/c", ".hid", ".dir/x", "skip/x", "zero", "big"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "zero" else b"x" * (5000 if name == "big" else 4))
    os.symlink(tmp_path / "sub", tmp_path / "way")
    os.symlink(tmp_path, tmp_path / "sub" / "up")  # a circle
    os.symlink("a.txt", tmp_path / "sound")
    os.symlink("nowhere", tmp_path / "dangling")
    short = lambda rows: sorted(r[0].removeprefix(str(tmp_path)).lstrip("/") for r in rows)
    roots = [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "none")]
    look = lambda **more: short(scan(spark, roots, [str(tmp_path / "a.txt"), str(tmp_path / "gone")], [str(tmp_path / "skip")], **more)[0].select("full_path").collect())
    assert look() == ["a.txt", "big", "sub/b.TXT", "sub/deep/c"]
    assert look(min_size=0, max_size=10, hidden=True) == [".dir/x", ".hid", "a.txt", "sub/b.TXT", "sub/deep/c", "zero"]
    assert look(extensions=[".TXT"]) == ["a.txt", "sub/b.TXT"] and look(subfolders=False) == ["a.txt", "big", "sub/b.TXT"]
    followed = look(follow=True)
    assert {"a.txt", "big", "sound", "sub/b.TXT", "way/b.TXT", "way/deep/c"} <= set(followed) and "dangling" not in followed
    assert scan(spark, roots)[1].count() == 0
    with pytest.raises(ValueError):
        scan(spark, roots, min_size=5, max_size=4)
    files = inventory(spark, [str(tmp_path)])["files"]
    seen = []

    def read(rows, most):
        seen.append(most)
        return with_content(rows, most)

    assert short(exact.funnel(files.where("size_bytes > 0"), True, read).select("full_path").collect()) == [".dir/x", ".hid", "a.txt", "skip/x", "sub/b.TXT", "sub/deep/c"]
    assert seen == [exact.PREFIX_BYTES, None] and exact.funnel(files, False, with_content).count() == 6


def test_providers(spark, tmp_path):
    (tmp_path / "good").write_bytes(b"12345")
    (tmp_path / "bad").write_bytes(b"x")

    def provider(path):
        with open(path, "rb") as f:
            data = f.read()
        if data == b"x":
            return False, None, "odd"
        return True, {"width": len(data), "height": 1, "luminance": data * 200 + bytes(24)}, None

    files = inventory(spark, [str(tmp_path)], [str(tmp_path / "bad")])["files"].unionByName(inventory(spark, [], [str(tmp_path / "good")])["files"].withColumn("full_path", F.lit(str(tmp_path / "gone")))).distinct()
    rows = attempted(files, provider, "width int, height int, luminance binary")
    got = {r["full_path"].rsplit("/", 1)[1]: (r["ok"], r["width"], r["error"]) for r in rows.collect()}
    assert got["good"] == (True, 5, None) and got["bad"] == (False, None, "odd") and got["gone"][:2] == (False, None) and got["gone"][2]
    good, skipped = review.sampled(rows, review.sound_image(), review.FAILED_IMAGE)
    assert [r["full_path"][-4:] for r in good.collect()] == ["good"] and {r["reason"] for r in skipped.collect()} == {review.CHANGED, review.FAILED_IMAGE}
    assert with_skips(rows, "no")[1].count() == 2


def test_one_operation_at_a_time(spark):
    operations = Operations(spark)
    assert not operations.cancel()
    with operations.run("scan") as tag:
        assert tag in spark.sparkContext.getJobTags()
        with pytest.raises(Busy), operations.run("other"):
            pass
        assert operations.cancel() and operations.cancelled and operations.active == "scan"
    assert operations.active is None and tag not in spark.sparkContext.getJobTags()
    with operations.run("next"):
        assert spark.range(3).count() == 3 and not operations.cancelled


def test_moves_of_numbered_names(spark):
    rows = spark.createDataFrame([("/x/a.txt", "a.txt"), ("/y/a.txt", "a.txt"), ("/z/a (2).txt", "a (2).txt"), ("/z/b (2).txt", "b (2).txt"), ("/z/(2)", "(2)")], "full_path string, file_name string")
    got = {r["full_path"]: r["new_name"] for r in actions.move_plan(rows, spark.createDataFrame([("A (3).txt",)], "name string"), "/to").collect()}
    assert got == {"/x/a.txt": "a.txt", "/y/a.txt": "a (2).txt", "/z/a (2).txt": "a (2) (2).txt", "/z/b (2).txt": "b (2).txt", "/z/(2)": "(2)"}
    many = spark.range(3000).select(F.format_string("/%05d/n.txt", "id").alias("full_path"), F.lit("n.txt").alias("file_name"))
    names = [r[0] for r in actions.move_plan(many, rows.select(F.col("file_name").alias("name")), "/to").orderBy("full_path").select("new_name").collect()]
    assert names == ["n.txt", *(f"n ({i}).txt" for i in range(2, 3001))]
    assert actions.move_plan(rows.limit(0), rows.select(F.col("file_name").alias("name")), "/to").count() == 0


def test_places_of_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k")).repartition(9)
    got = numbered(rows, [F.desc("k"), F.col("v")]).collect()
    want = sorted(((r["k"], r["v"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 1001))
    assert numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_a_shared_folder_is_required_on_a_cluster(tmp_path):
    class Conf:
        def __init__(self, **found):
            self.found = found

        def get(self, key, default=None):
            return self.found.get(key, default)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError):
        tables.shared_folder(session)
    session.conf = Conf(**{"spark.checkpoint.dir": "hdfs://shared"})
    assert tables.shared_folder(session) == "hdfs://shared"


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([("/b", "File", "r,1", None, None, None, 5, None, 638_081_280_000_000_000, {"b": "1", "a": "2"}), ("/A", "File", "r", "s", "g", 87.5, None, None, None, {})], "path string, kind string, reason string, suggestion string, group_id string, similarity_percent double, size_bytes long, created_ticks long, modified_ticks long, metadata map<string,string>")
    skipped = spark.createDataFrame([("/a", 'no "way"')], "path string, reason string")
    rows = export.export_rows(items, skipped, "T", 638_081_280_000_000_000, export.scope_text(2, 1, 0, False))
    target = str(tmp_path / "x.csv")
    export.write_csv(rows, target)
    data = open(target, "rb").read()
    lines = data.decode("utf-8-sig").split("\r\n")
    assert data.startswith(b"\xef\xbb\xbf") and len(lines) == 5 and lines[0].startswith("record_type,tool")
    assert [x.split(",")[0] for x in lines[1:4]] == ["skipped_path", "item", "item"] and '"{""a"":""2"",""b"":""1""}"' in lines[2] and '"no ""way"""' in lines[1] and ",g,87.5," in lines[3]
    with pytest.raises(FileExistsError):
        export.write_csv(rows, target)
    with pytest.raises(ValueError):
        export.write_csv(rows, "relative.csv")
    export.write_json(rows, str(tmp_path / "x.json"))
    whole = json.load(open(tmp_path / "x.json"))
    assert [len(whole["items"]), len(whole["skippedPaths"]), whole["metadata"]["scope_summary"]] == [2, 1, "2 folders, 1 file, 0 excluded; subfolders excluded"]
    assert sorted(os.listdir(tmp_path)) == ["x.csv", "x.json"]


def test_evidence_follows_snapshots(spark):
    schema = "full_path string, size_bytes long, modified_ticks long"
    now = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 3), ("/c", 3, 3)], schema)
    cache = spark.createDataFrame([("/a", 1, 1, 2, 10), ("/b", 2, 2, 2, 20), ("/c", 3, 3, 1, 30), ("/d", 4, 4, 2, 40)], schema + ", version int, hash long")
    assert sorted(r[0] for r in evidence.missing(now, cache, 2).select("full_path").collect()) == ["/b", "/c"]
    fresh = evidence.refreshed(now, cache, 2, lambda df: df.withColumn("hash", F.lit(0).cast("long")))
    assert sorted((r["full_path"], r["hash"]) for r in fresh.collect()) == [("/a", 10), ("/b", 0), ("/c", 0)]


def test_moves(spark):
    rows = spark.createDataFrame([("/1/a.txt", "a.txt"), ("/2/A.TXT", "A.TXT"), ("/3/b", "b")], "full_path string, file_name string")
    used = spark.createDataFrame([("a (2).txt",)], "name string")
    plan = lambda how: {r["full_path"]: (r["new_name"], r["action"]) for r in actions.move_plan(rows, used, "/to", how).collect()}
    assert plan("KeepBoth") == {"/1/a.txt": ("a.txt", "move"), "/2/A.TXT": ("A (3).TXT", "move"), "/3/b": ("b", "move")}
    assert [plan("Skip")[k][1] for k in ("/1/a.txt", "/2/A.TXT")] == ["move", "skip"]
    assert {v[1] for v in plan("Cancel").values()} == {"cancel"}


def test_geometry_and_codecs(spark):
    rows = spark.createDataFrame([(720, 576, 16, 15, "None"), (720, 576, None, None, "Rotate90"), (0, 5, 1, 1, "None"), (5, 5, 0, 1, "None")], "w int, h int, n int, d int, o string")
    g = media_policy.display_geometry(*(F.col(c) for c in "whndo"))
    got = [tuple(r) for r in rows.select(g["width"], g["height"], g["display_width"], g["display_height"]).collect()]
    assert got == [(720, 576, 768.0, 576.0), (576, 720, 576.0, 720.0), (None,) * 4, (None,) * 4]
    names = spark.createDataFrame([(" h264es ",), ("hevc",), ("VP9 ",)], "c string").select(media_policy.codec(F.col("c"), media_policy.VIDEO_CODECS)).collect()
    assert [r[0] for r in names] == ["H.264", "HEVC", "VP9"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def test_plans_that_overlap(spark):
    pairs = spark.createDataFrame([("/a", "/b"), ("/a", "/c"), ("/d", "/B")], "survivor_path string, duplicate_path string")
    assert [r["path_key"] for r in actions.repeated_paths(pairs).collect()] == ["/B"]


def test_options_settings_scope_and_progress():
    from filegrove.operators import review

    review.check_options("SimilarImages", {"distance": 12}, 4)
    review.check_options("EmptyFiles", {})
    review.check_scan(0, None, 8)
    for bad in ((-1,), (5, 4), (0, None, 3)):
        with pytest.raises(ValueError):
            review.check_scan(*bad)
    for tool, options, workers in (("SimilarImages", {"distance": 13}, 1), ("SimilarVideos", {"mean": 14}, 1), ("EmptyFiles", {"distance": 1}, 1), ("BigFiles", {}, 1), ("BigFiles", {"minimum_bytes": -1}, 1), ("EmptyFiles", {}, 3), ("Nothing", {}, 1)):
        with pytest.raises(ValueError):
            review.check_options(tool, options, workers)
    read = review.Settings(min_bytes=-5, temporary_days=0, image_preset="x", media_workers=3, hashing_workers=8).normal()
    assert (read.min_bytes, read.temporary_days, read.image_preset, read.media_workers, read.hashing_workers) == (0, 1, "balanced", None, 8)
    scope = review.Scope().include("/a").include("/A/").include(" ").exclude("/b").include("/B").exclude("/a/")
    assert (scope.included, scope.excluded) == (("/B",), ("/a/",))
    assert [review.eta_text(*x) for x in ((0, 5, 1), (5, 0, 1), (9, 10, 1), (1, 3, 2.2))] == ["-", "-", "<1s", "5s"]
    assert review.whole_progress(1, 4, 0.5) == 37.5 and review.whole_progress(1, 4, 0.1, 30.0) == 30.0 and review.whole_progress(3, 4, 7) == 100


def test_xxh3(spark):
    import xxhash

    from filegrove.functions import hashes

    rows = spark.createDataFrame([(b"",), (b"abc",), (b"x" * 5000,), (None,)], "b binary").select("b", hashes.hex16(hashes.xxh3(F.col("b"))).alias("h")).collect()
    assert all(r["h"] == (None if r["b"] is None else f"{xxhash.xxh3_64_intdigest(bytes(r['b'])):016X}") for r in rows)


def test_video_samples_need_five_frames(spark):
    from filegrove.operators import review

    frame = b"f" * 1024
    rows = [(1, [frame] * 5, 1.0, "c"), (2, [frame] * 4, 1.0, "c"), (3, [frame] * 4 + [None], 1.0, "c"), (4, None, 1.0, "c"), (5, [frame] * 5, float("inf"), "c"), (6, [frame] * 5, 1.0, " "), (7, [frame] * 4 + [b"short"], 1.0, "c")]
    df = spark.createDataFrame(rows, "i int, frames array<binary>, fps double, codec string").withColumns({c: F.lit(2.0) for c in ("width", "height", "display_aspect", "duration_ticks")})
    assert [r["i"] for r in df.where(review.sound_video()).collect()] == [1]


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    asked, stars = [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda edges: asked.append(1) or stars(edges))
    path = spark.range(300).selectExpr("(id * 8) % 301 AS a", "(id * 8 + 8) % 301 AS b")
    want = {(i, 0) for i in range(301)}
    assert {tuple(r) for r in graph.connected(path).collect()} == want and len(asked) == 1
    monkeypatch.setattr(graph, "CONTRACTED", 60)  # stars of several tasks
    assert {tuple(r) for r in graph.connected(path.repartition(8)).collect()} == want


def test_components_after_nodes_went(spark):
    import random

    from filegrove.operators.graph import connected, without_nodes

    rng = random.Random(9)
    edges = [(i, i + rng.randint(1, 3)) for i in range(0, 300) if rng.random() < 0.75] + [(1000, i) for i in range(1001, 1200)] + [(2000, 2001)]
    table = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    labels = connected(table(edges))
    before = {r["node"]: r["label"] for r in labels.collect()}
    for gone in ([], [1000], [2001, 7777], rng.sample(range(300), 20), list(range(3000))):
        want = {r["node"]: r["label"] for r in connected(table([e for e in edges if not set(e) & set(gone)])).collect()}
        found = without_nodes(table(edges), labels, spark.createDataFrame([(g,) for g in [*gone, *gone[:3]]], "node long"))
        got = [(r["node"], r["label"]) for r in found.collect()]
        assert dict(got) == want and len(got) == len(want)
    assert before

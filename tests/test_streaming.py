from filegrove.streaming.incremental import Throttle, watch_groups

FILE = "full_path string, file_name string, extension string, size_bytes long, created_ticks long, modified_ticks long, attributes int, identity string, content binary"


def test_groups_grow_with_the_stream(spark, tmp_path):
    rows = lambda *files: spark.createDataFrame([(p, p, "", len(c), 1, 1, 0, i, c) for p, c, i in files], FILE)
    rows(("/a", b"x", "1"), ("/b", b"y", "2"), ("/c", b"x", "1")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    run = lambda: watch_groups(spark.readStream.schema(FILE).parquet(str(tmp_path / "in")), str(tmp_path / "seen"), lambda df, _: got.append(sorted(r["full_path"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert got == [[]]  # /a and /c are one file
    rows(("/d", b"x", "4"), ("/e", b"z", "5")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert got[1:] == [["/a", "/d"]]


def test_throttle():
    now, seen = [0.0], []
    t = Throttle(seen.append, 0.1, lambda: now[0])
    for i, at in enumerate((0.0, 0.05, 0.1, 0.15, 0.16)):
        now[0] = at
        t(i, final=i == 4)
    assert seen == [0, 2, 4]

import gzip
import random

import duckdb
from pyspark.sql import functions as F

from filegrove.llm.warc import NOT_MODIFIED, ORACLE, PERMITTED, canonical_url, format_record, latest_earlier, parse_warc, read_warc, resolve_revisits, revisit_digests


def test_records_round_trip_and_broken_files():
    one = format_record("response", "<a>", "http://x/é", 100, "200 OK", [("A", "1"), ("a", "é")], b"body\r\n\r\nWARC/1.1")
    two = format_record("revisit", "<b>", "http://x/", 101, "304 Not Modified", [], b"", NOT_MODIFIED)
    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        rows = list(parse_warc(data))
        assert [r[0] for r in rows] == ["<a>", "<b>"] and rows[0][3:6] == (100, None, 200) and rows[0][7] == b"body\r\n\r\nWARC/1.1"
        assert rows[0][6] == [{"name": "A", "value": "1"}, {"name": "a", "value": "é"}] and rows[1][4:6] == (NOT_MODIFIED, 304)
    assert list(parse_warc(None)) == list(parse_warc(b"\r\n")) == []
    for bad in (b"junk", one[:-30], one + b"WARC/1.1\r\nx", b"\x1f\x8bjunk junk junk", b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        assert list(parse_warc(bad))[-1][8]


def test_reading_goes_on_behind_what_is_broken():
    one = format_record("response", "<a>", "http://x/", 100, "200 OK", [], b"body")
    two = format_record("response", "<b>", "http://x/", 101, "200 OK", [], b"more")
    ids = lambda data: [r[0] for r in parse_warc(data)]
    for bad in (b"junk", one[:-30], one.replace(b"Content-Length: ", b"Content-Length: x"), one.replace(b"Content-Length: ", "Content-Length: ²".encode()), b"WARC/1.1\r\nx\r\n\r\n", one.replace(b"Length: ", b"Length: 9999999999999999999")):
        assert ids(bad + b"\r\n" + two) == [None, "<b>"] and ids(two + bad)[0] == "<b>" and ids(two + bad)[-1] is None
    assert [r[5] for r in parse_warc(one.replace(b"1.1 200", "1.1 ²00".encode()).replace(b"Content-Length: 2", b"Content-Length: 2"))][0] is None
    packed = gzip.compress(one) + gzip.compress(two)
    assert ids(packed[:-20]) == ["<a>", None] or ids(packed[:-20]) == ["<a>", None, None]
    assert list(parse_warc(packed[:-20]))[-1][8].startswith("gzip") and list(parse_warc(gzip.compress(one)[:-3]))[-1][8]
    assert ids(gzip.compress(one) + b"tail") == ["<a>", None] and ids(gzip.compress(one) + b"\x1f\x8bbad bad bad") == ["<a>", None]


def test_long_records_and_repeated_ids(spark):
    body = bytes(range(256)) * 20_000
    files = [format_record("response", "<1>", "http://h/p", 10, "200 OK", [], body) * 3, b"".join(format_record("revisit", f"<v{i}>", "http://h/p", 20 + i, "304 Not Modified", [], b"", NOT_MODIFIED) for i in range(40))]
    rows = resolve_revisits(read_warc(spark.createDataFrame([(f,) for f in files], "content binary"))).collect()
    assert len(rows) == 40 and all(r["outcome"] == "unverified" and r["payload"] == body for r in rows)


def test_canonical_urls(spark):
    cases = {
        "HTTP://user:p@WWW2.Example.com:80/a/b/?b=2&utm_source=x&a=1#f": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "https://example.com:8080/?": "example.com:8080",
        "//h/x?": "h/x", "http://h/A?q": "h/A?q", "mailto:x": None, "": None, None: None, "http://h/?REF=1&sid": "h", " http://h/ ": "h",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases


def test_latest_earlier_is_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(60)]), rng.random() < 0.3, f"r{i:04}") for i in range(800)]
    for partitions in (1, 7):
        for r in latest_earlier(spark.createDataFrame(rows, "key string, ts long, full boolean, id string"), partitions).collect():
            fits = [(t, i) for k, t, full, i in rows if full and k is not None and k == r["key"] and t is not None and r["ts"] is not None and t < r["ts"]]
            assert (tuple(r["before"]) if r["before"] else None) == max(fits, default=None)


def test_outcomes_and_headers(spark):
    rev = lambda i, ts, head: format_record("revisit", f"<v{i}>", "https://www.h/p/#x", ts, "304 Not Modified", head, b"", NOT_MODIFIED)
    files = [
        format_record("response", "<1>", "http://h/p", 10, "200 OK", [("ETag", '"a"'), ("Date", "old"), ("Content-Type", "t")], b"one"),
        format_record("response", "<2>", "http://h/p", 20, "404 Not Found", [("ETag", '"z"')], b"not full"),
        format_record("response", "<3>", "http://h/p", 30, "200 OK", [("Last-Modified", "m")], b"three"),
        rev(0, 10, []), rev(1, 11, [("etag", 'W/"a"'), ("Date", "new"), ("Content-Type", "bad"), ("Vary", "*")]), rev(2, 25, [("ETag", '"b"')]), rev(3, 30, []),
        rev(4, 31, [("ETag", '"b"'), ("Last-Modified", "m")]), rev(5, 32, [("Last-Modified", "n")]), rev(6, 33, [("Server", "s")]),
        format_record("revisit", "<other>", "http://h/p", 40, "200 OK", [], b"", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    ]
    df = spark.createDataFrame([(f,) for f in files] + [(None,), (b"junk",)], "content binary")
    rows = {r["record_id"]: r for r in resolve_revisits(read_warc(df)).collect()}
    got = {k: (r["outcome"], r["response_id"]) for k, r in rows.items()}
    assert got == {"<v0>": ("missing", None), "<v1>": ("resolved", "<1>"), "<v2>": ("mismatch", "<1>"), "<v3>": ("unverified", "<1>"), "<v4>": ("resolved", "<3>"), "<v5>": ("mismatch", "<3>"), "<v6>": ("unverified", "<3>")}
    assert [tuple(h) for h in rows["<v1>"]["headers"]] == [("Content-Type", "t"), ("etag", 'W/"a"'), ("Date", "new"), ("Vary", "*")]
    assert rows["<v1>"]["payload"] == b"one" and rows["<v2>"]["payload"] is None and rows["<v6>"]["headers"][0]["name"] == "Last-Modified"
    assert all(n == n.lower() for n in PERMITTED)


def test_crawl_is_that_of_the_sql(spark):
    for sf in ("0.001", "0.01"):
        path = f"/root/testdata/sf{sf}/pages.parquet"
        db = duckdb.connect()
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
        want = sorted(db.execute(ORACLE).fetchall(), key=lambda r: r[0])
        got = sorted(map(tuple, revisit_digests(spark.read.parquet(path)).collect()), key=lambda r: r[0])
        assert got == want and {r[2] for r in got} == {"resolved", "unverified", "mismatch", "missing"}


def test_empty_null_and_clashing(spark):
    schema = "page_id long, url string, html string, ts long, content string"
    assert revisit_digests(spark.createDataFrame([], schema)).count() == 0
    rows = revisit_digests(spark.createDataFrame([(1, None, None, 5, "x"), (2, "http://a/b", None, 5, "x"), (None, "http://a/b", "z", 5, "x")], schema)).collect()
    assert sorted((r["page_id"], r["outcome"]) for r in rows) == [(1, "missing"), (2, "resolved")]

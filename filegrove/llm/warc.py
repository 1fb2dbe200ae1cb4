"""Operator 9: WARC records, and not-modified revisits resolved by an as-of join on canonical URLs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filegrove.llm.common import CHUNK_BYTES, map_arrow, written

#: Fields of a 304 answer that replace those of the stored response (lower case).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that tell nothing about the page.
NOISE = r"^(?:utm_[a-z_]+|gclid|fbclid|msclkid|ref|phpsessid|jsessionid|sid|sessionid)(?:=.*)?$"
DIGITS = re.compile("[0-9]{1,18}")
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

RECORD = "record_id string, warc_type string, uri string, ts long, profile string, status int, headers array<struct<name:string,value:string>>, payload binary, error string"
_FIELDS = ["record_id", "warc_type", "uri", "ts", "profile", "status", "headers", "payload", "error"]
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), _HEADERS, pa.binary(), pa.string()]


# --- records as bytes ------------------------------------------------------------------------------------------------


def _seconds(date: str | None) -> int | None:
    try:
        return int(datetime.strptime((date or "")[:19], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def _date(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Names and values of header lines; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.replace(b"\r\n", b"\n").split(b"\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def unzipped(data: bytes) -> tuple[bytes, str | None]:
    """Concatenated gzip members as plain bytes, and what is wrong with them; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: a member is cut"
        data = member.unused_data
    return (b"".join(out), "gzip: no member" if data.strip(b"\0") else None) if out else (data, None)


def _next_record(data: bytes, at: int) -> int:
    """Where the next line that begins a record stands, or the end."""
    while (at := data.find(b"WARC/1.", at)) > 0 and data[at - 1] not in b"\r\n":
        at += 1
    return at if at >= 0 else len(data)


def parse_warc(data: bytes | None) -> Iterator[tuple]:
    """The records of a WARC file as rows of RECORD. Whatever can't be read yields one row with an error; what follows it is
    read from the next line that begins a record."""
    broken = lambda why: (None,) * 8 + (why,)
    data, fault = unzipped(data or b"")
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            break
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0 or data.find(b"\nWARC/1.", at, end) >= 0:
            yield broken("no record header, or cut")
            at = _next_record(data, at + 1)
            continue
        line, _, head = data[at:end].partition(b"\r\n")
        fields = {k.lower(): v for k, v in _fields(head)}
        length = fields.get("content-length", "")
        # a block is followed by line ends or by nothing
        if not DIGITS.fullmatch(length) or (after := end + 4 + int(length)) > len(data) or data[after : after + 1] not in (b"\r", b"\n", b""):
            yield broken("no content length, or cut")
            at = _next_record(data, at + 1)
            continue
        block, at = data[end + 4 : after], after
        status, headers, payload = None, [], block
        if fields.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            first, _, rest = top.partition(b"\r\n")
            words = first.split()
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) == 3 else None
            headers = _fields(rest)
        yield fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri", "").strip("<>") or None, _seconds(fields.get("warc-date")), fields.get("warc-profile"), status, [{"name": k, "value": v} for k, v in headers], payload, None
    if fault:
        yield broken(fault)


def format_record(kind: str, record_id: str, uri: str, ts: int, status: str, headers: list[tuple[str, str]], payload: bytes, profile: str = "") -> bytes:
    """One WARC/1.1 record of an HTTP answer."""
    block = b"".join([f"HTTP/1.1 {status}\r\n".encode(), *(f"{k}: {v}\r\n".encode() for k, v in headers), b"\r\n", payload])
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", _date(ts)), ("Content-Type", "application/http;msgtype=response")]
    head += [("WARC-Profile", profile)] * bool(profile) + [("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def read_warc(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of all files (a binary column): columns of RECORD. Null and empty files have no records. Records leave
    the worker as soon as about CHUNK_BYTES of them are read."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_FIELDS)

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for data in batch.column("content"):
            for row in parse_warc(data.as_py()):
                rows.append(row)
                held += len(row[7] or b"") + 500
                if held > CHUNK_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return map_arrow(files.select(F.col(f"`{content}`").alias("content")), kernel, RECORD)


# --- revisits --------------------------------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """A URL without scheme, user, www, default port, fragment, trailing slash and noise parameters; host in small letters,
    parameters sorted. Null for null and for a text without a host."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(F.trim(url), pattern, i)
    host = F.regexp_replace(F.lower(part(1)), r"^www[0-9]*\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), "/+$", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(NOISE)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, port, path, query))


def _header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.try_element_at(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(1))


def latest_earlier(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows (key, ts, full, id) and before: struct<ts,id> of the latest full row of the key with a smaller ts, or null.

    Rows are dealt by ranges of (key, ts), so a key with very many rows spreads over tasks; each range looks back within
    itself, and takes what the key's earlier ranges hand on: one row a range and key. Of full rows with the same ts the
    greatest id counts. Rows with a null key or ts have none and hand on none.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, "key", "ts").withColumn("part", F.spark_partition_id()), "asof-ranges")
    full = F.when(F.col("full") & F.col("key").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "id"))
    handed = dealt.groupBy("key", "part").agg(F.max(full).alias("last"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    handed = handed.select("key", "part", F.max("last").over(earlier).alias("handed")).where("key IS NOT NULL AND handed IS NOT NULL")
    within = Window.partitionBy("key", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.when(F.col("key").isNotNull() & F.col("ts").isNotNull(), F.max(full).over(within)))
    return near.join(handed, ["key", "part"], "left").select(*rows.columns, F.coalesce("near", F.when(F.col("ts").isNotNull(), F.col("handed"))).alias("before"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit of records (RECORD): record_id, uri, url (canonical), ts, outcome, response_id,
    response_ts, headers, payload.

    The response is the latest full one (type response, status 200) of the same canonical URL with an earlier time.
    Outcomes: resolved (ETags agree, weakly compared; without ETags on both sides, Last-Modified agrees), unverified (no
    validator on both sides), mismatch (they differ), missing (no earlier response, or the revisit has no URL or time).
    Resolved and unverified rows have the response's payload and its headers, in which those PERMITTED of the revisit take
    the place of the old; others have nulls. Other records and other profiles play no part. Ids of responses are expected to
    be distinct; of equal ones any counts. Repeated revisits are all answered. A response that very many revisits name is
    joined by as many tasks as its revisits need.
    """
    records = records.select(*_FIELDS)
    url = canonical_url(F.col("uri"))
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    revisit = (F.col("warc_type") == "revisit") & F.col("profile").contains("server-not-modified")
    rows = records.where(full | revisit).select(url.alias("key"), "ts", F.coalesce(full, F.lit(False)).alias("full"), F.col("record_id").alias("id"), "uri", F.when(revisit, F.col("headers")).alias("own"))
    found = latest_earlier(rows).where(~F.col("full")).select(F.col("id").alias("record_id"), "uri", F.col("key").alias("url"), "ts", "own", F.col("before.id").alias("response_id"), F.col("before.ts").alias("response_ts"))
    response = records.where(full).select(F.col("record_id").alias("response_id"), F.col("headers").alias("old"), "payload")
    # an aggregate right below the join would keep Spark from splitting a response with many revisits, so only ids that
    # do occur several times go through one
    again = written(response.groupBy("response_id").agg(F.count("*").alias("n")).where("n > 1").select("response_id"), "warc-repeated")
    if not again.isEmpty():
        response = response.join(again, "response_id", "left_anti").unionByName(response.join(again, "response_id", "left_semi").dropDuplicates(["response_id"]))
    missing = found.where("response_id IS NULL").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in response.schema.fields[1:]])
    both = found.where("response_id IS NOT NULL").join(response, "response_id", "left").select(*missing.columns).unionByName(missing)
    tag = lambda h: F.regexp_replace(_header(h, "etag"), "^W/", "")
    own, old = F.col("own"), F.col("old")
    agree = F.coalesce(tag(own) == tag(old), _header(own, "last-modified") == _header(old, "last-modified"))
    outcome = F.when(F.col("response_id").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    named = lambda h: F.lower(h["name"])
    fresh = F.filter(own, lambda h: named(h).isin(*PERMITTED))
    replaced = F.transform(fresh, named)
    merged = F.concat(F.filter(old, lambda h: ~F.array_contains(replaced, named(h))), fresh)
    given = F.col("outcome").isin("resolved", "unverified")
    return both.withColumn("outcome", outcome).select(
        "record_id", "uri", "url", "ts", "outcome", "response_id", "response_ts", F.when(given, merged).alias("headers"), F.when(given, F.col("payload")).alias("payload")
    )


# --- a crawl of the pages table --------------------------------------------------------------------------------------

#: Seconds at which the crawl begins, and pages after which a page is visited again.
EPOCH, LATER = 1_700_000_000, 40


def crawl(pages: DataFrame) -> DataFrame:
    """content: for each page with an id a WARC file of two records; pages with a null page_id have none, as in ORACLE. A full
    response, at EPOCH + 2 x page_id; and a revisit, LATER pages and a second on, under another spelling of the URL. Of the
    revisits, each fifth has another ETag, others only a date or no validator at all, and each thirteenth asks for a page that
    was never there. Null url and html: empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            url, body = url or "", (html or "").encode()
            tag, date = f'"{hashlib.md5(body).hexdigest()[:16]}"', _date(EPOCH - 1000 - i)
            at = EPOCH + 2 * i
            answer = [("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("ETag", tag), ("Last-Modified", date), ("Cache-Control", f"max-age={i % 600}"), ("Date", _date(at))]
            again = at + 2 * LATER + 1
            other = url.replace("http://", "HTTP://WWW.", 1) if url.startswith("http://") else url.replace("https://", "http://", 1)
            other = other.partition("#")[0]
            other += ("&" if "?" in other else "?") + "utm_source=again#r" if i % 13 != 6 else "/never"
            checks = [("ETag", '"changed"')] if i % 5 == 0 else [("Last-Modified", date)] if i % 7 == 3 else [] if i % 11 == 4 else [("etag", f"W/{tag}"), ("Last-Modified", "another")]
            head = [*checks, ("Date", _date(again)), ("Content-Length", "0"), ("Cache-Control", "no-cache"), ("X-Served-By", "cache")]
            out.append(format_record("response", f"<urn:page:{i}>", url, at, "200 OK", answer, body) + format_record("revisit", f"<urn:revisit:{i}>", other, again, "304 Not Modified", head, b"", NOT_MODIFIED))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(pages.where("page_id IS NOT NULL"), kernel, "content binary")


def revisit_digests(pages: DataFrame) -> DataFrame:
    """One row per revisit of the crawl of pages: what resolve_revisits says, with digests in place of the bytes."""
    records = written(read_warc(crawl(pages)), "warc-records")
    found = resolve_revisits(records)
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    line = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", F.lower(h["name"]), h["value"])), "\n")
    return found.select(number(F.col("record_id")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "outcome", number(F.col("response_id")).alias("response_page_id"), (F.col("ts") - F.col("response_ts")).alias("age_s"), F.sha2(line, 256).alias("headers_sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"))


#: DuckDB SQL for revisit_digests(pages).
ORACLE = r"""
WITH p AS (
  SELECT page_id AS i, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body, 1700000000 + 2 * page_id AS t0 FROM pages WHERE page_id IS NOT NULL
), t AS (
  SELECT *, '"' || substr(md5(body), 1, 16) || '"' AS tag, strftime(make_timestamp((1700000000 - 1000 - i) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified,
         regexp_replace(CASE WHEN starts_with(url, 'http://') THEN 'HTTP://WWW.' || substr(url, 8) WHEN starts_with(url, 'https://') THEN 'http://' || substr(url, 9) ELSE url END, '#.*$', '') AS other
  FROM p
), r AS (
  SELECT *, t0 + 81 AS again, CASE WHEN i % 13 = 6 THEN other || '/never' ELSE other || CASE WHEN contains(other, '?') THEN '&' ELSE '?' END || 'utm_source=again#r' END AS uri,
         CASE WHEN i % 5 = 0 THEN '"changed"' WHEN i % 7 = 3 OR i % 11 = 4 THEN NULL ELSE tag END AS own_tag,
         CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 3 THEN modified WHEN i % 11 = 4 THEN NULL ELSE 'another' END AS own_modified
  FROM t
), c AS (
  SELECT *, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['h', 'o', 'p', 'q']) AS a,
         regexp_extract(trim(uri), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['h', 'o', 'p', 'q']) AS b
  FROM r
), k AS (
  SELECT *, list_sort(list_filter(string_split(a.q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z_]+|gclid|fbclid|msclkid|ref|phpsessid|jsessionid|sid|sessionid)(?:=.*)?$'))) AS qa,
         list_sort(list_filter(string_split(b.q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z_]+|gclid|fbclid|msclkid|ref|phpsessid|jsessionid|sid|sessionid)(?:=.*)?$'))) AS qb
  FROM c
), u AS (
  SELECT *,
    CASE WHEN a.h <> '' THEN regexp_replace(lower(a.h), '^www[0-9]*\.', '') || CASE WHEN a.o IN ('', '80', '443') THEN '' ELSE ':' || a.o END || regexp_replace(a.p, '/+$', '') || CASE WHEN len(qa) > 0 THEN '?' || array_to_string(qa, '&') ELSE '' END END AS key_full,
    CASE WHEN b.h <> '' THEN regexp_replace(lower(b.h), '^www[0-9]*\.', '') || CASE WHEN b.o IN ('', '80', '443') THEN '' ELSE ':' || b.o END || regexp_replace(b.p, '/+$', '') || CASE WHEN len(qb) > 0 THEN '?' || array_to_string(qb, '&') ELSE '' END END AS key_again
  FROM k
), m AS (
  SELECT v.i, v.key_again, v.own_tag, v.own_modified, v.again, f.i AS fi, f.t0 AS fat, f.tag, f.modified, f.body,
         row_number() OVER (PARTITION BY v.i ORDER BY f.t0 DESC NULLS LAST, f.i DESC) AS n
  FROM u AS v LEFT JOIN u AS f ON v.key_again = f.key_full AND f.t0 < v.again
), o AS (
  SELECT *, CASE WHEN fi IS NULL THEN 'missing' WHEN coalesce(own_tag = tag, own_modified = modified) IS NULL THEN 'unverified'
                 WHEN coalesce(own_tag = tag, own_modified = modified) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM m WHERE n = 1
)
SELECT i AS page_id, coalesce(key_again, '') AS url, outcome, fi AS response_page_id, again - fat AS age_s,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN sha256(
    'content-type: text/html' || chr(10) || 'content-length: ' || octet_length(body)
    || CASE WHEN own_tag IS NULL THEN chr(10) || 'etag: ' || tag ELSE '' END
    || CASE WHEN own_modified IS NULL THEN chr(10) || 'last-modified: ' || modified ELSE '' END
    || CASE WHEN own_tag IS NOT NULL THEN chr(10) || 'etag: ' || CASE WHEN i % 5 = 0 THEN own_tag ELSE 'W/' || own_tag END ELSE '' END
    || CASE WHEN own_modified IS NOT NULL THEN chr(10) || 'last-modified: ' || own_modified ELSE '' END
    || chr(10) || 'date: ' || strftime(make_timestamp(again * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'cache-control: no-cache') END AS headers_sha256,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN octet_length(body)::BIGINT END AS payload_bytes,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN sha256(body) END AS payload_sha256
FROM o
"""

"""The queries of the engine's operators over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegrove.functions import hashes, paths, perceptual, signatures, text
from filegrove.operators import actions, evidence, exact, export, findings, graph, media_policy, results, review, similarity, trees
from filegrove.operators.tables import numbered, placed, stored
from filegrove.session import table
from filegrove.sources import adapters, archives
from filegrove.sources.adapters import BASE, DAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark, sf_dir):
    return adapters.files(table(spark, sf_dir, "documents"))


def _members(spark, sf_dir):
    return exact.funnel(exact.admitted(_files(spark, sf_dir), hidden=True, system=True))


_W = f"WITH RECURSIVE {adapters.FILES_SQL}, adm AS (SELECT * FROM files WHERE size_bytes >= 1 AND attributes & 1024 = 0)"
_MEMBERS = (
    _W
    + """, uq AS (SELECT *, row_number() OVER (PARTITION BY content, identity ORDER BY upper(full_path), full_path) AS r FROM adm),
 mem AS (SELECT * EXCLUDE r FROM (SELECT *, count(*) OVER (PARTITION BY content) AS n FROM uq WHERE r = 1) WHERE n > 1),
 grp AS (SELECT content, size_bytes, count(*) AS n_files, arg_min(full_path, upper(full_path)) AS first_path, arg_min(file_name, upper(full_path)) AS first_name FROM mem GROUP BY content, size_bytes)"""
)

# --- identical files -------------------------------------------------------------------------------------------------

_GROUP = ["first_path", "first_name", "size_bytes", "n_files", "wasted_bytes"]


@query(_MEMBERS + " SELECT first_path, first_name, size_bytes, n_files, size_bytes * (n_files - 1) AS wasted_bytes FROM grp")
def exact_groups(spark, sf_dir):
    return exact.groups(_members(spark, sf_dir)).select(*_GROUP)


@query(_MEMBERS + " SELECT full_path, first_path, mem.size_bytes, modified_ticks FROM mem JOIN grp USING (content)")
def exact_members(spark, sf_dir):
    members = _members(spark, sf_dir)
    return members.join(exact.groups(members).select("digest", "first_path"), "digest").select("full_path", "first_path", "size_bytes", "modified_ticks")


@query(_MEMBERS + " SELECT (SELECT count(*) FROM adm) AS n_scanned, count(*) AS n_groups, sum(n_files - 1)::BIGINT AS n_copies, sum(size_bytes * (n_files - 1))::BIGINT AS reclaimable_bytes FROM grp")
def exact_summary(spark, sf_dir):
    return exact.summary(exact.admitted(_files(spark, sf_dir), hidden=True, system=True), _members(spark, sf_dir))


@query(_MEMBERS + " SELECT first_path, n_files FROM grp")
def exact_staged(spark, sf_dir):
    """The funnel by stages: size, prefix, whole content."""
    members = exact.funnel(exact.admitted(_files(spark, sf_dir), hidden=True, system=True), staged=True)
    return exact.groups(members).select("first_path", "n_files")


def _held(files):
    """Files and what reads their contents, 500 bytes at a time."""
    return files.drop("content"), exact.held_contents(files, 500)


@query(_MEMBERS + " SELECT full_path, first_path, mem.size_bytes FROM mem JOIN grp USING (content)")
def exact_waves(spark, sf_dir):
    """Contents are read range by range, and no further where they differ."""
    files, (digests, _, parts) = _held(exact.admitted(_files(spark, sf_dir), hidden=True, system=True))
    members, _ = exact.same_contents(files, digests, parts)
    return members.join(exact.groups(members).select("digest", "first_path"), "digest").select("full_path", "first_path", "size_bytes")


@query(_MEMBERS + " SELECT full_path, first_path, mem.size_bytes FROM mem JOIN grp USING (content)")
def exact_verified(spark, sf_dir):
    """Digests of three bits, which agree by chance: longer ones tell most contents apart, bytes what is left."""
    admitted = exact.admitted(_files(spark, sf_dir), hidden=True, system=True)
    files, (digests, compare, parts) = _held(admitted)
    weak = admitted.select("full_path", F.pmod(F.crc32(F.col("content").cast("binary")), F.lit(8)).cast("string").alias("digest"))
    # identities go by content, so names of one file are told apart afterwards
    found, _ = exact.verified(exact.several(files.join(weak, "full_path"), ["size_bytes", "digest"]), compare, parts, digests)
    members = exact.one_of_each(found)
    return members.join(exact.groups(members).select("size_bytes", "digest", "first_path"), ["size_bytes", "digest"]).select("full_path", "first_path", "size_bytes")


_LEAVES = _W + ", p0 AS (SELECT full_path, n, i AS part, sha256(unhex(substr(hex(encode(content)), i * 2000 + 1, 2000))) AS d FROM (SELECT *, greatest(ceil(size_bytes / 1000)::BIGINT, 1) AS n FROM files), LATERAL (SELECT unnest(range(n)) AS i))"
_TREE = "".join(f", p{i + 1} AS (SELECT full_path, (any_value(n) + 3) // 4 AS n, part // 4 AS part, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY part)) ELSE any_value(d) END AS d FROM p{i} GROUP BY full_path, part // 4)" for i in range(8))


@query(_LEAVES + _TREE + " SELECT full_path, d AS digest FROM p8")
def content_tree(spark, sf_dir):
    """Digests of contents as trees: leaves of 1000 bytes, nodes of four children."""
    files = _files(spark, sf_dir)
    digests, _, _ = exact.held_contents(files, 1000)
    return exact.tree_digests(digests(files.drop("content"), 0, 1 << 40), fan=4)


@query(_W + " SELECT size_bytes, count(*) AS n_files FROM adm GROUP BY 1 HAVING count(*) > 1")
def size_buckets(spark, sf_dir):
    return exact.admitted(_files(spark, sf_dir), hidden=True, system=True).groupBy("size_bytes").agg(F.count("*").alias("n_files")).where("n_files > 1")


@query(_W + " SELECT full_path FROM (SELECT full_path, count(*) OVER (PARTITION BY size_bytes, substr(hex(encode(content)), 1, 131072)) AS n FROM adm) WHERE n > 1")
def prefix_buckets(spark, sf_dir):
    files = exact.admitted(_files(spark, sf_dir), hidden=True, system=True).withColumn("prefix", F.xxhash64(F.substring(F.col("content").cast("binary"), 1, exact.PREFIX_BYTES)))
    return exact.several(files, ["size_bytes", "prefix"]).select("full_path")


@query(_MEMBERS + " SELECT identity, count(*) AS n_names, min(full_path) AS first_name_of_all FROM adm GROUP BY 1 HAVING count(*) > 1")
def identity_aliases(spark, sf_dir):
    """Names of one physical file."""
    return exact.admitted(_files(spark, sf_dir), hidden=True, system=True).groupBy("identity").agg(F.count("*").alias("n_names"), F.min("full_path").alias("first_name_of_all")).where("n_names > 1")


@query(_W.replace("size_bytes >= 1 AND attributes & 1024 = 0", "size_bytes BETWEEN 500 AND 5000 AND attributes & 1030 = 0 AND extension IN ('.txt', '.py', '.csv')") + " SELECT doc_id, full_path, size_bytes FROM adm")
def scan_admission(spark, sf_dir):
    return exact.admitted(_files(spark, sf_dir), 500, 5000, extensions=[".txt", ".py", ".csv"]).select("doc_id", "full_path", "size_bytes")


@query(_W + " SELECT full_path, extension FROM files WHERE extension IN ('.jpg', '.zip', '.mp3')")
def ext_category_filter(spark, sf_dir):
    return exact.admitted(_files(spark, sf_dir), 0, hidden=True, system=True, links=True, extensions=paths.category_extensions(["Images", "Archives", "Audio"])).select("full_path", "extension")


@query(_W + " SELECT full_path FROM files WHERE NOT (upper(full_path) LIKE '/SRC0/%' OR upper(full_path) LIKE '/SRC1/EN/%' OR upper(full_path) LIKE '/SRC7/FR/%' OR doc_id = 21 OR doc_id = 42)")
def exclusion_antijoin(spark, sf_dir):
    gone = spark.createDataFrame([("/SRC0/",), ("/src1/EN",), ("/src7/fr/",), ("/nowhere",)], "excluded_path string")
    files = _files(spark, sf_dir)
    one = files.where("doc_id IN (21, 42)").select(F.lower("full_path").alias("excluded_path"))
    return exact.excluded(files, gone.unionByName(one)).select("full_path")


_NEWEST = "modified_ticks DESC, length(full_path), upper(full_path), full_path"


def _kept(order: str) -> str:
    return _MEMBERS + f" SELECT full_path, first_value(full_path) OVER (PARTITION BY content ORDER BY {order}) AS survivor_path, row_number() OVER (PARTITION BY content ORDER BY {order}) > 1 AS selected FROM mem"


_KEEP = ["full_path", "survivor_path", "selected"]


@query(_kept(_NEWEST))
def keep_newest(spark, sf_dir):
    return exact.keep_one(_members(spark, sf_dir), "newest").select(*_KEEP)


@query(_kept(_NEWEST.replace(" DESC", "")))
def keep_oldest(spark, sf_dir):
    return exact.keep_one(_members(spark, sf_dir), "oldest").select(*_KEEP)


@query(_kept("length(full_path), upper(full_path), full_path"))
def keep_shortest(spark, sf_dir):
    return exact.keep_one(_members(spark, sf_dir), "shortest").select(*_KEEP)


@query(_kept("CASE WHEN full_path LIKE '/src3/%' THEN 0 ELSE 1 END, " + _NEWEST))
def keep_preferred(spark, sf_dir):
    return exact.keep_one(_members(spark, sf_dir), "preferred", "/SRC3/").select(*_KEEP)


_SELECTED = _MEMBERS + f", sel AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY {_NEWEST}) > 1 AS selected FROM mem)"


@query(_SELECTED + """, lft AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY content) AS m FROM sel WHERE doc_id % 4 <> 1) WHERE m > 1)
 SELECT full_path, selected AND NOT (bool_and(selected) OVER (PARTITION BY content) AND row_number() OVER (PARTITION BY content ORDER BY modified_ticks DESC, length(full_path), upper(full_path)) = 1) AS selected FROM lft""")
def exclude_files(spark, sf_dir):
    """After every file with an id of 1 modulo 4 went."""
    members = exact.keep_one(_members(spark, sf_dir))
    return exact.without(members, members.where("doc_id % 4 = 1").select(F.col("full_path").alias("gone_path"))).select("full_path", "selected")


@query(_MEMBERS + " SELECT full_path FROM mem WHERE content IN (SELECT content FROM mem WHERE contains(upper(full_path), '/EN/DOC_1'))")
def search_groups(spark, sf_dir):
    return exact.search(_members(spark, sf_dir), "/en/doc_1").select("full_path")


_GROUP_ORDERS = ("size_bytes * (n_files - 1) DESC", "size_bytes DESC", "n_files DESC", "upper(first_name)", "upper(lower(regexp_extract(first_name, '[.][^.]+$')))")


def _union(orders: tuple[str, ...], select: str) -> str:
    return " UNION ALL ".join(" " + select.format(i=i, order=order) for i, order in enumerate(orders))


@query(_MEMBERS + _union(_GROUP_ORDERS, "SELECT {i} AS sort_option, first_path, row_number() OVER (ORDER BY {order}, upper(first_name), upper(first_path), first_path) AS place FROM grp"))
def sort_groups(spark, sf_dir):
    """Groups in each of the five orders, with their places."""
    result = exact.groups(_members(spark, sf_dir))
    out = [exact.sort_groups(result, i).select(F.lit(i).alias("sort_option"), "first_path", "place") for i in range(len(exact.SORTS))]
    return reduce(DataFrame.unionByName, out)


@query(_MEMBERS + " SELECT first_path, row_number() OVER (ORDER BY size_bytes * (n_files - 1) DESC, upper(first_name), upper(first_path), first_path) AS place FROM grp")
def exact_order(spark, sf_dir):
    """The order in which groups are listed."""
    return placed(exact.groups(_members(spark, sf_dir))).select("first_path", "place")


@query(_SELECTED + """ SELECT count(DISTINCT content) AS n_groups, (count(*) - count(DISTINCT content))::BIGINT AS n_copies, (SELECT sum(size_bytes * (n_files - 1)) FROM grp)::BIGINT AS reclaimable_bytes,
 count(DISTINCT CASE WHEN selected THEN content END) AS selected_groups, count(*) FILTER (selected) AS selected_files, (sum(size_bytes) FILTER (selected))::BIGINT AS selected_bytes FROM sel""")
def result_totals(spark, sf_dir):
    return exact.totals(exact.keep_one(_members(spark, sf_dir)))


@query(_SELECTED + " SELECT a.full_path, count(b.full_path) AS n_survivors, arg_min(b.full_path, upper(b.full_path)) AS first_survivor FROM sel a LEFT JOIN sel b ON a.content = b.content AND NOT b.selected WHERE a.selected GROUP BY a.full_path")
def survivors_per_target(spark, sf_dir):
    return exact.survivors_of_targets(exact.keep_one(_members(spark, sf_dir))).select("full_path", "n_survivors", "first_survivor")


@query(_SELECTED + f""", old AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY {_NEWEST.replace(" DESC", "")}) > 1 AS was FROM sel)
 SELECT full_path, CASE WHEN selected THEN 'a' ELSE 'b' END AS side FROM old WHERE selected <> was""")
def selection_difference(spark, sf_dir):
    """What two rules select differently."""
    members = _members(spark, sf_dir)
    chosen = lambda rule: exact.keep_one(members, rule).where("selected").select("full_path")
    return actions.same_rows(chosen("newest"), chosen("oldest"))


# --- findings --------------------------------------------------------------------------------------------------------

_F = ["full_path", "kind", "reason", "size_bytes", "modified_ticks"]


@query(_W + " SELECT full_path, 'File' AS kind, 'At least 10,000 bytes' AS reason, size_bytes, modified_ticks, extension FROM files WHERE size_bytes >= 10000 AND attributes & 1024 = 0")
def large_files(spark, sf_dir):
    return findings.large_files(_files(spark, sf_dir), 10_000).select(*_F, F.col("metadata")["Extension"].alias("extension"))


@query(_W + " SELECT full_path, 'File' AS kind, 'File is empty' AS reason, size_bytes, modified_ticks, extension FROM files WHERE size_bytes = 0 AND attributes & 1024 = 0")
def empty_files(spark, sf_dir):
    return findings.empty_files(_files(spark, sf_dir)).select(*_F, F.col("metadata")["Extension"].alias("extension"))


_NOW = BASE + 900 * DAY


@query(_W + f""" SELECT full_path, 'File' AS kind, 'Temporary file at least 30 days old' AS reason, size_bytes, modified_ticks FROM files
 WHERE (starts_with(file_name, '~$') OR suffix(file_name, '~') OR extension IN ('.tmp', '.crdownload')) AND modified_ticks <= {_NOW - 30 * DAY} AND attributes & 1024 = 0""")
def temp_files(spark, sf_dir):
    return findings.temporary_files(_files(spark, sf_dir), _NOW, 30 * DAY).select(*_F)


_DIRS = "dirs AS (SELECT concat('/top/', c_custkey % 20, '/', c_custkey) AS full_path, (c_custkey % 4)::INT - 1 AS physical_child_count, (2 + c_custkey % 3)::INT AS depth, CASE WHEN c_custkey % 25 = 1 THEN 1040 ELSE 16 END AS attributes, c_custkey FROM customer)"


@query(f"WITH {_DIRS} SELECT full_path, 'Directory' AS kind, 'Folder is empty' AS reason, 0::BIGINT AS size_bytes, depth::VARCHAR AS depth FROM dirs WHERE physical_child_count = 0 AND attributes & 1024 = 0 AND c_custkey NOT IN (5, 9) AND c_custkey % 100 <> 13")
def empty_folders(spark, sf_dir):
    return _empty_folders(spark, sf_dir).select("full_path", "kind", "reason", "size_bytes", F.col("metadata")["Depth"].alias("depth"))


def _empty_folders(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat_ws("/", F.lit("/top"), (F.col("c_custkey") % 20).cast("string"), F.col("c_custkey").cast("string"))
    folders = c.select(path.alias("full_path"), ((F.col("c_custkey") % 4).cast("int") - 1).alias("physical_child_count"), (F.col("c_custkey") % 3 + 2).cast("int").alias("depth"), F.when(F.col("c_custkey") % 25 == 1, 1040).otherwise(16).alias("attributes"))
    roots = c.where("c_custkey IN (5, 9)").select(F.upper(path).alias("path"))
    links = c.where("c_custkey % 100 = 13").select(path.alias("path"))
    return actions.deepest_first(findings.empty_folders(folders, roots, links))


@query("""WITH l AS (SELECT concat('/ln/', s_suppkey) AS full_path, s_suppkey % 3 = 0 AS is_directory, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('../', s_suppkey + 1) END AS target, s_suppkey % 5 AS k FROM supplier)
 SELECT full_path, CASE WHEN is_directory THEN 'Directory' ELSE 'File' END AS link_kind, target, CASE k WHEN 1 THEN 'Link target is missing.' WHEN 2 THEN 'Link target is inaccessible.' ELSE 'Link target cannot be resolved.' END AS reason FROM l WHERE target IS NOT NULL AND k <> 0""")
def invalid_links(spark, sf_dir):
    k = F.col("s_suppkey")
    state = F.when(k % 5 == 0, "ok").when(k % 5 == 1, "missing").when(k % 5 == 2, "denied").when(k % 5 == 3, "unresolvable").otherwise("loop")
    links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/ln/"), k.cast("string")).alias("path"), (k % 3 == 0).alias("is_directory"), F.when(k % 7 != 0, F.concat(F.lit("../"), (k + 1).cast("string"))).alias("immediate_target"), state.alias("resolve_state"))
    return findings.invalid_links(links).select("full_path", F.col("metadata")["LinkKind"].alias("link_kind"), F.col("metadata")["ImmediateTarget"].alias("target"), "reason")


_TYPE_OF = {
    0: "JPEG", 1: "PNG", 2: "GIF", 3: "BMP", 4: "TIFF", 5: "PDF", 6: "ZIP", 7: "RAR", 8: "7z", 9: "MP3", 10: "MP3", 11: "FLAC", 12: "Ogg", 13: "WebP", 14: "WAV", 15: "AVI", 16: "MP4", 17: "QuickTime", 18: None, 19: "WebM", 20: None, 24: "ISO BMFF",
}
_TYPED = f"WITH {adapters.HEADERS_SQL}, typed AS (SELECT *, CASE p_partkey % 25 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _TYPE_OF.items() if v) + " END AS detected FROM heads)"


@query(_TYPED + " SELECT full_path, detected FROM typed")
def signature_detect(spark, sf_dir):
    return adapters.headers(table(spark, sf_dir, "part")).select("full_path", signatures.detect(F.col("content")).alias("detected"))


_BYTE = "('0x' || substr(digits, {at}, 2))::INT"
_RULED = f"""WITH h0 AS (SELECT p_partkey, {adapters._HEAD} || md5(p_partkey::VARCHAR) AS whole FROM part), h AS (SELECT p_partkey, upper(substr(whole, 1, (2 * (p_partkey * 7 % 41))::INT)) AS digits FROM h0),
 n AS (SELECT *, length(digits) // 2 AS n, CASE WHEN length(digits) >= 8 THEN {_BYTE.format(at=3)} END AS b1, CASE WHEN length(digits) >= 8 THEN {_BYTE.format(at=5)} END AS b2, CASE WHEN length(digits) >= 8 THEN {_BYTE.format(at=7)} END AS b3,
  CASE WHEN length(digits) >= 32 AND substr(digits, 9, 8) = '66747970' THEN ('0x' || substr(digits, 1, 8))::BIGINT END AS box, CASE WHEN starts_with(digits, '1A45DFA3') AND length(digits) >= 10 THEN {_BYTE.format(at=9)} - 128 END AS head FROM h),
 br AS (SELECT *, CASE WHEN box >= 16 AND box <= n AND box % 4 = 0 THEN [substr(digits, 17, 8)] || list_transform(range((box - 16) // 4), lambda i: substr(digits, (33 + 8 * i)::INT, 8)) END AS brands,
  CASE WHEN head BETWEEN 0 AND n - 5 THEN CASE WHEN substr(digits, 11, 4) = '4282' AND head >= 3 AND {_BYTE.format(at=15)} - 128 BETWEEN 0 AND head - 3 THEN substr(digits, 17, (2 * ({_BYTE.format(at=15)} - 128))::INT) END END AS doctype FROM n)"""
_MP4_HEX = "[" + ", ".join(f"'{b.encode().hex().upper()}'" for b in signatures.MP4_BRANDS) + "]"


@query(
    _RULED
    + " SELECT p_partkey, CASE "
    + " ".join(f"WHEN starts_with(digits, '{d}') THEN '{t}'" for t, d in signatures.PREFIXES)
    + f""" WHEN starts_with(digits, '494433') THEN 'MP3' WHEN n >= 4 AND starts_with(digits, 'FF') AND b1 & 224 = 224 AND (b1 >> 3) & 3 <> 1 AND (b1 >> 1) & 3 <> 0 AND b2 >> 4 NOT IN (0, 15) AND (b2 >> 2) & 3 <> 3 AND b3 & 3 <> 2 THEN 'MP3'
 WHEN starts_with(digits, '664C6143') THEN 'FLAC' WHEN starts_with(digits, '4F676753') THEN 'Ogg' WHEN n >= 12 AND starts_with(digits, '52494646') AND substr(digits, 17, 8) = '57454250' THEN 'WebP' WHEN n >= 12 AND starts_with(digits, '52494646') AND substr(digits, 17, 8) = '57415645' THEN 'WAV'
 WHEN n >= 12 AND starts_with(digits, '52494646') AND substr(digits, 17, 8) = '41564920' THEN 'AVI' WHEN doctype = '7765626D' THEN 'WebM' WHEN doctype IS NOT NULL THEN 'EBML'
 WHEN brands IS NOT NULL THEN CASE WHEN len(list_filter(brands, lambda b: NOT list_contains({_MP4_HEX}, b))) = 0 THEN 'MP4' WHEN len(list_filter(brands, lambda b: b <> '71742020')) = 0 THEN 'QuickTime' ELSE 'ISO BMFF' END END AS detected FROM br"""
)
def signature_rules(spark, sf_dir):
    """Types of headers that are cut anywhere or go on with any bytes."""
    k = F.col("p_partkey")
    digits = F.concat(F.expr(adapters._HEAD), F.md5(k.cast("string")))
    heads = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.substring(digits, F.lit(1), (k * 7 % 41 * 2).cast("int"))).alias("content"))
    return heads.select("p_partkey", signatures.detect(F.col("content")).alias("detected"))


def _case(values: dict, name: str = "detected") -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


#: What each detected type may be called, and what it should be (fixed values, written out).
_ALLOWED = _case({
    "JPEG": "['.jpg', '.jpeg']", "PNG": "['.png']", "GIF": "['.gif']", "BMP": "['.bmp']", "TIFF": "['.tif', '.tiff']", "WebP": "['.webp']", "PDF": "['.pdf']", "RAR": "['.rar']", "7z": "['.7z']",
    "ZIP": "['.zip', '.docx', '.docm', '.dotx', '.dotm', '.xlsx', '.xlsm', '.xltx', '.xltm', '.xlsb', '.xlam', '.pptx', '.pptm', '.potx', '.potm', '.ppsx', '.ppsm', '.ppam', '.sldx', '.sldm', '.odt', '.ott', '.ods', '.ots', '.odp', '.otp', '.odg', '.otg', '.odf']",
    "MP3": "['.mp3']", "FLAC": "['.flac']", "WAV": "['.wav']", "Ogg": "['.ogg', '.oga', '.ogv', '.opus']", "MP4": "['.mp4', '.m4a', '.m4v']", "QuickTime": "['.mov']", "ISO BMFF": "['.mp4', '.m4a', '.m4v', '.mov']",
    "WebM": "['.webm']", "Matroska": "['.mkv', '.mka', '.mks', '.mk3d']", "EBML": "['.webm', '.mkv', '.mka', '.mks', '.mk3d']", "AVI": "['.avi']",
})
_PROPER = _case({
    "JPEG": "'.jpg'", "PNG": "'.png'", "GIF": "'.gif'", "BMP": "'.bmp'", "TIFF": "'.tiff'", "WebP": "'.webp'", "PDF": "'.pdf'", "ZIP": "'.zip'", "RAR": "'.rar'", "7z": "'.7z'", "MP3": "'.mp3'", "FLAC": "'.flac'", "WAV": "'.wav'", "Ogg": "'.ogg'",
    "MP4": "'.mp4'", "QuickTime": "'.mov'", "WebM": "'.webm'", "Matroska": "'.mkv'", "AVI": "'.avi'",
})


@query(_TYPED + f""" SELECT full_path, regexp_replace(file_name, '[.][^.]*$', '') || {_PROPER} AS suggestion, CASE extension WHEN '' THEN '(none)' ELSE extension END AS current_extension, {_PROPER} AS proper_extension, detected AS detected_type
 FROM typed WHERE attributes = 0 AND {_PROPER} IS NOT NULL AND NOT list_contains({_ALLOWED}, extension)""")
def bad_extensions(spark, sf_dir):
    found = findings.bad_extensions(adapters.headers(table(spark, sf_dir, "part")))
    m = F.col("metadata")
    return found.select("full_path", "suggestion", m["CurrentExtension"].alias("current_extension"), m["ProperExtension"].alias("proper_extension"), m["DetectedType"].alias("detected_type"))


_PROBED = _TYPED + """, pr AS (SELECT *, CASE WHEN p_partkey % 6 = 1 THEN size_bytes + 1 ELSE size_bytes END AS before_size, CASE WHEN p_partkey % 10 = 3 THEN modified_ticks + 1 ELSE modified_ticks END AS after_ticks,
 CASE p_partkey % 4 WHEN 0 THEN 'Valid' WHEN 1 THEN 'Invalid' WHEN 2 THEN 'UnsupportedOrProtected' END AS status FROM typed WHERE attributes = 0 AND size_bytes <> 0), ok AS (SELECT *, before_size = size_bytes AND after_ticks = modified_ticks AS same FROM pr)"""


def _broken(spark, sf_dir):
    files = adapters.headers(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "Valid").when(k % 4 == 1, "Invalid").when(k % 4 == 2, "UnsupportedOrProtected")
    probes = files.select(
        F.col("full_path").alias("path"), (F.col("size_bytes") + (k % 6 == 1).cast("long")).alias("before_size"), F.col("modified_ticks").alias("before_ticks"), F.col("size_bytes").alias("after_size"), (F.col("modified_ticks") + (k % 10 == 3).cast("long")).alias("after_ticks"),
        signatures.detect(F.col("content")).alias("detected_type"), status.alias("status"), F.when(k % 2 == 0, "Damaged").alias("error_type"),
    )
    return findings.broken_files(files, probes)


_VALIDATOR = _case({n: f"'{k}'" for k, v in signatures.VALIDATORS.items() for n in v}).replace(" END", " ELSE 'Header' END")


@query(_PROBED + f""" SELECT full_path, CASE status WHEN 'Invalid' THEN 'Unreadable or malformed file.' ELSE 'Unsupported or protected.' END AS reason, {_VALIDATOR} AS validator, CASE WHEN p_partkey % 2 = 0 THEN 'Damaged' ELSE '' END AS error_type, detected AS detected_type
 FROM ok WHERE same AND status IN ('Invalid', 'UnsupportedOrProtected')""")
def broken_files(spark, sf_dir):
    m = F.col("metadata")
    return _broken(spark, sf_dir)[0].select("full_path", "reason", m["Validator"].alias("validator"), m["ErrorType"].alias("error_type"), F.try_element_at(m, F.lit("DetectedType")).alias("detected_type"))


@query(_PROBED + " SELECT full_path AS path, CASE WHEN NOT same THEN 'File changed since scan.' ELSE 'Could not validate file.' END AS reason FROM ok WHERE NOT same OR status IS NULL")
def broken_skipped(spark, sf_dir):
    return _broken(spark, sf_dir)[1]


_NAMES = r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'con.txt' WHEN 1 THEN ' lead.txt' WHEN 2 THEN 'trail.txt ' WHEN 3 THEN 'dot.' WHEN 4 THEN '.env' WHEN 5 THEN 'a:b?.txt' WHEN 6 THEN 'LPT9 .tar.gz' WHEN 7 THEN '...' WHEN 8 THEN ' aux. ' WHEN 9 THEN 'q"<>|*' WHEN 10 THEN 'tab' || chr(9) || '.x' WHEN 11 THEN chr(127) || 'del' WHEN 12 THEN '' ELSE 'plain ' || p_partkey || '.txt' END AS name FROM part)"""
_REASONS = r"""array_to_string(list_filter([CASE WHEN regexp_matches(name, '[\x00-\x1F\x7F]') THEN 'Contains control characters' END, CASE WHEN regexp_matches(name, '["<>|:*?\\/]') THEN 'Contains invalid Windows characters' END,
 CASE WHEN regexp_matches(name, '^\s|\s$') THEN 'Has leading or trailing whitespace' END, CASE WHEN regexp_matches(name, '[.]\s*$') THEN 'Ends with a dot' END,
 CASE WHEN regexp_matches(upper(name), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])[ .]*([.].*)?$') THEN 'Uses a reserved DOS device name' END,
 CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(name, '[\x00-\x1F\x7F]', '', 'g'), '^\s+', ''), '[\s.]+$', ''), '^([.][^.]*)?$') THEN 'Has an empty file name stem' END], lambda x: x IS NOT NULL), '; ')"""


def _named(spark, sf_dir):
    k = F.col("p_partkey") % 16
    odd = ["con.txt", " lead.txt", "trail.txt ", "dot.", ".env", "a:b?.txt", "LPT9 .tar.gz", "...", " aux. ", 'q"<>|*', "tab\t.x", "\x7fdel", ""]
    name = F.concat(F.lit("plain "), F.col("p_partkey").cast("string"), F.lit(".txt"))
    for i, n in enumerate(odd):
        name = F.when(k == i, F.lit(n)).otherwise(name)
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("file_name"), F.lit(0).alias("attributes"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("created_ticks"), F.lit(1).cast("long").alias("modified_ticks"))
    return rows.withColumn("full_path", F.concat(F.lit("/n/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("file_name")))


@query(_NAMES + f", r AS (SELECT concat('/n/', p_partkey, '/', name) AS full_path, name AS current_name, {_REASONS} AS reasons FROM n) SELECT * FROM r WHERE reasons <> ''")
def bad_names(spark, sf_dir):
    return findings.bad_names(_named(spark, sf_dir)).select("full_path", F.col("metadata")["CurrentName"].alias("current_name"), F.col("reason").alias("reasons"))


_SUGGESTED = {0: "con_file.txt", 1: "lead.txt", 2: "trail.txt", 3: "dot", 4: "file.env", 5: "a_b_.txt", 6: "LPT9 _file.tar.gz", 7: "file", 8: "aux_file", 9: "q_____", 10: "tab.x", 11: "del", 12: "file"}


@query(_NAMES + " SELECT concat('/n/', p_partkey, '/', name) AS full_path, CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SUGGESTED.items()) + " END AS suggestion FROM n WHERE p_partkey % 16 < 13")
def name_suggestions(spark, sf_dir):
    return findings.bad_names(_named(spark, sf_dir)).select("full_path", "suggestion")


# --- similar pictures, videos and tracks -----------------------------------------------------------------------------

_PHASH = """WITH t AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, k AS piece, rpad(substr(h, (2048 * k + 1)::INT, 2048), 2048, '0') AS h FROM t, LATERAL (SELECT unnest(range(greatest(1, (length(h) + 2047) // 2048))) AS k)),
 px AS (SELECT doc_id, piece, i // 32 AS y, i % 32 AS x, ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT AS v FROM d, range(1024) AS t(i)),
 c AS (SELECT p, f, cos(pi() * (2 * p + 1) * f / 64) * CASE WHEN f = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) END AS w FROM range(32) AS a(p), range(8) AS b(f)),
 hz AS (SELECT doc_id, piece, y, f AS u, sum(v * w) AS s FROM px JOIN c ON x = p GROUP BY ALL),
 co AS (SELECT doc_id, piece, f * 8 + u AS i, round(sum(s * w), 9) AS q FROM hz JOIN c ON y = p GROUP BY doc_id, piece, f, u),
 md AS (SELECT doc_id, piece, list_sort(list(q))[32] AS m FROM co WHERE i > 0 GROUP BY doc_id, piece)"""


@query(_PHASH + " SELECT doc_id, piece, lpad(hex(sum(CASE WHEN q > m THEN 1::HUGEINT << i::INT ELSE 0 END)::UBIGINT), 16, '0') AS phash FROM co JOIN md USING (doc_id, piece) GROUP BY doc_id, piece")
def phash(spark, sf_dir):
    """Hashes of whole texts as grey pictures: one for each 1024 bytes, the last filled up with zeros."""
    content = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    last = F.greatest(F.ceil(F.octet_length("text") / 1024) - 1, F.lit(0)).cast("long")
    pieces = docs.select("doc_id", content.alias("content"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    sample = F.rpad(F.substring("content", (F.col("piece") * 1024 + 1).cast("int"), F.lit(1024)), F.lit(1024), F.lit(bytes(1)))
    return pieces.select("doc_id", "piece", F.lpad(F.hex(perceptual.phash(sample)), 16, "0").alias("phash"))


_PAIR_SQL = " SELECT a.full_path AS a_path, b.full_path AS b_path, bit_count(xor(a.hash, b.hash))::INT AS distance FROM images a JOIN images b ON a.full_path < b.full_path AND bit_count(xor(a.hash, b.hash)) <= {d} AND abs(a.width / a.height::DOUBLE - b.width / b.height::DOUBLE) / greatest(a.width / a.height::DOUBLE, b.width / b.height::DOUBLE) <= 0.05"


@query(f"WITH {adapters.IMAGES_SQL}" + _PAIR_SQL.format(d=8))
def image_pairs(spark, sf_dir):
    return similarity.image_pairs(adapters.images(table(spark, sf_dir, "part")), 8)


_REACH = """, both_ways AS (SELECT a_path AS a, b_path AS b FROM pairs UNION SELECT b_path, a_path FROM pairs), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
 comp AS (SELECT a AS full_path, min(b) AS label FROM reach GROUP BY a)"""


def _groups_sql(source: str, pairs: str, order: str, distance: str, prefix: str) -> str:
    return f"""WITH RECURSIVE {source}, pairs AS ({pairs}){_REACH}, it AS (SELECT * FROM {prefix}s JOIN comp USING (full_path)),
 rf AS (SELECT label, full_path AS ref_path, ref, '{prefix}-' || lpad(row_number() OVER (ORDER BY upper(full_path), full_path)::VARCHAR, 4, '0') AS group_id
        FROM (SELECT *, {{ref}} AS ref, row_number() OVER (PARTITION BY label ORDER BY {order}, upper(full_path), full_path) AS r FROM it) WHERE r = 1)
 SELECT group_id, full_path, full_path = ref_path AS is_reference, {distance} AS distance, 100.0::DOUBLE * (64 - {distance}) / 64 AS similarity_percent FROM it JOIN rf USING (label)"""


_IMAGE_GROUPS = _groups_sql(adapters.IMAGES_SQL, _PAIR_SQL.format(d=12), "width::BIGINT * height DESC, size_bytes DESC", "bit_count(xor(hash, ref))::INT", "image").replace("{ref}", "hash")
_G = ["group_id", "full_path", "is_reference", "distance", "similarity_percent"]


@query(_IMAGE_GROUPS)
def image_groups(spark, sf_dir):
    return similarity.image_groups(adapters.images(table(spark, sf_dir, "part")), 12).select(*_G)


@query(_IMAGE_GROUPS.replace(" FROM part)", " FROM part WHERE p_partkey % 4 <> 1)").replace("<= 12", "<= 9"))
def image_regroup(spark, sf_dir):
    """Groups from what is left of the stored evidence after some pictures went, at another distance."""
    left = adapters.images(table(spark, sf_dir, "part").where("p_partkey % 4 <> 1"))
    return similarity.image_groups(left, 9).select(*_G)


@query(f"WITH RECURSIVE {adapters.IMAGES_SQL.replace(' FROM part)', ' FROM part WHERE p_partkey % 11 <> 3)')}, pairs AS ({_PAIR_SQL.format(d=12)}){_REACH} SELECT full_path, label FROM comp")
def image_components_left(spark, sf_dir):
    """Components of similar pictures after some went, of which only those that lost one are made anew."""
    part = table(spark, sf_dir, "part")
    edges = stored(similarity.image_pairs(adapters.images(part), 12).select(F.col("a_path").alias("a"), F.col("b_path").alias("b")), "image-edges")
    gone = adapters.images(part.where("p_partkey % 11 = 3")).select(F.col("full_path").alias("node"))
    return graph.without_nodes(edges, graph.connected(edges), gone).select(F.col("node").alias("full_path"), "label")


_TOTAL = "list_sum(list_transform(range(1, 6), lambda i: bit_count(xor({a}.hashes[i], {b}.hashes[i]))))::INT"
_VPAIR = f""" SELECT a.full_path AS a_path, b.full_path AS b_path, {_TOTAL.format(a="a", b="b")} AS total FROM videos a JOIN videos b ON a.full_path < b.full_path
 AND (abs(a.duration_ticks - b.duration_ticks) <= 20000000 OR abs(a.duration_ticks - b.duration_ticks) <= greatest(a.duration_ticks, b.duration_ticks) // 50)
 AND abs(a.display_aspect - b.display_aspect) / greatest(a.display_aspect, b.display_aspect) <= 0.05 AND {_TOTAL.format(a="a", b="b")} <= 45"""


@query(f"WITH {adapters.VIDEOS_SQL}" + _VPAIR)
def video_pairs(spark, sf_dir):
    return similarity.video_pairs(adapters.videos(table(spark, sf_dir, "part")), 9)


@query(_groups_sql(adapters.VIDEOS_SQL, _VPAIR, "width::BIGINT * height DESC, bitrate DESC, size_bytes DESC", "(list_sum(list_transform(range(1, 6), lambda i: bit_count(xor(hashes[i], ref[i]))))::DOUBLE / 5)", "video").replace("{ref}", "hashes"))
def video_groups(spark, sf_dir):
    return similarity.video_groups(adapters.videos(table(spark, sf_dir, "part")), 9).select(*_G)


_MUSIC = f"""WITH RECURSIVE {adapters.TRACKS_SQL}, k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(coalesce(artist, '')), '[^a-z0-9]+', ' ', 'g')) AS ka,
 trim(regexp_replace(lower(coalesce(album_artist, '')), '[^a-z0-9]+', ' ', 'g')) AS kb FROM tracks), kk AS (SELECT *, CASE WHEN ka <> '' THEN ka ELSE kb END AS artist_key FROM k),
 good AS (SELECT * FROM kk WHERE duration_ticks > 0 AND title_key <> '' AND artist_key <> ''),
 num AS (SELECT *, row_number() OVER (PARTITION BY title_key, artist_key ORDER BY duration_ticks, full_path) AS rn FROM good),
 walk AS (SELECT title_key, artist_key, rn, full_path, duration_ticks, duration_ticks AS anchor FROM num WHERE rn = 1
          UNION ALL SELECT n.title_key, n.artist_key, n.rn, n.full_path, n.duration_ticks, CASE WHEN n.duration_ticks - w.anchor > {{most}} THEN n.duration_ticks ELSE w.anchor END
          FROM walk w JOIN num n ON n.title_key = w.title_key AND n.artist_key = w.artist_key AND n.rn = w.rn + 1)"""


@query(_MUSIC.replace("{most}", "300000000") + " SELECT full_path, title_key, artist_key, anchor FROM walk")
def music_clusters(spark, sf_dir):
    good, _ = similarity.music_keys(adapters.tracks(table(spark, sf_dir, "events")), ready=True)
    rows = similarity.anchored_clusters(good, ["title_key", "artist_key"], "duration_ticks", 300_000_000)
    return rows.select("full_path", "title_key", "artist_key", F.col("cluster").alias("anchor"))


@query(_MUSIC.replace("{most}", "300000000") + """, it AS (SELECT w.*, g.bitrate, g.size_bytes, count(*) OVER (PARTITION BY w.title_key, w.artist_key, anchor) AS n,
  row_number() OVER (PARTITION BY w.title_key, w.artist_key, anchor ORDER BY g.bitrate DESC, g.size_bytes DESC, upper(w.full_path), w.full_path) AS r FROM walk w JOIN good g USING (full_path)),
 rf AS (SELECT title_key, artist_key, anchor, full_path AS ref_path, duration_ticks AS rt, 'music-' || lpad(row_number() OVER (ORDER BY upper(full_path), full_path)::VARCHAR, 4, '0') AS group_id FROM it WHERE n > 1 AND r = 1)
 SELECT group_id, full_path, full_path = ref_path AS is_reference, abs(duration_ticks - rt) AS difference_ticks FROM it JOIN rf USING (title_key, artist_key, anchor)""")
def music_groups(spark, sf_dir):
    good, _ = similarity.music_keys(adapters.tracks(table(spark, sf_dir, "events")), ready=True)
    return similarity.music_groups(good, 300_000_000).select("group_id", "full_path", "is_reference", "difference_ticks")


@query(_MUSIC.split(", good AS")[0] .replace("{most}", "0") + " SELECT full_path AS path, CASE WHEN duration_ticks <= 0 THEN 'Could not read music metadata.' ELSE 'Required music metadata is missing.' END AS reason FROM kk WHERE duration_ticks <= 0 OR title_key = '' OR artist_key = ''")
def music_skipped(spark, sf_dir):
    return similarity.music_keys(adapters.tracks(table(spark, sf_dir, "events")))[1]


@query(f"WITH {adapters.IMAGES_SQL} SELECT full_path, replace(full_path, '/img/', '')[-7:] = '.gone.jpg' AS missing FROM images WHERE (size_bytes % 5 = 0)")
def revalidate_evidence(spark, sf_dir):
    """Pictures whose fresh hash is another: every one with a size that 5 divides."""
    stored = adapters.images(table(spark, sf_dir, "part"))
    fresh = stored.withColumn("hash", F.when(F.col("size_bytes") % 5 == 0, F.col("hash").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("hash")))
    return similarity.changed(stored, fresh, ["hash", "width", "height"])


# --- plans and exports -----------------------------------------------------------------------------------------------

_PLAN = _SELECTED + """, tgt AS (SELECT * FROM sel WHERE selected), now AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN size_bytes + 1 ELSE size_bytes END AS s2, CASE WHEN doc_id % 7 = 2 THEN modified_ticks + 1 ELSE modified_ticks END AS t2 FROM files WHERE doc_id % 11 <> 3),
 ks AS (SELECT content, count(*) FILTER (n.doc_id IS NULL OR n.s2 <> s.size_bytes OR n.t2 <> s.modified_ticks OR n.attributes & 1040 <> 0) AS bad FROM sel s LEFT JOIN now n USING (full_path) WHERE NOT s.selected GROUP BY s.content)"""


@query(_PLAN.replace("ks AS (SELECT content", "ks AS (SELECT s.content") + """ SELECT t.full_path, CASE WHEN ks.bad > 0 THEN 'The source changed since the scan.' WHEN n.doc_id IS NULL THEN 'The source no longer exists.' WHEN n.s2 <> t.size_bytes OR n.t2 <> t.modified_ticks THEN 'The source changed since the scan.' END AS failure
 FROM tgt t LEFT JOIN now n USING (full_path) JOIN ks ON ks.content = t.content""")
def revalidate_plan(spark, sf_dir):
    members = exact.keep_one(_members(spark, sf_dir))
    kept = members.where("NOT selected").groupBy("digest", "size_bytes").agg(F.collect_list(F.struct(F.col("full_path").alias("path"), "size_bytes", "modified_ticks")).alias("survivors"))
    targets = members.where("selected").join(kept, ["digest", "size_bytes"]).select("full_path", F.lit("File").alias("kind"), "size_bytes", "modified_ticks", "survivors")
    k = F.col("doc_id")
    now = _files(spark, sf_dir).where("doc_id % 11 <> 3").withColumns({"size_bytes": F.col("size_bytes") + (k % 5 == 1).cast("long"), "modified_ticks": F.col("modified_ticks") + (k % 7 == 2).cast("long"), "physical_child_count": F.lit(None).cast("int")})
    return actions.revalidated(targets, now).select("full_path", "failure")


@query(_PLAN.replace("ks AS (SELECT content", "ks AS (SELECT s.content") + """, oc AS (SELECT t.size_bytes, ks.bad > 0 OR n.doc_id IS NULL OR n.s2 <> t.size_bytes OR n.t2 <> t.modified_ticks AS failed FROM tgt t LEFT JOIN now n USING (full_path) JOIN ks ON ks.content = t.content)
 SELECT count(*) FILTER (NOT failed) AS n_done, coalesce(sum(size_bytes) FILTER (NOT failed), 0)::BIGINT AS bytes_done, count(*) FILTER (failed) AS n_failed FROM oc""")
def action_summary(spark, sf_dir):
    sizes = exact.keep_one(_members(spark, sf_dir)).where("selected").select("full_path", "size_bytes")
    return actions.action_summary(revalidate_plan(spark, sf_dir).join(sizes, "full_path"))


def _leaves(spark, sf_dir):
    """Files of ten folders whose names repeat across folders."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".TXT").otherwise(".txt"))
    return p.select("p_partkey", name.alias("file_name"), F.concat(F.lit("/d"), F.lpad((F.floor(F.col("p_partkey") / 40)).cast("string"), 6, "0"), F.lit("/"), name).alias("full_path"))


_LEAVES = "WITH f AS (SELECT p_partkey, concat('f', p_partkey % 40, CASE WHEN p_partkey % 3 = 0 THEN '.TXT' ELSE '.txt' END) AS file_name FROM part), l AS (SELECT *, concat('/d', lpad((p_partkey // 40)::VARCHAR, 6, '0'), '/', file_name) AS full_path FROM f)"


@query(_LEAVES + """, o AS (SELECT *, row_number() OVER (PARTITION BY upper(regexp_replace(file_name, '[.][^.]*$', '')) ORDER BY upper(full_path), full_path) + CASE WHEN p_partkey % 40 = 7 THEN 1 ELSE 0 END AS n FROM l),
 o2 AS (SELECT *, CASE WHEN p_partkey % 40 = 9 AND n >= 3 THEN n + 1 ELSE n END AS m FROM o)
 SELECT full_path, CASE WHEN m = 1 THEN file_name ELSE regexp_replace(file_name, '[.][^.]*$', '') || ' (' || m || ')' || regexp_extract(file_name, '[.][^.]*$') END AS new_name FROM o2""")
def move_plan(spark, sf_dir):
    """All files into one folder that has f7 and a third f9 in either spelling: names in use are passed over."""
    used = spark.createDataFrame([("F7.txt",), ("f9 (3).txt",), ("f9 (3).TXT",), ("other.txt",)], "name string")
    return actions.move_plan(_leaves(spark, sf_dir), used, "/to").select("full_path", "new_name")


@query(_LEAVES + " SELECT full_path, regexp_replace(file_name, '[.][^.]*$', '') || '.optimized' || CASE WHEN p_partkey % 40 = 5 THEN ' (2)' ELSE '' END || '.mp4' AS new_name FROM l")
def output_names(spark, sf_dir):
    """Output names beside the sources; each folder has f5.optimized.mp4 already."""
    files = _leaves(spark, sf_dir).withColumn("folder", paths.parent(F.col("full_path")))
    taken = files.select("folder").distinct().withColumn("name", F.lit("F5.Optimized.mp4"))
    return actions.free_names(files, taken, "folder", actions.OPTIMIZED).select("full_path", "new_name")


@query(_LEAVES + """, c AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'new' || p_partkey || '.txt' WHEN 1 THEN 'a/b' WHEN 2 THEN upper(file_name) WHEN 3 THEN 'nul.txt' WHEN 4 THEN 'F' || (p_partkey + 1) % 40 || '.txt' ELSE 'x.' END AS new_name FROM l)
 SELECT c.full_path, new_name, CASE WHEN p_partkey % 6 IN (1, 3, 5) THEN 'Enter a valid Windows file name.' WHEN p_partkey % 6 = 2 THEN 'Choose a different file name.'
  WHEN EXISTS (SELECT 1 FROM l s WHERE s.full_path <> c.full_path AND s.p_partkey // 40 = c.p_partkey // 40 AND upper(s.file_name) = upper(c.new_name)) THEN 'A file or folder with the same name already exists.' END AS message FROM c""")
def rename_checks(spark, sf_dir):
    files = _leaves(spark, sf_dir)
    k = F.col("p_partkey")
    new = F.when(k % 6 == 0, F.concat(F.lit("new"), k.cast("string"), F.lit(".txt"))).when(k % 6 == 1, "a/b").when(k % 6 == 2, F.upper("file_name")).when(k % 6 == 3, "nul.txt").when(k % 6 == 4, F.concat(F.lit("F"), ((k + 1) % 40).cast("string"), F.lit(".txt"))).otherwise("x.")
    candidates = files.select("full_path", new.alias("new_name"), F.lit(None).cast("string").alias("suggestion"))
    return actions.rename_checks(candidates, files).select("full_path", "new_name", "message")


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS p_partkey, CASE WHEN k % 11 = 1 THEN 'The file changed since the duplicate scan.' WHEN k % 13 = 2 THEN 'The file has unsupported or unsafe attributes.' WHEN k % 7 = 3 THEN 'The file attributes no longer match exactly.'
 WHEN k % 17 = 4 THEN 'The duplicate already has more than one physical hard link.' WHEN k % 19 = 5 THEN 'Hard-link replacement requires two files on a local NTFS volume.' WHEN k % 23 = 6 THEN 'Hard-link replacement requires the survivor and duplicate on the same volume.'
 WHEN k % 29 = 7 THEN 'The survivor has reached the NTFS hard-link limit of 1024 links.' WHEN k % 31 = 8 THEN 'The files are no longer byte-identical.' END AS refusal FROM p""")
def link_eligibility(spark, sf_dir):
    k = F.col("p_partkey")
    one = lambda v: F.lit(v)
    rows = table(spark, sf_dir, "part").select("p_partkey").withColumns({
        "s_length": one(10), "s_expected_length": one(10), "s_ticks": one(5), "s_expected_ticks": one(5), "d_length": one(10), "d_expected_length": F.when(k % 11 == 1, 11).otherwise(10), "d_ticks": one(6), "d_expected_ticks": one(6),
        "s_attributes": F.when(k % 13 == 2, paths.REPARSE_POINT).otherwise(32), "d_attributes": F.when(k % 7 == 3, 33).otherwise(32), "s_links": F.when(k % 29 == 7, 1024).otherwise(1), "d_links": F.when(k % 17 == 4, 2).otherwise(1),
        "s_is_local": one(True), "d_is_local": one(True), "s_file_system": one("ntfs"), "d_file_system": F.when(k % 19 == 5, "FAT32").otherwise("NTFS"), "s_volume": one(1), "d_volume": F.when(k % 23 == 6, 2).otherwise(1),
        "same_security": one(True), "same_streams": one(True), "same_content": k % 31 != 8,
    })
    return actions.link_eligibility(rows).select("p_partkey", "refusal")


_UTC = "strftime(make_timestamp(({t} - 621355968000000000) // 10), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(({t} % 10000000)::VARCHAR, 7, '0') || 'Z'"
_LARGE = f"{_W}, lg AS (SELECT * FROM files WHERE size_bytes >= 10000 AND attributes & 1024 = 0), sk AS (SELECT concat('/skip,', s_suppkey) AS path, 'Access \"denied\"' AS reason FROM supplier)"


def _export(spark, sf_dir):
    items = export.finding_items(findings.large_files(_files(spark, sf_dir), 10_000))
    skipped = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/skip,"), F.col("s_suppkey").cast("string")).alias("path"), F.lit('Access "denied"').alias("reason"))
    return export.export_rows(items, skipped, "BigFiles", BASE + 7, export.scope_text(1, 0, 2))


@query(_LARGE + f""" SELECT 'item' AS record_type, 'BigFiles' AS tool, '2023-01-01T00:00:00.0000007Z' AS generated_utc, full_path AS path, 'At least 10,000 bytes' AS reason, size_bytes, {_UTC.format(t="modified_ticks")} AS modified_utc, '{{"Extension":"' || extension || '"}}' AS metadata, NULL AS skipped_reason FROM lg
 UNION ALL SELECT 'skipped_path', 'BigFiles', '2023-01-01T00:00:00.0000007Z', path, NULL, NULL, NULL, '{{}}', reason FROM sk""")
def export_rows(spark, sf_dir):
    return _export(spark, sf_dir).select("record_type", "tool", "generated_utc", "path", "reason", "size_bytes", "modified_utc", "metadata", "skipped_reason")


@query(_LARGE + f""" SELECT 'item,BigFiles,2023-01-01T00:00:00.0000007Z,"1 folder, 0 files, 2 excluded; subfolders included",' || full_path || ',File,"At least 10,000 bytes",,,,' || size_bytes || ',,' || {_UTC.format(t="modified_ticks")} || ',"{{""Extension"":""' || extension || '""}}",' AS line FROM lg
 UNION ALL SELECT 'skipped_path,BigFiles,2023-01-01T00:00:00.0000007Z,"1 folder, 0 files, 2 excluded; subfolders included","' || path || '",,,,,,,,,{{}},"Access ""denied""\"' FROM sk""")
def export_csv(spark, sf_dir):
    return export.csv_lines(_export(spark, sf_dir))


@query(_MEMBERS + " SELECT full_path AS path, 'Byte-identical duplicate' AS reason, upper(substr(sha256(content), 1, 16)) AS group_id, size_bytes FROM mem")
def export_exact(spark, sf_dir):
    return export.exact_items(_members(spark, sf_dir)).select("path", "reason", "group_id", "size_bytes")


_LISTED = adapters.FILES_SQL + """, fd AS (SELECT full_path, 'At least 10,000 bytes' AS reason, size_bytes, modified_ticks, extension FROM files WHERE size_bytes >= 10000 AND attributes & 1024 = 0
  UNION ALL SELECT full_path, 'File is empty', size_bytes, modified_ticks, extension FROM files WHERE size_bytes = 0 AND attributes & 1024 = 0)"""


@query(f"WITH {_LISTED} SELECT full_path, reason, row_number() OVER (ORDER BY size_bytes DESC, upper(full_path), full_path) AS place FROM fd WHERE contains(upper(full_path), '/EN/D') OR contains(upper(reason), '/EN/D')")
def findings_search_sort(spark, sf_dir):
    """Findings with a text, largest first."""
    files = _files(spark, sf_dir)
    both = results.search_findings(findings.large_files(files, 10_000).unionByName(findings.empty_files(files)), " /en/d ")
    return numbered(both, [F.desc("size_bytes"), *paths.path_order("full_path")]).select("full_path", "reason", "place")


_LIST_ORDERS = ("upper(full_path)", "size_bytes DESC", "modified_ticks DESC NULLS LAST")


@query(
    _IMAGE_GROUPS.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_LISTED}, ").replace(" SELECT group_id, full_path, full_path = ref_path", ", gi AS (SELECT *, full_path = ref_path").replace(" AS is_reference,", " AS own,").replace("FROM it JOIN rf USING (label)", "FROM it JOIN rf USING (label))")
    + """, hit AS (SELECT DISTINCT group_id FROM gi WHERE contains(group_id, '16') OR contains(full_path, '16') OR contains('Width: ' || width || chr(10) || 'Height: ' || height || chr(10) || 'HammingDistance: ' || distance, '16')),
 ls AS (SELECT 'finding' AS row_type, NULL::VARCHAR AS group_id, full_path, size_bytes::HUGEINT AS size_bytes, NULL::BIGINT AS modified_ticks FROM fd WHERE contains(full_path, '16') OR contains('Extension: ' || extension, '16')
  UNION ALL SELECT 'group', group_id, max(full_path) FILTER (own), sum(size_bytes), max(modified_ticks) FILTER (own) FROM gi WHERE group_id IN (SELECT group_id FROM hit) GROUP BY group_id)"""
    + _union(_LIST_ORDERS, "SELECT {i} AS sort_option, row_type, group_id, full_path, size_bytes::BIGINT AS size_bytes, row_number() OVER (ORDER BY {order}, upper(full_path), full_path, row_type, group_id) AS place FROM ls")
)
def results_list(spark, sf_dir):
    """Findings and groups of pictures that hold a text, in one list, in each of the three orders."""
    files = _files(spark, sf_dir)
    found = results.search_findings(findings.large_files(files, 10_000).unionByName(findings.empty_files(files)).withColumn("modified_ticks", F.lit(None).cast("long")), "16")
    items = results.search_items(similarity.image_groups(adapters.images(table(spark, sf_dir, "part")), 12), "16")
    rows = stored(results.listed(found, items), "listed")  # sorted three times
    out = [results.ordered(rows, i).select(F.lit(i).alias("sort_option"), "row_type", "group_id", "full_path", "size_bytes", "place") for i in range(3)]
    return reduce(DataFrame.unionByName, out)


# --- media decisions -------------------------------------------------------------------------------------------------

_USABLE = "par_n > 0 AND coalesce(trim(video_codec), '') <> '' AND trim(container) <> '' AND video_tracks = 1 AND audio_tracks IN (0, 1) AND metadata_tracks = 0 AND (audio_tracks = 0 OR coalesce(trim(audio_codec), '') <> '')"
_PROFILE = f"""WITH {adapters.MEDIA_SQL}, sc AS (SELECT *, least(1.0::DOUBLE, least(1920 / display_width, 1080 / display_height)) AS scale FROM media),
 sz AS (SELECT *, (floor(display_width * scale / 2) * 2)::BIGINT AS w, (floor(display_height * scale / 2) * 2)::BIGINT AS h FROM sc), pf AS (SELECT *, {_USABLE} AND w >= 2 AND h >= 2 AS good FROM sz),
 prof AS (SELECT *, CASE WHEN good THEN w END AS t_width, CASE WHEN good THEN h END AS t_height, CASE WHEN good THEN CASE WHEN fps_n <= 60 * fps_d THEN fps_n ELSE 60 END END AS t_fps_n, CASE WHEN good THEN CASE WHEN fps_n <= 60 * fps_d THEN fps_d ELSE 1 END END AS t_fps_d,
  CASE WHEN good THEN CASE WHEN video_bitrate = 0 THEN 8000000 ELSE least(video_bitrate, 8000000) END END AS t_video_bitrate, CASE WHEN good THEN CASE WHEN audio_tracks = 0 THEN 0 WHEN audio_bitrate = 0 THEN 192000 ELSE least(audio_bitrate, 192000) END END AS t_audio_bitrate FROM pf)"""


@query(_PROFILE + " SELECT p_partkey, t_width, t_height, t_fps_n::BIGINT AS t_fps_n, t_fps_d::BIGINT AS t_fps_d, t_video_bitrate::BIGINT AS t_video_bitrate, t_audio_bitrate::BIGINT AS t_audio_bitrate, CASE WHEN NOT good THEN 'UnsupportedInput' END AS outcome FROM prof")
def video_profile(spark, sf_dir):
    rows = media_policy.video_profiles(adapters.media(table(spark, sf_dir, "part")), "Balanced")
    return rows.select("p_partkey", "t_width", "t_height", "t_fps_n", "t_fps_d", "t_video_bitrate", "t_audio_bitrate", "outcome")


_O = {
    "width": "t_width + CASE WHEN k % 17 = 1 THEN 2 ELSE 0 END", "height": "t_height", "display_width": "CAST(t_width + CASE WHEN k % 17 = 1 THEN 2 ELSE 0 END AS DOUBLE)", "display_height": "CAST(t_height AS DOUBLE)", "display_aspect": "CAST(t_width AS DOUBLE) / t_height * CASE WHEN k % 19 = 2 THEN 2 ELSE 1 END",
    "par_n": "CASE WHEN k % 23 = 3 THEN 2 ELSE 1 END", "par_d": "1", "duration_ticks": "duration_ticks + CASE WHEN k % 29 = 4 THEN 10000001 WHEN k % 29 = 5 THEN 10000000 ELSE 0 END", "fps_n": "t_fps_n * 2", "fps_d": "t_fps_d * CASE WHEN k % 31 = 6 THEN 1 ELSE 2 END",
    "container": "CASE WHEN k % 37 = 7 THEN 'MKV' ELSE 'mp4' END", "video_codec": "CASE WHEN k % 41 = 8 THEN '' ELSE 'h.264' END", "video_tracks": "CASE WHEN k % 43 = 9 THEN 2 ELSE 1 END", "metadata_tracks": "0", "audio_tracks": "CASE WHEN k % 47 = 10 THEN 1 ELSE audio_tracks END",
    "audio_codec": "'aac'", "audio_bitrate": "CASE WHEN k % 53 = 11 THEN t_audio_bitrate + 1 ELSE t_audio_bitrate END",
}
_OUT = ", ".join(f"{v.replace('k %', 'p_partkey %')} AS o_{n}" for n, v in _O.items())
_V = media_policy.VIDEO_FAULTS
_VERIFY = f""", ot AS (SELECT *, {_OUT} FROM prof WHERE good) SELECT p_partkey, CASE WHEN o_video_codec = '' THEN '{_V[0]}' WHEN o_container = 'MKV' THEN '{_V[1]}' WHEN o_video_tracks <> 1 THEN '{_V[2]}' WHEN o_width <> t_width THEN '{_V[3]}' WHEN o_par_n <> 1 THEN '{_V[4]}'
 WHEN o_display_width > display_width OR o_display_height > display_height THEN '{_V[5]}' WHEN abs(o_display_aspect - display_aspect) / greatest(o_display_aspect, display_aspect) > 2.0 / least(t_width, t_height) THEN '{_V[6]}' WHEN o_fps_n * t_fps_d <> t_fps_n * o_fps_d THEN '{_V[7]}'
 WHEN audio_tracks = 0 AND o_audio_tracks <> 0 THEN '{_V[8]}' WHEN audio_tracks <> 0 AND NOT (o_audio_bitrate > 0 AND o_audio_bitrate <= t_audio_bitrate) THEN '{_V[9]}' WHEN abs(o_duration_ticks - duration_ticks) > 10000000 THEN '{_V[10]}' ELSE '{media_policy.VIDEO_SOUND}' END AS detail FROM ot"""


@query(_PROFILE + _VERIFY)
def video_verify(spark, sf_dir):
    rows = media_policy.video_profiles(adapters.media(table(spark, sf_dir, "part")), "Balanced").where("outcome IS NULL")
    rows = rows.selectExpr("*", *[f"{v.replace('k %', 'p_partkey %')} AS o_{n}" for n, v in _O.items()])
    return media_policy.verify_video(rows).select("p_partkey", "detail")


@query("SELECT p_partkey, (p_size - p_partkey % 60)::BIGINT AS saved_bytes, CASE WHEN p_size - p_partkey % 60 <= 0 THEN 'NoSpaceSaving' WHEN p_partkey % 9 = 0 THEN 'DestinationCollision' ELSE 'Succeeded' END AS outcome FROM part")
def size_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("source_bytes"), (F.col("p_partkey") % 60).cast("long").alias("output_bytes"), (F.col("p_partkey") % 9 == 0).alias("destination_taken"))
    return media_policy.size_gate(rows).select("p_partkey", "saved_bytes", "outcome")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _queries_sql(kind: str) -> str:
    return " || ".join(f"CASE WHEN p_partkey % {2 + i} = 0 THEN {_list(media_policy.metadata_queries(kind, (o,)))} ELSE []::VARCHAR[] END" for i, o in enumerate(media_policy.OPTIONS))


_EXIF = f"WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN {_queries_sql('Jpeg')} ELSE {_queries_sql('Tiff')} END AS qs, CASE WHEN p_partkey % 3 = 1 THEN 'Jpeg' ELSE 'Tiff' END AS container FROM part)"


def _selected(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 1, "Jpeg").otherwise("Tiff").alias("container"))
    return rows.withColumn("selected", media_policy.selected_queries(F.col("container"), {o: k % (2 + i) == 0 for i, o in enumerate(media_policy.OPTIONS)}))


@query(_EXIF + " SELECT p_partkey, len(qs)::INT AS n_queries, array_to_string(qs, '|') AS queries FROM q")
def exif_queries(spark, sf_dir):
    return _selected(spark, sf_dir).select("p_partkey", F.size("selected").alias("n_queries"), F.array_join("selected", "|").alias("queries"))


@query(_EXIF + f""", a AS (SELECT *, CASE container WHEN 'Jpeg' THEN {_list(media_policy.metadata_queries("Jpeg"))} ELSE {_list(media_policy.metadata_queries("Tiff"))} END AS known FROM q)
 SELECT p_partkey, NOT (p_partkey % 13 = 1 AND len(qs) > 0) AND NOT (p_partkey % 17 = 2 AND len(list_filter(known, lambda x: NOT list_contains(qs, x))) > 0) AND p_partkey % 19 <> 3 AS verified FROM a""")
def exif_verify(spark, sf_dir):
    """Outputs that kept a selected path, changed an unselected one, or another picture."""
    k = F.col("p_partkey")
    known = F.when(F.col("container") == "Jpeg", F.array(*map(F.lit, media_policy.metadata_queries("Jpeg")))).otherwise(F.array(*map(F.lit, media_policy.metadata_queries("Tiff"))))
    rows = _selected(spark, sf_dir).withColumn("metadata", F.map_from_arrays(known, known))
    left = F.map_filter("metadata", lambda q, _: ~F.array_contains("selected", q) | (k % 13 == 1))
    rows = rows.withColumns({"o_metadata": F.transform_values(left, lambda _, v: F.when(k % 17 == 2, F.concat(v, F.lit("!"))).otherwise(v)), "render": F.struct(F.lit(1).alias("frames")), "o_render": F.struct(F.when(k % 19 == 3, 2).otherwise(1).alias("frames")), "o_container": F.col("container")})
    return media_policy.verify_metadata(rows).select("p_partkey", "verified")


@query(_W + " SELECT full_path FROM files WHERE extension = '.jpg' AND attributes & 1104 = 0")
def exif_queue(spark, sf_dir):
    return media_policy.exif_queue(_files(spark, sf_dir)).select("full_path")


@query(_W + " SELECT full_path FROM files WHERE extension = '.mp4' AND attributes & 1104 = 0")
def video_queue(spark, sf_dir):
    return media_policy.video_queue(_files(spark, sf_dir)).select("full_path")


@query(_TYPED + """ SELECT full_path, CASE WHEN detected IN ('MP3', 'FLAC', 'WAV') OR detected = 'Ogg' THEN 'Audio' ELSE 'Video' END AS route FROM typed WHERE detected IN ('MP3', 'FLAC', 'WAV', 'Ogg', 'MP4', 'QuickTime', 'ISO BMFF', 'AVI')""")
def media_route(spark, sf_dir):
    rows = adapters.headers(table(spark, sf_dir, "part")).withColumn("detected", signatures.simple_type(F.col("content")))
    return rows.where(F.col("detected").isin("MP3", "FLAC", "WAV", "Ogg", "MP4", "QuickTime", "ISO BMFF", "AVI")).select("full_path", media_policy.media_route(F.col("detected"), F.col("extension")).alias("route"))


# --- side table, numbers and texts -----------------------------------------------------------------------------------


def _cache(files: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    return files.where(k % 3 != 0).select("full_path", "size_bytes", (F.col("modified_ticks") + (k % 5 == 0).cast("long")).alias("modified_ticks"), F.when(k % 7 == 0, 1).otherwise(2).alias("version"), (k * 10).alias("print"))


@query(_W + " SELECT full_path FROM files WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0")
def cache_misses(spark, sf_dir):
    files = _files(spark, sf_dir)
    return evidence.missing(files, _cache(files), 2).select("full_path")


@query(_W + " SELECT full_path, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN -doc_id ELSE doc_id * 10 END AS print, 2 AS version FROM files")
def cache_refresh(spark, sf_dir):
    files = _files(spark, sf_dir)
    return evidence.refreshed(files, _cache(files), 2, lambda df: df.select("full_path", "size_bytes", "modified_ticks", (-F.col("doc_id")).alias("print"))).select("full_path", "print", "version")


@query("""WITH b AS (SELECT o_orderkey, (o_orderkey * o_orderkey * 37 % 5000000000000) AS n FROM orders), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM b)
 SELECT o_orderkey, CASE WHEN i = 0 THEN n || ' B' ELSE regexp_replace(regexp_replace(printf('%.2f', round(n / pow(1024, i), 2)), '0+$', ''), '[.]$', '') || ' ' || ['KB', 'MB', 'GB', 'TB'][i] END AS size_text FROM u""")
def byte_text(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37 % 5_000_000_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", text.byte_text(n).alias("size_text"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 77 WHEN 1 THEN 77 WHEN 2 THEN 9223372036854775807 WHEN 3 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS bytes FROM orders")
def byte_input(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).when(k == 2, 1e19).when(k == 3, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.bytes_of_input(value, 77).alias("bytes"))


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey * 123456789) % 3000000000000 - 1000000000000 AS k FROM orders), a AS (SELECT *, abs(k) // 10000000 AS s, abs(k) % 10000000 AS r FROM t)
 SELECT o_orderkey, CASE WHEN k < 0 THEN '-' ELSE '' END || CASE WHEN s >= 86400 THEN (s // 86400) || '.' ELSE '' END || lpad((s // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || CASE WHEN r > 0 THEN '.' || lpad(r::VARCHAR, 7, '0') ELSE '' END AS span FROM a""")
def span_text(spark, sf_dir):
    k = F.col("o_orderkey") * 123456789 % 3_000_000_000_000 - 1_000_000_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", text.span_text(k).alias("span"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.p' || p_size ELSE '.x y' END AS extension FROM part")
def normal_extension(spark, sf_dir):
    k = F.col("p_partkey") % 5
    typed = F.when(k == 0, " *.JPG ").when(k == 1, "  ** ").when(k == 2, "Tar.GZ").when(k == 3, F.concat(F.lit("*P"), F.col("p_size").cast("string"))).otherwise("* .X y")
    return table(spark, sf_dir, "part").select("p_partkey", paths.normal_extension(typed).alias("extension"))


@query("""WITH s AS (SELECT p_partkey, (p_partkey * 7 % 3000 + 1)::INT AS w, (p_partkey * 13 % 2000 + 1)::INT AS h FROM part) SELECT p_partkey, CASE WHEN w <= 512 AND h <= 512 THEN w WHEN w >= h THEN 512 ELSE greatest(1, round(w::DOUBLE * 512 / h)::INT) END AS preview_width,
 CASE WHEN w <= 512 AND h <= 512 THEN h WHEN w >= h THEN greatest(1, round(h::DOUBLE * 512 / w)::INT) ELSE 512 END AS preview_height FROM s""")
def preview_size(spark, sf_dir):
    width, height = (F.col("p_partkey") * 7 % 3000 + 1).cast("int"), (F.col("p_partkey") * 13 % 2000 + 1).cast("int")
    wide, high = media_policy.preview_size(width, height, 512)
    return table(spark, sf_dir, "part").select("p_partkey", wide.alias("preview_width"), high.alias("preview_height"))


# --- around results --------------------------------------------------------------------------------------------------


@query(_SELECTED + f""", old AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY length(full_path), upper(full_path)) > 1 AS was0 FROM sel), snap AS (SELECT *, coalesce(CASE WHEN doc_id % 5 = 0 THEN false WHEN size_bytes % 3 = 0 THEN true ELSE was0 END, false) AS was FROM old)
 SELECT full_path, CASE WHEN bool_and(was) OVER (PARTITION BY content) THEN selected ELSE was END AS selected FROM snap""")
def undo_selection(spark, sf_dir):
    """Back to a snapshot that lacks every fifth file and has whole groups selected."""
    members = exact.keep_one(_members(spark, sf_dir))
    before = exact.keep_one(members.drop("selected", "survivor_path"), "shortest")
    snapshot = before.where("doc_id % 5 <> 0").select("full_path", F.when(F.col("size_bytes") % 3 == 0, True).otherwise(F.col("selected")).alias("selected"))
    return review.undone(members, snapshot).select("full_path", "selected")


@query(_W + " SELECT count(*) AS n_items, count(*) FILTER (doc_id % 3 = 0) AS n_selected, (sum(size_bytes) FILTER (doc_id % 3 = 0))::BIGINT AS selected_bytes, sum(size_bytes)::BIGINT AS total_bytes FROM files")
def findings_totals(spark, sf_dir):
    return review.findings_totals(_files(spark, sf_dir).withColumn("selected", F.col("doc_id") % 3 == 0))


_NAMES_OF_OUTCOMES = "[" + ", ".join(f"'{o}'" for o in media_policy.VIDEO_OUTCOMES) + "]"


@query(f"WITH o AS (SELECT unnest({_NAMES_OF_OUTCOMES}) AS outcome), r AS (SELECT {_NAMES_OF_OUTCOMES}[(p_partkey * p_partkey % 9 + 1)::INT] AS outcome FROM part) SELECT outcome, (SELECT count(*) FROM r WHERE r.outcome = o.outcome) AS n FROM o")
def outcome_counts(spark, sf_dir):
    names = F.array(*map(F.lit, media_policy.VIDEO_OUTCOMES))
    results = table(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_partkey") * F.col("p_partkey") % 9 + 1).cast("int")).alias("outcome"))
    return review.outcome_counts(results, media_policy.VIDEO_OUTCOMES)


@query("SELECT concat('/s/', s_suppkey) AS path, 'Access denied' AS reason, 0 AS source FROM supplier UNION ALL SELECT concat('/n/', n_nationkey), 'File changed since scan.', 1 FROM nation")
def all_skipped(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/s/"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("Access denied").alias("reason"))
    second = table(spark, sf_dir, "nation").select(F.concat(F.lit("/n/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(review.CHANGED).alias("reason"))
    return review.all_skipped(first, second)


@query(_W + " SELECT full_path, doc_id % 11 <> 3 AND doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND attributes & 1024 = 0 AS current FROM files WHERE extension = '.mp4'")
def queue_recheck(spark, sf_dir):
    files, k = _files(spark, sf_dir), F.col("doc_id")
    now = files.where("doc_id % 11 <> 3").withColumns({"size_bytes": F.col("size_bytes") + (k % 5 == 1).cast("long"), "modified_ticks": F.col("modified_ticks") + (k % 7 == 2).cast("long")})
    return review.still_same(files.where("extension = '.mp4'"), now).select("full_path", "current")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 IN (1, 2, 3) THEN 'Video optimization requires fully qualified source and output paths and a valid source snapshot.' WHEN p_partkey % 7 IN (4, 5, 6) THEN 'The output must be a different sibling .mp4 path.' END AS fault FROM part""")
def request_checks(spark, sf_dir):
    k = F.col("p_partkey") % 7
    source = F.when(k == 1, "relative.mov").when(k == 2, F.lit(None).cast("string")).otherwise("/a/b.mov")
    target = F.when(k == 4, "/a/B.MOV").when(k == 5, "/c/b.mp4").when(k == 6, "/a/b.mkv").otherwise("/A/x.MP4")
    return table(spark, sf_dir, "part").select("p_partkey", review.request_fault(source, target, F.when(k == 3, -1).otherwise(5)).alias("fault"))


@query("""SELECT concat('/i/', p_partkey) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'File changed since scan.' ELSE 'Could not decode image.' END AS reason FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0 OR p_partkey % 7 = 1""")
def image_samples_skipped(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/i/"), k.cast("string")).alias("full_path"), F.lit(9).alias("size_bytes"), F.lit(9).alias("modified_ticks"), F.lit(9).alias("before_size"), F.lit(9).alias("before_ticks"), F.lit(9).alias("after_size"), (F.lit(9) + (k % 5 == 0).cast("int")).alias("after_ticks"), F.when(k % 3 == 0, 0).otherwise(32).alias("width"), F.lit(32).alias("height"), F.when(k % 7 == 1, F.lit("x")).otherwise(F.lit("x" * 1024)).cast("binary").alias("luminance"))
    return review.sampled(rows, review.sound_image(), review.FAILED_IMAGE)[1]


#: Codes and kinds that the two queries below ask about, and what the rule says of them, written out (fixed values).
_CODES = ["88982F50", "88982F80", "88982F81", "88982F07", "88982F60", "88982F61", "88982F62", "88982F63", "88982F70", "88982F72", "C00D36BE", "C00D5212", "C00D36C4", "C00D3700", "C00D714A", "C00D36BE", "C00D3E84"]
_KINDS = ["data", "argument", "unsupported", "platform", "other"]
_ASKED = f"p AS (SELECT p_partkey, {_CODES}[(p_partkey % {len(_CODES)} + 1)::INT] AS code, {_KINDS}[(p_partkey % 5 + 1)::INT] AS kind FROM part)"
_BY_KIND = "(VALUES ('data', 'Invalid', '{bad}'), ('argument', 'Invalid', '{bad}'), ('unsupported', 'UnsupportedOrProtected', 'UnsupportedContainer'), ('platform', 'UnsupportedOrProtected', 'UnsupportedContainer'))"
_VERDICT = "SELECT p_partkey, coalesce(r.status, k.status) AS status, coalesce(r.error_type, k.error_type) AS error_type FROM p LEFT JOIN r USING (code) LEFT JOIN k USING (kind)"


@query(f"""WITH {_ASKED}, r(code, status, error_type) AS (VALUES ('C00D5212', 'UnsupportedOrProtected', 'CodecUnavailable'), ('C00D36C4', 'UnsupportedOrProtected', 'UnsupportedContainer'), ('C00D3700', 'UnsupportedOrProtected', 'PasswordProtected'),
  ('C00D714A', 'UnsupportedOrProtected', 'PasswordProtected'), ('C00D36BE', 'Invalid', 'MediaOpenFailure'), ('C00D3E84', 'Invalid', 'MediaOpenFailure')), k(kind, status, error_type) AS {_BY_KIND.format(bad="MediaOpenFailure")} {_VERDICT}""")
def media_verdicts(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    verdict = review.probe_verdict(pick(_CODES), pick(_KINDS), image=False)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in verdict.items()])


@query("""WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 1 THEN 1440 ELSE 720 END AS w, 576 AS h, p_partkey % 4 = 2 AS turned, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 16 END AS pn, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 15 END AS pd FROM part)
 SELECT k AS p_partkey, (CASE WHEN turned THEN h ELSE w END)::INT AS width, (CASE WHEN turned THEN h::DOUBLE ELSE w * (pn::DOUBLE / pd) END) AS display_width, pn::BIGINT AS par_n, CASE k % 3 WHEN 0 THEN 'H.264' WHEN 1 THEN 'HEVC' ELSE 'AV1' END AS video_codec,
 CASE WHEN k % 2 = 0 THEN 'AAC ADTS' END AS audio_codec, k % 11 <> 0 AND k % 13 <> 0 AS valid FROM v""")
def video_info(spark, sf_dir):
    k = F.col("p_partkey")
    zero = k % 5 == 0
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 3 == 1, 1440).otherwise(720).alias("coded_width"), F.lit(576).alias("coded_height"), F.when(k % 4 == 2, "Rotate270").otherwise("Rotate180").alias("orientation"), F.when(zero, 0).otherwise(16).cast("long").alias("par_n"), F.when(zero, 0).otherwise(15).cast("long").alias("par_d"),
        F.when(k % 11 == 0, 0).otherwise(5).alias("duration_ticks"), F.lit(30).alias("fps_n"), F.lit(1).alias("fps_d"), F.when(k % 3 == 0, " h264 ").when(k % 3 == 1, "hevces").otherwise("AV1 ").alias("video_codec"), F.lit("mpeg4").alias("container"), F.lit("aac adts").alias("audio_codec"), F.lit(64000).alias("audio_bitrate"),
        F.lit(1).alias("video_tracks"), F.when(k % 2 == 0, 1).otherwise(0).alias("audio_tracks"), F.when(k % 13 == 0, 1).otherwise(0).alias("metadata_tracks"),
    )
    return review.video_info(rows).select("p_partkey", "width", "display_width", "par_n", "video_codec", "audio_codec", "valid")


@query()
def content_hash(spark, sf_dir):
    """XXH3-64 of contents, as 16 hex digits (no SQL function has it)."""
    return _files(spark, sf_dir).select("full_path", hashes.hex16(hashes.xxh3(F.col("content").cast("binary"))).alias("hash"))


# --- rules of selections, plans and lists ----------------------------------------------------------------------------


@query(_SELECTED + " SELECT sha256(content) AS digest, size_bytes FROM sel GROUP BY content, size_bytes HAVING bool_and(selected OR size_bytes % 2 = 1)")
def survivor_rule(spark, sf_dir):
    """Groups without a survivor, of a selection that takes all files of an odd size."""
    members = exact.keep_one(_members(spark, sf_dir))
    return exact.unsafe(members.withColumn("selected", F.col("selected") | (F.col("size_bytes") % 2 == 1))).select("digest", "size_bytes")


_NAMED = _SELECTED + """, nm AS (SELECT content, full_path AS survivor_path FROM sel WHERE (size_bytes % 3 <> 0 AND NOT selected) OR (size_bytes % 3 = 0 AND selected AND doc_id % 2 = 0)),
 sound AS (SELECT s.content, any_value(survivor_path) AS survivor_path FROM sel s JOIN nm ON s.content = nm.content AND s.full_path = nm.survivor_path GROUP BY s.content HAVING count(*) = 1 AND bool_and(NOT selected))"""


def _link_plan(spark, sf_dir):
    """Groups whose size 3 divides name selected files as survivors, or none."""
    members = exact.keep_one(_members(spark, sf_dir)).drop("survivor_path")
    three = F.col("size_bytes") % 3 == 0
    named = members.where((~three & ~F.col("selected")) | (three & F.col("selected") & (F.col("doc_id") % 2 == 0)))
    return actions.link_plan(members, named.select("digest", "size_bytes", F.col("full_path").alias("survivor_path")))


@query(_NAMED + " SELECT survivor_path, full_path AS duplicate_path FROM sel JOIN sound USING (content) WHERE selected")
def link_pairs(spark, sf_dir):
    return _link_plan(spark, sf_dir)[0]


@query(_NAMED + " SELECT DISTINCT sha256(content) AS digest, size_bytes FROM sel WHERE selected AND content NOT IN (SELECT content FROM sound)")
def link_faults(spark, sf_dir):
    return _link_plan(spark, sf_dir)[1]


_TOOL_NAMES = ["ExactScan", "EmptyFiles", "EmptyFolders", "BigFiles", "TemporaryFiles", "InvalidLinks", "BrokenFiles", "SimilarImages", "SimilarVideos", "MusicDuplicates", "BadExtensions", "BadNames"]


@query(f"WITH t AS (SELECT p_partkey, {_TOOL_NAMES}[(p_partkey % 12 + 1)::INT] AS tool FROM part) SELECT p_partkey, tool, p_partkey % 12 BETWEEN 1 AND 9 AS may_change, p_partkey % 12 BETWEEN 1 AND 11 AND p_partkey % 12 <> 6 AS may_rename FROM t")
def tool_authority(spark, sf_dir):
    tool = F.element_at(F.array(*map(F.lit, _TOOL_NAMES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return actions.authority(table(spark, sf_dir, "part").select("p_partkey", tool.alias("tool")))


@query(ORACLES["video_groups"].replace(" FROM part)", " FROM part WHERE p_partkey % 4 <> 1)").replace("<= 45", "<= 25"))
def video_regroup(spark, sf_dir):
    """Groups from what is left of the stored evidence after some videos went, at another distance."""
    return similarity.video_groups(adapters.videos(table(spark, sf_dir, "part").where("p_partkey % 4 <> 1")), 5).select(*_G)


@query(ORACLES["music_groups"].replace(" FROM events)", " FROM events WHERE event_id % 3 <> 1)").replace("300000000", "9000000000"))
def music_regroup(spark, sf_dir):
    left = table(spark, sf_dir, "events").where("event_id % 3 <> 1")
    good, _ = similarity.music_keys(adapters.tracks(left), ready=True)
    return similarity.music_groups(good, 9_000_000_000).select("group_id", "full_path", "is_reference", "difference_ticks")


_ITEM = " SELECT group_id, full_path, full_path = ref_path AS is_reference, "


def _described(sql: str, columns: str) -> str:
    """A query of groups with other columns of its items."""
    return sql[: sql.rindex(_ITEM)] + f", gi AS (SELECT *, {sql[sql.rindex(_ITEM) + len(_ITEM) :].replace(' FROM it JOIN', ' FROM it JOIN')}) SELECT {columns} FROM gi"


_IMAGE_TEXT = """'{"HammingDistance":"' || distance || '","Height":"' || height || '","Width":"' || width || '"}'"""


@query(_described(_IMAGE_GROUPS, f"""full_path, {_IMAGE_TEXT} AS metadata, '{{"MaximumHammingDistance":"12","Type":"Image"}}' AS group_metadata"""))
def image_metadata(spark, sf_dir):
    rows = similarity.image_groups(adapters.images(table(spark, sf_dir, "part")), 12)
    return rows.select("full_path", text.map_json(F.col("metadata")).alias("metadata"), text.map_json(F.col("group_metadata")).alias("group_metadata"))


def _span_sql(ticks: str) -> str:
    return f"CASE WHEN {ticks} >= 864000000000 THEN ({ticks} // 864000000000) || '.' ELSE '' END || lpad(({ticks} // 36000000000 % 24)::VARCHAR, 2, '0') || ':' || lpad(({ticks} // 600000000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ticks} // 10000000 % 60)::VARCHAR, 2, '0') || CASE WHEN {ticks} % 10000000 > 0 THEN '.' || lpad(({ticks} % 10000000)::VARCHAR, 7, '0') ELSE '' END"


@query(_described(ORACLES["video_groups"], f"""full_path, '{{"Bitrate":"' || bitrate || '","Duration":"' || {_span_sql("duration_ticks")} || '","Height":"' || height || '","MeanFrameDistance":"' || regexp_replace(distance::VARCHAR, '[.]0$', '') || '","Width":"' || width || '"}}' AS metadata"""))
def video_metadata(spark, sf_dir):
    rows = similarity.video_groups(adapters.videos(table(spark, sf_dir, "part")), 9)
    return rows.select("full_path", text.map_json(F.col("metadata")).alias("metadata"))


@query(ORACLES["music_groups"].rsplit(" SELECT group_id", 1)[0].replace("SELECT w.*, g.bitrate,", "SELECT w.*, g.title, g.artist, g.album_artist, g.bitrate,") + f""" SELECT full_path, '{{"AlbumArtist":"' || coalesce(album_artist, '') || '","Artist":"' || artist || '","Bitrate":"' || bitrate || '","Confidence":"High","Duration":"' || {_span_sql("duration_ticks")} || '","DurationDifference":"' || {_span_sql("abs(duration_ticks - rt)")} || '","Title":"' || title || '"}}' AS metadata FROM it JOIN rf USING (title_key, artist_key, anchor)""")
def music_metadata(spark, sf_dir):
    good, _ = similarity.music_keys(adapters.tracks(table(spark, sf_dir, "events")), ready=True)
    return similarity.music_groups(good, 300_000_000).select("full_path", text.map_json(F.col("metadata")).alias("metadata"))


@query(_described(_IMAGE_GROUPS, """full_path AS path, 'Similarity match' AS reason, group_id, similarity_percent, '{"HammingDistance":"' || distance || '","Height":"' || height || '","MaximumHammingDistance":"12","Type":"Image","Width":"' || width || '"}' AS metadata"""))
def export_similarity(spark, sf_dir):
    """Items of similarity groups as an export has them: an item's metadata and its group's."""
    items = similarity.image_groups(adapters.images(table(spark, sf_dir, "part")), 12)
    rows = export.group_items(items, F.col("metadata"), F.col("group_metadata"))
    return rows.select("path", "reason", "group_id", "similarity_percent", text.map_json(F.col("metadata")).alias("metadata"))


@query(_W + " SELECT full_path, row_number() OVER (ORDER BY size_bytes DESC, upper(full_path), full_path) AS place FROM files WHERE size_bytes >= 10000 AND attributes & 1024 = 0")
def large_files_order(spark, sf_dir):
    return placed(findings.large_files(_files(spark, sf_dir), 10_000)).select("full_path", "place")


@query(ORACLES["bad_names"].replace("SELECT * FROM r WHERE", "SELECT full_path, row_number() OVER (ORDER BY upper(full_path), full_path) AS place FROM r WHERE"))
def bad_names_order(spark, sf_dir):
    return placed(findings.bad_names(_named(spark, sf_dir))).select("full_path", "place")


@query(f"WITH {_DIRS} SELECT full_path, row_number() OVER (ORDER BY depth DESC, upper(full_path), full_path) AS place FROM dirs WHERE physical_child_count = 0 AND attributes & 1024 = 0 AND c_custkey NOT IN (5, 9) AND c_custkey % 100 <> 13")
def folder_order(spark, sf_dir):
    """Empty folders in the order in which they can be deleted."""
    return placed(_empty_folders(spark, sf_dir)).select("full_path", "place")


@query(_LARGE + """, xr AS (SELECT 'item' AS record_type, full_path AS path FROM lg UNION ALL SELECT 'skipped_path', path FROM sk) SELECT record_type, path, row_number() OVER (ORDER BY upper(path), path, record_type) AS place FROM xr""")
def export_order(spark, sf_dir):
    return placed(_export(spark, sf_dir)).select("record_type", "path", "place")


_NUMBERED = "WITH RECURSIVE f AS (SELECT p_partkey, concat('f', p_partkey % 25, CASE p_partkey // 25 % 4 WHEN 1 THEN ' (2)' WHEN 2 THEN ' (2) (3)' WHEN 3 THEN ' (4)' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN '.TXT' ELSE '.txt' END) AS name FROM part), l AS (SELECT *, concat('/d', lpad((p_partkey * 7919 % 100000)::VARCHAR, 6, '0'), '/', p_partkey, '/', name) AS full_path, p_partkey % 25 AS base FROM f)"


@query(_NUMBERED + """, o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY upper(full_path), full_path) AS i, regexp_replace(name, '[.][^.]*$', '') AS stem, regexp_extract(name, '[.][^.]*$') AS ext FROM l),
 walk AS (SELECT base, 0::BIGINT AS i, CASE base WHEN 7 THEN ['F7 (2).TXT', 'F7 (2) (2).TXT'] ELSE []::VARCHAR[] END AS used, NULL::VARCHAR AS full_path, NULL::VARCHAR AS new_name FROM (SELECT DISTINCT base FROM o)
  UNION ALL SELECT o.base, o.i, list_append(w.used, upper(x.new)), o.full_path, x.new FROM walk w JOIN o ON o.base = w.base AND o.i = w.i + 1,
   LATERAL (SELECT list_filter(list_transform(range(1, len(w.used) + 2), lambda n: CASE WHEN n = 1 THEN o.name ELSE o.stem || ' (' || n || ')' || o.ext END), lambda t: NOT list_contains(w.used, upper(t)))[1] AS new) AS x)
 SELECT full_path, new_name FROM walk WHERE i > 0""")
def move_plan_numbered(spark, sf_dir):
    """A move of files whose names look numbered already, into a folder that has some of them."""
    k = F.col("p_partkey")
    turn = F.floor(k / 25) % 4
    name = F.concat(F.lit("f"), (k % 25).cast("string"), F.when(turn == 1, " (2)").when(turn == 2, " (2) (3)").when(turn == 3, " (4)").otherwise(""), F.when(k % 3 == 0, ".TXT").otherwise(".txt"))
    files = table(spark, sf_dir, "part").select(name.alias("file_name"), F.concat(F.lit("/d"), F.lpad((k * 7919 % 100000).cast("string"), 6, "0"), F.lit("/"), k.cast("string"), F.lit("/"), name).alias("full_path"))
    used = spark.createDataFrame([("F7 (2).txt",), ("f7 (2) (2).TXT",), ("else.txt",)], "name string")
    return actions.move_plan(files, used, "/to").select("full_path", "new_name")


@query(_LEAVES + " SELECT full_path, regexp_replace(full_path, '/[^/]*$', '') || '/' || regexp_replace(file_name, '[.][^.]*$', '') || '.clean' || CASE WHEN p_partkey % 40 = 5 THEN ' (2)' ELSE '' END || regexp_extract(file_name, '[.][^.]*$') AS output_path FROM l")
def clean_plan(spark, sf_dir):
    """Outputs beside the sources; each folder has f5.clean.txt already."""
    files = _leaves(spark, sf_dir).withColumn("directory_path", paths.parent(F.col("full_path")))
    taken = files.select(F.col("directory_path").alias("folder")).distinct().withColumn("name", F.lit("F5.Clean.TXT"))
    return actions.clean_plan(files, taken).select("full_path", "output_path")


_EXIF_NAMES = "[" + ", ".join(f"'{o}'" for o in media_policy.EXIF_OUTCOMES) + "]"


@query(f"WITH o AS (SELECT unnest({_EXIF_NAMES}) AS outcome), r AS (SELECT {_EXIF_NAMES}[(p_size * p_size % 7 + 1)::INT] AS outcome FROM part) SELECT outcome, (SELECT count(*) FROM r WHERE r.outcome = o.outcome) AS n FROM o")
def exif_outcomes(spark, sf_dir):
    names = F.array(*map(F.lit, media_policy.EXIF_OUTCOMES))
    found = table(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_size") * F.col("p_size") % 7 + 1).cast("int")).alias("outcome"))
    return review.outcome_counts(found, media_policy.EXIF_OUTCOMES)


@query(f"""WITH {_ASKED}, r(code, status, error_type) AS (VALUES ('88982F50', 'UnsupportedOrProtected', 'CodecUnavailable'), ('88982F80', 'UnsupportedOrProtected', 'CodecUnavailable'), ('88982F81', 'UnsupportedOrProtected', 'UnsupportedContainer'),
  ('88982F07', 'Invalid', 'ImageDecodeFailure'), ('88982F60', 'Invalid', 'ImageDecodeFailure'), ('88982F61', 'Invalid', 'ImageDecodeFailure'), ('88982F62', 'Invalid', 'ImageDecodeFailure'), ('88982F63', 'Invalid', 'ImageDecodeFailure'),
  ('88982F70', 'Invalid', 'ImageDecodeFailure'), ('88982F72', 'Invalid', 'ImageDecodeFailure'), ('C00D36BE', 'Invalid', 'ImageDecodeFailure')), k(kind, status, error_type) AS {_BY_KIND.format(bad="ImageDecodeFailure")} {_VERDICT}""")
def image_verdicts(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    verdict = review.probe_verdict(pick(_CODES), pick(_KINDS), image=True)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in verdict.items()])


@query("SELECT concat('/v/', p_partkey) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'File changed since scan.' ELSE 'Could not decode video.' END AS reason FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 1 OR p_partkey % 3 = 0 OR p_partkey % 11 = 2 OR p_size % 6 <> 5")
def video_samples_skipped(spark, sf_dir):
    """Samples with too few frames, a blank codec, no rate or no end are skipped; so are files that changed meanwhile."""
    k = F.col("p_partkey")
    nine = F.lit(9).cast("long")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("/v/"), k.cast("string")).alias("full_path"), nine.alias("size_bytes"), nine.alias("modified_ticks"), nine.alias("before_size"), nine.alias("before_ticks"), (nine + (k % 5 == 0).cast("int")).alias("after_size"), nine.alias("after_ticks"),
        F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(1.3).alias("display_aspect"), F.when(k % 11 == 2, float("inf")).otherwise(5.0).alias("duration_ticks"), F.when(k % 7 == 1, 0.0).otherwise(25.0).alias("fps"), F.when(k % 3 == 0, " ").otherwise("hevc").alias("codec"),
        F.array_repeat(F.repeat(F.lit("x"), F.lit(1024)).cast("binary"), F.col("p_size") % 6).alias("frames"),
    )
    return review.sampled(rows, review.sound_video(), review.FAILED_VIDEO)[1]


@query(_W + " SELECT full_path, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS print FROM files WHERE doc_id % 7 <> 0 AND doc_id % 9 <> 4")
def cache_accepted(spark, sf_dir):
    """What of a cache counts: this version, sound evidence, one entry a snapshot."""
    files, k = _files(spark, sf_dir), F.col("doc_id")
    rows = files.select("full_path", "size_bytes", "modified_ticks", F.when(k % 7 == 0, 1).otherwise(2).alias("version"), F.explode(F.array(k + 1, k + 2, k + (k % 2))).alias("print"), F.when(k % 9 == 4, 0.0).otherwise(1.5).alias("width"))
    return evidence.accepted(rows, 2, F.col("width") > 0).select("full_path", "print")


@query(_W + " SELECT count(*) FILTER (doc_id % 3 = 0) + (SELECT count(*) FROM supplier) AS n_done, coalesce(sum(size_bytes) FILTER (doc_id % 3 = 0), 0)::BIGINT AS bytes_done, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes_total FROM files")
def progress_bytes(spark, sf_dir):
    """Files that were looked at so far, in other capitals, and paths that the inventory doesn't know."""
    files = _files(spark, sf_dir)
    unknown = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/none/"), F.col("s_suppkey").cast("string")).alias("path"))
    return results.bytes_done(files.where("doc_id % 3 = 0").select(F.lower("full_path").alias("path")).unionByName(unknown), files)


@query("""WITH b AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey * 1024 WHEN 3 THEN o_orderkey * 1048576 WHEN 4 THEN 1099511627776 * 3 ELSE -1024 END AS n FROM orders)
 SELECT o_orderkey, CASE WHEN n <= 0 THEN 0 WHEN n % 1099511627776 = 0 THEN 4 WHEN n % 1073741824 = 0 THEN 3 WHEN n % 1048576 = 0 THEN 2 WHEN n % 1024 = 0 THEN 1 ELSE 0 END AS unit FROM b""")
def editor_units(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    n = F.when(k % 6 == 0, 0).when(k % 6 == 1, k).when(k % 6 == 2, k * 1024).when(k % 6 == 3, k * 1048576).when(k % 6 == 4, 3 * 1024**4).otherwise(-1024)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.editor_unit(n).alias("unit"))


_ZIP = """WITH z AS (SELECT p_partkey, p_partkey % 3 AS c, p_partkey % 2 AS flags, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS disk, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS off, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS more, p_partkey % 13 = 0 AS cut FROM part),
 st AS (SELECT *, CASE WHEN cut THEN 'Invalid' WHEN disk <> 0 OR off <> 0 THEN 'UnsupportedOrProtected' WHEN more <> 0 THEN 'Invalid' WHEN c > 0 AND flags = 1 THEN 'UnsupportedOrProtected' ELSE 'Valid' END AS status,
  CASE WHEN cut THEN 'ZipCentralDirectoryFailure' WHEN disk <> 0 OR off <> 0 THEN 'UnsupportedContainer' WHEN more <> 0 THEN 'ZipCentralDirectoryFailure' WHEN c > 0 AND flags = 1 THEN 'PasswordProtected' END AS error_type FROM z)"""


def _zips(spark, sf_dir):
    """A ZIP file of each part: so many entries of one name each, and an end record that may say otherwise."""
    k = F.col("p_partkey")
    word = lambda n: F.concat(F.lpad(F.hex(n), 2, "0"), F.lit("00"))
    flag = lambda c: c.cast("int")
    entries = (k % 3).cast("int")
    entry = F.concat(F.lit("504B010200000000"), word(k % 2), F.lit("00" * 18), F.lit("0100"), F.lit("00" * 16), F.lit("61"))
    said = entries + flag(k % 5 == 0)
    end = F.concat(F.lit("504B0506"), word(flag(k % 7 == 0)), F.lit("0000"), word(said + flag(k % 11 == 0)), word(said), word(entries * 47), F.lit("0000"), F.lit("04000000"), F.lit("0000"))
    digits = F.concat(F.lit("504B0304"), F.repeat(entry, entries), end)
    content = F.unhex(F.when(k % 13 == 0, F.substring(digits, F.lit(1), F.length(digits) - 2)).otherwise(digits))
    path = F.concat(F.lit("/zip/"), k.cast("string"), F.lit(".zip"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("full_path"), F.lit(".zip").alias("extension"), F.octet_length(content).cast("long").alias("size_bytes"), k.alias("created_ticks"), k.alias("modified_ticks"), F.lit(0).alias("attributes"), content.alias("content"))


@query(_ZIP + " SELECT p_partkey, status, error_type FROM st")
def zip_probe(spark, sf_dir):
    status = archives.zip_status("content")
    return _zips(spark, sf_dir).select("p_partkey", status.alias("z")).select("p_partkey", "z.status", "z.error_type")


@query(_ZIP + " SELECT concat('/zip/', p_partkey, '.zip') AS full_path, CASE status WHEN 'Invalid' THEN 'Unreadable or malformed file.' ELSE 'Unsupported or protected.' END AS reason, 'Zip' AS validator, error_type FROM st WHERE status <> 'Valid'")
def broken_archives(spark, sf_dir):
    """ZIP files that their own directories show to be broken or locked."""
    files = _zips(spark, sf_dir)
    m = F.col("metadata")
    return findings.broken_files(files, findings.probed(files))[0].select("full_path", "reason", m["Validator"].alias("validator"), m["ErrorType"].alias("error_type"))


@query("""WITH t AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, rpad(h, ((length(h) + 7) // 8 * 8)::INT, '0') AS h FROM t),
 px AS (SELECT doc_id, i, ('0x' || substr(h, (8 * i + 1)::INT, 2))::INT AS b, ('0x' || substr(h, (8 * i + 3)::INT, 2))::INT AS g, ('0x' || substr(h, (8 * i + 5)::INT, 2))::INT AS r, ('0x' || substr(h, (8 * i + 7)::INT, 2))::INT AS a FROM d, LATERAL (SELECT unnest(range(length(h) // 8)) AS i)),
 w AS (SELECT doc_id, i, (b * a + 255 * (255 - a) + 127) // 255 AS b, (g * a + 255 * (255 - a) + 127) // 255 AS g, (r * a + 255 * (255 - a) + 127) // 255 AS r FROM px)
 SELECT doc_id, string_agg(lpad(hex((54 * r + 183 * g + 19 * b) >> 8), 2, '0'), '' ORDER BY i) AS luminances FROM w GROUP BY doc_id""")
def pixel_luminance(spark, sf_dir):
    """Whole texts as BGRA pixels, on white."""
    content = F.col("text").cast("binary")
    whole = F.rpad(content, (F.ceil(F.octet_length("text") / 4) * 4).cast("int"), F.lit(bytes(1)))
    return table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", F.hex(perceptual.luminances(whole)).alias("luminances"))


@query(_LARGE + f""" SELECT '{{"record_type":"item","tool":"BigFiles","generated_utc":"2023-01-01T00:00:00.0000007Z","scope_summary":"1 folder, 0 files, 2 excluded; subfolders included","path":"' || full_path || '","kind":"File","reason":"At least 10,000 bytes","size_bytes":' || size_bytes || ',"modified_utc":"' || {_UTC.format(t="modified_ticks")} || '","metadata":"{{\\"Extension\\":\\"' || extension || '\\"}}"}}' AS line FROM lg
 UNION ALL SELECT '{{"record_type":"skipped_path","tool":"BigFiles","generated_utc":"2023-01-01T00:00:00.0000007Z","scope_summary":"1 folder, 0 files, 2 excluded; subfolders included","path":"' || path || '","metadata":"{{}}","skipped_reason":"Access \\"denied\\""}}' FROM sk""")
def export_json(spark, sf_dir):
    return export.json_items(_export(spark, sf_dir))


_HEADS = ["", " ", ".", "con", "a:", "\t", "LPT1", "..", "AUX.", "x\x01y"]
_BODIES = ["", "x", "nul", "b?d", " ", ".c", "é", "com1 "]
_TAILS = ["", ".", " ", ".txt", ". .", ".tar.gz", "\x7f"]


def _sql_text(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" if not c.isprintable() else f"'{c}'" for c in value) or "''"


_PIECED = f"""WITH n AS (SELECT p_partkey, [{", ".join(map(_sql_text, _HEADS))}][(p_partkey % 10 + 1)::INT] || [{", ".join(map(_sql_text, _BODIES))}][(p_partkey // 10 % 8 + 1)::INT] || [{", ".join(map(_sql_text, _TAILS))}][(p_partkey // 80 % 7 + 1)::INT] AS name FROM part),
 r AS (SELECT *, {_REASONS} AS reasons FROM n), e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[\\x00-\\x1F\\x7F]', '', 'g'), '["<>|:*?\\\\/]', '_', 'g'), '^\\s+', ''), '[\\s.]+$', '') AS e FROM r),
 f AS (SELECT *, CASE WHEN regexp_matches(e, '^([.][^.]*)?$') THEN 'file' || e ELSE e END AS f FROM e),
 d AS (SELECT *, CASE WHEN regexp_matches(upper(f), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])[ .]*([.].*)?$') THEN regexp_replace(f, '^([^.]*)', '\\1_file') ELSE f END AS suggestion FROM f)"""


@query(_PIECED + " SELECT p_partkey, reasons, suggestion FROM d WHERE reasons <> ''")
def name_rules(spark, sf_dir):
    """Reasons and suggestions for names of all sorts of pieces."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(_HEADS, 1), pick(_BODIES, 10), pick(_TAILS, 80)).alias("file_name"), F.lit(0).alias("attributes"), *[F.lit(1).cast("long").alias(c) for c in ("size_bytes", "created_ticks", "modified_ticks")])
    found = findings.bad_names(rows.withColumn("full_path", k.cast("string")))
    return found.select(F.col("full_path").cast("long").alias("p_partkey"), F.col("reason").alias("reasons"), "suggestion")


# --- metadata as trees -----------------------------------------------------------------------------------------------

#: Trees of 13 to 20 parts each, the first ten of which are blocks.
_NODES = "n AS (SELECT p_partkey // 20 AS tree, p_partkey AS node, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_partkey - p_partkey % 20 + (p_partkey % 20 - 1) // (2 + p_partkey // 20 % 4) END AS parent, p_brand AS name, p_partkey % 20 < 10 AS block, encode(p_name) AS value FROM part WHERE p_partkey % 20 <= 12 + p_partkey // 20 % 7)"
_DEEP = "d AS (SELECT *, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.*, depth + 1 FROM n JOIN d ON n.tree = d.tree AND n.parent = d.node)"
_FAULT = """f AS (SELECT tree, CASE WHEN max(depth) FILTER (block) > 2 THEN 'depth' WHEN sum(CASE WHEN block AND parent IS NOT NULL THEN 2 ELSE 1 END) > 27 THEN 'nodes' WHEN max(octet_length(value)) FILTER (NOT block) > 11 THEN 'leaf'
  WHEN sum(CASE WHEN block THEN 0 ELSE octet_length(value) END + CASE WHEN parent IS NULL THEN 0 ELSE octet_length(encode(name)) + 41 END) > 890 THEN 'bytes' END AS fault FROM d GROUP BY tree)"""
_SUMS = "".join(
    f""", s{i} AS (SELECT d.*, CASE WHEN d.block THEN coalesce(made, sha256('')) ELSE sha256(value) END AS digest FROM d LEFT JOIN (SELECT tree, parent, sha256(string_agg(octet_length(encode(name)) || ':' || name || CASE WHEN block THEN 'B' ELSE 'V' END || digest, '' ORDER BY name, block, digest)) AS made FROM s{i + 1} GROUP BY tree, parent) m ON m.tree = d.tree AND m.parent = d.node WHERE depth = {i})"""
    for i in range(5, -1, -1)
)


@query(f"WITH RECURSIVE {_NODES}, {_DEEP}, {_FAULT}, s6 AS (SELECT *, '' AS digest FROM d WHERE depth > 6){_SUMS} SELECT f.tree, fault, CASE WHEN fault IS NULL THEN digest END AS digest FROM f JOIN s0 USING (tree)")
def tree_digests(spark, sf_dir):
    """Trees of parts: the first limit that each one breaks, or its digest."""
    k = F.col("p_partkey").cast("long")
    parent = F.when(k % 20 == 0, None).otherwise(k - k % 20 + F.floor((k % 20 - 1) / (2 + F.floor(k / 20) % 4)))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 20 <= 12 + p_partkey div 20 % 7").select(F.floor(k / 20).alias("tree"), k.alias("node"), parent.alias("parent"), F.col("p_brand").alias("name"), (k % 20 < 10).alias("block"), F.col("p_name").cast("binary").alias("value"))
    return trees.tree_digests(nodes, trees.Limits(depth=2, nodes=27, leaf_bytes=11, total_bytes=890))

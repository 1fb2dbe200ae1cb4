"""Operator 8 [native]: secrets in text, by patterns and by sliding-window Shannon entropy; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import let

#: Kinds in the order in which they are listed; entropy spans come from the sliding window.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: Symbols of candidate strings.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
#: Folds copy their result at each step; so long blocks only.
_BLOCK = 256
_SCALE = 1 << 20


#: What words hardly have and random strings often do: a single small letter before a capital one; in paths also a digit
#: before a letter. (Patterns of repeated groups would say more, but fail on very long candidates.)
_NO_WORD = "(?:^|[^a-z])[a-z][A-Z]"
_NO_PATH = f"[0-9][A-Za-z]|{_NO_WORD}"


@dataclass(frozen=True)
class Rules:
    """A candidate is a maximal run of ALPHABET of window symbols or more. It is a secret where a window's entropy reaches
    the limit (bits a symbol) of the candidate's character class, unless an entry of the allow list suppresses it: it matches
    the first pattern and not the second, if there is one."""

    window: int = 20
    limits: dict = field(default_factory=lambda: {"hex": 2.9, "one_case": 3.4, "any": 3.6})
    allow: tuple[tuple[str, str], ...] = (
        (r"^[A-Za-z+/_=-]+$", _NO_WORD),  # no digit: words, paths, rules of dashes
        (r"^[0-9+/_=-]+$", ""),  # no letter: numbers, dates
        (r"(?i)example|sample|dummy|placeholder|x{6}|0123456789|abcdefgh", ""),
        (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", ""),  # identifiers made to be public
        (r"^[A-Za-z0-9_-]*/[A-Za-z0-9_/-]*$", _NO_PATH),  # paths
    )


CLASSES = {"hex": "^(?:[0-9a-f]+|[0-9A-F]+)$", "one_case": "^(?:[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", "any": ""}


def _places(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,match,group>>, in code points, end exclusive.

    What lies between the matches and the matches themselves give the places by running sums, in blocks, so that a text
    with many matches takes about linear time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("found"), part.alias("part")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("n"), x["found"].alias("match"), x["part"].alias("group")))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,group:string>>)")
    nested = F.expr("cast(array() as array<array<struct<start:int,end:int,match:string,group:string>>>)")

    def one(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + x["n"]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), end.alias("end"), x["match"], x["group"])).alias("out"))

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda at: F.aggregate(F.slice(steps, at * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("out")), one))

    shift = lambda by: lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["match"], x["group"])
    joined = F.aggregate(let(steps, blocks), F.struct(F.lit(0).alias("at"), nested.alias("out")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], F.transform(b["out"], shift(acc["at"]))).alias("out")))
    return F.flatten(joined["out"])


def _costs(window: int) -> Column:
    """n log2 n for n from 0 to window, scaled to whole numbers, so that running sums are exact."""
    return F.array(*[F.lit(round(n * math.log2(n) * _SCALE) if n else 0).cast("long") for n in range(window + 1)])


def least_cost(symbols: Column, window: int) -> Column:
    """The least sum of n log2 n over the counts n of a window's symbols, over all windows of an array of single symbols.

    The window's Shannon entropy is log2(window) - cost / window: the least cost marks the highest entropy. Each step
    adds one count for the symbol that enters and takes one off for the one that leaves.
    """
    costs = _costs(window)
    cost = lambda n: F.element_at(costs, n + 1)
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("least"))

    def step(index: Column, acc: Column, i: Column) -> Column:
        # no null index anywhere: element_at counts as never null under ANSI rules
        full = i > window
        enters, leaves = F.element_at(index, i), F.element_at(index, F.greatest(i - window, F.lit(1)))
        counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == enters).cast("int") - (full & (k + 1 == leaves)).cast("int"))
        was_in, was_out = F.element_at(acc["counts"], enters), F.element_at(acc["counts"], leaves)
        gone = F.when(full, cost(was_out - 1) - cost(was_out)).otherwise(F.lit(0).cast("long"))
        changed = F.when(full & (leaves == enters), F.lit(0).cast("long")).otherwise(cost(was_in + 1) - cost(was_in) + gone)
        now = acc["cost"] + changed
        return F.struct(counts.alias("counts"), now.alias("cost"), F.when(i >= window, F.least(acc["least"], now)).alias("least"))

    fold = lambda index: F.aggregate(F.sequence(F.lit(1), F.size(index)), start, lambda acc, i: step(index, acc, i), lambda acc: acc["least"])
    return let(F.transform(symbols, lambda c: F.instr(F.lit(ALPHABET), c)), fold)


def is_secret(candidate: Column, rules: Rules) -> Column:
    """Whether a candidate string's highest window entropy reaches its class's limit and the allow list doesn't suppress it."""
    most = lambda name: F.lit(math.floor((math.log2(rules.window) - rules.limits[name]) * rules.window * _SCALE)).cast("long")
    limit = F.when(candidate.rlike(CLASSES["hex"]), most("hex")).when(candidate.rlike(CLASSES["one_case"]), most("one_case")).otherwise(most("any"))
    allowed = F.lit(False)
    for pattern, unless in rules.allow:
        allowed |= candidate.rlike(pattern) & ~candidate.rlike(unless) if unless else candidate.rlike(pattern)
    return F.when(allowed, False).otherwise(least_cost(F.split(candidate, ""), rules.window) <= limit)


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", rules: Rules = Rules()) -> DataFrame:
    """df and an array of (start, ord, end, kind), sorted: spans in code points, end exclusive; ord counts the kinds.

    Null text has none, as has an empty one. Spans of different kinds may overlap; repeated rows are judged alike. A
    column of df with the name of the new one is replaced. Texts without the letters that a base pattern needs are
    passed over by a plain search before it runs.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string,group:string>>)")
    low = F.lower(raw)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    run = f"(?<!{_CLASS}){_CLASS}{{{rules.window},}}"

    def of(kind: str, may: Column, pattern: str, group: int | None, holds) -> Column:
        found = F.when(may & raw.rlike(pattern), _places(raw, pattern, group)).otherwise(none)
        return F.transform(F.filter(found, holds), lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("ord"), x["end"], F.lit(kind).alias("kind")))

    every = F.concat(
        of("assign", named, ASSIGN, 2, lambda x: F.length(x["group"]) >= 8),
        of("access", raw.contains("AKIA"), ACCESS, None, lambda x: F.length(x["match"]) >= 16),
        of("hex", raw.rlike("[0-9a-f]{32}"), HEX.replace("+", "{32,}"), None, lambda x: F.length(x["match"]) >= 32),
        of("entropy", F.lit(True), run, None, lambda x: is_secret(x["match"], rules)),
    )
    return df.withColumn(out, F.array_sort(every))


def span_digests(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The digest columns of operator 8, one row per document."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules=rules)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), count("entropy"))


def _found_sql(kind: int, pattern: str, holds: str) -> str:
    """Rows (r, a, ord, b, m) of matches: what stands between them and they themselves give the places."""
    return f"""SELECT r, s AS a, {kind} AS ord, s + length(m) AS b, m FROM (
      SELECT r, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)) WHERE {holds}"""


_ASSIGN_SQL = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUN_SQL = "[A-Za-z0-9+/_=-]{20,}"
_RULES = Rules()
_ALLOW_SQL = " OR ".join("(regexp_matches(m, '" + (f"(?i:{a[4:]})" if a.startswith("(?i)") else a) + "')" + (f" AND NOT regexp_matches(m, '{u}'))" if u else ")") for a, u in _RULES.allow)
_MOST = {k: math.floor((math.log2(_RULES.window) - v) * _RULES.window * _SCALE) for k, v in _RULES.limits.items()}
#: DuckDB SQL for span_digests(documents).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found_sql(0, _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 8")}
  UNION ALL {_found_sql(1, "AKIA[A-Z0-9]+", "length(m) >= 16")} UNION ALL {_found_sql(2, "[0-9a-f]{32,}", "true")}),
runs AS ({_found_sql(3, _RUN_SQL, f"NOT ({_ALLOW_SQL})")}),
win AS (SELECT r, a, ord, b, m, unnest(range(1, length(m) - 18)) AS w FROM runs),
chars AS (SELECT r, a, ord, b, m, w, unnest(string_split(substr(m, w, 20), '')) AS c FROM win),
cost AS (SELECT r, a, ord, b, m, w, sum(round(n * log2(n) * {_SCALE})) AS k FROM (SELECT r, a, ord, b, m, w, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
high AS (SELECT r, a, ord, b, m FROM cost GROUP BY ALL HAVING min(k) <= CASE WHEN regexp_matches(m, '{CLASSES["hex"]}') THEN {_MOST["hex"]} WHEN regexp_matches(m, '{CLASSES["one_case"]}') THEN {_MOST["one_case"]} ELSE {_MOST["any"]} END),
every AS (SELECT r, a, ord, b, ['assign', 'access', 'hex', 'entropy'][ord + 1] || ':' || a || ':' || b AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM high))
SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, sha256(coalesce(string_agg(said, ',' ORDER BY a, ord, b) FILTER (ord < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY a, ord, b), '') AS spans, count(*) FILTER (ord = 3) AS n_entropy FROM d LEFT JOIN every USING (r) GROUP BY d.r, doc_id
"""

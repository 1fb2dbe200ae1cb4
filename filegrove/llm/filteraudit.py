"""Operator 11: how filters interact, by the multilinear extension of what they remove, in exact numbers."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import let, text_key

#: The four filters on a text alone; E, the fifth, is on equal texts.
LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a whole text (null: empty) fails A (under 100 words), B (under 80 different words in 100), C (over 10 capital
    letters A-Z in 100 characters), D (one of #$%&*|). Words are runs without blanks, tabs and line ends."""
    raw = F.coalesce(text, F.lit(""))
    counts = let(F.array_remove(F.split(raw, r"[\x20\x09-\x0D]+"), ""), lambda words: F.struct(F.size(words).alias("all"), F.size(F.array_distinct(words)).alias("different")))
    capitals = F.octet_length(raw) - F.octet_length(F.regexp_replace(raw, "[A-Z]+", ""))
    words = let(counts, lambda n: F.struct((n["all"] < 100).alias("few"), (n["different"] * F.lit(100).cast("long") < n["all"] * F.lit(80).cast("long")).alias("same")))
    return [words["few"], words["same"], capitals.cast("long") * 100 > F.length(raw).cast("long") * 10, raw.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail (bit i: the i-th letter).

    A null part or text is an empty one. A document fails E if a document with a smaller doc_id has the same text; one with a
    null doc_id neither fails it nor makes others fail. Rows with one doc_id and text fail or pass together. good and toxic
    count documents that any row of labels marks so. All copies of a text in one part are one row before texts meet, so no task
    sees a large group of copies.
    """
    fails = F.array(*text_failures(F.col(f"`{text}`").cast("string")))
    mask = let(fails, lambda f: sum((f[i].cast("int") * (1 << i) for i in range(4)), F.lit(0)))
    key = text_key(text)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(key, F.unhex(F.md5(F.lit("")))).alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = thin.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["key", "mask", "part", "good", "toxic"]
    rows = marked.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    least = groups.groupBy(F.col("key").alias("of")).agg(F.min("first.doc_id").alias("least"))
    met = groups.join(least, F.col("key") == F.col("of"))
    kept = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n"))))
    split = met.select("part", "good", "toxic", both.alias("x"))
    return split.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


class Removal:
    """How many documents a set of filters removes, as a polynomial in one variable for each filter: the sum over documents
    of 1 - prod(1 - x_i) over the filters i that the document fails. coefficients[s] belongs to the product of the variables
    in s (a bit mask): with alternating signs, the documents that fail all of s."""

    def __init__(self, counts: dict[int, int], filters: int) -> None:
        self.filters = filters
        self.coefficients = [0] * (1 << filters)
        for s in range(1, 1 << filters):
            failing = sum(n for mask, n in counts.items() if mask & s == s)
            self.coefficients[s] = failing if s.bit_count() % 2 else -failing

    def at(self, corner: int) -> int:
        """The value where the variables in corner are 1 and the others 0: what these filters remove together."""
        return sum(c for s, c in enumerate(self.coefficients) if s & corner == s)

    def share(self, i: int) -> Fraction:
        """The integral of the partial derivative for filter i along the diagonal from 0 to 1: its Shapley value. A product
        of k variables that has x_i leaves t^(k-1), whose integral is 1/k."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The rows of RESULT for mask_counts: each part, order of the filters and step. A part has 2^filters rows at most."""

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, good, toxic = (Removal({int(m): int(c) for m, c in zip(rows["mask"], rows[what], strict=True)}, len(letters)) for what in MEASURES)
        total, everything = int(rows["n"].sum()), (1 << len(letters)) - 1
        shapley = [n.share(i) * factorial(len(letters)) for i in range(len(letters))]
        removed, lost, harm = ([p.at(s) for s in range(everything + 1)] for p in (n, good, toxic))
        out = []
        for order in permutations(range(len(letters))):
            name, before = "".join(letters[i] for i in order), 0
            for step, i in enumerate(order, 1):
                now = before | 1 << i
                here = removed[now] - removed[before]
                alone = removed[everything] - removed[everything ^ 1 << i]
                out.append((key[0], name, step, total - removed[now], here, removed[1 << i] - here, alone, lost[now] - lost[before], harm[now] - harm[before], int(shapley[i])))
                before = now
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return counts.groupBy("part").applyInPandas(of_part, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of operator 11. No documents: no rows."""
    return audit(mask_counts(docs, labels))


#: DuckDB SQL for filter_audit(documents, labels): every order is applied to the masks of all documents.
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, i::INT AS step, o[i] AS filter FROM o, i),
r AS (SELECT part, filter_order, step, filter, d.*, list_filter(o[1:step], lambda x: f[x]) AS failed, f[filter] AS fails FROM s, d),
x AS (SELECT part, filter_order, step, any_value(filter) AS filter, sum(n) FILTER (len(failed) = 0) AS kept, sum(n) FILTER (fails AND len(failed) = 1) AS removed, sum(n) FILTER (fails AND len(failed) > 1) AS redundant,
        sum(n) FILTER (fails AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails, sum(good) FILTER (fails AND len(failed) = 1) AS good_lost, sum(toxic) FILTER (fails AND len(failed) = 1) AS toxic_lost FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM x
"""

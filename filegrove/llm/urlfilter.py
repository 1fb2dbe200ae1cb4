"""Operator 12: URL filters, by rules on host and path and, where no rule fits, gradient-boosted trees on lexical features."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import fresh, let
from filegrove.operators.tables import stored

BLOCK, ALLOW = "block", "allow"
#: Suffixes whose statistics are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SUFFIXES = 1_000_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_share", "other_share", "entropy", "parameters", "fragment", "suffix_share", "suffix_hosts")


@dataclass(frozen=True)
class Rule:
    """verdict for the URLs of a host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule(BLOCK, "net"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))


@dataclass(frozen=True)
class Settings:
    """rows: labelled URLs that teach at most, those with the least hashes. trees, depth, step: those of the boosting."""

    rows: int = 20_000
    trees: int = 20
    depth: int = 4
    step: float = 0.2


@dataclass
class Model:
    """trees, or the only verdict that the labels know; suffixes: (suffix, suffix_share, suffix_hosts) of all URLs."""

    suffixes: DataFrame
    trees: GBTClassificationModel | None
    only: str = ALLOW


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both are empty for null and where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. rules is a short list, which becomes one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(str(r)), len(r.host))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_statistics(hosts: DataFrame) -> DataFrame:
    """(suffix, suffix_share, suffix_hosts): which share of all URLs have this suffix, and the logarithm of how many hosts."""
    each = hosts.groupBy("host").agg(F.count("*").alias("n"))
    found = each.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
    total = found.agg(F.sum("n").alias("total"))  # one row
    return found.crossJoin(F.broadcast(total)).select("suffix", (F.col("n") / F.col("total")).alias("suffix_share"), F.log2(F.col("hosts") + 1.0).alias("suffix_hosts"))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    n = F.length(text)
    of = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    sums = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + of(c) * F.log2(F.greatest(of(c), F.lit(1)).cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - sums / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that need no statistics, as doubles; a null URL has those of an empty one."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    named = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        "digit_share": F.regexp_count(url, F.lit("[0-9]")) / n, "other_share": F.regexp_count(url, F.lit("[^A-Za-z0-9/.:]")) / n, "entropy": let(url, entropy),
        "parameters": F.regexp_count(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("[^&]+")), "fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return [column.cast("double").alias(name) for name, column in named.items()]


def _vectors(df: DataFrame, suffixes: DataFrame, out: str) -> DataFrame:
    """df (columns url, host, path and any others) and a vector of FEATURES."""
    sent = F.broadcast(suffixes) if suffixes.count() <= BROADCAST_SUFFIXES else suffixes
    told = df.withColumn("suffix", suffix(F.col("host"))).join(sent, "suffix", "left").select("*", *lexical(F.col("url"), F.col("host"), F.col("path")))
    return VectorAssembler(inputCols=list(FEATURES), outputCol=out).transform(told.fillna(0.0, ["suffix_share", "suffix_hosts"])).drop("suffix", *FEATURES)


def fit(urls: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from labelled (url, blocked: boolean), with suffix statistics of all urls (url).

    A URL that occurs several times teaches once, as blocked if any label says so. At most settings.rows of them, those with
    the least hashes, teach; null ones don't. If the labels know one verdict only, the model knows no other; without labels
    it allows.
    """
    host = parts(F.col("url").cast("string"))[0]
    suffixes = stored(suffix_statistics(urls.select(host.alias("host"))), "suffixes")
    once = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").groupBy(F.col("url").cast("string").alias("url")).agg(F.max(F.col("blocked").cast("double")).alias("label"))
    some = once.orderBy(F.xxhash64("url"), "url").limit(settings.rows)
    own_host, own_path = parts(F.col("url"))
    taught = stored(_vectors(some.select("url", "label", own_host.alias("host"), own_path.alias("path")), suffixes, "features").select("url", "label", "features"), "url-sample", settings.rows)
    known = sorted(r["label"] for r in taught.select("label").distinct().collect())
    if len(known) < 2:
        return Model(suffixes, None, BLOCK if known == [1.0] else ALLOW)
    learner = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=11, checkpointInterval=-1)
    return Model(suffixes, learner.fit(taught))


def judge(df: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, url: str = "url", out: str = "judged") -> DataFrame:
    """df and a struct (host, path, rule, verdict, score): the verdict of the longest rule that fits, else of the trees; score
    (0 to 1, higher: blocking likelier) is that of the trees for every URL. Null and empty URLs are judged like any other. A
    column of df with the name of out is replaced; no row is lost or merged."""
    df = df.drop(out)
    row, features, raw, probability, predicted, score = fresh(df, "row", "features", "raw", "probability", "predicted", "score")
    host, path = parts(F.col("url"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    if model.trees is None:
        scored = rows.withColumn(score, F.lit(1.0 if model.only == BLOCK else 0.0))
    else:
        trees = model.trees.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(probability).setPredictionCol(predicted)
        scored = trees.transform(_vectors(rows, model.suffixes, features)).withColumn(score, vector_to_array(F.col(probability))[1])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col(score) >= 0.5, BLOCK).otherwise(ALLOW)
    found = scored.withColumn("found", rule).select(row, F.struct("host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), F.col(score).alias("score")).alias(out))
    return found.select(f"{row}.*", out)


def judged_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """The columns of operator 12, one row per page. The rules' own verdicts are the labels that the trees learn from."""
    urls = pages.select(F.col("url").cast("string").alias("url"))
    labelled = urls.select("url", best_rule(*parts(F.col("url")), rules)["verdict"].alias("verdict")).where("verdict IS NOT NULL").select("url", (F.col("verdict") == BLOCK).alias("blocked"))
    found = judge(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), fit(urls, labelled, settings), rules)
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")

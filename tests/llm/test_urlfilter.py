import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filegrove.llm import urlfilter
from filegrove.llm.urlfilter import ALLOW, BLOCK, FEATURES, RULES, Rule, Settings, fit, judge, judged_pages

ODD = [
    None, "", "no scheme", "://", "a://B.NET", "http://NET/", "http://x.net?q=/en/", "http://fishnet/", "http://Example.Net/en/1", "http://a.example.net/enx", "http://a.b.example.net/en/",
    "http://example.com/de/x#y?z", "http://example.com/DE/", "http://badexample.com/de/", "x.org://y.org/fr/", "http://org/fr/://net/", "//net/", "http://é.net/ü?a=1&&b=2&c", "http://net\n/x\ny", "http:///en/",
    "http://u@x.net:80/", "http://x.net:80/", "http://x.org/fr", "http://x.org/fr/", "http://" + "a" * 100_000 + ".net/" + "b/" * 50_000 + "?" + "c=1&" * 1000,
]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def rule_of(url):
    host, path = host_and_path(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


def features(url, urls):
    host, path = host_and_path(url)
    hosts = [host_and_path(u)[0] for u in urls]
    ending = lambda h: ".".join(h.split(".")[-2:])
    url = url or ""
    n, counts = max(len(url), 1), Counter(url)
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    return [
        len(url), len(host), len(path), sum(a == "/" and b != "/" for a, b in zip(path, path[1:])), len(host.split(".")) if host else 0,
        sum("0" <= c <= "9" for c in url) / n, sum(not (c.isascii() and c.isalnum() or c in "/.:") for c in url) / n, -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(p != "" for p in query.split("&")), int("#" in url), sum(ending(h) == ending(host) for h in hosts) / len(hosts), math.log2(len({h for h in hosts if ending(h) == ending(host)}) + 1),
    ]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_hosts_paths_rules_and_verdicts_of_odd_urls(spark):
    got = {r["page_id"]: r for r in judged_pages(pages(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        rule = rule_of(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*host_and_path(url), rule and str(rule)), url
        assert got[i]["verdict"] == (rule.verdict if rule else BLOCK if got[i]["score"] >= 0.5 else ALLOW)


@pytest.mark.parametrize("few", [True, False])
def test_features_are_those_of_plain_loops(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(urlfilter, "BROADCAST_SUFFIXES", 0)
    df = pages(spark, ODD).select("page_id", "url", *[c.alias(n) for c, n in zip(urlfilter.parts(F.col("url")), ("host", "path"), strict=True)])
    got = {r["page_id"]: r["v"].toArray() for r in urlfilter._vectors(df, urlfilter.suffix_statistics(df.select("host")), "v").collect()}
    for i, url in enumerate(ODD):
        assert got[i] == pytest.approx(features(url, ODD), abs=1e-9), (url, FEATURES)


def urls(n, rng):
    """Half of them with many digits and parameters, which are to be blocked."""
    out = []
    for i in range(n):
        bad = i % 2
        host = "".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) + rng.choice([".example.org", ".example.com", ".test"])
        path = "/".join("".join(rng.choices("0123456789" if bad and rng.random() < 0.8 else "abcdefgh", k=rng.randint(3, 12))) for _ in range(rng.randint(1, 5)))
        out.append((f"http://{host}/{path}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.5 else ""), bool(bad)))
    return out


def test_held_out_accuracy_and_the_same_verdicts_again(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame(urls(1200, rng), "url string, blocked boolean")
    held_out = F.crc32(F.col("url").cast("binary")) % 4 == 0
    model = fit(rows.select("url"), rows.where(~held_out))
    told = judge(rows.where(held_out), model, rules=())
    assert told.where("judged.rule IS NOT NULL").isEmpty()
    right = told.select(F.avg(((F.col("judged.verdict") == BLOCK) == F.col("blocked")).cast("double"))).first()[0]
    assert right > 0.9
    again = judge(rows.where(held_out), fit(rows.select("url"), rows.where(~held_out).repartition(7)), rules=())
    assert sorted(told.collect()) == sorted(again.collect())


def test_trees_say_what_their_nodes_say(spark):
    """Scores against a plain walk through the trees."""
    rows = urls(300, random.Random(5))
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    model = fit(df.select("url"), df, Settings(trees=4, depth=3))

    def walk(node, x):
        while node.numDescendants():
            left = x[node.split().featureIndex()] <= node.split().threshold()
            node = node.leftChild() if left else node.rightChild()
        return node.prediction()

    weights, trees = model.trees.treeWeights, [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in model.trees.trees]
    everything = [u for u, _ in rows]
    for row in judge(df.limit(25), model, rules=()).collect():
        x = features(row["url"], everything)
        margin = sum(w * walk(t, x) for w, t in zip(weights, trees, strict=True))
        assert row["judged"]["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)


def test_labels_of_one_kind_none_and_bounds(spark):
    one = pages(spark, ["http://a.net/x", "http://b.net/y", "http://c.com/z"])
    assert [r["verdict"] for r in judged_pages(one).orderBy("page_id").collect()] == [BLOCK] * 3
    other = pages(spark, ["http://c.com/z", None])
    assert [r["verdict"] for r in judged_pages(other).orderBy("page_id").collect()] == [ALLOW] * 2
    assert judged_pages(one.limit(0)).count() == 0
    bounded = fit(one, one.select("url", F.lit(True).alias("blocked")), Settings(rows=1))
    assert bounded.trees is None and bounded.only == BLOCK


def test_rows_columns_and_clashing_names(spark):
    df = pages(spark, ["http://a.net/x", "http://a.net/x", "http://c.com/z", "http://d.org/fr/"]).union(pages(spark, [None]).select(F.lit(None).cast("long"), "url"))
    for name in ("row", "features", "probability", "score", "host", "suffix", "found", "length", "judged"):
        df = df.withColumn(name, F.lit(name))
    found = judge(df, fit(df.select("url"), df.select("url", F.col("url").contains("net").alias("blocked"))))
    assert found.columns == [c for c in df.columns if c != "judged"] + ["judged"] and found.count() == 5
    assert {(r["score"], r["host"]) for r in found.collect()} == {("score", "host")}


def test_the_longest_rule_wins(spark):
    rules = (Rule(BLOCK, "b.c", "/"), Rule(ALLOW, "c", "/xx/y"), Rule(BLOCK, "a.b.c", "/xx/"))
    df = pages(spark, ["http://a.b.c/xx/y", "http://b.c/xx/y", "http://b.c/x", "http://d.c/xx/yz"])
    got = df.select(urlfilter.best_rule(*urlfilter.parts(F.col("url")), rules)["rule"].alias("rule")).collect()
    assert [r["rule"] for r in got] == ["a.b.c/xx/", "c/xx/y", "b.c/", "c/xx/y"]

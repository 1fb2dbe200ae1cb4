import math
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from filegrove.llm.quality import AT_THRESHOLD, FEATURES, _pairs, features, fit, fit_pairs, score, score_matrix


def tables(spark, n=200):
    good = lambda i: f"A plain sentence number {i} about things that are well told, and then some more of it."
    bad = lambda i: f"BUY!! {i} NOW!! $$$ CLICK!! ### HERE!!"
    rows = [(i, bad(i) if i % 5 == 0 else good(i)) for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None), (n + 1, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(n)] + [(None, 1, 0), (n, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_features():
    assert all(len(features(t)) == len(FEATURES) and np.isfinite(features(t)).all() for t in (None, "", "a", "é" * 100_000, "\ud800", "A!! b\n\nc"))
    assert (features(None) == features("")).all()


def test_pairs_order_rows_and_the_quantile_parts_them(spark):
    docs, labels = tables(spark)
    model = fit(docs, labels)
    rows = {r["doc_id"]: r["quality_score"] for r in score(docs, model).collect()}
    assert all((rows[i] >= AT_THRESHOLD) == (i % 5 != 0) for i in range(200))
    assert abs(model.quantile - 0.2) < 0.01
    assert all(0 <= v <= 1 for v in rows.values())


def test_one_label_or_none(spark):
    docs, labels = tables(spark)
    for some, kept in ((labels.where("quality = 1"), True), (labels.where("quality = 0"), False), (labels.limit(0), True)):
        found = score(docs, fit(docs, some)).select((F.col("quality_score") >= AT_THRESHOLD).alias("p")).distinct().collect()
        assert [r["p"] for r in found] == [kept]
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_the_gradient_vanishes_at_the_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.logistic(size=500) > 0).astype(int)
    model = fit_pairs(x, y)
    assert np.corrcoef(model.weights, [1, -2, 0, 0.5])[0, 1] > 0.97
    s = score_matrix(model, x)
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.85


def test_held_out_accuracy(spark):
    from filegrove.llm.queries import op4_quality

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op4_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    good, bad = [[r["score"] for r in rows if r["quality"] == q] for q in (1, 0)]
    print("AUC", (np.array(good)[:, None] > np.array(bad)).mean(), "kept", np.mean([s >= 0.3 for s in good]), "dropped", np.mean([s < 0.3 for s in bad]))
    assert (np.array(good)[:, None] > np.array(bad)).mean() > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def plain_features(text):
    """The features with plain loops over characters, words and lines."""
    text = text or ""
    kinds = dict.fromkeys(FEATURES[:-8], 0)
    for c in text:
        if c in string.punctuation:
            kinds[f"mark_{c}"] += 1
        else:
            kinds["newline" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other_letter" if c.isalpha() else "other"] += 1
    out = [math.log(1 + 200 * n / max(len(text), 1)) for n in kinds.values()]
    words = text.split()
    plain = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    lines = [x for x in text.split("\n") if x]
    some = max(len(words), 1)
    out += [math.log(1 + len(words)), sum(map(len, words)) / some, len(set(plain)) / len(plain) if plain else 1, sum(len(w) <= 3 for w in words) / some, max(Counter(plain).values(), default=0) / max(len(plain), 1)]
    return [*out, math.log(1 + len(text) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), sum(w.isupper() for w in words) / some]


def test_scores_are_those_of_plain_loops(spark):
    """Features by plain loops; the fitted weights are where the ranking loss of all preference pairs has no slope, the
    threshold is the cut that errs least, and scores follow from both."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")
    model = fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: np.array(plain_features(t)) for i, t in texts.items()}
    rows = sorted({(r["quality"], tuple(x[r["doc_id"]]), r["doc_id"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in x})
    every, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert np.allclose(model.mean, every.mean(axis=0), atol=1e-9)
    z = np.clip((every - model.mean) / model.scale, -8, 8)
    order = np.lexsort((*every.T, y))
    d = _pairs(z[order][y[order] == 1], z[order][y[order] == 0], 40_000)
    slope = (d * (1 / (1 + np.exp(d @ model.weights)))[:, None]).mean(axis=0) - 0.01 * model.weights
    assert np.abs(slope).max() < 1e-6
    raw = z @ model.weights
    errors = lambda cut: sum((s >= cut) != (q == 1) for s, q in zip(raw, y, strict=True))
    assert errors(model.threshold) == min(map(errors, [*raw, raw.max() + 1]))
    found = {r["doc_id"]: r["quality_score"] for r in score(docs, model).collect()}
    for i, text in texts.items():
        s = sum(w * min(8, max(-8, (v - m) / c)) for w, v, m, c in zip(model.weights, plain_features(text), model.mean, model.scale, strict=True)) - model.threshold
        assert abs(found[i] - 1 / (1 + math.exp(-s) * (1 - AT_THRESHOLD) / AT_THRESHOLD)) < 1e-9


def test_repeated_rows_clashing_names_and_long_texts(spark):
    docs, labels = tables(spark)
    model = fit(docs, labels)
    many = docs.unionByName(docs).unionByName(docs.where("doc_id = 7").selectExpr("doc_id", "'ZZZ !! another text' AS text").limit(1))
    again = fit(docs.unionByName(docs), labels.unionByName(labels))
    assert np.allclose(again.weights, model.weights) and abs(again.threshold - model.threshold) < 1e-12  # copies teach nothing new
    assert fit(many, labels).weights.shape == model.weights.shape
    clash = docs.withColumn("quality_score", F.lit("x")).withColumn("quality", F.lit(1)).withColumn("my col", F.lit(2))
    out = score(clash, model)
    assert out.columns == ["doc_id", "text", "quality", "my col", "quality_score"] and out.count() == 203
    long = score(spark.createDataFrame([(1, "A plain sentence. " * 200_000)], "doc_id long, text string"), model).first()
    assert 0 <= long["quality_score"] <= 1

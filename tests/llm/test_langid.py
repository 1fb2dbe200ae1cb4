import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from filegrove.llm.langid import count_vectors, fit, identify, predict_texts

EN, FR = "the quick brown fox and the lazy dog of this land ", "le renard brun et le chien paresseux de cette maison "


def labelled(spark):
    rows = [(i, (EN if i % 2 else FR) * (1 + i % 3) + str(i), "en" if i % 2 else "fr") for i in range(60)]
    return spark.createDataFrame([*rows, (90, None, "en"), (91, "x", None), (92, "", "de"), (93, "123", "de")], "doc_id long, text string, lang string")


def test_counts_are_those_of_a_plain_loop():
    texts = ["Ab c!!d", "", None, "12", "é", "a" * 5000]
    rows = count_vectors(texts)
    for text, row in zip(texts, rows, strict=True):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(words)} " if words else ""
        assert row.sum() == sum(max(0, len(padded) - n + 1) for n in (2, 3))
    assert (count_vectors(["ab"])[0] == count_vectors(["zz", "AB", "q"])[1]).all()


def test_learns_and_rejects(spark):
    model = fit(labelled(spark), per_language=20, centroids=2)
    assert sorted(set(model.languages)) == ["en", "fr"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    found = predict_texts(model, ["the fox of the land", "le chien de la maison", None, "", "12 !?", "жщю"])
    assert [x[0] for x in found[:5]] == ["en", "fr", "und", "und", "und"]
    assert not found[0][2] and found[5][2] and found[5][0] in ("en", "fr")  # far from all: rejected, the nearest is still told
    assert all(0 <= x[1] <= 1 for x in found)


def test_no_rows_and_clashing_columns(spark):
    empty = fit(labelled(spark).limit(0))
    assert predict_texts(empty, ["abc"]) == [("und", 0.0, True)]
    model = fit(labelled(spark))
    clash = labelled(spark).withColumn("lang_score", F.lit("x")).withColumn("my col", F.lit(1))
    out = identify(clash, model)
    assert out.columns.count("lang_score") == 1 and out.count() == 64
    assert identify(clash.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from filegrove.llm.queries import op5_language_id

    rows = op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def plain_grams(text):
    """Hashed letter pairs and triples of a text, one by one."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = f" {' '.join(words)} " if words else ""
    out = Counter()
    for n in (2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) % (1 << 64)
            out[h * 0xBF58476D1CE4E5B9 % (1 << 64) >> 51] += 1
    return out


def test_predictions_are_those_of_plain_loops(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    model = fit(docs)
    rows = [(r["doc_id"], plain_grams(r["text"]), r["lang"], r["text"]) for r in docs.collect()]
    taught = [(g, lang) for _, g, lang, text in rows if text is not None and lang is not None]
    seen = Counter(x for g, _ in taught for x in g)
    idf = {x: math.log((1 + len(taught)) / (1 + n)) + 1 for x, n in seen.items()}
    assert all(abs(model.idf[x] - v) < 1e-5 for x, v in idf.items())
    default = math.log(1 + len(taught)) + 1

    def vector(grams):
        raw = {x: math.log(1 + n) * idf.get(x, default) for x, n in grams.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {x: v / size for x, v in raw.items()} if size else {}

    vectors = [(lang, vector(g)) for g, lang in {(frozenset(g.items()), lang): (g, lang) for g, lang in taught}.values() if g]
    for i, lang in enumerate(model.languages):  # each centroid is the direction of the mean of the texts nearest to it
        own = [j for j, other in enumerate(model.languages) if other == lang]
        mine = np.zeros(model.centroids.shape[1])
        for _, v in (x for x in vectors if x[0] == lang):
            near = [sum(model.centroids[j][x] * w for x, w in v.items()) for j in own]
            if own[int(np.argmax(near))] == i:
                for x, w in v.items():
                    mine[x] += w
        assert mine @ model.centroids[i] > 0.95 * np.linalg.norm(mine)
    found = {r["doc_id"]: r for r in identify(docs.drop("lang"), model).collect()}
    for i, grams, _, _ in rows:
        v = vector(grams)
        near = [sum(float(c[x]) * w for x, w in v.items()) for c in model.centroids]
        best = max(near, default=0) if v else 0
        if v:
            assert abs(found[i]["lang_score"] - best) < 1e-4 and near[model.languages.index(found[i]["lang_nearest"])] <= best + 1e-9
            assert max(n for n, lang in zip(near, model.languages, strict=True) if lang == found[i]["lang_nearest"]) > best - 1e-4
        else:
            assert (found[i]["lang_nearest"], found[i]["lang_score"]) == ("und", 0.0)


def test_repeated_rows_and_a_long_text(spark):
    model = fit(labelled(spark), per_language=20, centroids=2)
    hot = labelled(spark).unionByName(spark.range(3000).select("id", F.lit(EN).alias("text"), F.lit("en").alias("lang")).toDF("doc_id", "text", "lang"))
    again = fit(hot, per_language=20, centroids=2)
    assert sorted(set(again.languages)) == ["en", "fr"]
    assert [x[0] for x in predict_texts(again, ["the fox of the land", "le chien de la maison"])] == ["en", "fr"]
    assert identify(hot.where("doc_id < 5"), model).count() == hot.where("doc_id < 5").count()
    assert predict_texts(model, [EN * 40_000])[0][0] == "en"


def test_languages_of_few_texts_that_repeat_are_learned(spark):
    """The sample is of different texts, so how often they occur doesn't matter."""
    own = {"aa": "zul mor kip tan", "bb": "wex hob dri fas", "cc": "yug nep cil ovo", "dd": "stra blim quor gned"}
    rows = [(f"{words} {words.split()[i % 4]} {'x' * i}", lang) for lang, words in own.items() for i in range(6 if lang != "dd" else 900)]
    many = [row for row in rows for _ in range(2000 if row[1] in ("aa", "bb") else 1)]
    docs = spark.createDataFrame(many, "text string, lang string")
    model = fit(docs, per_language=40, centroids=2)
    assert sorted(set(model.languages)) == sorted(own)
    assert [x[0] for x in predict_texts(model, list(own.values()))] == list(own)

from itertools import permutations

from pyspark.sql import functions as F

from filegrove.llm.filteraudit import Removal, filter_audit, mask_counts

LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if w]


def brute(rows, labels):
    """Every order on every document, with plain loops; rows are (doc_id, text, lang)."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    fails = []
    for i, t, _ in rows:
        w = words(t)
        same = any(u == t and j is not None and i is not None and j < i for j, u, _ in rows)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": same})
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, _, p in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                here = {k for k in left if fails[k][f]}
                gone = {k for k in own if fails[k][f]} - left
                left -= here
                total[f] += len(here)
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own)
                out[part, "".join(order), step] = [len(left), len(here), len(gone), alone, sum(rows[k][0] in good for k in here), sum(rows[k][0] in toxic for k in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def cases():
    many = " ".join(f"word{i}" for i in range(150))
    texts = [None, "", " \t\n", "short", "short", many, many, many, many + " #", ("same words " * 80), ("same words " * 80), "A" * 50 + " " + many, "ABC " * 200, "ABC$ " * 120, "\x1cx " * 100, "y\x0bz\x0cq\r" * 60, "é" * 20 + " Ü" * 200, "short", "X&Y"]
    parts = ["en", "en", None, "", "de", "de", "en", "en", "fr", "fr", "en", "en", "de", "de", "en", None, "fr", "fr", "it"]
    rows = [(i * 3 % 19, t, p) for i, (t, p) in enumerate(zip(texts, parts, strict=True))]
    return rows + [(None, "short", "en"), (None, many, "de"), rows[6], rows[6]]


def test_every_row_is_that_of_brute_force(spark):
    labels = [(0, 1, 0), (3, 0, 1), (6, 1, 1), (6, 0, 0), (9, None, 1), (12, 1, None), (99, 1, 1), (None, 1, 1), *[(i, i % 2, i % 3 == 0) for i in range(13, 19)]]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame(cases(), "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("key", F.lit(1)).withColumn("good", F.lit(1)).withColumn("n", F.lit(2))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute(cases(), labels)


def test_no_documents_and_no_labels(spark):
    docs, none = spark.createDataFrame(cases(), "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert filter_audit(docs.limit(0), none).count() == 0
    assert filter_audit(docs, none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert mask_counts(docs, none).agg(F.sum("n")).first()[0] == len(cases())


def test_a_very_long_text(spark):
    long = "word " * 500_000 + "#"
    got = mask_counts(spark.createDataFrame([(1, long, "en"), (2, long, "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS))
    assert sorted((r["mask"], r["n"]) for r in got.collect()) == [(0b01010, 1), (0b11010, 1)]


def test_polynomial():
    counts = {0: 7, 0b01: 2, 0b10: 1, 0b11: 3}
    removal = Removal(counts, 2)
    assert [removal.at(s) for s in range(4)] == [0, 5, 4, 6]
    assert (removal.share(0) * 2, removal.share(1) * 2) == (7, 5)  # 5 + 2 and 1 + 4 over the two orders

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from filegrove.llm.decontaminate import ORACLE, Index, contamination_digests, find_contamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(13, len(v))
        for q in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[q : q + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(item_id) if item_id is not None else "")
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(2)
    some = lambda n, of=400: " ".join(f"w{rng.randrange(of)}é" for _ in range(n))
    items = [(i, some(rng.choice([13, 14, 20, 40]))) for i in range(12)] + [(100, "Two words"), (101, "single1"), (102, ""), (103, None), (104, "!!"), (7, some(30)), (None, some(16)), (110, some(3, 4)), (111, "a a a a a a a a a a a a a a a a a")]
    items.append((112, items[0][1]))
    texts = [None, "", "...", "two, WORDS", "x single1 y single1", "a " * 12, "a " * 13, "a " * 40]
    for _ in range(60):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 1))
            parts += [" ".join(v[a : a + rng.choice([11, 12, 13, 14, 40])]).upper().replace("É", "é"), some(rng.randint(0, 20))]
        texts.append(", ".join(parts))
    return items, texts


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_both_paths_are_brute_force(spark, docs, broadcast_bytes):
    items, texts = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in contamination_digests(docs(*texts), benchmark, broadcast_bytes=broadcast_bytes).collect():
        assert tuple(r)[1:] == brute(texts[r["doc_id"]], items), texts[r["doc_id"]]


def test_sql_is_brute_force():
    items, texts = cases()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    for r in db.execute(ORACLE).fetchall():
        assert r[1:] == brute(texts[r[0]], items)


def test_long_text_over_chunks(spark, docs):
    item = " ".join(f"k{i}" for i in range(50))
    text = "filler word " * 300_000 + item + " end" * 300_000
    r = find_contamination(docs(text), spark.createDataFrame([(1, item)], "item_id long, text string")).first()["contamination"]
    assert (r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["contaminated"]) == (900_050, 50, [(600_000, 600_050)], False)


def test_empty_tables_clashing_columns_and_repeats(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination_digests(docs(), none).count() == 0
    clash = docs("a b", "a b").withColumn("contamination", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("text_key", F.lit(2))
    for size in (8 << 20, -1):
        rows = find_contamination(clash, none, broadcast_bytes=size).collect()
        assert [r["contamination"]["n_words"] for r in rows] == [2, 2] and rows[0]["text_key"] == 2


def test_repeated_words_are_brute_force_and_quick():
    rng = random.Random(5)
    for turn in range(150):
        unit = lambda: [rng.choice("abcd") for _ in range(rng.randint(1, 20))]
        piece = lambda u: " ".join((u * 60)[rng.randint(0, 5) :][: rng.randint(1, 60 if len(u) < 4 else 20 * len(u))])
        u, v = unit(), unit()
        items = [(i, " ".join(rng.choice([piece(u), piece(v), " ".join(unit())]) for _ in range(rng.randint(1, 4)))) for i in range(2)]
        text = " x ".join(rng.choice([piece(u), piece(v), " ".join(unit())]) for _ in range(rng.randint(1, 4)))
        index = Index([(str(i), t.encode()) for i, t in items])
        ((n, spans, ids),) = index.scan([text.encode()])
        want = brute(text, items)
        assert (n, sum(b - a for a, b in spans), len(ids)) == want[:3], (turn, items, text)
    index = Index([("a", b"w " * 2000), ("b", b"u v " * 5000)])
    began = time.perf_counter()
    found = index.scan([b"w " * 20_000, b"v u " * 20_000, b"w u " * 20_000])
    assert [(n, spans, ids) for n, spans, ids in found] == [(20_000, [(0, 20_000)], ["a"]), (40_000, [(0, 40_000)], ["b"]), (40_000, [], [])]
    assert time.perf_counter() - began < 5

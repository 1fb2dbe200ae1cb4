import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filegrove.llm import neardup
from filegrove.llm.neardup import Plan, classes, fine_sketch, keep_first, prob_min_hash
from filegrove.operators.graph import connected as components

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def shingle_set(text):
    w = WORDS.findall((text or "").lower().encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """The class of each place of rows (id, text): links of 0.8 or more, joined."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for members in by.values():
        for j in members[1:]:
            for i in members:
                if i < j and root(i) != root(j):
                    n = len(sets[i] & sets[j])
                    if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                        parent[root(j)] = root(i)
    return [root(i) if sets[i] else -1 - i for i in range(len(rows))]


def corpus():
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("mnopqr") + rng.choice("stuvwxyz") + rng.choice("aeiou")
    some = lambda n: [word() for _ in range(n)]
    texts = [None, "", "!!", "hello", "Hello!", "one two three four", "one two three four five", None, ""]
    for _ in range(25):
        base = some(rng.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ".join(copy), ", ".join(copy).upper()]))
    passage = some(60)
    texts += [" ".join(some(40) + passage + some(40)) for _ in range(40)]
    chain = some(120)
    for i in range(10):  # each step is near the next, the ends are apart
        chain = chain[4:] + some(4)
        texts.append(" ".join(chain))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_classes_are_those_of_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = corpus()
    want = brute(rows)
    found = classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(set)
    for i, label in enumerate(want):
        groups[label].add(i)
    assert len(found) == len(rows)
    for r in found:
        group = groups[want[r["doc_id"]]]
        assert (r["class_id"], r["class_size"], r["first"]) == (min(group), len(group), r["doc_id"] == min(group)), (r["doc_id"], group)


def test_leftover_pairs_are_found_without_rounds(spark):
    rows = corpus()
    want = brute(rows)
    for plan in (Plan(rounds=0), Plan(rounds=1)):
        found = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string"), plan=plan).collect()}
        assert all((found[i] == found[j]) == (want[i] == want[j]) for i in range(len(rows)) for j in range(i))


def test_one_row_of_each_class_stays(spark):
    rows = [*corpus(), (3, "hello"), (3, "hello"), (None, "hello"), (None, "nobody else has this"), (500, "repeated row"), (500, "repeated row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_key", F.lit("x")).withColumn("node", F.lit(1)).withColumn("best_id", F.lit(2))
    kept = keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute(rows)
    assert len(ids) == len(set(want))
    assert ids.count(3) == 1 and ids.count(500) == 1 and ids.count(None) == 1
    assert keep_first(df.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    element, n = rng.integers(0, 1 << 63, 400, dtype=np.uint64), 4000
    a, b = rng.random(400) + 0.5, rng.random(400) + 0.5
    a[300:], b[:100] = 0, 0
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(400) if a[i] and b[i])
    owner = np.repeat([0, 1], 400)
    both = np.concatenate((a, b))
    real = both > 0
    signature = prob_min_hash(owner[real], np.concatenate((element, element))[real], both[real], 3, n)
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * (want * (1 - want) / n) ** 0.5
    assert not signature[2].any()


def test_sketches_of_small_sets_leave_similar_pairs():
    rng = np.random.default_rng(11)
    for shared, a, b in ((4, 4, 5), (5, 5, 6), (8, 8, 10), (8, 9, 9), (12, 13, 14), (20, 20, 25)):
        sets = []
        for _ in range(100):
            every = rng.integers(0, 1 << 63, a + b - shared, dtype=np.uint64)
            sets += [every[:a], np.concatenate((every[:shared], every[a:]))]
        owner = np.repeat(np.arange(200), [len(x) for x in sets])
        bits = fine_sketch(owner, np.concatenate(sets), 200, Plan().fine).view(np.uint64)
        unlike = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1)
        assert unlike.max() <= Plan().unlike_bits, (shared, a, b, unlike.max())


def test_short_texts_are_those_of_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(5, 30))]
        rows += [" ".join(words), " ".join(words + [f"v{i}" for _ in range(rng.randint(1, 2))]), " ".join([f"u{i}", *words])]
    rows = list(enumerate(rows))
    want = brute(rows)
    close = [(i, j) for i in range(0, len(rows), 3) for j in (i + 1, i + 2) if 0.8 <= len(shingle_set(rows[i][1]) & shingle_set(rows[j][1])) / len(shingle_set(rows[i][1]) | shingle_set(rows[j][1])) <= 0.85]
    assert len(close) > 50
    found = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {label: i for i, label in reversed(list(enumerate(want)))}
    assert found == {i: least[label] for i, label in enumerate(want)}


def test_repeated_passages_do_not_hide_links(spark):
    rng = random.Random(17)
    rows = []
    for _ in range(150):  # the halves and the ends that differ are repeated in one text each
        x, y, p, q = ([f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (50, 50, 9, 9))
        rows += [" ".join(x * 30 + x[:4] + y + y[:4] + p * 30), " ".join(x + x[:4] + y * 30 + y[:4] + q * 30)]
    rows = list(enumerate(rows))
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) <= 0.85
    found = classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in found)


def test_equal_texts_without_words_are_one_class(spark):
    rows = [(1, "!!"), (2, "!!"), (3, "! !"), (4, " "), (5, " "), (6, ""), (7, ""), (8, None), (9, None), (10, "hello"), (None, "!!"), (11, "\u00e9"), (12, "K"), (13, "k"), (14, "--"), (14, "--")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["class_id"], r["class_size"], r["first"]) for r in classes(df).collect()]
    want = {1: (1, 3), 2: (1, 3), None: (1, 3), 3: (3, 1), 4: (4, 2), 5: (4, 2), 12: (12, 2), 13: (12, 2), 14: (14, 2)}
    assert sorted(found, key=str) == sorted(((i, *want.get(i, (i, 1)), i == want.get(i, (i, 1))[0]) for i, _ in rows), key=str)
    assert sorted(r["doc_id"] for r in keep_first(df).collect()) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1050)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def multisets(text):
    w = WORDS.findall((text or "").lower().encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_counted_shingles_link_multisets(spark):
    rng = random.Random(23)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(120):  # the same shingles, said more or less often
        x, y = some(40), some(10)
        rows += [" ".join(x + y * rng.randint(1, 6)), " ".join(x + y * rng.randint(1, 6))]
    rows = list(enumerate(rows))
    want = []
    for i in range(0, len(rows), 2):
        a, b = multisets(rows[i][1]), multisets(rows[i + 1][1])
        want.append(5 * sum((a & b).values()) >= 4 * sum((a | b).values()))
    assert 20 < sum(want) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in classes(df, plan=Plan(counted=True)).collect()}
    assert [found[i] == found[i + 1] for i in range(0, len(rows), 2)] == want
    plain = {r["doc_id"]: r["class_id"] for r in classes(df).collect()}
    assert sum(plain[i] == plain[i + 1] for i in range(0, len(rows), 2)) > sum(want)


def test_the_sieve_of_sketches_loses_next_to_nothing():
    """Registers are independent, so unlike bits of a pair are a binomial of half its distance."""
    plan = Plan()
    p = 0.5 * (1 - plan.similar[0] / plan.similar[1])
    tail = sum(math.exp(math.lgamma(plan.fine + 1) - math.lgamma(k + 1) - math.lgamma(plan.fine - k + 1) + k * math.log(p) + (plan.fine - k) * math.log(1 - p)) for k in range(plan.unlike_bits + 1, plan.fine + 1))
    assert tail < 1.2e-6
    assert (1 - (plan.similar[0] / plan.similar[1]) ** plan.rows) ** plan.bands < 4e-6


def test_a_large_group_and_a_long_text(spark):
    """A group of near copies whose links need no common middle, texts just under the threshold beside it, and a long text."""
    rng = random.Random(29)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base = some(150)
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 8])):
            copy[at] = f"x{i}y{at}"
        rows.append(" ".join(copy))
    long = some(30_000)
    rows += [" ".join(long), " ".join(["other", *long[: len(long) - 5]]), " ".join(some(30_000))]
    rows = list(enumerate(rows))
    want = brute(rows)
    found = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {label: i for i, label in reversed(list(enumerate(want)))}
    assert found == {i: least[label] for i, label in enumerate(want)}

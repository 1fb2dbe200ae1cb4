import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filegrove.llm import linededup
from filegrove.llm.linededup import Tree, drop_recurring_lines


def mask(line):
    tokens = re.split(r"[ \t\n\x0b\f\r]+", line)
    return [t if not re.search("[0-9]", t) else "<*>" for t in tokens if t]


def brute(texts, tree=Tree()):
    """What the method says, with plain loops over all lines of a leaf."""
    key = {t: hashlib.md5(t.encode()).hexdigest() for t in texts if t is not None}
    lines = [(t, i, len(line), tuple(mask(line))) for t in key for i, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    texts_of, whole = defaultdict(set), defaultdict(int)
    for t, _, n, m in lines:
        texts_of[m].add(t)
        whole[t] += n
    agree = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= math.ceil(len(a) * tree.constant_share)
    rank = lambda m: (len(texts_of[m]) >= tree.min_docs, hashlib.md5(" ".join(m).encode()).hexdigest()[:15])
    leaves = defaultdict(list)
    for m in texts_of:
        if len(m) >= tree.min_tokens:
            leaves[len(m), m[: tree.depth]].append(m)
    family = {m: {m} for m in texts_of}  # the families of a line
    for members in leaves.values():
        if sum(len(texts_of[m]) for m in members) < tree.min_docs:
            continue
        leads = []
        for m in sorted(members, key=rank, reverse=True):
            if not any(agree(m, lead) for lead in leads):
                leads.append(m)
        for m in members:
            family[m] |= {lead for lead in leads if agree(m, lead)}
    where = defaultdict(set)
    for m, names in family.items():
        for name in names:
            where[name] |= texts_of[m]
    where = {name: ts for name, ts in where.items() if len(ts) >= tree.min_docs}
    leader = {name: min(ts, key=key.get) for name, ts in where.items()}
    shared, own = defaultdict(int), defaultdict(int)
    for t, i, n, m in lines:
        for lead in {leader[name] for name in family[m] if name in leader}:
            shared[t, lead] += n
        for name in family[m]:
            own[t, name] += n
    most, covered = defaultdict(int), defaultdict(int)
    for (t, name), n in own.items():
        if name in leader:
            most[t, leader[name]] = max(most[t, leader[name]], n)
    for t, _, n, m in lines:
        covered[t] += n if family[m] & leader.keys() else 0
    copy_of = {t: t for t in key}

    def root(t):
        while copy_of[t] is not t:
            t = copy_of[t]
        return t

    def shingles(t):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    met = defaultdict(list)
    for (t, lead), n in shared.items():
        m = most[t, lead]
        if t is not lead and whole[t] > m and n > m:
            met[t].append((n - m, key[lead], lead, m))
    for t, found in met.items():
        links = [lead for n, _, lead, m in found if n >= (whole[t] - m) * tree.link_share and covered[t] - m >= (whole[t] - m) * tree.copy_share]
        if not links:
            _, _, lead, m = max(found, key=lambda x: x[:2])
            own_, other = shingles(t), shingles(lead)
            if own_ and len(own_ & other) * whole[t] - len(own_) * m >= len(own_) * (whole[t] - m) * tree.word_share:
                links = [lead]
        for lead in links:
            copy_of[root(t)] = root(lead)

    def unit(t, name):
        return "" if own[t, name] == whole[t] else root(t)

    recurs = {name for name, ts in where.items() if len({unit(t, name) for t in ts}) >= tree.min_docs}
    gone = {m for m, names in family.items() if names & recurs}
    out = []
    for t in texts:
        lost = [(x, tuple(mask(x))) for x in t.split("\n")] if t is not None else []
        less = sum(m in gone for _, m in lost)
        out.append(("\n".join(x for x, m in lost if m not in gone) if less else t, less))
    return out


def cases():
    rng = random.Random(3)
    some = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('xyz')}{rng.choice('stuv')}" for _ in range(n))
    texts = [None, "", "\n\n", "x", "one line", "one line", "one line"]
    for i in range(60):
        lines = [some(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), "All rights reserved.")
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Page {i}  of 90 on 2024-01-{i}")
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Posted by {some(1)} in the news section of today")
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), "")
        if i % 7 == 0:
            lines = ["All rights reserved."] * 9 + lines[:1]
        if i % 9 == 0:
            lines.append(f"Written by {'ABCDEFGHIJ'[i // 9]} Lee")
        texts.append("\n".join(lines))
    texts += [texts[10]] * 5 + [texts[12] + "\nmore of it here"] + [some(20) + "\n" + "only two\ndocs"] * 2
    return texts


@pytest.mark.parametrize("broadcast", [True, False])
def test_texts_are_those_of_brute_force(spark, docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
        monkeypatch.setattr(linededup, "BROADCAST_NUMBERS", 0)
    texts = cases()
    want = brute(texts)
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in drop_recurring_lines(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    for boilerplate in ("Posted by", "Written by", "All rights", "Page"):
        assert sum(boilerplate in (t or "") for t in texts) >= 6 and not any(boilerplate in (w[0] or "") for w in want)


def test_rare_values_of_a_frequent_template_go(spark, docs):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + (i * 7 + j) % 26)}x{chr(97 + j)}" for j in range(12))
    names = ["Anna"] * 40 + ["Bob", "Carl"]
    texts = [f"{own(i)}\nPosted by {n} in the news section of today\nmore {own(i + 50)}" for i, n in enumerate(names)]
    out = [r["text"] for r in drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    assert out == [w for w, _ in brute(texts)] and not any("Posted" in t for t in out)


def test_copies_keep_what_only_they_share(spark, docs):
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    base = [some(rng.randint(8, 20)) for _ in range(10)]
    copies = ["\n".join([*base[:i], some(9), *base[i + 1 :], "Stock line of a house"]) for i in range(10)]
    one = some(60).split()
    single = [" ".join([*one[:i], "other", *one[i + 1 :]]) for i in range(5, 25)]  # whole texts that agree in all tokens but two
    short = [f"Stock line of a house\n{some(3)}" for _ in range(5)]
    others = [f"{some(30)}\nStock line of a house" for _ in range(3)]
    texts = [*copies, *single, *short, *others]
    out = [r["text"] for r in drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    assert out == [w for w, _ in brute(texts)]
    assert out[: len(copies)] == [t.removesuffix("\nStock line of a house") for t in copies]
    assert out[len(copies) : len(copies) + len(single)] == single and not any("Stock" in t for t in out)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


@pytest.mark.parametrize("own", [1, 5, 17, 40])
def test_a_stock_line_goes_however_much_of_a_text_it_is(spark, docs, own):
    rng = random.Random(own)
    stock = "All rights reserved by the publisher and its many licensors worldwide today"
    texts = [f"{words(rng, own)}\n{stock}" if i % 2 else f"{stock}\n{words(rng, own)}" for i in range(60)]
    out = [(r["text"], r["dropped_lines"]) for r in drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    assert out == brute(texts) and [n for _, n in out] == [1] * 60


def test_lines_go_whatever_else_leads(spark, docs):
    """Templates of one leaf that share words in all places don't hide each other's lines."""
    rng = random.Random(12)
    some = [f"{words(rng, 9)}\nPosted by {words(rng, 1)} in the news section of today" for _ in range(50)]
    some += [f"{words(rng, 9)}\nPosted by editors at the news desk every morning" for _ in range(5)]
    some += [f"{words(rng, 9)}\nPosted by staff from our own section of today" for _ in range(5)]
    some += [f"{words(rng, 9)}\nPosted by {a} {b} {c} {d} {e} {f} today" for a, b, c, d, e, f in zip(*[rng.choices(["in", "at", "the", "news", "own", "desk", "of"], k=80) for _ in range(6)], strict=True)]
    rng.shuffle(some)
    out = [(r["text"], r["dropped_lines"]) for r in drop_recurring_lines(docs(*some)).orderBy("doc_id").collect()]
    assert out == brute(some)
    assert all(n == 1 for t, (_, n) in zip(some, out, strict=True) if "in the news section" in t or "desk every morning" in t or "from our own" in t)


def test_rows_columns_and_empty_tables(spark, docs):
    assert drop_recurring_lines(docs()).count() == 0
    clash = docs(*cases()).withColumn("key", F.lit(1)).withColumn("line_key", F.lit(2)).withColumn("template", F.lit(1)).withColumn("family", F.lit(1)).withColumn("dropped_lines", F.lit("x")).withColumn("gone", F.lit(3))
    out = drop_recurring_lines(clash)
    assert out.columns == [*[c for c in clash.columns if c != "dropped_lines"], "dropped_lines"]
    assert {(r["doc_id"], r["line_key"]) for r in out.collect()} == {(i, 2) for i in range(len(cases()))}


def test_a_long_text(spark, docs):
    long = "\n".join(f"line number {i} {'x' * (i % 7)}" if i % 2 else f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'ABCDEFGHIJ'[i // 100 % 10]}{'KLMNOPQRST'[i // 1000 % 10]} text" for i in range(20_000))
    texts = [long, long + "\nq", "line number 5 x\nanother thing that is longer"]
    assert [tuple(r) for r in drop_recurring_lines(docs(*texts)).orderBy("doc_id").select("text", "dropped_lines").collect()] == brute(texts)


def test_small_tables_are_not_counted(spark, docs):
    """A join with few rows at most needs no query that counts them: the driver keeps each query for a while."""
    rng, tracker = random.Random(13), spark.sparkContext.statusTracker()
    texts = [f"{words(rng, 9)}\nPosted by {words(rng, 1)} in the news section of today" for _ in range(9)]
    spark.sparkContext.setJobGroup("few-queries", "")
    try:
        out = [(r["text"], r["dropped_lines"]) for r in drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(tracker.getJobIdsForGroup("few-queries"))
    assert out == brute(texts) and jobs < 130, jobs

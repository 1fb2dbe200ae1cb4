"""Operator 1: near-duplicate texts by ProbMinHash signatures, banding, exact verification and connected components."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import fresh, gram_hashes, map_arrow, mix, text_key, word_hashes
from filegrove.operators.graph import connected
from filegrove.operators.tables import Scratch, stored


@dataclass(frozen=True)
class Plan:
    """Shingles of so many words; the least Jaccard similarity of the shingle sets as a fraction; bands of rows registers.

    counted: shingles weigh as often as they occur, in signatures and in links, which then are of multisets (the sum of the
    lesser counts over that of the greater ones; probability Jaccard is never below it). Else all weigh the same.

    32 bands of 5 miss a pair of similarity 0.8 with probability (1 - 0.8^5)^32 = 3e-6. Candidates have a sketch of fine
    bits, which differ independently of each other: a pair of 0.8 has over unlike_bits unlike ones (205 on average, 13.6 the
    standard deviation) with probability 0.9e-6. Candidates go through so many sieves (see _linkable; what one drops makes
    the next finer). In rounds many rounds each bucket's members meet one of them, from the second round on one that isn't of
    the bucket's largest class; what is still apart then meets all members of the bucket that belong to other classes.
    """

    words: int = 5
    similar: tuple[int, int] = (4, 5)
    bands: int = 32
    rows: int = 5
    fine: int = 2048
    unlike_bits: int = 272
    sieves: int = 2
    rounds: int = 2
    counted: bool = False

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased texts: the text's place, the hash and how often it occurs; sorted by text and hash.

    A text of 1 to k - 1 words has one shingle, all its words; one without words has none.
    """
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(words) >= k:
        inside = doc[: len(words) - k + 1] == doc[k - 1 :]
        found, owner = gram_hashes(words, k)[inside], doc[: len(words) - k + 1][inside]
    else:
        found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    short = [(i, gram_hashes(words[ends[i] - n : ends[i]], n)[0]) for i, n in enumerate(counts.tolist()) if 0 < n < k]
    if short:
        owner = np.concatenate((owner, np.array([i for i, _ in short])))
        found = np.concatenate((found, np.array([h for _, h in short], np.uint64)))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])))) if len(found) else np.zeros(0, np.int64)
    return owner[first], found[first], np.diff(np.append(first, len(found)))


def occurrences(owner: np.ndarray, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counted shingles as a set of single ones, the n-th occurrence of each: sets that share as much as the multisets do."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(owner, count), mix(np.repeat(found, count) + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets, as n x registers element hashes (0 for an empty set).

    Each element's arrivals are a Poisson process with its weight as the rate, drawn from its hash alone, each at a random
    register; a register keeps the element that arrives first. Two sets agree in a register with the probability Jaccard
    similarity of their weights. An element stops at the set's horizon: by then every register has its first arrival but
    for a chance of e^-4; sets with an empty register go on with the double horizon.
    """
    out = np.zeros((n, registers), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    horizon = registers * (math.log(registers) + 4) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        local = np.full(n, -1)
        local[todo] = np.arange(len(todo))
        chosen = np.flatnonzero(local[owner] >= 0) if len(todo) < n else np.arange(len(owner))
        own, what, rate, until = local[owner[chosen]], element[chosen], weight[chosen], horizon[owner[chosen]]
        time, active, arrivals, step = np.zeros(len(chosen)), np.arange(len(chosen)), [], 0
        while len(active):
            step = (step + 0x9E3779B97F4A7C15) % (1 << 64)
            draw = mix(what[active] + np.uint64(step))
            time[active] -= np.log(((draw >> np.uint64(11)) + 0.5) * 2.0**-53) / rate[active]
            early = time[active] < until[active]
            active = active[early]
            register = ((draw[early] & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
            arrivals.append((own[active] * registers + register.astype(np.int64), time[active], what[active]))
        place, when, who = (np.concatenate(x) for x in zip(*arrivals, strict=True))
        first = np.full(len(todo) * registers, np.inf)
        np.minimum.at(first, place, when)
        winner = when == first[place]
        signature = np.zeros(len(todo) * registers, np.uint64)
        signature[place[winner]] = who[winner]
        full = np.isfinite(first).reshape(len(todo), registers).all(axis=1)
        out[todo[full]] = signature.reshape(len(todo), registers)[full]
        todo = todo[~full]
        horizon[todo] *= 2
    return out


SKETCH = "node binary, doc_id long, bands array<long>"
#: Rows up to which a table of ids (8 bytes a row, 32 with the text's key and document) is broadcast.
BROADCAST_IDS = 500_000
#: Sets of which fine sketches are made at once, which bounds the arrivals in memory.
FINE_BLOCK = 64


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def fine_sketch(owner: np.ndarray, found: np.ndarray, n: int, registers: int) -> np.ndarray:
    """One bit a register, packed: sets of similarity s differ in (1 - s) / 2 of the bits. The bit is of the element and the
    register's number together: of the element alone, the bits of a small set would be the same few over and over."""
    out = np.zeros((n, registers // 64), np.int64)
    place = np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, FINE_BLOCK):
        stop = min(n, at + FINE_BLOCK)
        low, high = np.searchsorted(owner, (at, stop))
        signature = prob_min_hash(owner[low:high] - at, found[low:high], np.ones(high - low), stop - at, registers)
        out[at:stop] = np.packbits((mix(signature + place) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    return out


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(node, doc_id, bands) of each row of docs (doc_id, text) that has words."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.lower().encode() for t in batch.column("text").to_pylist()]
        owner, found, count = shingles(texts, plan.words)
        signature = prob_min_hash(owner, found, count.astype(float) if plan.counted else np.ones(len(found)), len(texts), plan.registers)
        some = np.flatnonzero(np.bincount(owner, minlength=len(texts)) > 0)
        signature = signature[some]
        bands = np.zeros((len(some), plan.bands), np.uint64) + np.arange(plan.bands, dtype=np.uint64)
        for r in range(plan.rows):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + signature[:, r :: plan.rows])
        take = pa.array(some)
        return pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("doc_id").take(take), _lists(bands)], names=["node", "doc_id", "bands"])

    return map_arrow(docs, kernel, SKETCH)


def shingle_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """(id, n, shingles) of each row of docs (id, text): the number of shingles, and their sorted hashes."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, found, count = shingles([t.lower().encode() for t in batch.column("text").to_pylist()], plan.words)
        if plan.counted:
            owner, found = occurrences(owner, found, count)
        offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64)))], names=["id", "n", "shingles"])

    return map_arrow(docs, kernel, "id long, n int, shingles array<long>")


def with_bits(sets: DataFrame, plan: Plan) -> DataFrame:
    """(id, bits): the fine sketch of each row of sets (id, shingles)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("shingles")
        ends = lists.offsets.to_numpy()
        found = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        return pa.RecordBatch.from_arrays([batch.column("id"), _lists(fine_sketch(owner, found, batch.num_rows, plan.fine))], names=["id", "bits"])

    return map_arrow(sets.select("id", "shingles"), kernel, "id long, bits array<long>")


def _only(sets: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of sets with one of these ids (distinct, and no more than most). Up to BROADCAST_IDS they go to all tasks, so that no set is
    shuffled only to be dropped."""
    few = most <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan, keep: Scratch, rows: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", 2 * rows)
    some = _only(sets, ids, 2 * rows)
    whole = lambda x: some.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    shared, sizes = F.size(F.array_intersect("a_set", "b_set")), F.col("a_n") + F.col("b_n")
    top, bottom = plan.similar
    return both.where(shared * (top + bottom) >= sizes * top).select("a", "b")  # shared / (sizes - shared) >= top / bottom


def _likely(pairs: DataFrame, live: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave a chance."""
    side = lambda x: live.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "rest", "bits")))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may(plan, "a_", "b_")).select("a", "b")


def _may(plan: Plan, a: str, b: str) -> Column:
    """Whether sizes and one-bit sketches leave a pair a chance: the columns n, rest and bits with prefixes a and b. rest
    shingles of a set occur in other sets as well, so no pair shares more than the lesser rest."""
    top, bottom = plan.similar
    of = lambda c: (F.col(f"{a}{c}"), F.col(f"{b}{c}"))
    (n, m), (bits, other) = of("n"), of("bits")
    unlike = sum((F.bit_count(bits[i].bitwiseXOR(other[i])) for i in range(plan.fine // 64)), F.lit(0))
    return (F.least(n, m) * bottom >= F.greatest(n, m) * top) & (F.least(*of("rest")) * (top + bottom) >= (n + m) * top) & (unlike <= plan.unlike_bits)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _linkable(sets: DataFrame, plan: Plan) -> DataFrame:
    """(id, n, rest) of the sets (id, n, shingles) that may have a link.

    A shingle that no other candidate has is lost to every pair; rest many are left. Where more than a fifth are lost, no
    other set can be similar enough. This settles texts that share a passage, and copies with many changes, without a look
    at any pair."""
    single = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("texts"), F.max("id").alias("id")).where("texts = 1")
    own = single.groupBy("id").agg(F.count("*").cast("int").alias("own"))
    top, bottom = plan.similar
    left = sets.select("id", "n").join(own, "id", "left").withColumn("rest", F.col("n") - F.coalesce("own", F.lit(0)))
    return left.where(F.col("rest") * bottom >= F.col("n") * top).drop("own")


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows (band, id) of bands that several ids have."""
    return buckets.join(buckets.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("band"), "band")


def links(docs: DataFrame, plan: Plan, keep: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Of docs (doc_id, text): a table (node, doc_id, ...) of the rows with words, and (node, label) of the classes of
    different texts that near-duplicate links join (None: there are no candidates at all)."""
    docs = docs.where("text IS NOT NULL").select("doc_id", "text", text_key().alias("node"))
    table = keep(sketches(docs, plan), "sketches")
    n_docs = table.count()
    bands = table.select("node", F.explode("bands").alias("band"))
    mark = F.xxhash64("node")
    several = bands.groupBy("band").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("band")
    hits = keep(bands.join(several, "band").distinct(), "hits", plan.bands * n_docs)
    n_hits = hits.count()
    # candidate texts get whole numbers, which later aggregates take without sorting
    nodes = keep(hits.select("node").distinct().withColumn("id", F.monotonically_increasing_id()), "nodes", n_hits)
    n = nodes.count()
    rows = table.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"))  # copies meet before the join
    wanted = keep(rows.join(nodes, "node").select("node", "doc_id", "id"), "chosen", n_docs)
    wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    text = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["node", "doc_id"]).dropDuplicates(["node", "doc_id"]).select("id", "text")
    sets = keep(shingle_sets(text, plan), "sets", 100 * n)
    n_shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = keep(_linkable(sets, plan), "linkable", n_shingles)
    for _ in range(1, plan.sieves):
        live = keep(_linkable(_only(sets, live.select("id"), n), plan), "linkable", n_shingles)
    live = keep(live.join(with_bits(_only(sets, live.select("id"), n), plan), "id"), "bits", 300 * live.count())
    buckets = keep(_shared(hits.join(nodes, "node").select("band", "id").join(live.select("id"), "id", "left_semi")), "shared", n_hits)
    # a text that meets many others in its buckets is near the middle of a group: it leads first
    sizes = buckets.groupBy("band").agg(F.count("*").alias("members"))
    middle = buckets.join(sizes, "band").groupBy("id").agg(F.sum("members").alias("middle"))
    buckets = keep(buckets.join(middle, "id"), "buckets", buckets.count())
    labels, tested = None, None

    def labelled() -> DataFrame:
        if labels is None:
            return buckets.withColumn("label", F.col("id"))
        return buckets.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def add(pairs: DataFrame, rows: int) -> bool:
        nonlocal labels, tested
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs", rows)
        if not (met := pairs.count()):
            return False
        found = keep(_verified(pairs, sets, plan, keep, met), "links", 50 * met)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():  # what was joined before is in the labels
            labels = connected(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), "neardup-components")
        return True

    for turn in range(plan.rounds):
        rows = labelled()
        some = rows if turn == 0 else rows.join(_mixed(rows), "band").where("label <> home")
        lead = some.groupBy("band").agg(F.max_by("id", "middle").alias("lead"))
        own = rows.select(F.col("id").alias("lead"), F.col("label").alias("lead_label")).distinct()
        met = rows.join(lead.join(own, "lead"), "band").where("label <> lead_label")
        if not add(_likely(met.select(*_ordered(F.col("id"), F.col("lead"))).distinct(), live, plan), n_hits):
            break
    mixed = keep(_mixed_rows(labelled().select("band", "id", "label"), live), "mixed", 4 * n_hits)
    add(_across(mixed, plan), 20 * mixed.count())
    if labels is None:
        return table, None
    names = nodes.select("id", "node")
    named = labels.select(F.col("node").alias("id"), "label").join(names, "id").select("node", F.col("label").alias("id")).join(names.withColumnRenamed("node", "label"), "id")
    return table, named.select("node", "label")


def _mixed(rows: DataFrame) -> DataFrame:
    """(band, home): the buckets that hold several classes, and their largest class."""
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("n"))
    return sizes.groupBy("band").agg(F.max_by("label", "n").alias("home"), F.count("*").alias("classes")).where("classes > 1").select("band", "home")


def _mixed_rows(rows: DataFrame, live: DataFrame) -> DataFrame:
    """rows (band, id, label) of buckets that hold several classes, with their home and what _may() needs."""
    return rows.join(_mixed(rows), "band").join(live, "id")


def _across(rows: DataFrame, plan: Plan) -> DataFrame:
    """All pairs of different classes that share a bucket and that sizes and bits leave a chance; rows as of _mixed_rows().

    In each bucket, members outside its largest class meet all members of other classes."""
    left = rows.where("label <> home").select("band", *(F.col(c).alias(f"x_{c}") for c in ("id", "label", "n", "rest", "bits")))
    near = left.join(rows, "band").where((F.col("x_label") != F.col("label")) & _may(plan, "x_", ""))
    return near.select(*_ordered(F.col("x_id"), F.col("id"))).distinct()


def classes(df: DataFrame, text: str = "text", id_column: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """(doc_id, node, class_key, class_id, class_size, first): one row per row of df.

    Two texts are linked if the Jaccard similarity of their sets of word shingles (A-Z and other capitals lowered) is at
    least 0.8, and equal texts always; a class is what links join. class_id is the class's least id; class_size counts rows;
    first marks rows that have that id. Texts without words are linked to equal ones only. Null and empty texts are classes
    of one row each: they have the id of their row, a class_key of null and first = true. Rows with a null id are members
    like others.
    """
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = docs.select("doc_id", text_key().alias("node"))
    with Scratch("neardup") as keep:
        table, labels = links(docs, plan, keep)
        n = table.count()
        wordy = table.groupBy("node").agg(F.count("*").alias("n"))  # texts with words
        label = wordy.select("node", F.col("node").alias("class_key")) if labels is None else wordy.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("class_key"))
        members = table.select("node", "doc_id").join(keep(label, "labels", n), "node")
        wordless = docs.where((F.col("text") != "") & ~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7f]")).select(text_key().alias("node"), "doc_id")
        members = keep(members.unionByName(wordless.withColumn("class_key", F.col("node"))), "members", 2 * n)
        sizes = members.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
        by_text = stored(members.select("node", "class_key").distinct().join(sizes, "class_key"), "neardup-classes", members.count())
    out = rows.join(by_text, "node", "left")
    alone = F.col("class_key").isNull()
    return out.select(
        "doc_id",
        "node",
        "class_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"),
    )


def keep_first(df: DataFrame, text: str = "text", id_column: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """df with one row of each class of near copies: the one with the least id (any of rows that share it)."""
    key, own, count, best_id = fresh(df, "class_key", "text_node", "rows_like_it", "best_id")
    found = classes(df, text, id_column, plan).where("first AND class_key IS NOT NULL").select(F.col("class_key").alias(key), F.col("node").alias(own), F.col("doc_id").alias(best_id))
    # a class's row is known by its id and text; repeated ids or rows leave several, of which one stays
    found = stored(found, "neardup-first")
    n = found.count()
    best = found.groupBy(key).agg(F.min(own).alias(own))
    rows = stored(found.join(best, [key, own]).groupBy(key, own, best_id).agg(F.count("*").alias(count)), "neardup-kept", n)
    marked = df.withColumn(own, text_key(text)).join(rows, own, "left")
    some = F.coalesce(F.col(f"`{text}`").cast("string") != "", F.lit(False))
    plain = marked.where(~some | (F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(best_id)) & (F.col(count) == 1)))
    repeated = marked.where(some & F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(best_id)) & (F.col(count) > 1)).dropDuplicates([key])
    return plain.unionByName(repeated).select(*df.columns)


#: DuckDB SQL for the query op1: candidates by the rarest shingles of each text, of which two similar texts share one; classes by
#: a walk over the links. For small tables: the walk makes a row for each two members of a class.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), u AS (SELECT text, any_value(w) AS w, row_number() OVER () AS id FROM d WHERE len(w) > 0 GROUP BY text),
sh AS (SELECT DISTINCT id, hash(array_to_string(w[p : p + 4], ' ')) AS s FROM u, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS p)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
f AS (SELECT s, count(*) AS f FROM sh GROUP BY s HAVING count(*) > 1),
pr AS (SELECT id, s, n FROM (SELECT sh.id, sh.s, n.n, f.f, row_number() OVER (PARTITION BY sh.id ORDER BY coalesce(f.f, 1), sh.s) AS r FROM sh JOIN n USING (id) LEFT JOIN f USING (s)) WHERE f IS NOT NULL AND r <= n - (4 * n + 4) // 5 + 1),
cd AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pr a JOIN pr b ON a.s = b.s AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
ln AS (SELECT a, b FROM (SELECT cd.a, cd.b, count(*) AS c FROM cd JOIN sh x ON x.id = cd.a JOIN sh y ON y.id = cd.b AND y.s = x.s GROUP BY ALL) JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
reach AS (SELECT a, a AS b FROM ways UNION SELECT r.a, ways.b FROM reach r JOIN ways ON r.b = ways.a),
lab AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a),
cls AS (
  SELECT d.doc_id, 'w' || coalesce(label, u.id) AS k FROM d JOIN u ON d.text = u.text LEFT JOIN lab USING (id)
  UNION ALL SELECT doc_id, 't' || text FROM d WHERE len(w) = 0 AND text <> ''
), sz AS (SELECT k, min(doc_id) AS class_id, count(*) AS class_size FROM cls GROUP BY k)
SELECT doc_id, class_id, class_size, doc_id IS DISTINCT FROM class_id AS duplicate FROM cls JOIN sz USING (k)
UNION ALL SELECT doc_id, doc_id, 1, false FROM documents WHERE text IS NULL OR text = ''
"""

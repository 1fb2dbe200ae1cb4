"""Operator 2: benchmark decontamination by winnowing. The least k-gram hash of each sliding window is a fingerprint;
documents and items that share one are compared word by word around it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import fresh, gram_hashes, map_arrow, word_hashes, written

#: Words of a window that counts as shared, and of the k-grams that are hashed.
WINDOW, GRAM = 13, 5
#: Bytes of item texts up to which the index of all items is broadcast; more are joined by a shuffle on fingerprints.
BROADCAST_BYTES = 8 << 20
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def winnow(words: np.ndarray, doc: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: of each run of span words within one text, the (first) least k-gram hash.

    Two texts that share span words in a row share that run's fingerprint.
    """
    k = min(gram, span)
    grams = gram_hashes(words, k)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    within = np.flatnonzero(doc[: len(words) - span + 1] == doc[span - 1 :])
    least = sliding_window_view(grams, span - k + 1).argmin(axis=1) if span > k else np.zeros(len(grams), np.int64)
    at = within + least[within]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, grams[at]


class Index:
    """Items by the fingerprints of their windows. Items shorter than a window are one window; those without words, none."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.ids, texts = [i for i, _ in items], [t.lower() for _, t in items]
        hashes, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        self.hashes = [hashes[e - c : e] for e, c in zip(ends, counts, strict=True)]
        self.plain = [WORDS.findall(t) for t in texts]
        self.spans: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        spans = np.minimum(counts, window)
        for span in sorted({*spans.tolist()} - {0}):
            prints, item, place = [], [], []
            for i in np.flatnonzero(spans == span):
                at, found = winnow(self.hashes[i], np.zeros(counts[i], np.int64), span)
                prints.append(found)
                item.append(np.full(len(at), i))
                place.append(at)
            prints, item, place = np.concatenate(prints), np.concatenate(item), np.concatenate(place)
            order = np.lexsort((place, item, prints))
            order = order[self._needed(prints[order], item[order], place[order], min(GRAM, span), window)]
            self.spans.append((span, prints[order], item[order], place[order]))
        self.word_of = {h: w for hs, ws in zip(self.hashes, self.plain, strict=True) for h, w in zip(hs.tolist(), ws, strict=True)}

    def _needed(self, prints: np.ndarray, item: np.ndarray, place: np.ndarray, k: int, window: int) -> np.ndarray:
        """Which places of sorted fingerprints texts must meet. Where an item repeats itself with a period, each window that
        a text may share also stands around one of the first or last window places or the middle one of the repetition, so
        the others add nothing; an item of one word said n times would else meet each place of a text n times."""
        keep = np.ones(len(prints), bool)
        same = np.flatnonzero((prints[2:] == prints[:-2]) & (item[2:] == item[:-2]) & (place[2:] - place[1:-1] == place[1:-1] - place[:-2]))
        if not len(same):
            return keep
        periodic = np.zeros(len(prints), bool)  # whether a place, the one before and the one after are a period apart
        for at in same.tolist():
            a, b, words = int(place[at]), int(place[at + 1]), self.hashes[item[at]]
            periodic[at + 1] = (words[a : b + k] == words[b : 2 * b - a + k]).all()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], periodic.view(np.int8), [0]))))
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if last - first > 2 * window:
                keep[first + window : last - window] = False
                keep[(first + last) // 2] = True
        return keep

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, hit spans of words, ids of items with a window in the text) of each text; null has no words."""
        lowered = [(t or b"").lower() for t in texts]
        hashes, counts = word_hashes(lowered)
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        hits: dict[int, list[tuple[int, int, int, int]]] = {}
        for span, prints, item, place in self.spans:
            at, found = winnow(hashes, doc, span)
            low, high = np.searchsorted(prints, found, "left"), np.searchsorted(prints, found, "right")
            some = np.flatnonzero(high > low)
            reached: dict[tuple[int, int], int] = {}
            for p, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                d = int(doc[p])
                for i, q in zip(item[a:b].tolist(), place[a:b].tolist(), strict=True):
                    if reached.get((i, p - q), -1) > p:
                        continue  # within a span that is known already
                    start, stop = self._extend(hashes, int(ends[d] - counts[d]), int(ends[d]), p, self.hashes[i], q)
                    reached[i, p - q] = max(stop, p + 1)
                    if stop - start >= span:
                        hits.setdefault(d, []).append((start, stop, i, start - (p - q)))
        out = []
        for d, n in enumerate(counts.tolist()):
            spans, ids = [], set()
            if d in hits:
                first, words = int(ends[d]) - n, WORDS.findall(lowered[d])
                spans = merged([(start - first, stop - first) for start, stop, _, _ in hits[d]])
                if all(self.word_of.get(h) == w for a, b in spans for h, w in zip(hashes[first + a : first + b].tolist(), words[a:b], strict=True)):
                    ids = {self.ids[i] for _, _, i, _ in hits[d]}  # the words themselves are equal
                else:  # two words share a hash
                    spans = []
                    for start, stop, i, q in hits[d]:
                        if words[start - first : stop - first] == self.plain[i][q : q + stop - start]:
                            spans.append((start - first, stop - first))
                            ids.add(self.ids[i])
            out.append((n, merged(spans), sorted(ids)))
        return out

    @staticmethod
    def _extend(words: np.ndarray, first: int, last: int, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
        """The longest run of equal words around place p of the text and q of the item."""
        n = min(last - p, len(item) - q)
        same = words[p : p + n] == item[q : q + n]
        stop = p + (n if same.all() else int(same.argmin()))
        n = min(p - first, q)
        same = (words[p - n : p] == item[q - n : q])[::-1]
        return p - (n if same.all() else int(same.argmin())), stop


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


_FOUND = "contamination struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>,contaminated:boolean>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])


def _rows(found: list) -> pa.Array:
    rows = []
    for n, spans, ids in found:
        hit = sum(b - a for a, b in spans)
        rows.append({"n_words": n, "n_hit": hit, "spans": [{"start": a, "stop": b} for a, b in spans], "items": ids, "contaminated": hit > 0 and 20 * hit >= n})
    return pa.array(rows, _FOUND_ARROW)


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df and a struct contamination: n_words, n_hit (words within an occurrence of an item's window), their spans
    (counted in words), items (ids whose windows occur, sorted as strings) and contaminated (n_hit is a twentieth or more).

    Each row of df has one row. Null and wordless texts have no words and no hits; items with a null text have no windows,
    a null id counts as an empty one, rows that share an id are one item. Columns of df that are called contamination are
    replaced. Up to broadcast_bytes of item texts, each task holds an index of all items; beyond, fingerprints of texts and
    items are joined by a shuffle, and each text meets only the items that share one with it. Both give the same rows.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    keep = [c for c in df.columns if c != "contamination"]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        index = Index([(r["item_id"], r["text"].encode()) for r in items.collect()])  # bounded by broadcast_bytes
        sent = df.sparkSession.sparkContext.broadcast(index)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = sent.value.scan(batch.column(text).cast(pa.binary()).to_pylist())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _rows(found)], names=[*keep, "contamination"])

        return map_arrow(df, kernel, f"{kept}, {_FOUND}")

    # every span length that items have, so that both sides choose fingerprints alike
    lengths = [r["span"] for r in _prints(items, None).select("span").distinct().collect()]  # WINDOW values at most
    own, near_items = fresh(df, "text_key", "near_items")
    shared = _prints(items, lengths).join(_prints(df.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL"), lengths).select(F.col("key").alias(own), "span", "print"), ["span", "print"])
    pairs = shared.select(own, F.col("key").alias("item_key")).distinct()
    named = items.select(F.unhex(F.md5("text")).alias("item_key"), "item_id", "text").distinct()
    near = written(pairs.join(named, "item_key").groupBy(own).agg(F.collect_list(F.struct("item_id", "text")).alias(near_items)), "decontaminate-near")
    both = df.withColumn(own, F.unhex(F.md5(F.col(f"`{text}`")))).join(near, own, "left").drop(own)

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t, near in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(near_items).to_pylist(), strict=True):
            found += Index([(x["item_id"], x["text"].encode()) for x in near or []]).scan([t])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _rows(found)], names=[*keep, "contamination"])

    return map_arrow(both, alone, f"{kept}, {_FOUND}")


def _prints(texts: DataFrame, lengths: list[int] | None) -> DataFrame:
    """(key, span, print): the fingerprints of texts for each span length; without lengths, each text's own length."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        hashes, counts = word_hashes([t.lower() for t in raw])
        doc = np.repeat(np.arange(len(raw)), counts)
        if lengths is None:
            own = [min(int(c), WINDOW) for c in counts]
            rows = [(i, s, 0) for i, s in enumerate(own) if s]
        else:
            rows = []
            for span in lengths:
                at, found = winnow(hashes, doc, span)
                rows += zip(doc[at].tolist(), [span] * len(at), found.view(np.int64).tolist(), strict=True)
        keys = batch.column("key").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([keys[r[0]] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "span", "print"])

    return map_arrow(texts.select(F.unhex(F.md5("text")).alias("key"), "text"), kernel, "key binary, span int, print long").distinct()


def contamination_digests(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The digest columns of operator 2, one row per document."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **more)
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


#: DuckDB SQL for contamination_digests(documents, benchmark).
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), s AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
m AS (SELECT r, p, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

"""Operator 4: document quality by Bradley-Terry ranking: scores whose differences explain pairwise preferences."""

from __future__ import annotations

import string
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import map_arrow, word_hashes

#: Classes of characters whose share of a text is a feature: each ASCII mark by itself, then kinds of all others.
MARKS = string.punctuation
KINDS = ("lower", "upper", "other_letter", "digit", "space", "newline", "other")
SHAPES = ("log_words", "word_length", "distinct_words", "short_words", "top_word", "line_length", "distinct_lines", "capital_words")
FEATURES = (*(f"mark_{c}" for c in MARKS), *KINDS, *SHAPES)
#: A score at the threshold.
AT_THRESHOLD = 0.3
_CLASSES: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    """Scores are weights . (features - mean) / scale; threshold is the raw score at the chosen quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:

        def kind(c: str) -> int:
            if c in MARKS:
                return MARKS.index(c)
            name = "newline" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other_letter" if c.isalpha() else "other"
            return len(MARKS) + KINDS.index(name)

        _CLASSES = np.fromiter((kind(chr(c)) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return _CLASSES


def forget() -> None:
    """Drops the table of classes at a task's end."""
    global _CLASSES
    _CLASSES = None


def _repeats(values: list) -> tuple[float, float]:
    """The share of distinct values, and the share of the most common one."""
    if not len(values):
        return 1.0, 0.0
    _, n = np.unique(values, return_counts=True)
    return len(n) / len(values), n.max() / len(values)


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; nothing but the text goes in. Null counts as empty."""
    text = text or ""
    n = len(text)
    counts = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(MARKS) + len(KINDS))
    words = text.split()
    hashes, _ = word_hashes([text.lower().encode("utf-8", "replace")])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct, top = _repeats(hashes)
    shapes = [
        np.log1p(len(words)),
        lengths.mean() if len(words) else 0.0,
        distinct,
        (lengths <= 3).mean() if len(words) else 0.0,
        top,
        np.log1p(n / max(len(lines), 1)),
        len(set(lines)) / max(len(lines), 1),
        sum(map(str.isupper, words)) / max(len(words), 1),
    ]
    return np.concatenate((np.log1p(200 * counts / max(n, 1)), shapes))


def _pairs(good: np.ndarray, bad: np.ndarray, n: int) -> np.ndarray:
    """Feature differences of n preference pairs, good before bad; the same pairs for the same rows."""
    rng = np.random.default_rng(4)
    return good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 0.01, rounds: int = 25) -> Model:
    """Bradley-Terry by Newton's method: the logistic loss of feature differences with a small ridge.

    The threshold is the training scores' quantile that errs least (each row counts once). With one label only, no
    preference exists: weights are zero, and all rows pass or fail alike.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(x.shape[1])
    if not (y == 1).any() or not (y == 0).any():
        return Model(mean, scale, w, -1.0 if (y == 1).any() else 1.0, 0.0)
    d = _pairs(z[y == 1], z[y == 0], pairs)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ranked, labels = s[order], y[order]
    errors = np.concatenate(([0], np.cumsum(labels == 1))) + (labels == 0).sum() - np.concatenate(([0], np.cumsum(labels == 0)))
    open_cut = np.concatenate(([True], ranked[1:] > ranked[:-1], [True]))
    cut = int(np.flatnonzero(open_cut)[np.argmin(errors[open_cut])])
    edge = np.concatenate(([ranked[0] - 1], ranked, [ranked[-1] + 1]))
    return Model(mean, scale, w, float((edge[cut] + edge[cut + 1]) / 2), cut / len(s))


def score_matrix(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1, AT_THRESHOLD at the threshold, rising with the raw score."""
    raw = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights - model.threshold
    return 1 / (1 + np.exp(-np.clip(raw + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality 0 or 1; null teaches nothing).

    The pairs come from at most about max_rows labelled rows, chosen by a hash of the id alike at every size, half of them
    of either label as far as there are so many; that bounds what is broadcast and what reaches the driver. The threshold
    weighs the rows back to the labels' shares in all of labels. Of texts that share an id one teaches, the one whose features
    come first, so no more rows than labels reach the driver.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    sizes = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    width = len(FEATURES)
    if not sizes:
        return fit_pairs(np.zeros((1, width)), np.ones(1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40))
    below = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 40, int((1 << 40) * max_rows / 2 / n) + 1)))])
    chosen = labels.where(place < below[F.col("quality")]).distinct()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    each = map_arrow(texts, kernel, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    rows = each.collect()  # a row for each chosen label: bounded by max_rows
    if not rows:
        return fit_pairs(np.zeros((1, width)), np.ones(1))
    x, y = np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows])
    order = np.lexsort((*x.T, y))  # the rows' order depends on the cluster; the model must not
    x, y = x[order], y[order]
    model = fit_pairs(x, y)
    if len(sizes) < 2:
        return model
    # back to the labels' shares: each row of a label stands for sizes / sampled rows
    weight = np.array([sizes[int(k)] / max((y == k).sum(), 1) for k in y])
    raw = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights
    order = np.argsort(raw, kind="stable")
    raw, good, weight = raw[order], y[order] == 1, weight[order]
    below_good, below_bad = np.concatenate(([0], np.cumsum(weight * good))), np.concatenate(([0], np.cumsum(weight * ~good)))
    errors = below_good + below_bad[-1] - below_bad
    errors[1:-1][raw[1:] <= raw[:-1]] = np.inf
    cut = int(np.argmin(errors))
    edge = np.concatenate(([raw[0] - 1], raw, [raw[-1] + 1]))
    return Model(model.mean, model.scale, model.weights, float((edge[cut] + edge[cut + 1]) / 2), float((below_good + below_bad)[cut] / weight.sum()))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """df and a score from 0 to 1 of each whole text (null: as an empty one); a column with that name is replaced."""
    keep = [c for c in df.columns if c != out]
    sent = df.sparkSession.sparkContext.broadcast(model)  # four numbers a feature

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t) for t in batch.column(text).to_pylist()])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score_matrix(sent.value, x))], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), kernel, f"{schema}, `{out}` double", forget)

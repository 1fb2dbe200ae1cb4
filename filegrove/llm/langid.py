"""Operator 5: language by the nearest of several TF-IDF centroids a language, with rejection by distance."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filegrove.llm.common import bounded, map_arrow, pieces, release

#: Hashed letter pairs and triples: the width of every vector, and documents that are made dense at once.
WIDTH, BLOCK = 1 << 13, 128
_LETTERS: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    """languages[i] owns centroid i; idf weights; least[i] is the cosine below which centroid i rejects."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTERS


def count_vectors(texts: list[str | None]) -> np.ndarray:
    """Counts of the hashed letter pairs and triples of lower-cased texts: len(texts) x WIDTH.

    All that is no letter counts as one space between words; a text without letters has a row of zeros.
    """
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _letters()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    points, doc, letter = points[keep], doc[keep], letter[keep]
    out = np.zeros(len(texts) * WIDTH, np.int64)
    for n in (2, 3):
        if len(points) < n:
            continue
        gram = np.zeros(len(points) - n + 1, np.uint64)
        for i in range(n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(gram)] + np.uint64(n)
        place = ((gram * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(51)).astype(np.int64)
        first, last = doc[: len(gram)], doc[n - 1 :]
        real = first == last
        out += np.bincount(first[real] * WIDTH + place[real], minlength=len(out))
    return out.reshape(len(texts), WIDTH)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (logarithmic counts); a row of zeros stays one."""
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the row nearest to the mean and then at the rows farthest from all chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many each hashed gram occurs: over all rows; each task sends one sum."""
    bounded(docs)

    def run(batches):
        n, total = 0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").to_pylist()
                for at in range(0, len(texts), BLOCK):
                    total += (count_vectors(texts[at : at + BLOCK]) > 0).sum(axis=0)
                n += len(texts)
        if n:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, WIDTH).astype(np.int32)), pa.array(np.append(total[used], n))], names=["gram", "n"])
        release()

    sums = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # WIDTH + 1 rows at most
    out = np.zeros(WIDTH + 1, np.int64)
    for row in sums:
        out[row["gram"]] = row["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, per_language: int = 400, centroids: int = 4, reject_share: float = 0.5) -> Model:
    """Learns from the columns text and lang of docs; rows where either is null teach nothing.

    IDF comes from every row. The centroids come from a sample of at most per_language different texts a language (all
    of a language with fewer, however often they occur), the ones with the smallest hashes. A centroid rejects what is less similar than
    reject_share of the similarity that 99 in 100 of its own rows reach. Without rows the model knows no language.
    """
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    n, seen = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40))
    # different texts, estimated: an error of a fifth, four times the usual one, still leaves enough below the bound
    sizes = {r["lang"]: max(1, r["n"]) for r in docs.groupBy("lang").agg(F.approx_count_distinct(place, 0.05).alias("n")).collect()}
    sample: dict[str, list] = {}
    if sizes:
        below = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1 << 40, int((1 << 40) * 1.3 * per_language / v) + 1)))])
        chosen = docs.withColumn("place", place).where(F.col("place") < below[F.col("lang")]).dropDuplicates(["lang", "place"])

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams, counts = [], []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), BLOCK):
                for row in count_vectors(texts[at : at + BLOCK]):
                    used = np.flatnonzero(row)
                    grams.append(used.astype(np.int32))
                    counts.append(row[used].astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(grams, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "place", "grams", "counts"])

        counted = map_arrow(chosen, kernel, "lang string, place long, grams array<int>, counts array<int>").where(F.size("grams") > 0)
        first = Window.partitionBy("lang").orderBy("place")
        for r in counted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).collect():  # per_language a language
            sample.setdefault(r["lang"], []).append((r["place"], r["grams"], r["counts"]))
    parts, languages, least = [], [], []
    for lang in sorted(sample):
        rows = sorted(sample[lang])
        dense = np.zeros((len(rows), WIDTH), np.float32)
        for i, (_, grams, counts) in enumerate(rows):
            dense[i, grams] = counts
        x = vectors(dense, idf)
        centres = _cluster(x, centroids)
        near = x @ centres.T
        for i in range(len(centres)):
            own = near[near.argmax(axis=1) == i, i]
            least.append(reject_share * float(np.quantile(own, 0.01)) if len(own) else 0.0)
        parts.append(centres)
        languages += [lang] * len(centres)
    centroid_rows = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return Model(idf, centroid_rows.astype(np.float32), languages, np.array(least, np.float32))


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(nearest language, cosine, rejected) of each text; ("und", 0.0, True) for null, no letter, or an empty model."""
    out: list[tuple[str, float, bool]] = []
    for at in range(0, len(texts), BLOCK):
        counts = count_vectors(texts[at : at + BLOCK])
        known = counts.any(axis=1) & bool(model.languages)
        if not model.languages:
            out += [("und", 0.0, True)] * len(counts)
            continue
        near = vectors(counts, model.idf) @ model.centroids.T
        best = near.argmax(axis=1)
        for i, (b, ok) in enumerate(zip(best.tolist(), known.tolist(), strict=True)):
            cosine = float(min(max(near[i, b], 0.0), 1.0))
            out.append((model.languages[b], cosine, cosine < float(model.least[b])) if ok else ("und", 0.0, True))
    return out


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df and the columns lang_nearest, lang_score (cosine, 0 to 1), lang_rejected (too far, or nothing to go by) and
    lang_id (lang_nearest, or und where rejected). Columns of df with these names are replaced.
    """
    made = ["lang_nearest", "lang_score", "lang_rejected"]
    keep = [c for c in df.columns if c not in {*made, "lang_id"}]
    sent = df.sparkSession.sparkContext.broadcast(model)  # languages x centroids x WIDTH numbers, however large df is

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = predict_texts(sent.value, batch.column(text).to_pylist())
        new = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    out = map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), kernel, f"{schema}, lang_nearest string, lang_score double, lang_rejected boolean")
    return out.withColumn("lang_id", F.when(F.col("lang_rejected"), "und").otherwise(F.col("lang_nearest")))

"""Operator 13: tokens of two tokenizers on the same text, aligned where both end: cuts, groups, links and their counts.

Both tokenizers always cut before a single blank between two visible characters: the byte-level one splits there before any
merge, and no piece of the other has a blank behind another character (aligned() looks). So the alignment of a text is that of
its segments, one behind the other. Segments are few and recur; the relational work (tokens by posexplode, ends by windowed
sums of lengths, an equi-join on segment and end, groups by running counts of cuts) is done once for each different one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filegrove.llm.bpe import from_piece
from filegrove.llm.common import bounded, map_arrow, pieces, release
from filegrove.operators.tables import Scratch, shuffles_released, stored

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of the texts of one block, whose segments are listed together (or one longer text).
BLOCK_CHARS = 24 << 20
#: Id pairs (32 bytes each) that are broadcast with their counts; beyond, links are joined to them by a shuffle.
BROADCAST_PAIRS = 2_000_000
_MARK = "▁"  # how pieces write a blank


class Tokenizers:
    """The two tokenizers and the bytes of their tokens; made once in each worker process."""

    made: dict[str, Tokenizers] = {}

    def __init__(self, entries: str, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(entries)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b"" if i in special else from_piece(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in side], np.int32) for side in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()

    def cut_at_blanks(self) -> bool:
        """Whether A splits by the usual pattern, and B has no piece with a blank behind another character and keeps blanks."""
        read = json.loads(self.a.to_str())
        split = read["pre_tokenizer"]["type"] == "ByteLevel" and read["pre_tokenizer"]["use_regex"] and not read["normalizer"]
        return split and all(b" " not in t.lstrip(b" ") for t in self.b_bytes) and self.b.encode("a  b ", out_type=str) == [f"{_MARK}a", _MARK, f"{_MARK}b", _MARK]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([f" {s}" for s in segments], add_special_tokens=False)], self.b.encode(segments, num_threads=1)

    def agree(self, segment: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides' bytes are a blank and the segment."""
        want = b" " + segment.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))


@contextmanager
def _co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins on a segment and an end within it use rows that are dealt by segment as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


BLOCKS = "block long, doc_id long, refs binary, at int, segment string, n long"


def _stored_refs(refs: np.ndarray) -> bytes:
    """Places in a block's list, compressed: they are about half of what goes to disk."""
    return len(refs).to_bytes(8, "little") + (pa.compress(refs.tobytes(), codec="zstd", asbytes=True) if len(refs) else b"")


def _read_refs(stored: bytes) -> np.ndarray:
    n = int.from_bytes(stored[:8], "little")
    return np.frombuffer(pa.decompress(stored[8:], 4 * n, codec="zstd", asbytes=True) if n else b"", np.int32)


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as places of their segments in a block's list (doc_id, refs), and the lists (at, segment, n: how often)."""
    bounded(docs)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1
        index: dict[str, int] = {}
        ids: list = []
        refs: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            block += 1
            counts = np.zeros(len(index), np.int64)
            for at in range(0, len(ids), 1000):
                some = refs[at : at + 1000]
                counts += np.bincount(np.concatenate(some), minlength=len(index))
                yield batch_of(len(some), doc_id=pa.array(ids[at : at + 1000], pa.int64()), refs=pa.array(map(_stored_refs, some), pa.binary()))
            words = list(index)
            for at in range(0, len(words), 10_000):
                some = words[at : at + 10_000]
                yield batch_of(len(some), at=pa.array(np.arange(at, at + len(some), dtype=np.int32)), segment=pa.array(some), n=pa.array(counts[at : at + len(some)]))
            ids.clear(), refs.clear(), index.clear()

        def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["block"] = pa.array(np.full(rows, block, np.int64))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in zip(names, types, strict=True)], names=names)

        chars = 0
        for batch in batches:
            for piece in pieces(batch):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids.append(doc)
                    refs.append(np.array([index.setdefault(s, len(index)) for s in CUT.split(text)] if text else [], np.int32))
                    chars += len(text or "")
                    if chars >= BLOCK_CHARS:
                        yield from flush()
                        chars = 0
        if ids:
            yield from flush()
        release()

    return docs.mapInArrow(run, BLOCKS)


#: ids and bytes: of the tokens of A, which are split ones, and of B behind them.
TOKENS = "segment string, n long, ids array<int>, bytes array<int>, split int, same boolean"


def _tokenised(segments: DataFrame, make) -> DataFrame:
    """(segment, n) with both sides' ids and the bytes of each, and whether both stand for the segment."""
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        both, words = make(), batch.column("segment").to_pylist()
        a, b = both.encode(words)
        same = pa.array([both.agree(*x) for x in zip(words, a, b, strict=True)], pa.bool_())
        split = np.array([len(x) for x in a], np.int32)
        ends = np.cumsum(split + np.array([len(x) for x in b], np.int32))
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(zip(a, b, strict=True))), np.int32, ends[-1])
        of_a = np.arange(len(flat)) < np.repeat(np.concatenate(([0], ends[:-1])) + split, np.diff(ends, prepend=0))
        sizes = np.where(of_a, both.a_lengths[flat * of_a], both.b_lengths[flat * ~of_a])
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (flat, sizes)]
        return pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("n"), *lists, pa.array(split), same], names=names)

    return map_arrow(segments, kernel, TOKENS, Tokenizers.made.clear)


def _without(blocks: DataFrame, tokens: DataFrame, keep: Scratch, n: int) -> DataFrame:
    """tokens with counts n over the texts that both sides stand for: those of other texts are taken off."""
    bad = keep(tokens.where("NOT same").select("segment"), "unlike", n)
    if bad.isEmpty():
        return tokens
    listed = blocks.where("segment IS NOT NULL")
    lists = listed.join(bad, "segment", "left_semi").groupBy("block").agg(F.collect_list("at").alias("bad"))  # a block's list at most

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        """(block, at) of all segments of the texts that have a bad one."""
        found, of = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for block, stored_refs, bad in zip(batch.column("block").to_pylist(), batch.column("refs").to_pylist(), batch.column("bad").to_pylist(), strict=True):
            refs = _read_refs(stored_refs)
            if np.isin(bad, refs).any():
                found.append(refs)
                of.append(np.full(len(refs), block, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), pa.array(np.concatenate(found))], names=["block", "at"])

    refs = map_arrow(blocks.where("refs IS NOT NULL").join(lists, "block").select("block", "refs", "bad"), kernel, "block long, at int")
    less = refs.groupBy("block", "at").agg(F.count("*").alias("less")).join(listed, ["block", "at"]).groupBy("segment").agg(F.sum("less").alias("less"))
    return tokens.join(less, "segment", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")


def _side(tokens: DataFrame, side: str, first: Column, n: Column) -> DataFrame:
    """(id, end, token): the tokens of one side with the bytes of the segment up to each one's end."""
    each = tokens.select("id", F.posexplode(F.arrays_zip(F.slice("ids", first, n).alias("id"), F.slice("bytes", first, n).alias("bytes"))).alias("at", "x"))
    upto = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("id", F.sum("x.bytes").over(upto).alias("end"), F.col("x.id").alias(side))


def _groups(tokens: DataFrame) -> DataFrame:
    """(id, groups, n_a, n_b, n_groups, links): groups as text, links as ids (a * 2^32 + b) of tokens that end together. Segments are
    dealt to tasks once, all else follows them."""
    tokens = tokens.select("id", "ids", "bytes", "split").repartition("id")
    behind = F.col("split") + 1
    ends = _side(tokens, "a", F.lit(1), F.col("split")).join(_side(tokens, "b", behind, F.size("ids") - F.col("split")), ["id", "end"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = ends.withColumn("group", F.count(F.when(both, 1)).over(before))
    said = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side].cast("string")), ",")
    link = F.max(F.when(both, F.shiftleft(F.col("a").cast("long"), 32) + F.col("b"))).alias("link")
    rows = cut.groupBy("id", "group").agg(F.concat(said("a"), F.lit("|"), said("b")).alias("text"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), link)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "text"))), lambda x: x["text"]), ";")
    return rows.groupBy("id").agg(text.alias("groups"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.collect_list("link").alias("links"))


def _pairs(segments: DataFrame, keep: Scratch, n: int) -> DataFrame:
    """(link, a, b, count, best), a table: how many links of the corpus an id pair has, and whether no pair of its b has more."""
    links = segments.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    a, b = F.shiftright("link", 32).cast("int"), F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    counts = keep(links.where("count > 0").select(a.alias("a"), b.alias("b"), "link", "count"), "counts", n)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "b").select("link", "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "token-pairs", n)


def _told(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """(segment, NUMBERS, groups), dealt by segment where pairs are few enough to be broadcast."""
    same = ["segment", "groups", "n_a", "n_b", "n_groups"]
    links = segments.repartition("segment").select(*same, F.explode("links").alias("link"))
    counts = pairs.select("link", "count", "best")
    found = links.join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts, "link")
    return found.groupBy(*same).agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


#: Bytes of segments that a task packs at once.
PACKED_BYTES = 16 << 20


def _packed(values: DataFrame) -> DataFrame:
    """(of, packed): the segments of each block that are in one task, compressed together before they are shuffled."""
    bounded(values)
    names = ["at", *NUMBERS, "groups"]

    def flush(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pa.array(np.argsort(table.column("of").to_numpy(), kind="stable")))
        of = table.column("of").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for at, stop in zip(starts, [*starts[1:], len(of)], strict=True):
            sink = pa.BufferOutputStream()
            part = table.slice(at, stop - at).select(names).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([of[at]]), pa.array([sink.getvalue().to_pybytes()])], names=["of", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACKED_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        release()

    return values.mapInArrow(run, "of long, packed binary")


def _joined(left: pa.Table, right: pa.Table, digest: bool) -> pa.Table:
    """Documents of a block from its segments."""
    parts = [pa.ipc.open_stream(x).read_all() for x in right.column("packed").to_pylist()]
    right = pa.concat_tables(parts) if parts else pa.table({"at": pa.array([], pa.int32()), **{n: pa.array([], pa.int64()) for n in NUMBERS}, "groups": pa.array([], pa.string())})
    places = right.column("at").to_numpy().astype(np.int64)
    size = int(places.max()) + 1 if len(places) else 0
    values = np.zeros((len(NUMBERS), size), np.int64)
    known, texts = np.zeros(size, bool), np.full(size, "", object)
    for i, name in enumerate(NUMBERS):
        values[i, places] = right.column(name).fill_null(0).to_numpy()
    known[places] = right.column("groups").is_valid().to_numpy(zero_copy_only=False)
    texts[places] = right.column("groups").to_numpy(zero_copy_only=False)
    sums, said = [], []
    for refs in map(_read_refs, left.column("refs").to_pylist()):
        if len(refs) and known[refs].all():
            sums.append(values[:, refs].sum(axis=1))
            text = ";".join(texts[refs].tolist())
            said.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        else:
            sums.append(np.zeros(len(NUMBERS), np.int64))
            said.append("")
    table = np.stack(sums, axis=1) if sums else np.zeros((len(NUMBERS), 0), np.int64)
    return pa.table([left.column("doc_id"), *(pa.array(x) for x in table), pa.array(said, pa.string())], names=["doc_id", *NUMBERS, "groups"])


def aligned(docs: DataFrame, entries_path: str, model_path: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) for docs (doc_id, text): a row per row of docs with NUMBERS and groups (ids of A and B in order, as
    `a1,a2|b1;a3|b2,b3`, or with digest its SHA-256), and a row (a, b, count, best) for each linked id pair.

    A is a byte-level tokenizer (JSON) on a blank and the text, B a sentencepiece model with byte fallback. A link is a pair of
    tokens that end at the same byte. Texts that are null, empty, or that either side's tokens don't stand for have zeros, an
    empty groups and no part in the counts. Equal rows get equal values, other columns are left out.
    """
    with open(entries_path, encoding="utf-8") as entries, open(model_path, "rb") as model:
        both = entries.read(), model.read()
    if not Tokenizers(*both).cut_at_blanks():
        raise ValueError("a tokenizer joins what a blank parts; segments can't stand for texts")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(both)  # a few MB

    def make() -> Tokenizers:
        if "both" not in Tokenizers.made:
            Tokenizers.made["both"] = Tokenizers(*sent.value)
        return Tokenizers.made["both"]

    with Scratch("aligned") as keep, _co_partitioned(spark):
        blocks = keep(_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "blocks", compression="zstd")
        listed = blocks.where("segment IS NOT NULL").select(F.col("block").alias("of"), "at", "segment", "n")
        tokens = _tokenised(listed.groupBy("segment").agg(F.sum("n").alias("n")), make)
        n = blocks.count()
        tokens = keep(tokens.withColumn("id", F.monotonically_increasing_id()), "tokens", n, "zstd")
        shuffles_released(spark)
        valid = _without(blocks, tokens, keep, n).where("same")
        groups = keep(_groups(valid).join(valid.select("id", "segment", "n"), "id"), "groups", n, "zstd")
        keep.drop(tokens)
        shuffles_released(spark)
        pairs = _pairs(groups, keep, n)
        values = listed.drop("n").join(_told(groups, pairs), "segment", "left").select("of", "at", *NUMBERS, "groups")
        packed = keep(_packed(values), "packed", n, "uncompressed")
        keep.drop(groups)
        shuffles_released(spark)
        schema = ", ".join(["doc_id long", *(f"{n} long" for n in NUMBERS), "groups string"])
        rows = blocks.where("refs IS NOT NULL").select("block", "doc_id", "refs")
        found = rows.groupBy("block").cogroup(packed.groupBy("of")).applyInArrow(lambda left, right: _joined(left, right, digest), schema)
        found = stored(found, "aligned-documents", n)
    shuffles_released(spark)
    return found, pairs.drop("link")


def alignment_digests(docs: DataFrame, entries_path: str, model_path: str) -> DataFrame:
    """The columns of operator 13, one row per document."""
    found, _ = aligned(docs, entries_path, model_path, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")

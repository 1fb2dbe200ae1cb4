"""Operator 10: byte-level BPE through a sentencepiece model that is serialised directly from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import arrow, map_arrow

#: Characters that stand for the 256 bytes: those that print stand for themselves, the others follow from U+0100.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_TO_CHAR = {b: chr(b) for b in _PRINTS} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTS)}
#: latin-1 text to mapped text.
_TO_PIECE = {b: c for b, c in BYTE_TO_CHAR.items()}
_FROM_PIECE = {ord(c): b for b, c in BYTE_TO_CHAR.items()}
#: Pre-tokens that a worker remembers in a task (about 200 bytes each), and texts that it looks through at once.
REMEMBERED, BLOCK = 250_000, 64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    out = sorted(ranks, key=ranks.__getitem__)
    if sorted(ranks.values()) != list(range(len(out))):
        raise ValueError("ranks have a gap")
    return out


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def from_piece(piece: str) -> bytes:
    return bytes(map(_FROM_PIECE.__getitem__, map(ord, piece)))


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: a BPE model whose piece i is the byte-mapped token i, scored -i; the identity as
    normalisation, nothing added, nothing stripped; one unknown piece after the last token."""
    normal, unknown = 1, 2
    pieces = [(to_piece(t), -float(i), normal) for i, t in enumerate(tokens)] + [("<unk>", 0.0, unknown)]
    out = bytearray()
    for piece, score, kind in pieces:
        out += _message(1, _message(1, piece.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    absent = _varint((1 << 64) - 1)  # -1: no such piece
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces))) + _field(40, 0, _varint(len(tokens))) + _field(41, 0, absent) + _field(42, 0, absent) + _field(43, 0, absent)
    normaliser = _message(1, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return bytes(out) + _message(2, trainer) + _message(3, normaliser)


def rust_pattern(pattern: str) -> str:
    """The pattern for Python's regex module with white space as Rust's engine has it: U+001C to U+001F are none."""
    white = r"\t-\r\x20\x85\xa0  -     　"
    inside = regex.sub(r"\[\^\\s", lambda _: f"[^{white}", pattern)
    return inside.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


class Codec:
    """Encodes and decodes with one model; made once in each worker process."""

    made: dict[str, Codec] = {}  # by the digest of model and pattern

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(rust_pattern(pattern)).findall
        self.tokens = tokens
        self.known: dict[str, tuple[int, ...]] = {}  # what the model said

    @classmethod
    def of(cls, key: str, tokens: list[bytes], model: bytes, pattern: str) -> Codec:
        if key not in cls.made:
            cls.made[key] = cls(tokens, model, pattern)
        return cls.made[key]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text: the model's ids of each pre-token. Those of up to REMEMBERED pre-tokens are kept."""
        for at in range(0, len(texts), BLOCK):
            parts = [self.find(t) for t in texts[at : at + BLOCK]]
            found = set().union(*parts)
            new = found.difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, found
            if new:
                made = self.model.encode([to_piece(p.encode()) for p in new], out_type=int, num_threads=1)
                self.known.update(zip(new, map(tuple, made), strict=True))
            for part in parts:
                yield list(chain.from_iterable(map(self.known.__getitem__, part)))

    @classmethod
    def forget(cls) -> None:
        """Gives the memory back at a task's end: idle workers live on, beside those of other operators."""
        cls.made.clear()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes behind ids, by the inverse mapping of the model's pieces."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(df: DataFrame, vocabulary: str, pattern: str):
    """What a worker needs to make its codec: a broadcast of the tokens and the model (about 2 MB for 50,000 tokens)."""
    tokens = read_ranks(vocabulary)
    model = serialise(tokens)
    sent = df.sparkSession.sparkContext.broadcast((hashlib.sha256(model + pattern.encode()).hexdigest(), model, pattern))

    def make() -> Codec:
        key, model, pattern = sent.value
        if key not in Codec.made:
            reader = sentencepiece.SentencePieceProcessor(model_proto=model)
            Codec.of(key, [from_piece(reader.id_to_piece(i)) for i in range(reader.get_piece_size() - 1)], model, pattern)
        return Codec.made[key]

    return make


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """df and an array column of token ids of the whole texts, as the tiktoken library gives them without special tokens;
    with round_trip also a boolean column of that name: whether the ids decode to the text's bytes.

    A null or empty text has no ids. Columns of df that have the name of a new one are replaced; rows stay as they are.
    """
    make = _codec(df, vocabulary, pattern)
    keep = [c for c in df.columns if c not in (ids, round_trip)]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, texts = make(), [t or "" for t in batch.column(text).to_pylist()]
        rows = list(codec.encode(texts))
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
        new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        if round_trip:
            new.append(pa.array([codec.decode(r) == t.encode() for r, t in zip(rows, texts, strict=True)], pa.bool_()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, ids, *[round_trip] * bool(round_trip)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep), f"`{ids}` array<int>", *[f"`{round_trip}` boolean"] * bool(round_trip)])
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), kernel, schema, Codec.forget)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df and a binary column with the bytes behind its token ids; null ids give null."""
    make = _codec(df, vocabulary, pattern)
    keep = [c for c in df.columns if c != out]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = make()
        rows = [None if r is None else codec.decode(r) for r in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), kernel, f"{schema}, `{out}` binary")


DIGEST = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The digest columns of operator 10. Encodes, decodes the ids again, and sends only the digests back."""
    make = _codec(docs, vocabulary, pattern)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = make()
        n, ids_sha, text_sha = [], [], []
        for ids in codec.encode([t or "" for t in batch.column("text").to_pylist()]):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return arrow(DIGEST, batch.column("doc_id"), n, ids_sha, text_sha)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(docs, kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Codec.forget)

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from filegrove.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    tokens = bpe.read_ranks(PATH)
    return bpe.Codec(tokens, bpe.serialise(tokens), PATTERN)


def test_the_model_has_every_token_as_itself(codec):
    pieces = [bpe.to_piece(t) for t in codec.tokens]
    assert codec.model.encode(pieces, out_type=int) == [[i] for i in range(len(pieces))]
    assert [bpe.from_piece(codec.model.id_to_piece(i)) for i in range(len(pieces))] == codec.tokens


def test_ids_are_those_of_the_library(codec, plain):
    rng = random.Random(10)
    odd = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "é", "'s", "'LL", "1", "½", "!?", "don't", "日本", "\0", "<unk>", "▁", "😀", "<|endoftext|>", "​", "ſ"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)] + ["a" * 20_000, "é" * 5000, " " * 3000]
    got = list(codec.encode(texts))
    assert got == [plain.encode_ordinary(t) for t in texts]
    assert all(codec.decode(ids) == t.encode() for ids, t in zip(got, texts, strict=True))


def test_a_short_memory_changes_nothing(codec, monkeypatch):
    texts = [f"word{i} Überraschung{i}" for i in range(500)]
    want = list(codec.encode(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert list(codec.encode(texts)) == want


def test_columns(spark, docs, plain):
    texts = [None, "", "plain words", "plain words", "x" * 100_000]
    df = docs(*texts).withColumn("token_ids", F.lit("x")).withColumn("round_trip", F.lit(1)).withColumn("my col", F.lit(2))
    out = bpe.encode_texts(df, PATH, PATTERN, round_trip="round_trip")
    rows = {r["doc_id"]: r for r in bpe.decode_ids(out, PATH, PATTERN).collect()}
    assert [list(rows[i]["token_ids"]) for i in range(5)] == [plain.encode_ordinary(t or "") for t in texts]
    assert all(bytes(r["decoded"]) == (texts[i] or "").encode() and r["round_trip"] and r["my col"] == 2 for i, r in rows.items())
    assert bpe.encode_texts(df.limit(0), PATH, PATTERN).count() == 0


def test_ranks_with_a_gap(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


def test_digests_are_those_of_the_library(spark, plain):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [(None, "x"), (7, None), (7, ""), (8, "z" * 200_000), *map(tuple, spark.read.parquet(path).select("doc_id", "text").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_sha256", F.lit(1))
    ids = [plain.encode_ordinary(t or "") for _, t in rows]
    want = [(i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(rows, ids, strict=True)]
    assert sorted(map(str, bpe.token_digests(df, PATH, PATTERN).collect())) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect())
    assert bpe.token_digests(df.limit(0), PATH, PATTERN).count() == 0


def test_every_pretoken_goes_through_the_model(codec, monkeypatch):
    seen = []
    model = codec.model

    class Spy:
        def encode(self, pieces, **more):
            seen.extend(pieces)
            return model.encode(pieces, **more)

    monkeypatch.setattr(codec, "model", Spy())
    monkeypatch.setattr(codec, "known", {})
    list(codec.encode(["the word the", "the end"]))
    assert sorted(seen) == sorted(bpe.to_piece(x.encode()) for x in ("the", " word", " the", " end"))

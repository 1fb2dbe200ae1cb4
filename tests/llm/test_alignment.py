import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filegrove.llm import alignment
from filegrove.llm.alignment import NUMBERS, aligned, alignment_digests
from filegrove.llm.bpe import from_piece

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Whole texts through both tokenizers, and plain loops: the numbers, the groups, and the counts of all id pairs."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ends(ids, of):
        at, out = 0, []
        for i in ids:
            at += len(of(i))
            out.append((at, i))
        return out

    docs, count = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of = lambda i: from_piece(a.id_to_token(i))
        if not b"".join(map(of, x)) == (" " + text).encode() == b"".join(map(piece, y)):
            docs.append(None)
            continue
        x, y = ends(x, of), ends(y, piece)
        cuts = sorted({e for e, _ in x} & {e for e, _ in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for e, i in x if low < e <= cut) + "|" + ",".join(str(i) for e, i in y if low < e <= cut))
            low = cut
        links = [(i, j) for e, i in x if e in set(cuts) for f, j in y if e == f] if len(x) < 3000 else [(dict(x)[e], dict(y)[e]) for e in cuts]
        count.update(links)
        docs.append((len(x), len(y), len(groups), links, ";".join(groups)))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    rows = [(*d[:3], len(d[3]), sum(count[p] == best[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) if d else (0,) * 6 + ("",) for d in docs]
    return rows, {(i, j): (n, n == best[j]) for (i, j), n in count.items()}


def cases():
    rng = random.Random(2)
    odd = [
        None, "", " ", "  ", "a", " a", "a ", "  two  blanks ", "tab\there", "\n\nx\n y", "a▁b the rest of it", "▁", "the the the <|endoftext|> </s> <s> <0x41>", "naïve café über straße", "日本語 の テキスト", "🙂🙃 🙂",
        "\x00\x01 \x1c x\x1d y", "a b 　c d e​f", "don't we'll I'm", "x" * 3000, "1234567 89 0.5e-7", "é ́ ä", "﻿bom �", "ﬁ ½ Ⅷ", "\r\n x \r\n", "\x85 q   z", "(a) [b] {c}:d;e", "ЖЖЖ жжж",
    ]
    pieces = ["the", "and", " ", "  ", "\n", "ing", "of", "é", "漢", "🙂", "x1", ".", ",", "'s", "\t", " ", "Q", "ous", "▁"]
    odd += ["".join(rng.choices(pieces[: -1 if i % 9 else None], k=rng.randint(1, 60))) for i in range(150)]
    odd += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2000, 0x2100), rng.randrange(0x4E00, 0x4F00), 32])) for _ in range(40)) for _ in range(80)]
    return odd + ["the most common words of the day"] * 7 + ["a▁b the rest of it"]


@pytest.mark.parametrize("small", [False, True])
def test_whole_texts_are_those_of_brute_force(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "BLOCK_CHARS", 50)
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    texts = cases()
    want, pairs = brute(texts)
    assert sum(w[6] == "" for w in want) > 5 and sum(w[2] for w in want) > 1000
    found, counts = aligned(docs(*texts), A, B)
    got = {r["doc_id"]: tuple(r[n] for n in (*NUMBERS, "groups")) for r in found.collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in counts.collect()} == pairs


def test_digests_repeated_ids_and_clashing_names(spark, docs):
    df = docs("the same text", "the same text", "another", None).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id") % 2)).withColumn("block", F.lit("x")).withColumn("refs", F.lit(1)).withColumn("n", F.lit(1))
    want, _ = brute(["the same text", "the same text", "another", None])
    got = sorted(alignment_digests(df, A, B).collect(), key=repr)
    assert got == sorted((type(got[0])(i, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in zip((0, 1, 0, None), want, strict=True)), key=repr)


def test_no_documents_and_none_with_tokens(spark, docs):
    assert alignment_digests(docs(), A, B).count() == 0
    assert [tuple(r) for r in alignment_digests(docs(None, "", "▁x"), A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


def test_a_very_long_text(spark, docs):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioubcdfg", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=20_000)), "".join(rng.choices(words, k=700)), "-" * 2500]
    found, _ = aligned(docs(*texts), A, B)
    got = {r["doc_id"]: r for r in found.collect()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for i, text in enumerate(texts):
        ids = [[x for g in got[i]["groups"].split(";") for x in g.split("|")[side].split(",")] for side in (0, 1)]
        assert [list(map(int, x)) for x in ids] == [a.encode(" " + text).ids, b.encode(text)]
        assert got[i]["n_links"] == got[i]["n_groups"] == got[i]["groups"].count(";") + 1

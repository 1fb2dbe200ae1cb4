import base64
import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_decontaminate
import test_linededup
import test_neardup
from filegrove.llm import quality
from filegrove.llm.common import bucket, written

SMALL = "/root/testdata/sf0.001"


def test_each_stage_is_its_brute_force_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        after = docs.orderBy("doc_id").collect()
        seen[name] = (before, after)
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["quality"]
    model = quality.fit(spark.createDataFrame(before), spark.read.parquet(f"{SMALL}/labels.parquet").where(bucket("doc_id", 5) != 0))
    x = [quality.features(r["text"]) for r in before]
    assert [r["doc_id"] for r in after] == [r["doc_id"] for r, s in zip(before, quality.score_matrix(model, __import__("numpy").stack(x)), strict=True) if s >= 0.3]
    assert 0 < len(before) - len(after) < len(before) / 2

    before, after = seen["line_dedup"]
    assert [r["text"] for r in after] == [t for t, _ in test_linededup.brute([r["text"] for r in before])]
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near_dedup"]
    groups = defaultdict(list)
    for r, label in zip(before, test_neardup.brute([(r["doc_id"], r["text"]) for r in before]), strict=True):
        groups[label].append(r["doc_id"])
    assert [r["doc_id"] for r in after] == sorted(min(g) for g in groups.values()) and len(after) < len(before)

    before, after = seen["decontamination"]
    clean = [r["doc_id"] for r in before if not test_decontaminate.brute(r["text"], benchmark)[4]]
    assert [r["doc_id"] for r in after] == clean

    before, after = seen["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [list(r["token_ids"]) for r in after] == [plain.encode_ordinary(r["text"]) for r in before] and all(r["round_trip"] for r in after)


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, score double"
    rows = [(1, None, None, None, None, "n", 1, 0.5), (None, "", "en", "s", 0, "n", 1, 0.5), (2, "plain text that is short", "en", "s", 24, "n", 1, None), (2, "plain text that is short", "en", "s", 24, "n", 1, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), f"odd-{name}")
        assert docs.count() <= len(some)

import hashlib

from pyspark.sql import functions as F

from filegrove.llm.chat import chat_digests, format_chats, read_chats, with_probe

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

ROWS = [
    (1, 0, "system", "be nice"), (1, 1, "user", "é[INST]\\k<s>"), (1, 2, "assistant", "\\\\b</s>\\l [x]"),
    (2, 1, "assistant", "second"), (2, 0, "user", None),
    (3, 0, "assistant", "starts wrongly"), (3, 1, None, "no role"), (3, 2, "to[ol<:>\\", "odd role\n"),
    (4, 0, "user", ""), (4, 0, "user", ""), (4, 1, "assistant", ""),
    (None, None, "user", "no id"), (5, 0, "user", "only"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (6, 2, "user", "c"), (6, 3, "assistant", "😀d"),
]


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_digests_are_those_of_brute_force(spark):
    probe = "</s>[INST] ok [/INST]"
    want = brute([*ROWS, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    got = {r["conv_id"]: r for r in chat_digests(with_probe(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))


def test_state_machine(spark):
    got = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in format_chats(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), None: (False, 1), 5: (False, 1), 6: (True, None)}


def test_segments_join_to_the_formatted_text_and_read_back(spark):
    for r in format_chats(spark.createDataFrame(ROWS, SCHEMA)).withColumn("back", read_chats(F.col("formatted"))).collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [tuple(t) for t in r["back"]] == brute(ROWS)[r["conv_id"]]


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert format_chats(empty).count() == 0
    assert [r["conv_id"] for r in chat_digests(with_probe(empty)).collect()] == [-1]
    extra = spark.createDataFrame(ROWS, SCHEMA).withColumn("turns", F.lit("x")).withColumn("formatted", F.lit(0)).withColumn("segments", F.lit(1))
    assert chat_digests(extra).count() == 7


def test_the_mask_and_the_marks_say_the_same(spark):
    """Segments in a row are the formatted text; what the loss mask covers in it is what the marks call an assistant's."""
    turns = with_probe(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    for r in format_chats(turns).select("*", read_chats(F.col("formatted")).alias("back")).collect():
        at, masked = 0, []
        for s in r["segments"]:
            assert r["formatted"][at : at + len(s["text"])] == s["text"]
            masked += [s["text"]] * s["learned"]
            at += len(s["text"])
        assert at == len(r["formatted"])
        plain = [m.replace("\\k", "[").replace("\\l", "<").replace("\\b", "\\") for m in masked]
        assert plain == [t["text"] for t in r["back"] if t["role"] == "assistant"]


def test_a_very_long_conversation(spark):
    n = 3000
    turns = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s>[x] "), F.col("id").cast("string"), F.repeat(F.lit("y"), (F.col("id") % 50 * 10).cast("int"))).alias("text"))
    (row,) = chat_digests(turns).collect()
    texts = [f"<s>[x] {i}{'y' * (i % 50 * 10)}" for i in range(n)]
    assert row["n_turns"] == n and row["valid"] and row["loss_chars"] == sum(map(len, texts[1::2]))
    assert row["loss_sha256"] == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(texts)).encode()).hexdigest()

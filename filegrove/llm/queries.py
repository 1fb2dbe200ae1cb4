"""The queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from filegrove.llm import alignment, bpe, chat, decontaminate, filteraudit, langid, linededup, media, neardup, quality, secrets, urlfilter, warc
from filegrove.llm.common import bucket


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark, sf_dir):
    found = neardup.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (~F.col("first")).alias("duplicate"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring_lines(docs).select("doc_id", F.coalesce(F.size(F.split("text", "\n")) + F.col("dropped_lines"), F.lit(0)).alias("n_lines"), "dropped_lines", "text")


def op4_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(bucket("doc_id", 5) != 0))
    scored = quality.score(docs, model, out="score")
    return scored.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.AT_THRESHOLD).cast("int").alias("predicted"))


def op5_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(bucket("doc_id", 4) != 2))
    found = langid.identify(docs.drop("lang"), model)
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), F.col("lang_nearest").alias("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op6_media_columns(spark, sf_dir):
    return media.text_image_features(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat.chat_digests(chat.with_probe(_table(spark, sf_dir, "conversations")))


def op8_secret_scan(spark, sf_dir):
    return secrets.span_digests(_table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark, sf_dir):
    return warc.revisit_digests(_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark, sf_dir):
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_filter_audit(spark, sf_dir):
    return filteraudit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_url_filter(spark, sf_dir):
    return urlfilter.judged_pages(_table(spark, sf_dir, "pages"))


def op13_token_alignment(spark, sf_dir):
    return alignment.alignment_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_minhash_neardup, op2_decontamination, op3_line_dedup, op4_quality, op5_language_id, op6_media_columns, op7_chat_format, op8_secret_scan, op9_warc_revisits, op10_byte_bpe, op11_filter_audit, op12_url_filter, op13_token_alignment)}
ORACLES: dict[str, str] = {
    "op1_minhash_neardup": neardup.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
    "op11_filter_audit": filteraudit.ORACLE,
}

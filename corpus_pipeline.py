"""From documents to token ids in five stages, each on all that its predecessor kept.

run() writes each stage's result as a table in the shared folder and reads it again, so that a lost executor costs one stage
at most; the table before it and what the stage made for itself go then. ORACLE_SQL is None: ranking, signatures and merges can't be expressed in SQL; the tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegrove.llm import bpe, decontaminate, linededup, neardup, quality
from filegrove.llm.common import bucket, fresh, written
from filegrove.operators.tables import Scope


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the threshold; learned from the labels that aren't held out."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket("doc_id", 5) != 0))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.AT_THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; n_chars as the texts now are. What only the copies of one text share
    doesn't recur (see linededup.Tree), so the next stage still finds copies nearly as they were."""
    (dropped,) = fresh(docs, "dropped")
    out = linededup.drop_recurring_lines(docs, dropped=dropped)
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark windows."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contamination.contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids decode to the text's bytes."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode_texts(docs.select("doc_id", "text", "lang", "source", "n_chars"), vocabulary, pattern, round_trip="round_trip")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", keep_first_copies), ("decontamination", drop_contaminated), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scope() as stages:
        for name, stage in STAGES:
            with Scope() as inner:
                made = inner.kept(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            stages.drop(docs)  # nothing reads it any more
            docs = made
        return stages.kept(docs)

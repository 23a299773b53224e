"""Pipeline over ``documents``: toxicity, language, repeated passages, near duplicates, packing.

Each stage takes all that the one before kept. The first four return the columns of ``documents`` (``n_chars`` follows the text), the
last one row per piece of a packed sequence. ``run`` writes each stage's result to the shared folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import language_id, line_dedup, near_dedup, packing, toxicity
from marlstone.llm._shared import stash
from marlstone.llm.queries import SEQUENCE, tokenizer

LANGUAGE_FLOOR = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window at or over the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learnt language, go."""
    return language_id.keep_known(docs, language_id.train(docs), LANGUAGE_FLOOR)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks, and passages of 50 or more words, that an earlier document has go; every document stays."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8) stays."""
    kept = near_dedup.near_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), SEQUENCE, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

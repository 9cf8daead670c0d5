"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage's result is written as Parquet to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, line_dedup, sentencepiece, simhash, toxicity
from chronoloom.llm.common import documents, id_crc, shared_path

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5
#: Share of common shingles from which documents are near-duplicates.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold. It learns from the labels that op4 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = ~F.coalesce(id_crc("_id") % 3 == 1, F.lit(False))
    found = toxicity.scored(docs, labels, learnt)
    return found.where(F.col(found.columns[-1]) < toxicity.THRESHOLD).drop(found.columns[-1])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier run of lines."""
    found = line_dedup.line_dedup(docs)
    return found.drop(*found.columns[-2:]).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows with the smallest doc_id (and rows without an id, which cannot be named).

    Rows go by id and text, so one that only shares its id with a near copy stays.
    """
    groups = simhash.near_groups(docs, SHINGLE, SIMILARITY)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_text")).distinct()
    # The columns go by number meanwhile, so that none clashes with these.
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    own_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    return numbered.join(gone, (own_id == F.col("gone_id")) & (simhash.text_md5(text) == F.col("gone_text")), "left_anti").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; each row is decided by its own text."""
    found = decontaminate.flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col(found.columns[-1])).drop(found.columns[-1])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its SentencePiece ids' number and crc32, and whether decoding gives the text again."""
    return sentencepiece.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Fingerprints, the classifier and the tokenizer cannot be put in SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

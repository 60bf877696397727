"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again: toxic documents go, then those of poor
quality, then all but one of each class of near duplicates; what is left is packed into token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import jaccard_join, packing, quality, toxicity
from tidepanel.llm.common import free_shuffles, table
from tidepanel.llm.queries import WORD_VOCABULARY
from tidepanel.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. All columns stay; an empty table stays empty."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; empty texts go. All columns stay."""
    return quality.without_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class that links of similarity 0.8 connect. All columns stay."""
    return jaccard_join.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets, as ``op7_packing`` returns them."""
    return packing.packed_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("jaccard_join", drop_near_duplicates),
    ("packing", pack),
]

#: Stages train models and use a tokenizer, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        free_shuffles(spark)  # of this stage: the next one needs its output alone
    return docs

"""A training corpus from raw documents: toxic documents go, then exact copies, then near copies; sources are
brought to their weights; what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes each
stage's result into the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestry.llm import cuckoo, minhash, mixing, packing, toxicity
from contestry.llm.queries import tokenizer
from contestry.session import Stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier does not reject."""
    return toxicity.keep_rows(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return cuckoo.keep_rows(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 or more."""
    return minhash.keep_rows(spark, docs, size=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source with the same weight, as many documents as before on average, globally shuffled."""
    return mixing.replicate(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, **tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus, made from all documents of ``sf_dir``."""
    stage = Stage(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), f"stage{i}")
    return docs

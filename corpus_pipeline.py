"""A training corpus from ``documents``: toxic and near-duplicate documents and benchmark leaks go, sources are mixed, shards dealt out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, jaccard, mixing, sharding, toxicity
from quadrille.llm.common import checkpoint_folder, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, fitted to all labels that these documents have, rejects go."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.clean(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams at a similarity of 0.8, the one of the least doc_id stays."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 7, and their slot in it."""
    return sharding.shard(docs, shards=8)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to and read from the shared checkpoint folder, but for the last."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""The corpus pipeline: each stage reads what the one before wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages that learn or compare with other
tables read those from sf_dir. All but the last return the columns of documents, and the rows they keep
whole. In every stage a null or empty text is a clean document of its own, repeated rows are handled
each (but where the near duplicates keep one), texts are read whole, and an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from kindred.llm.common import remove, shared_folder, table

SHARDS = 16


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not call toxic (score below 0.7). Without labels or documents nothing is toxic."""
    grammar = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, grammar).where("predicted = 0").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each class of the n-gram Jaccard join; null ids count as one id, below all."""
    return near_duplicates.deduplicated(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target says: null sources are one source, those without words are left out."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records shuffled into shards, with shard and slot; copies of a record have slots of their own."""
    return sharding.document_shards(docs, shards=SHARDS)


STAGES = [("toxicity", not_toxic), ("near duplicates", one_of_each), ("decontamination", not_leaked), ("mixing", mixed), ("sharding", sharded)]

#: A stage learns weights and others verify by hashes: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

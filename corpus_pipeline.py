"""A training-data pipeline of five corpus operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. Stages 1 to 4 return the columns of ``documents``.
Rows that share an id go or stay together; null texts pass every filter, but the mix, which
takes words, has none of them to take. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm.common import read, stored, without_ids
from rankweave.llm.decontamination import decontaminate
from rankweave.llm.mixing import mixed_documents
from rankweave.llm.near_dedup import near_dedup
from rankweave.llm.sharding import shard_documents
from rankweave.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine (trained on ``labels``) rejects go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    groups = near_dedup(docs)
    return without_ids(docs, groups.where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a ``benchmark`` item go."""
    hits = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return without_ids(docs, hits.where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many words, as the mix takes them."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row."""
    return shard_documents(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained scores, signatures and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

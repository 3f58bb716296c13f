"""From raw documents to shards: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents as they came, whatever
other columns they have and whatever these are called (dots and the names that
operators use inside included).  Null texts and texts without a word go in the
first stage.  Rows that are equal tie and share their fate, up to one of each
group in near_dedup.  Very long texts are read whole by every stage.  Empty
tables pass through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corrente.llm import decontaminate, mixing, neardup, quality, sharding
from corrente.llm.common import removed, shared_folder, table

SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling does not draw go; the rate is the share of good ones among the labels."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: that of the smallest id."""
    return neardup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go, however long they are."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 times."""
    return mixing.mixed(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it; own columns of these names stay, and the added ones get an underscore before theirs."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("shard", shard_stage)]

#: Models and random processes decide; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again; only the last one's files stay, as the result reads them."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        if before:
            removed(spark, f"{home}/{before}")
        docs, before = spark.read.parquet(f"{home}/{name}"), name
    return docs

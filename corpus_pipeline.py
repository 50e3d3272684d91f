"""From raw documents to training shards: five stages, each on all that the one before kept.

Operators are imported where they are used, so that this module loads without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    from ledgerjobs.llm import quality

    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    from ledgerjobs.llm import neardup

    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    from ledgerjobs.llm import decontamination

    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from ledgerjobs.llm import mixing

    return mixing.repeated(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    from ledgerjobs.llm import sharding

    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned classifier and minhashing cannot be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table, and what the stages staged for it, is dropped once the next one is written.

    Null ids, null and empty texts, repeated rows and empty tables go through all stages as the
    operators define it; without documents the result is empty, without benchmark items or
    labels nothing is taken for contaminated or rejected on their account.
    """
    from ledgerjobs.llm.common import Workspace, gathered

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark)
    for name, stage in STAGES:
        with gathered() as made:
            docs = space.stage(stage(spark, docs, sf_dir), name)
        for used in made:
            used.drop()
        space.drop(docs)
    return docs

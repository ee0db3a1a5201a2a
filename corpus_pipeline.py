"""Documents to shards: quality rules, near-duplicates, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents; the last returns
doc_id, size, text_crc32, law, shard, slot and virtual_slot of every row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktab.llm import decontaminate, mixing, neardup, quality, sharding
from sparktab.llm.common import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are more likely bad than good go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.emit(docs)


def shard_assignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row of the mix."""
    return sharding.assign(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", source_mixing), ("sharding", shard_assignment)]

#: The stages fit models, follow links and hash with functions that SQL engines don't share; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

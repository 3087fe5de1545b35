"""The corpus pipeline: documents through five stages of cairnflow.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm.boosted_rules import quality_stage
from cairnflow.llm.common import cut, table
from cairnflow.llm.mixing import mixing_stage
from cairnflow.llm.packing import packing_stage
from cairnflow.llm.simhash import dedup_stage
from cairnflow.llm.suffix_dedup import repeats_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("suffix_dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the first two could be told in SQL over whole tables; tests/llm/test_pipeline.py holds all five against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

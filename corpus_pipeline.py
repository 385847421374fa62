"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollmill.llm import stages
from rollmill.llm.common import materialize

STAGES = stages.STAGES

#: Near copies and tokens have no form in SQL; tests/llm/test_pipeline_by_hand.py compares every row of run() with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

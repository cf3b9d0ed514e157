"""Corpus pipeline: stages applied to documents one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import stored
from gridloom.llm.stages import encode_stage, mix_stage, near_duplicate_stage, quality_stage, substring_stage

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table, each to what the one before wrote."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, stored(out, f"stage-{k}") if k else out, sf_dir)
    return out

"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.

In every stage rows are judged as they come, whatever their number: an empty table gives an empty one, other columns are left behind, equal
rows are documents of their own unless a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, ngram_join, quality_rules, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text is too short and goes; a null id is like any other."""
    judged = quality_rules.measures(docs, keep=["text", "lang", "source", "n_chars"])
    return judged.filter(~quality_rules.failed()).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id. Null ids and empty texts link with nothing and stay; rows of one id are one
    document, of which all rows stay or go."""
    found = ngram_join.classes(docs)
    gone = found.filter("component_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller ids have; those that lose all their words go. A text that loses nothing stays as it
    is, empty and null (as the empty text) ones too; a row with a null id loses nothing."""
    cleaned = substring_dedup.dedup(docs, carry=("lang", "source"), as_is=True)
    left = cleaned.filter("n_removed = 0 OR n_removed < n_words").withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as documents, once or twice each. Null sources are a source, texts without words are in no mix."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix; a null text has no tokens and decodes to the empty one."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.round_trip(docs, path))

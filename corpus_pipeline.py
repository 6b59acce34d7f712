"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each result as Parquet into the shared folder and rereads it as
the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import order_minhash, packing, quality_rules, rule_ensemble, shared
from sluice.llm.queries import table

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.3


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the others of their language and source."""
    return quality_rules.judge(docs).filter("__kept").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones of ``documents``, does not reject."""
    model = rule_ensemble.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model).filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return order_minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("quality_rules", drop_outliers), ("quality_classifier", drop_low_quality), ("near_dedup", drop_copies), ("packing", pack)]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

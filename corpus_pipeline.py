"""From raw documents to packed training sequences, in stages that each write their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import packing, quality, rules, simhash, suffixes
from strandline.llm.common import documents, ship, written
from strandline.llm.subwords import default_path
from strandline.session import tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of the current policy keep."""
    return rules.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, learned from labels of documents not held out.

    It learns from the whole table: the rules before it reject what is labelled bad.
    """
    ship(spark)
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id: 4-word SimHash fingerprints within 4 bits."""
    ship(spark)
    return simhash.representatives(docs, shingle=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; no document goes, but its text may be empty."""
    ship(spark)
    return suffixes.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    ship(spark)
    return packing.digest(packing.pack(docs, default_path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: Packing and the classifier are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    tune(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

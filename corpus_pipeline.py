"""Corpus pipeline: toxicity, quality, exact and near duplicates, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  ``run`` writes each stage's result as Parquet in
the shared checkpoint folder and reads it back as the next stage's ``docs``.  All stages but the last return the
columns of documents; the last returns the packed pieces.

An empty table, null texts or ids, repeated rows and extra columns are handled by the operators, whose docstrings
say how.  No stage reads more than its predecessor's rows and, for the two models, the labels of those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, genetic_packing, ngram_join, quality_gam, toxic_passages
from riskloom.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_passages.reject(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.reject(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return genetic_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_duplicates", exact_duplicates),
          ("near_duplicates", near_duplicates), ("packing", packing)]

#: The two models and the packing cannot be stated in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

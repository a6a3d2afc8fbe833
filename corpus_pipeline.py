"""Corpus pipeline over ``documents``: ``STAGES`` in order, each written as Parquet and
read again as the next stage's input.

1. quality_rules: documents that the repetition rules reject go;
2. toxicity: documents with a score of 0.5 or more go (learned from the labelled documents
   of the stage's own input that are not held out);
3. simhash_near_dedup: of each component of fingerprints at two bits or less, the document
   with the least id stays (3-word shingles);
4. pii: personal data is replaced by surrogates;
5. packing: the documents' sequences with bucket, batch and place.

All stages but the last return the columns of their input, whatever they are.  An empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shockspark.llm.common import table, written
from shockspark.llm.packing import byte_length, pack
from shockspark.llm.quality import keep_quality
from shockspark.llm.queries import PII_KEY
from shockspark.llm.simhash import keep_one
from shockspark.llm.surrogates import replace_personal_data
from shockspark.llm.toxicity import keep_clean, train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=3, distance=2)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replace_personal_data(docs, PII_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, byte_length())


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

#: A trained model decides in stage 2, which SQL cannot say; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

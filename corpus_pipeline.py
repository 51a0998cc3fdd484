"""Corpus pipeline: documents in, packed training sequences out.

Five stages, each one of the operators of ``ledgerlens.llm``; each works on all rows
its predecessor kept, written as Parquet under the shared checkpoint folder and
reread.  All stages but the last return the columns of ``documents``.

1. toxicity: documents scored toxic by the boosted trees go (trained on the
   labels of the folder's ``labels`` table).
2. exact_dedup: of equal texts the row with the smallest doc_id stays.
3. near_dedup: one document of each class of near-duplicates stays.
4. mixing: sources are mixed to their target weights; a document is repeated
   as often as the mix takes its words, rounded (0, 1 or 2 times).
5. packing: the mix's token sequences, one row per piece.

Nulls, empty tables, repeated rows and extra columns are handled as the operators'
docstrings say; a document without words is not part of a mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact_dedup, minhash, mixing, packing, toxicity
from ledgerlens.llm.common import ship_package
from ledgerlens.session import cut_lineage


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.keep_first(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.keep_one(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

# Boosted trees, signatures and tokenizer are beyond SQL; tests hold every stage against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir), f"pipeline_{name}")
    return rows


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

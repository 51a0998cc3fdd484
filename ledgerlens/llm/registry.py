"""Named queries of the corpus operators: ``(spark, sf_dir) -> DataFrame``.

Each applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (conversation_repair, exact_dedup, html_extract, minhash, mixing, packing, pii, quality, secrets,
               token_alignment, token_files, topk_search, toxicity)
from .common import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op1_query(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_query(table(spark, sf_dir, "documents"))


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4_query(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op6_query(table(spark, sf_dir, "documents"))


def op7_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op10_query(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5_query(table(spark, sf_dir, "documents"))


def op8_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8_query(table(spark, sf_dir, "documents"))


def op9_html_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op9_query(table(spark, sf_dir, "pages"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op11_query(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op12_query(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.op13_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity_trees": op3_toxicity_trees,
    "op4_pack_sequences": op4_pack_sequences,
    "op6_token_files": op6_token_files,
    "op7_quality_forest": op7_quality_forest,
    "op10_exact_dedup": op10_exact_dedup,
    "op5_pii_spans": op5_pii_spans,
    "op8_secret_novelty": op8_secret_novelty,
    "op9_html_recurrent": op9_html_recurrent,
    "op11_topk_search": op11_topk_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_topk_search": topk_search.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}

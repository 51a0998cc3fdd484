"""Catalog access: SQL over registered tables, table scans, reuse."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Register frames as temporary views (``project.dataset.table``
    names become plain view names)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table or view by name."""
    return spark.table(name)


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Run SQL text over registered tables; returns a lazy DataFrame."""
    return spark.sql(sql)


@contextmanager
def reused(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a frame cached while several results read it, then release it.

    Lost cached blocks are recomputed from lineage, so reuse survives
    executor loss.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()

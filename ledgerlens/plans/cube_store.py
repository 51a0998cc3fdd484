"""A stored cube: mergeable measures by month, rebuilt only where rows arrive.

Two Parquet tables below one folder, both partitioned by (Year, Month):

* ``cells``: the six-key cells with counts, exact sums and the number of known
  amounts (so means can be merged) and the cell's unique users;
* ``users``: bitmaps of the users of every cell (see ``operators.distinct``).

``load`` adds a batch of clean transactions: the batch alone is aggregated, and
only the partitions of its months are read, merged and overwritten; all other
files stay as they are.  ``cube`` gives the stored cube in the shape of
``build_cube``; ``unique_users`` counts the users of any selection and grouping exactly
from the stored bitmaps.

A load is two partition overwrites, cells last.  Adding users again changes
nothing (a bitmap knows who it has), so a load that failed between the two is
repeated whole; one that failed before the cells were committed has not counted
its rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MONEY, col
from ..operators.aggregates import count_true
from ..operators.distinct import BUCKET, bitmap_size, count_bitmaps, distinct_bitmaps
from ..operators.relational import in_lists
from ..session import cut_lineage, scratch_scope
from ..sources.sinks import check_codec
from .cube import CELL_MONEY, CUBE_KEYS, STATE, YEAR, clean_transactions, cube_dashboard, read_transactions_csv

MONTH_KEYS = ["Year", "Month"]
BATCH_COLUMNS = ["User", "amount_clean", "has_error"]        # what a load reads beside the keys
CELLS, USERS = "cells", "users"
# measures that add up over batches
ADDED = {"total_transactions": "bigint", "amount": CELL_MONEY, "known_amounts": "bigint", "error_count": "bigint"}


def batch_cells(clean: DataFrame) -> DataFrame:
    """Mergeable measures of a batch per cell."""
    cents = F.col("amount_clean").cast(MONEY)
    return clean.groupBy(*[col(k) for k in CUBE_KEYS]).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(cents), F.lit(0)).cast(CELL_MONEY).alias("amount"),
        F.count(cents).alias("known_amounts"),
        count_true("has_error").cast("bigint").alias("error_count"))


def _months(batch: DataFrame) -> list[tuple]:
    """The (Year, Month) pairs of a batch: partition names, a few per year of data."""
    return [tuple(r) for r in batch.select(*MONTH_KEYS).distinct().collect()]


def _in_months(months: Sequence[tuple]) -> Column:
    """A partition filter, null-safe."""
    same = [reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.lit(v)) for k, v in zip(MONTH_KEYS, m)]) for m in months]
    return reduce(lambda a, b: a | b, same, F.lit(False))


class CubeStore:
    """The cube at ``path``; absent tables count as empty."""

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd"):
        self.spark, self.path, self.compression = spark, path.rstrip("/"), check_codec(compression)

    def _read(self, name: str) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return df.select(*[col(k) for k in CUBE_KEYS], *[c for c in df.columns if c not in CUBE_KEYS])

    def _overwrite_months(self, df: DataFrame, name: str) -> None:
        """``df``: its months lie together (a large one in several tasks, small ones share a task)."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", self.compression).partitionBy(*MONTH_KEYS).parquet(f"{self.path}/{name}"))

    def load(self, clean: DataFrame) -> list[tuple]:
        """Add a batch of clean transactions; returns the months that were rebuilt.

        The batch is read twice (cells, users): pass a written frame when its lineage is expensive."""
        with scratch_scope(self.spark):
            return self._load(clean)

    def _load(self, clean: DataFrame) -> list[tuple]:
        cells = cut_lineage(batch_cells(clean), "batch_cells")
        months = _months(cells)
        if not months:
            return months
        old_cells, old_users = self._read(CELLS), self._read(USERS)
        known = None if old_users is None else old_users.where(_in_months(months))
        users = distinct_bitmaps(clean, CUBE_KEYS, "User", known, MONTH_KEYS)
        # months lie together, in key order; the old files are replaced when all new ones are written
        self._overwrite_months(users.sortWithinPartitions(*[col(k) for k in CUBE_KEYS], BUCKET), USERS)
        users = self._must(USERS).where(_in_months(months))
        if old_cells is not None:
            cells = old_cells.where(_in_months(months)).select(cells.columns).unionByName(cells)
        none = {c: F.lit(0).cast(t).alias(c) for c, t in ADDED.items()}
        counted = cells.withColumn("unique_users", F.lit(0).cast("bigint")).unionByName(
            users.select(*[col(k) for k in CUBE_KEYS], *none.values(), bitmap_size().alias("unique_users")))
        merged = counted.groupBy(*[col(k) for k in CUBE_KEYS]).agg(
            *[F.sum(c).cast(t).alias(c) for c, t in ADDED.items()], F.sum("unique_users").alias("unique_users"))
        merged = cut_lineage(merged, "merged_cells")
        self._overwrite_months(merged.hint("rebalance", *[col(k) for k in MONTH_KEYS]), CELLS)
        return months

    def load_csv(self, path: str | Sequence[str], file_columns: Sequence[str] | None = None) -> list[tuple]:
        """A further run of the ETL: only the new files are read."""
        return self.load(clean_transactions(read_transactions_csv(self.spark, path, file_columns)))

    def _must(self, name: str) -> DataFrame:
        df = self._read(name)
        if df is None:
            raise FileNotFoundError(f"cube not found at {self.path}: load a batch first")
        return df

    def cube(self) -> DataFrame:
        """The stored cells in the shape of ``build_cube``."""
        total = F.col("amount").cast("double")
        return self._must(CELLS).select(
            *[col(k) for k in CUBE_KEYS], "total_transactions", total.alias("total_amount"),
            F.when(F.col("known_amounts") > 0, total / F.col("known_amounts")).alias("avg_amount"),
            "error_count", "unique_users")

    def unique_users(self, by: Sequence[str] = (), years: Sequence[int] | None = None,
                     states: Sequence[str] | None = None, name: str = "unique_users") -> DataFrame:
        """Exact distinct users of a selection, per ``by`` (any of the cube's keys).

        Reads the stored bitmaps alone; years prune partitions."""
        return count_bitmaps(in_lists(self._must(USERS), **{YEAR: years, STATE: states}), by, name)

    def dashboard(self, years: Sequence[int] | None = None, states: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The card dashboard's figures on the stored cube, with the selection's unique users."""
        return {**cube_dashboard(self.cube(), years, states), "unique_users": self.unique_users((), years, states)}

"""Aggregation helpers (DataFrame -> DataFrame, Column aggregates)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def n_unique(c) -> Column:
    """Exact distinct count where null counts as one more value.

    Spark's ``count(DISTINCT c)`` skips nulls; the source counts them.
    Catalyst plans the distinct part as a two-level aggregation (keys + c,
    then keys), each level partially aggregated map-side, so a hot group is
    spread over many tasks.  Not additive: never re-sum over groups.
    """
    return F.count_distinct(col(c)) + F.max(F.when(col(c).isNull(), F.lit(1)).otherwise(F.lit(0)))


def count_true(c) -> Column:
    """Number of rows where ``c`` is true (0, never null)."""
    return F.count_if(col(c))


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = (),
          descending: bool = True) -> DataFrame:
    """``ORDER BY by DESC, tiebreak... LIMIT k`` (``TakeOrderedAndProject``:
    each task keeps its own k best, the driver merges k x tasks rows)."""
    order = [F.desc_nulls_last(col(by)) if descending else F.asc_nulls_first(col(by))]
    order += [F.asc_nulls_first(col(t)) for t in tiebreak]
    return df.orderBy(*order).limit(k)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Sorted non-null distinct values of one column (a slicer domain)."""
    return df.select(col(name)).where(col(name).isNotNull()).distinct().orderBy(col(name))


def category_share(df: DataFrame, name: str) -> DataFrame:
    """``value_counts(normalize=True, dropna=False)``: rows and share per value.

    The total is the sum of the counts themselves (same subtree, so the
    count exchange is reused - one scan), joined back as a one-row
    broadcast; null is a value of its own.
    """
    counts = df.groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return (counts.crossJoin(F.broadcast(total))
            .select("value", "n", (F.col("n") / F.col("__total")).alias("share")))

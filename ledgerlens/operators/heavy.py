"""Values that reach a share of all rows, without shuffling all distinct values.

Per column a bounded sketch is counted first: every value falls into one of ``WIDTH``
buckets under each of ``HASHES`` hash functions, and a bucket's rows are at least those
of any value in it.  So a value of ``share >= threshold`` lies in buckets that reach the
threshold under every function, of which there are at most 1/threshold each, and no
frequent value is ever missed.  Only values in such buckets (candidates) are then
counted exactly; the chance that a rare value is one is about
(1 / (threshold * WIDTH)) ** HASHES, 1.5e-6 at 5 %.

Two scans of the columns (and a count of rows).  The first shuffles at most columns * HASHES * WIDTH counts a
task, the second the candidates' counts a task; a column of any number of distinct values
costs the same.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage

WIDTH = 16_384
HASHES = 2


def _bucket(value: Column, function: int, width: int) -> Column:
    """Bucket of a value; null has a bucket of its own."""
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(value, F.lit(function)), F.lit(width)).cast("int"))


def _pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of every row and column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.column", "p.value")


def heavy_buckets(df: DataFrame, columns: Sequence[str], threshold: float, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """(column, function, bucket) of the buckets that reach the threshold: at most
    columns * hashes / threshold rows, whatever the data."""
    placed = _pairs(df, columns).select("column", F.explode(F.array(*[
        F.struct(F.lit(i).alias("function"), _bucket(F.col("value"), i, width).alias("bucket")) for i in range(hashes)])).alias("b"))
    counts = placed.groupBy("column", "b.function", "b.bucket").agg(F.count(F.lit(1)).alias("n"))
    # every row falls into one bucket per column and function
    total = counts.agg((F.sum("n") / F.lit(len(columns) * hashes)).alias("__total"))
    return (counts.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("__total") >= F.lit(float(threshold)))
            .select("column", "function", "bucket"))


def candidates(df: DataFrame, columns: Sequence[str], threshold: float, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """(column, value) of the rows whose value lies in heavy buckets under every function."""
    # a few rows, written: the functions' joins below read them instead of counting again
    heavy = cut_lineage(heavy_buckets(df, columns, threshold, width, hashes), "heavy_buckets")
    rows = _pairs(df, columns)
    for i in range(hashes):
        mine = (heavy.where(F.col("function") == i)
                .select(F.col("column").alias("__c"), F.col("bucket").alias("__b")))          # bounded, see heavy_buckets
        rows = rows.join(F.broadcast(mine), (F.col("column") == F.col("__c"))
                         & (_bucket(F.col("value"), i, width) == F.col("__b")), "left_semi")
    return rows


def frequent_values_bounded(df: DataFrame, columns: Sequence[str], threshold: float,
                            width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """(column, value, n, share) of every value with ``share >= threshold``, exactly as
    a full count gives it; null is a value."""
    counts = (candidates(df, columns, threshold, width, hashes)
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    found = (counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total"))
             .where(F.col("share") >= F.lit(float(threshold))).drop("__total"))
    return cut_lineage(found, "frequent_values")         # at most columns / threshold rows

"""Rare-category collapse (``map_rare_categories`` of the survey ETL)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .heavy import frequent_values_bounded

# Fixed values of the survey cleaning step.
CATEGORY_THRESHOLD = 0.05
OTHER = "OTROS"
MISSING = "DESCONOCIDO"

_SEP = "\u0001"


def max_frequent(threshold: float) -> int:
    """Upper bound of values whose share can reach ``threshold``."""
    return int(math.floor(1.0 / threshold + 1e-9))


def frequent_values(df: DataFrame, columns: Sequence[str],
                    threshold: float = CATEGORY_THRESHOLD) -> DataFrame:
    """(column, value, n, share) for every value with ``share >= threshold``.

    One scan emits (column, value) pairs into a partially aggregated count
    (map-side combine: a hot value costs one row per task).  Every row
    emits exactly one pair per column, so the row total is the sum of all
    counts divided by the number of columns - read from the same counts,
    no second scan.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    counts = (df.select(pairs.alias("p")).select("p.column", "p.value")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg((F.sum("n") / F.lit(len(columns))).alias("__total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn("share", F.col("n") / F.col("__total"))
            .where(F.col("share") >= F.lit(float(threshold)))
            .drop("__total"))


def fill_missing(df: DataFrame, columns: Sequence[str], missing: str | None = MISSING) -> DataFrame:
    """Cast ``columns`` to text and replace null by ``missing``."""
    text = (lambda c: F.coalesce(col(c).cast("string"), F.lit(missing))) if missing is not None \
        else (lambda c: col(c).cast("string"))
    return df.select(*[text(c).alias(c) if c in columns else col(c) for c in df.columns])


def frequent_keys(filled: DataFrame, columns: Sequence[str],
                  threshold: float = CATEGORY_THRESHOLD, many_values: bool = False) -> DataFrame:
    """One-column frame of ``column<SEP>value`` keys that are frequent
    (at most ``len(columns)/threshold`` rows)."""
    count = frequent_values_bounded if many_values else frequent_values
    return count(filled, columns, threshold).select(
        F.concat(F.col("column"), F.lit(_SEP), F.col("value")).alias("__fkey"))


def map_rare(filled: DataFrame, keys: DataFrame, columns: Sequence[str],
             other: str = OTHER) -> DataFrame:
    """Replace each value of ``columns`` not listed in ``keys`` by ``other``.

    The same tiny build side serves every column: it is broadcast once
    (the plan shows it reused) and each column costs one hash probe in the
    pipeline stage of the scan.
    """
    out = filled
    for i, c in enumerate(columns):
        probe = F.concat(F.lit(c + _SEP), col(c))
        out = (out.join(F.broadcast(keys), probe == F.col("__fkey"), "left")
               .withColumnRenamed("__fkey", f"__hit{i}"))
    mapped = {c: F.when(F.col(f"__hit{i}").isNotNull(), col(c)).otherwise(F.lit(other))
              for i, c in enumerate(columns)}
    return out.select(*[mapped[c].alias(c) if c in mapped else col(c) for c in filled.columns])


def collapse_rare(df: DataFrame, columns: Sequence[str], threshold: float = CATEGORY_THRESHOLD,
                  other: str = OTHER, missing: str | None = MISSING, many_values: bool = False) -> DataFrame:
    """Replace values whose share of rows is below ``threshold`` by ``other``.

    Per column, independently: nulls first become ``missing`` (which may
    itself collapse), the share is ``rows with value / all rows`` in double
    precision and the test is inclusive (``share >= threshold`` is kept).
    An existing ``other`` value merges with the collapsed ones.  Collapsed
    columns come out as text; absent columns are skipped.

    Two passes over ``df`` (count, then map; three with ``many_values``, for columns of
    millions of distinct values, which are then never shuffled): pass a materialized frame when
    its lineage is expensive.  At most ``1/threshold`` values per column can
    be frequent, so the key table holds at most ``len(columns)/threshold``
    rows whatever the data size (a proven bound) and is broadcast.  No window,
    no collect.
    """
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    filled = fill_missing(df, cols, missing)
    return map_rare(filled, frequent_keys(filled, cols, threshold, many_values), cols, other)

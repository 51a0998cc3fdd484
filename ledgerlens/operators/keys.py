"""Dense surrogate keys 1..n over distinct natural keys.

``row_number() over (order by k)`` would pull every row into a single task.
Instead the distinct keys are range-partitioned and sorted, each row gets
its position inside its partition from ``monotonically_increasing_id``
(partition index in the upper 31 bits, position in the lower 33), the
tagged rows are written to the shared folder so positions are fixed data
(a lost executor re-reads them instead of re-sampling the range bounds),
and each partition's offset comes from a tiny per-partition count table
(one row per partition, broadcast).  Keys are ordered by the natural keys
ascending, nulls first.  The finished key table is written as well, so
its users read a plain table.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage

_POS_BITS = 33


def surrogate_key(df: DataFrame, keys: Sequence[str], name: str,
                  num_partitions: int | None = None) -> DataFrame:
    """Distinct ``keys`` of ``df`` plus ``name`` = 1..n in key order.

    The number of tasks follows the distinct keys (AQE coalesces the sorted
    partitions by their size), whatever the number of rows.
    """
    order = [col(k).asc_nulls_first() for k in keys]
    distinct = df.select(*[col(k) for k in keys]).distinct()
    ranged = (distinct.repartitionByRange(num_partitions, *order) if num_partitions
              else distinct.repartitionByRange(*order))
    tagged = cut_lineage(ranged.sortWithinPartitions(*order)
                         .withColumn("__mid", F.monotonically_increasing_id()), f"sk_{name}_tagged")
    tagged = (tagged.withColumn("__pid", F.shiftright(F.col("__mid"), _POS_BITS))
              .withColumn("__pos", F.col("__mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    # one row per partition: a window over it is trivially small
    offsets = (tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.coalesce(F.sum("__n").over(
                   Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("__pid", "__off"))
    keyed = (tagged.join(F.broadcast(offsets), "__pid")
             .select(*[col(k) for k in keys],
                     (F.col("__off") + F.col("__pos") + F.lit(1)).cast("bigint").alias(name)))
    return cut_lineage(keyed, f"sk_{name}")


def extend_keys(known: DataFrame | None, df: DataFrame, keys: Sequence[str], name: str,
                num_partitions: int | None = None) -> DataFrame:
    """Keys that stay the same across loads: the stored map ``known`` (``keys`` and
    ``name``) with what is new in ``df``.

    A natural key of the map keeps its number whether or not it occurs again; new ones
    are numbered after the greatest, in key order, by the range-partitioned ranks of
    :func:`surrogate_key`.  Null is a value of its own and matches null.  A load without
    anything new gives the same map; ``known=None`` is the first load."""
    if known is None:
        return surrogate_key(df, keys, name, num_partitions)
    held = known.select(*[col(k).alias(f"__held{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__held{i}")) for i, k in enumerate(keys)])
    fresh = surrogate_key(df.select(*[col(k) for k in keys]).distinct().join(held, same, "left_anti"),
                          keys, name, num_partitions)
    greatest = known.agg(F.coalesce(F.max(col(name)), F.lit(0)).alias("__greatest"))      # one row
    numbered = fresh.crossJoin(F.broadcast(greatest)).select(
        *[col(k) for k in keys], (col(name) + F.col("__greatest")).cast("bigint").alias(name))
    return known.select(*[col(k) for k in keys], col(name).cast("bigint").alias(name)).unionByName(numbered)

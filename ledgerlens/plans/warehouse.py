"""Warehouse query patterns: top-k, CTE + full outer join, date-sharded
wildcard scans, create-table-as-select, monthly growth with windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, default_to, month_of, month_start, parse_yyyymmdd
from ..operators.relational import all_but, full_outer_using
from ..session import cut_lineage
from ..sources.catalog import query, register
from ..sources.files import read_sharded
from ..sources.sinks import create_table_as

# Q1 as SQL text over a registered view (the catalog path of the API).
STATE_TOTALS_SQL = """
SELECT {key}, CAST(SUM(number) AS DOUBLE) AS total_count
FROM {view}
GROUP BY {key}
ORDER BY total_count DESC, {key}
LIMIT {k}
"""


def state_totals(spark: SparkSession, names: DataFrame, k: int = 50,
                 view: str = "usa_names", key: str = "state") -> DataFrame:
    """Sum of ``number`` per state (or another ``key``), the ``k`` largest."""
    register(spark, {view: names})
    return query(spark, STATE_TOTALS_SQL.format(view=view, k=int(k), key=f"`{key}`"))


def popular_names(names: DataFrame, states: list[str], min_total: float = 0,
                  min_share: float | None = None, k: int = 10) -> DataFrame:
    """(state, name, total) of the ``k`` largest names of each state whose total
    exceeds ``min_total`` (HAVING), or ``min_share`` of the state's total (ties: name).

    One scan and one aggregate for all states; the windows see one row per
    (state, name)."""
    agg = names.where(F.col("state").isin(states)).groupBy("state", "name").agg(F.sum("number").alias("total"))
    floor = F.lit(min_total) if min_share is None else \
        F.sum("total").over(Window.partitionBy("state")) * F.lit(min_share)
    nth = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("total"), "name"))
    return (agg.withColumn("floor", floor).where("total > floor").withColumn("nth", nth).where(F.col("nth") <= k)
            .select("state", "name", F.col("total").cast("double").alias("total")))


def compare_states(names: DataFrame, left: str = "TX", right: str = "PA",
                   min_total: float = 100_000, min_share: float | None = None, k: int = 10,
                   left_col: str = "total_tx", right_col: str = "total_pa") -> DataFrame:
    """Two filtered top-k lists side by side (``FULL OUTER JOIN USING``).

    The lists (at most ``2 k`` rows) are written before the join, so both sides
    come from one scan of the input."""
    top = cut_lineage(popular_names(names, [left, right], min_total, min_share, k), "popular_names")
    side = lambda state, total: top.where(F.col("state") == state).select("name", F.col("total").alias(total))
    return full_outer_using(side(left, left_col), side(right, right_col), "name")


def shard_report(shards: DataFrame, *more: str) -> DataFrame:
    """The day, its month, the upper-cased event name, the country with a
    default for missing ones (a nested-field projection), and ``more`` columns."""
    return shards.select(
        *more,
        F.col("table_suffix").alias("event_date"),
        month_of(parse_yyyymmdd("table_suffix")).cast("bigint").alias("mes"),
        F.upper("event_name").alias("evento_gritando"),
        default_to(F.col("geo.country"), "Desconocido").alias("pais"))


def events_by_suffix(spark: SparkSession, base: str, first: str, last: str, data_schema=None) -> DataFrame:
    """Wildcard scan of the daily event shards ``first`` .. ``last`` below
    ``base`` (laid out by :func:`ledgerlens.sources.write_date_shards`); other
    shards are pruned by the suffix partition filter."""
    return shard_report(read_sharded(spark, base, between=(first, last), data_schema=data_schema))


def taxi_subset(spark: SparkSession, trips: DataFrame, taxi_id, name: str, path: str) -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS SELECT ts, miles, total WHERE
    taxi_id = …`` (the filter reaches the Parquet scan)."""
    sel = (trips.where(F.col("taxi_id") == F.lit(taxi_id))
           .select("trip_start_timestamp", "trip_miles", "trip_total"))
    return create_table_as(spark, sel, name, path)


def monthly_growth(taxis: DataFrame) -> DataFrame:
    """Monthly money and km, month number and growth over the previous
    month present.

    Money is summed exactly (cents) before rounding; km is rounded from the
    double sum.  The two windows have no PARTITION BY, so they run in a
    single task - acceptable only because they see one row per month,
    never raw rows.  Growth over a zero month is null (``try_divide``).
    """
    agg = taxis.groupBy(month_start("trip_start_timestamp").alias("mes_original")).agg(
        F.round(F.sum(F.col("trip_total").cast(MONEY)), 0).cast("double").alias("total_dinero"),
        F.round(F.sum(F.col("trip_miles") * F.lit(1.6)), 0).alias("total_km"))
    w = Window.orderBy("mes_original")
    prev = F.lag("total_dinero", 1).over(w)
    return all_but(agg.select(
        "*",
        F.col("mes_original").cast("date").alias("mes"),
        F.row_number().over(w).cast("bigint").alias("num_mes_historia"),
        (F.try_divide(F.col("total_dinero"), prev) - F.lit(1)).alias("pct_crecimiento_dinero"),
    ), "mes_original")

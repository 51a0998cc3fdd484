"""Card transactions -> six-key BI cube -> dashboard queries.

Build: tolerant CSV scan (or any frame of the same shape) -> typed and
cleaned transactions -> one ``groupBy`` over six keys with five measures
-> Parquet.  Catalyst prunes the columns the cube does not use (``Day``,
``Card``, ``Merchant City``, ``date``) right at the scan.

Dashboard: every function takes the cube and the slicer selection and
returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import (MONEY, col, date_from_parts, is_present, money_from_text,
                                 pct, period_label, strict_cast, yes_flag)
from ..operators.aggregates import count_true, distinct_values, n_unique, top_k
from ..operators.relational import in_frame, in_lists
from ..sources.files import load_parquet, read_csv_tolerant
from ..sources.sinks import write_parquet

# The raw columns the build reads, in order.
RAW_COLUMNS = ["User", "Card", "Year", "Month", "Day", "Amount", "Use Chip",
               "Merchant City", "Merchant State", "MCC", "Errors?", "Is Fraud?"]
# what the tolerant scan parses numbers as (unparseable -> null)
SCAN_TYPES = {"User": "bigint", "Card": "bigint", "Year": "bigint", "Month": "bigint",
              "Day": "bigint", "MCC": "bigint"}
# what cleaning requires (anything else raises)
STRICT_TYPES = {"User": "bigint", "Card": "int", "Year": "int", "Month": "int", "Day": "int", "MCC": "int"}
CUBE_KEYS = ["Year", "Month", "Merchant State", "Use Chip", "MCC", "is_fraud"]
CELL_MONEY = "decimal(28,2)"         # sums of MONEY
YEAR, STATE, CHANNEL, MCC = "Year", "Merchant State", "Use Chip", "MCC"


def read_transactions_csv(spark: SparkSession, path, file_columns=None, **reading) -> DataFrame:
    """Tolerant scan of the raw card CSV (extra columns ignored).
    ``file_columns``: the file's full header when known (see
    :func:`ledgerlens.sources.files.read_csv_text`)."""
    return read_csv_tolerant(spark, path, RAW_COLUMNS, SCAN_TYPES, file_columns, **reading)


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Strict types, exact money, flags and the calendar date.

    ``amount_clean`` is ``decimal(18,2)``; ``is_fraud`` is three-valued
    (null when the fraud field is missing); ``has_error`` is two-valued.
    """
    return raw.select(
        *[strict_cast(c, t).alias(c) for c, t in STRICT_TYPES.items() if c != "MCC"],
        col("Use Chip").cast("string").alias("Use Chip"),
        col("Merchant City").cast("string").alias("Merchant City"),
        col("Merchant State").cast("string").alias("Merchant State"),
        strict_cast("MCC", STRICT_TYPES["MCC"]).alias("MCC"),
        money_from_text("Amount").alias("amount_clean"),
        yes_flag("Is Fraud?").alias("is_fraud"),
        is_present("Errors?").alias("has_error"),
    ).withColumn("date", date_from_parts("Year", "Month", "Day"))


def build_cube(clean: DataFrame) -> DataFrame:
    """Six-key cube with five measures (one grouping set; null keys group).

    * ``total_transactions``: rows; ``total_amount``: exact sum, 0 when
      every amount is null; ``avg_amount``: exact mean, null then.
    * ``error_count``: rows with an error; ``unique_users``: distinct users
      counting null as a user (not additive across cells).

    Plan: partial aggregation on (keys, User) map-side, shuffle, then
    (keys) - no group is ever held by a single task before reduction.
    """
    cents = F.col("amount_clean").cast(MONEY)
    n_amount = F.count(cents)
    return clean.groupBy(*[col(k) for k in CUBE_KEYS]).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(cents), F.lit(0).cast(MONEY)).cast("double").alias("total_amount"),
        F.when(n_amount > 0, F.sum(cents).cast("double") / n_amount).alias("avg_amount"),
        count_true("has_error").cast("bigint").alias("error_count"),
        n_unique("User").cast("bigint").alias("unique_users"),
    )


def build_cube_from_csv(spark: SparkSession, csv_path, out_path: str,
                        compression: str = "zstd", file_columns=None, **reading) -> str:
    """The whole ETL: CSV -> cube Parquet (written in parallel)."""
    cube = build_cube(clean_transactions(read_transactions_csv(spark, csv_path, file_columns, **reading)))
    return write_parquet(cube, out_path, compression)


def load_cube(spark: SparkSession, path: str) -> DataFrame:
    """Read a built cube; a missing cube is a clear error."""
    return load_parquet(spark, path, what="cube")


# ---------------------------------------------------------------- slicers
def slicer_years(cube: DataFrame) -> DataFrame:
    return distinct_values(cube, YEAR)


def slicer_states(cube: DataFrame) -> DataFrame:
    return distinct_values(cube, STATE)


def first_states(cube: DataFrame, n: int) -> DataFrame:
    """The first ``n`` states in sort order (a dashboard's opening selection)."""
    return slicer_states(cube).limit(n)


def slice_cube(cube: DataFrame, years: Sequence[int] | None = None,
               states: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows with ``Year IN years AND Merchant State IN states``.

    ``None`` means no restriction (null years and states included); a
    selection never matches null.  ``states`` may be a one-column frame of
    a bounded number of states, such as :func:`first_states`.
    """
    if isinstance(states, DataFrame):
        return in_frame(in_lists(cube, **{YEAR: years}), states, STATE, bounded=True)
    return in_lists(cube, **{YEAR: years, STATE: states})


def _money_total(c: str = "total_amount"):
    """Re-sum cube amounts exactly (each cell's amount is a whole number of
    cents, which a double names uniquely)."""
    return F.coalesce(F.sum(col(c).cast(CELL_MONEY)), F.lit(0).cast(CELL_MONEY)).cast("double")


def kpis(sliced: DataFrame) -> DataFrame:
    """One row: transactions, amount, fraud cases and rate, errors and rate."""
    fraud = F.when(col("is_fraud"), col("total_transactions")).otherwise(F.lit(0))
    agg = sliced.agg(
        F.coalesce(F.sum("total_transactions"), F.lit(0)).cast("bigint").alias("total_transactions"),
        _money_total().alias("total_amount"),
        F.coalesce(F.sum(fraud), F.lit(0)).cast("bigint").alias("fraud_cases"),
        F.coalesce(F.sum("error_count"), F.lit(0)).cast("bigint").alias("error_count"),
    )
    return agg.select(
        "total_transactions", "total_amount", "fraud_cases",
        pct("fraud_cases", "total_transactions").alias("fraud_rate"),
        "error_count",
        pct("error_count", "total_transactions").alias("error_rate"))


def monthly_amount(sliced: DataFrame) -> DataFrame:
    """Amount per (Year, Month) with a ``Year-Month`` label, in time order."""
    return (sliced.groupBy(YEAR, "Month").agg(_money_total().alias("total_amount"))
            .withColumn("period", period_label(YEAR, "Month"))
            .orderBy(F.asc_nulls_first(YEAR), F.asc_nulls_first("Month")))


def amount_by_channel(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy(col(CHANNEL)).agg(_money_total().alias("total_amount"))


def top_mcc(sliced: DataFrame, k: int = 10) -> DataFrame:
    """Top-k merchant categories by amount (ties: lower MCC first)."""
    agg = sliced.groupBy(MCC).agg(_money_total().alias("total_amount"))
    return top_k(agg, "total_amount", k, tiebreak=[MCC])


def fraud_by_state(sliced: DataFrame, k: int = 10) -> DataFrame:
    """Top-k states by fraud count (ties: state name)."""
    agg = (sliced.where(col("is_fraud")).groupBy(col(STATE))
           .agg(F.sum("total_transactions").cast("bigint").alias("fraud_count")))
    return top_k(agg, "fraud_count", k, tiebreak=[STATE])


def preview(sliced: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` cells in key order (nulls first): a deterministic head."""
    return sliced.orderBy(*[F.asc_nulls_first(col(c)) for c in CUBE_KEYS]).limit(n)


def cube_dashboard(cube: DataFrame, years: Sequence[int] | None = None,
                   states: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every figure of the card dashboard for one slicer selection, as lazy
    frames (the slice is shared; nothing runs until a frame is used)."""
    s = slice_cube(cube, years, states)
    return {"years": slicer_years(cube), "states": slicer_states(cube), "kpis": kpis(s),
            "monthly_amount": monthly_amount(s), "amount_by_channel": amount_by_channel(s),
            "top_mcc": top_mcc(s), "fraud_by_state": fraud_by_state(s), "preview": preview(s)}

"""Sinks: Parquet with codec, CSV export, JDBC, tables, materialized views."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import drop_table, replace_table

# The Parquet codecs the cube build accepts.
PARQUET_CODECS = ("zstd", "snappy", "lz4")


def check_codec(codec: str) -> str:
    if codec not in PARQUET_CODECS:
        raise ValueError(f"compression must be one of {PARQUET_CODECS}, got {codec!r}")
    return codec


def write_parquet(df: DataFrame, path: str, compression: str = "zstd",
                  partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """Write ``df`` to ``path`` as Parquet, overwriting unless ``mode`` says otherwise
    (distributed write: one file per task, no collect)."""
    w = df.write.mode(mode).option("compression", check_codec(compression))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Overwrite ``path`` with ``df`` as headed CSV (a folder of parts).

    RFC 4180: quotes inside a value are doubled, blanks at its ends are
    kept.  CSV cannot tell null from empty text: both read back as null.
    """
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def export_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict:
    """Write each named frame to ``out_dir/<name>`` (csv or parquet)."""
    out = {}
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        out[name] = write_csv(df, p) if fmt == "csv" else write_parquet(df, p)
    return out


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, batchsize: int = 10_000,
                 truncate: bool = False, num_partitions: int | None = None) -> dict:
    """Options of a relational write (``to_sql(..., if_exists='replace')``).

    ``num_partitions`` bounds the connections open at once: with more tasks
    the rows are coalesced to that many first.
    """
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC url starts with 'jdbc:'")
    opts = {"url": url, "dbtable": table, "batchsize": str(batchsize),
            "truncate": str(truncate).lower()}
    if num_partitions is not None:
        if num_partitions < 1:
            raise ValueError("num_partitions is at least 1")
        opts["numPartitions"] = str(num_partitions)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            opts[k] = v
    return opts


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **kw) -> None:
    """Replace a database table with ``df`` (each task writes its rows)."""
    df.write.format("jdbc").options(**jdbc_options(url, table, **kw)).mode(mode).save()


def create_table_as(spark: SparkSession, df: DataFrame, name: str, path: str, compression: str = "zstd") -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS SELECT …``: a new version below ``path``, then
    ``name`` points to it (see :mod:`ledgerlens.sources.versions`); returns the table.

    Readers see the old or the new rows; a failed write leaves the old ones."""
    if "." in name:
        db = name.split(".")[0]
        # keep the database folder next to the table, not in the local cwd
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}` LOCATION '{path.rstrip('/')}.db'")
    return replace_table(spark, df, name, path, check_codec(compression))


def drop_view(spark: SparkSession, name: str) -> None:
    """Forget a materialized view (its files stay until they are rewritten)."""
    drop_table(spark, name)


def materialize(spark: SparkSession, df: DataFrame, name: str, path: str) -> DataFrame:
    """Materialized view with full rebuild: the result becomes a new version below
    ``path`` and replaces the old one in the catalog in one step; the name outlives
    the session wherever the catalog does."""
    return create_table_as(spark, df, name, path)


def reload_steps(tables: Mapping[str, DataFrame],
                 summaries: Mapping[str, DataFrame]) -> list[tuple[str, str, DataFrame | None]]:
    """(step, name, frame) of a reload in its safe order: drop what depends
    on the tables, replace the tables, build the summaries again."""
    return ([("drop", n, None) for n in summaries] + [("table", n, df) for n, df in tables.items()]
            + [("summary", n, df) for n, df in summaries.items()])


BY_SIZE = "by size"


def write_date_shards(df: DataFrame, base: str, date_col: str, fmt: str = "yyyyMMdd",
                      suffix_column: str = "table_suffix",
                      files_per_shard: int | str | None = None, mode: str = "overwrite") -> str:
    """Lay a table out as one shard per day: ``base/table_suffix=YYYYMMDD/``.

    Default: no shuffle - each task writes one file per day it holds, so a
    hot day is spread over many files instead of one task.  With
    ``files_per_shard`` one shuffle on (day, row-hash salt) first groups the
    rows, giving about that many files per day; the salt keeps a hot day
    split over that many tasks.  ``BY_SIZE`` leaves it to the size: days are
    rebalanced at run time, a large one over many tasks and files, small ones
    together in a task.  ``mode="append"`` adds shards to those there.
    """
    out = df.withColumn(suffix_column, F.date_format(F.col(date_col), fmt))
    if files_per_shard == BY_SIZE:
        out = out.hint("rebalance", F.col(suffix_column))
    elif files_per_shard:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(int(files_per_shard)))
        out = out.repartition(F.col(suffix_column), salt)
    return write_parquet(out, base, partition_by=(suffix_column,), mode=mode)

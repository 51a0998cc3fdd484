"""Tables laid out so that selections skip files and row groups.

``write_clustered`` range-partitions and sorts by the cluster columns, so every file
(at most ``rows_per_file`` rows) holds a narrow range of them, and writes Parquet bloom filters
for the columns asked.  A small index beside the data has each file's least and
greatest value per cluster column.

``read_selected`` opens only the files whose ranges meet the selection; inside
them the pushed IN filter skips row groups and pages by statistics, dictionaries and
bloom filters.  The result is that of the plain filter.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.relational import in_lists
from .sinks import check_codec

INDEX = "_file_ranges"               # hidden from scans of the table
ROWS_PER_FILE = 4_000_000
ROW_GROUP_BYTES = 16 << 20           # small row groups skip better


def write_clustered(df: DataFrame, path: str, cluster_by: Sequence[str], bloom: Sequence[str] = (),
                    rows_per_file: int = ROWS_PER_FILE, compression: str = "zstd",
                    bloom_values: int | None = None) -> str:
    """Overwrite ``path`` with ``df`` clustered by ``cluster_by``, and its file index.

    A value that holds many rows spans several files: the ranges are of the sort
    order over all cluster columns.  ``bloom_values``: distinct values a filter is
    sized for (Parquet's default otherwise)."""
    spark, order = df.sparkSession, [col(c).asc_nulls_first() for c in cluster_by]
    # ties of the cluster columns are dealt on by the row's hash
    spread = F.xxhash64(*[col(c) for c in df.columns])
    writer = (df.repartitionByRange(*order, spread).sortWithinPartitions(*order).write.mode("overwrite")
              .option("compression", check_codec(compression)).option("maxRecordsPerFile", rows_per_file)
              .option("parquet.block.size", ROW_GROUP_BYTES))
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if bloom_values:
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", str(bloom_values))
    writer.parquet(path)
    ranges = [f(col(c)).alias(f"{name} {c}") for c in cluster_by for f, name in ((F.min, "min"), (F.max, "max"))]
    (spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
     .agg(F.count(F.lit(1)).alias("rows"), *ranges)
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}"))
    return path


def _meets(c: str, values: Sequence) -> Column:
    """Whether a file's range of ``c`` holds one of the values (null ranges hold none)."""
    inside = [F.lit(v).between(F.col(f"`min {c}`"), F.col(f"`max {c}`")) for v in values if v is not None]
    return F.coalesce(reduce(lambda a, b: a | b, inside, F.lit(False)), F.lit(False))


def selected_files(spark: SparkSession, path: str, **allowed: Sequence | None) -> list[str]:
    """Files that can hold rows of the selection; names only, from the index."""
    index = spark.read.parquet(f"{path}/{INDEX}")
    clustered = [c[len("min "):] for c in index.columns if c.startswith("min ")]
    asked = [_meets(c, v) for c, v in allowed.items() if v is not None and c in clustered]
    rows = index.where(reduce(lambda a, b: a & b, asked, F.lit(True))).select("file").collect()
    return [unquote(r["file"]) for r in rows]            # file paths of rows are written as URLs


def read_selected(spark: SparkSession, path: str, **allowed: Sequence | None) -> DataFrame:
    """Rows with ``c1 IN (...) AND c2 IN (...)``; a None list is no restriction, null never matches."""
    schema = spark.read.parquet(path).schema
    files = selected_files(spark, path, **allowed)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return in_lists(rows, **allowed)

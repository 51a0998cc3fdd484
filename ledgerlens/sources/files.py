"""File sources: tolerant CSV scans, NA tokens, Parquet, wildcard shards."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .csv_lines import kept_rows

# The text tokens pandas.read_csv reads as missing by default
# (matched exactly, without trimming).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def read_csv_text(spark: SparkSession, path: str | Sequence[str],
                  columns: Sequence[str] | None = None,
                  file_columns: Sequence[str] | None = None, multi_line: bool = False,
                  check_quotes: bool = True) -> DataFrame:
    """CSV (RFC 4180: a doubled quote inside quotes is a quote) with a header, every column as text (no type inference).

    Columns are selected *by name*, so extra or reordered columns in the
    file are harmless and a missing one is an error.  Empty fields (quoted
    or not) are null.

    By default a record is a line, so large files split across tasks.  A
    quote that its line does not close would shift values silently, so lines
    are checked first and such a file is refused; the check is one pass over the
    text without parsing it (``check_quotes=False`` where the writer is known to
    keep records on one line).  ``multi_line`` reads newlines inside
    quotes; then one task reads each file whole, so keep files small (a few
    hundred MB).

    ``file_columns`` declares the header when the layout is known: no job
    is spent reading it up front, and every file's header is still checked
    against the declared names (a mismatch fails the read rather than
    silently shifting columns).
    """
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE").option("multiLine", multi_line)
              .option("escape", '"'))
    if check_quotes and not multi_line:
        refuse_open_quotes(spark, path)
    if file_columns:
        reader = reader.option("enforceSchema", False).schema(
            T.StructType([T.StructField(c, T.StringType(), True) for c in file_columns]))
    df = reader.csv(path)
    return df.select(*[col(c) for c in columns]) if columns else df


def refuse_open_quotes(spark: SparkSession, path: str | Sequence[str]) -> None:
    """Raise if some line of the CSV has a quote it does not close."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    bad = spark.read.text(path).where(quotes % 2 == 1).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{path}: a quoted field runs over the end of its line; read it with multi_line=True")


def tolerant_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Parse text columns leniently: a value that does not parse as the
    column's type becomes null (scan-level ``ignore_errors``)."""
    return df.select(*[col(c).try_cast(types[c]).alias(c) if c in types else col(c)
                       for c in df.columns])


def read_csv_tolerant(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                      types: Mapping[str, str],
                      file_columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Tolerant typed CSV scan: lines that are no record of the header's shape are
    skipped (:mod:`ledgerlens.sources.csv_lines` lists them), values that do not parse are
    null.  One scan of the text; ``multi_line`` reads quoted newlines, a file a task."""
    text = (read_csv_text(spark, path, columns, file_columns, multi_line=True) if multi_line
            else kept_rows(spark, path, columns, file_columns))
    return tolerant_types(text, types)


def na_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Turn pandas' missing-value tokens into null in every text column."""
    in_list = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in tokens)
    return df.select(*[
        F.expr(f"CASE WHEN `{f.name}` IN ({in_list}) THEN NULL ELSE `{f.name}` END").alias(f.name)
        if isinstance(f.dataType, T.StringType) else col(f.name)
        for f in df.schema.fields])


def read_csv_na(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                file_columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV read with pandas' NA semantics (all columns text; see
    :data:`NA_TOKENS`), one scan as :func:`read_csv_tolerant`.  Numeric parsing is left to the cleaning step;
    :func:`ledgerlens.sources.csv_lines.read_csv_inferred` infers types."""
    text = (read_csv_text(spark, path, columns, file_columns, multi_line=True) if multi_line
            else kept_rows(spark, path, columns, file_columns))
    return na_to_null(text)


def load_parquet(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """Read Parquet; a missing path raises a clear, actionable error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(
                f"{what} not found at {path}: build it first") from e
        raise


SUFFIX_COLUMN = "table_suffix"


def read_sharded(spark: SparkSession, base: str, between: tuple[str, str] | None = None,
                 suffix_column: str = SUFFIX_COLUMN,
                 data_schema: T.StructType | None = None) -> DataFrame:
    """Wildcard scan over date shards laid out as ``base/table_suffix=…/``.

    The suffix is declared a *string* partition column, so
    ``table_suffix BETWEEN a AND b`` is a partition filter: shards outside
    the range are never listed into the scan.  Pass ``data_schema`` on
    very large shard trees to skip the schema-inference listing.
    """
    if data_schema is None:
        data_schema = spark.read.parquet(base).schema
    fields = [f for f in data_schema.fields if f.name != suffix_column]
    schema = T.StructType(fields + [T.StructField(suffix_column, T.StringType(), True)])
    df = spark.read.schema(schema).parquet(base)
    if between is not None:
        df = df.where(F.col(suffix_column).between(F.lit(between[0]), F.lit(between[1])))
    return df


def read_glob_shards(spark: SparkSession, pattern: str, between: tuple[str, str] | None = None,
                     prefix: str = "events_", suffix_column: str = SUFFIX_COLUMN) -> DataFrame:
    """Wildcard scan over separate tables ``…/events_YYYYMMDD/`` by glob.

    The suffix is recovered from each row's file path; the range filter
    runs after listing (use :func:`read_sharded` for true pruning).
    """
    df = spark.read.parquet(pattern)
    suffix = F.regexp_extract(F.col("_metadata.file_path"), prefix + r"([^/]+)/", 1)
    df = df.withColumn(suffix_column, suffix)
    if between is not None:
        df = df.where(F.col(suffix_column).between(F.lit(between[0]), F.lit(between[1])))
    return df

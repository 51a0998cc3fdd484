"""CSV read as lines: one text scan that parses, and knows what it refuses.

A record is a line (files split across tasks).  In the scan itself a line is

* ``short`` or ``long``: it has fewer or more fields than the header;
* ``quote``: a field begins with a quote that is not closed before the next comma or
  the end of the line (text after a closing quote, or a quoted newline, too).

Such lines are refused; all others are parsed by Spark's CSV parser (RFC 4180; a quote
inside an unquoted field is text).  Blank lines and header lines are skipped.  A line that holds the
header's names in another order raises: that file's columns would be mistaken.

``kept_rows`` is the lazy tolerant read.  ``CsvQuarantine`` writes what the scan found once, so
kept rows, refused lines (file, line number, text, reason) and inferred types all come
from a single pass over the text.
"""

from __future__ import annotations

import csv
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, lenient_number
from ..session import cut_lineage

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'          # a whole quoted field
_BEFORE, _AFTER = r"(?<![^,])", r"(?![^,])"  # at the start / end of a field


def header_of(spark: SparkSession, path) -> list[str]:
    """Names in the first line of the first file."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path}: no header line")
    return next(csv.reader([first[0]["value"]]))


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def line_state(line: Column, names: Sequence[str]) -> Column:
    """Null for a record; else header, blank, or why the line is refused: short, long, quote.

    Nearly all lines are settled by the first branch, one pattern (a field per name, each without
    quotes or in a pair of them); the others by what is left when whole quoted fields are taken out."""
    n, bare = len(names), [c.replace('"', "") for c in names]
    field = r'(?:[^",]*+|"[^"]*+")'
    plain = line.rlike(rf"^{field}(?:,{field}){{{n - 1}}}$")
    named = F.instr(line, max(bare, key=len)) > 0          # a header line holds its longest name
    text = F.replace(line, F.lit('"'), F.lit(""))
    moved = F.array_sort(F.split(text, ",")) == F.array_sort(F.array(*map(F.lit, bare)))
    rest = F.regexp_replace(line, _BEFORE + _QUOTED + _AFTER, "")
    return (F.when(~named & plain & (F.lit(True) if n > 1 else F.trim(line) != ""), F.lit(None).cast("string"))
            .when(F.trim(line) == "", F.lit("blank"))
            .when(named & (text == ",".join(bare)), F.lit("header"))
            .when(named & moved, F.raise_error(F.concat(F.lit("a header with the columns in another order: "), line)).cast("string"))
            .when(rest.rlike(_BEFORE + '"'), F.lit("quote"))
            .when(_commas(rest) + 1 < n, F.lit("short"))
            .when(_commas(rest) + 1 > n, F.lit("long")))


def _parsed(line: Column, names: Sequence[str]) -> Column:
    ddl = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in names)
    return F.from_csv(line, ddl, {"escape": '"'})


def kept_rows(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
              file_columns: Sequence[str] | None = None) -> DataFrame:
    """The good lines as text columns, refused ones left out; one lazy text scan.

    ``file_columns`` declares the header, so that nothing is read beforehand."""
    names = list(file_columns or header_of(spark, path))
    line = F.col("value")
    good = spark.read.text(path).where(line_state(line, names).isNull())
    rows = good.select(_parsed(line, names).alias("v"))
    return rows.select(*[F.col("v").getField(c).alias(c) for c in (columns or names)])


class CsvQuarantine:
    """What one scan of a CSV found, written once.

    ``kept``: good lines as text columns; ``refused``: file, line number, reason and text
    of the others; ``counts``: rows per kind."""

    def __init__(self, spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                 file_columns: Sequence[str] | None = None):
        names = list(file_columns or header_of(spark, path))
        self.columns = list(columns or names)
        line = F.col("value")
        scan = spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at"), line_state(line, names).alias("__state"))
        state, other = F.col("__state"), F.col("__state").isin("header", "blank")
        found = scan.select(
            "__file", "__block", "__at", F.when(~other, state).alias("__reason"),
            F.when(state.isNull(), F.lit("row")).when(other, state).otherwise(F.lit("refused")).alias("__kind"),
            F.when(~other, line).alias("__line"), F.when(state.isNull(), _parsed(line, names)).alias("__v"))
        self.table = cut_lineage(found.select(
            "__file", "__block", "__at", "__kind", "__reason", "__line",
            *[F.col("__v").getField(c).alias(c) for c in self.columns]), "csv_lines")

    @property
    def kept(self) -> DataFrame:
        return self.table.where("__kind = 'row'").select(*[col(c) for c in self.columns])

    @property
    def refused(self) -> DataFrame:
        """file, line (number in the file, from 1), reason, text."""
        # one row per split of a file
        splits = self.table.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        starts = splits.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        bad = self.table.where("__kind = 'refused'").select("__file", "__block", "__at", "__reason", "__line")
        return bad.join(starts, ["__file", "__block"]).select(
            F.col("__file").alias("file"), (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line"),
            F.col("__reason").alias("reason"), F.col("__line").alias("text"))

    def counts(self) -> DataFrame:
        """kind, reason, rows."""
        return self.table.groupBy(F.col("__kind").alias("kind"), F.col("__reason").alias("reason")).agg(
            F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- inference
_LONG = r"^\s*[+-]?\d+\s*$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
# The spellings of booleans that pandas.read_csv reads.
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _as_type(c: str, to: str) -> Column:
    """A text column read as a type; null where it does not parse."""
    x = col(c)
    if to == "bigint":
        return F.when(x.rlike(_LONG), F.trim(x).try_cast("bigint"))
    if to == "double":
        return lenient_number(c)
    if to == "boolean":
        return F.when(x.isin(*_TRUE), F.lit(True)).when(x.isin(*_FALSE), F.lit(False))
    if to == "date":
        return F.when(x.rlike(_DATE), F.try_to_date(x, "yyyy-MM-dd"))
    return x


INFERRED = ("bigint", "double", "boolean", "date")      # narrowest first


def inferred_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that every non-null value of each text column parses as.

    One aggregate with a count per column and type; a single row reaches the
    driver.  A column without values is double, as pandas reads it; nulls do not widen a type."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return {}
    counts = df.agg(*[F.count(col(c)).alias(f"{i}_n") for i, c in enumerate(text)],
                    *[F.count(_as_type(c, t)).alias(f"{i}_{t}") for i, c in enumerate(text) for t in INFERRED]).first()
    out = {}
    for i, c in enumerate(text):
        n = counts[f"{i}_n"]
        out[c] = "double" if not n else next((t for t in INFERRED if counts[f"{i}_{t}"] == n), "string")
    return out


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns read as ``types``; the others as they are."""
    return df.select(*[_as_type(c, types[c]).alias(c) if c in types else col(c) for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                      file_columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with missing-value tokens as null and inferred types: the text is read
    once, types come from the written rows."""
    from .files import na_to_null
    text = na_to_null(CsvQuarantine(spark, path, columns, file_columns).kept)
    return with_types(text, inferred_types(text))

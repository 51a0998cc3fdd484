"""Wildcard scans over date shards whose columns differ.

The newest shard of the range gives the schema, as warehouse wildcard tables do: a
column that an older shard lacks is null there, one that only older shards have is
left out, and a type may have been widened on the way (checked; anything else names the
shard and the column and raises).  Structs and arrays are reconciled inside.

Shards of one layout are one scan, so a range has as many scans as layouts, each with its
own pruned columns and pushed filters.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

SUFFIX_COLUMN = "table_suffix"
FOOTER_READERS = 8                   # schemas read at once (one footer a shard)

_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}      # decimal digits of a type
# a value of the first type is one of the second
_WIDER = {(T.FloatType, T.DoubleType), (T.ByteType, T.DoubleType), (T.ShortType, T.DoubleType), (T.IntegerType, T.DoubleType),
          (T.ByteType, T.FloatType), (T.ShortType, T.FloatType), (T.DateType, T.TimestampNTZType)}


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of ``old`` is a value of ``new`` (the same type included)."""
    if old == new or isinstance(old, T.NullType):
        return True
    a, b = type(old), type(new)
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[a] <= _WHOLE[b]
    if b is T.DecimalType and (a in _WHOLE or a is T.DecimalType):
        whole, scale = (_WHOLE[a], 0) if a in _WHOLE else (old.precision - old.scale, old.scale)
        return whole <= new.precision - new.scale and scale <= new.scale
    return (a, b) in _WIDER


def conform(value: Column, old: T.DataType, new: T.DataType, where: str) -> Column:
    """``value`` of type ``old`` as type ``new``; raises TypeError where that loses values."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        held = {f.name: f for f in old.fields}
        parts = [conform(value.getField(f.name), held[f.name].dataType, f.dataType, f"{where}.{f.name}") if f.name in held
                 else F.lit(None).cast(f.dataType) for f in new.fields]
        whole = F.struct(*[p.alias(f.name) for p, f in zip(parts, new.fields)])
        return F.when(value.isNotNull(), whole)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(value, lambda x: conform(x, old.elementType, new.elementType, f"{where}[]"))
    if not widens(old, new):
        raise TypeError(f"{where}: {old.simpleString()} does not widen to {new.simpleString()}")
    return value if old == new else value.cast(new)


def shard_folders(spark: SparkSession, base: str, between: tuple[str, str] | None = None,
                  prefix: str = f"{SUFFIX_COLUMN}=") -> dict[str, str]:
    """Suffix -> folder of the shards ``base/<prefix><suffix>`` in the range, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    found = sorted(n[len(prefix):] for n in names if n.startswith(prefix))
    return {s: f"{base.rstrip('/')}/{prefix}{s}" for s in found if between is None or between[0] <= s <= between[1]}


def read_evolved_shards(spark: SparkSession, base: str, between: tuple[str, str] | None = None,
                        prefix: str = f"{SUFFIX_COLUMN}=", suffix_column: str = SUFFIX_COLUMN) -> DataFrame:
    """All shards of the range in the newest one's schema, with their suffix."""
    folders = shard_folders(spark, base, between, prefix)
    if not folders:
        raise FileNotFoundError(f"no shard {prefix}… in the range below {base}")
    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        schemas = dict(zip(folders, pool.map(lambda p: spark.read.parquet(p).schema, folders.values())))
    newest = schemas[max(folders)]
    layouts: dict[str, list[str]] = {}
    for suffix, schema in schemas.items():
        layouts.setdefault(schema.json(), []).append(suffix)
    parts = []
    for suffixes in layouts.values():
        schema = schemas[suffixes[0]]
        held = {f.name: f.dataType for f in schema.fields}
        columns = [conform(col(f.name), held[f.name], f.dataType, f"shard {suffixes[0]}, {f.name}").alias(f.name)
                   if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in newest.fields]
        scan = spark.read.schema(schema).parquet(*[folders[s] for s in suffixes])
        # the folder's name, whatever else its path holds
        suffix = F.regexp_extract(F.col("_metadata.file_path"), rf"\Q{prefix}\E([^/]+)/[^/]*$", 1)
        parts.append(scan.select(*columns, suffix.alias(suffix_column)))
    return reduce(DataFrame.unionByName, parts)

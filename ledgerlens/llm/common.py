"""Helpers shared by the operators: Arrow text slices and stable hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes worked on at once inside a task (numpy temporaries are ~20x that).
SLICE_BYTES = 2 << 20

# The separators of "words" in every contract, [\x20\x09-\x0D].
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python
    workers import it, wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ledgerlens-")), "ledgerlens-package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)


def text_or_empty(column: str = "text") -> Column:
    """Null texts count as empty everywhere."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls become empty strings."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[array.offset: array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Cut batches into row runs of at most ``max_bytes`` of text (one row at
    least) and ``max_rows`` rows."""
    for batch in batches:
        _, off = utf8_buffers(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), n, at + max_rows)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two xor-shift multiplies); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


GOLDEN64 = np.uint64(0x9E3779B97F4A7C15)


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers (a counter through the finalizer)."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * GOLDEN64)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row id that is unique, and stable once the result has been written."""
    return df.withColumn(name, F.monotonically_increasing_id())

"""Mergeable exact distinct counts: one small bitmap per (keys, bucket).

A count of distinct values cannot be added over groups; its bitmaps can be
combined.  Integer values are dealt into buckets of 64 positions, and a bucket
that a group meets is a bitmap of 8 bytes.  So a group never holds more bitmap
rows than distinct values, however sparse they are, and 64 times fewer where they are
dense.  Null is apart: a row without a bucket says that the group has null.

``distinct_bitmaps`` builds them, ``merge_bitmaps`` combines those of several
loads or groups, ``count_bitmaps`` counts any grouping exactly.

Build plan: rows shrink to one word of bits per (keys, bucket) with map-side combine, together
with the bitmaps of earlier loads if given, so a hot group is spread by bucket.  The words are then
laid together by ``near`` (split by size), and become bitmaps where they lie.
Inside a plan bits are words (``bit_or`` in hash aggregates); stored they are bytes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

BUCKET, BITMAP = "bucket", "bitmap"
_POSITIONS = 6                       # bits of a value that name its position in a bucket


def _word(bitmap: str = BITMAP) -> Column:
    """The 8 bytes of a bitmap as one integer."""
    return F.conv(F.hex(F.col(bitmap)), 16, -10).cast("bigint")


def _bytes(word: str) -> Column:
    return F.unhex(F.lpad(F.hex(F.col(word)), 16, "0"))


def _merged(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One word ``__w`` per (keys, bucket)."""
    return words.groupBy(*[col(k) for k in keys], F.col(BUCKET)).agg(F.bit_or("__w").alias("__w"))


def _words(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bitmaps.select(*[col(k) for k in keys], F.col(BUCKET), _word().alias("__w"))


def _as_bitmaps(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    return words.select(*[col(k) for k in keys], F.col(BUCKET), _bytes("__w").alias(BITMAP))


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], value: str, known: DataFrame | None = None,
                     near: Sequence[str] | None = None) -> DataFrame:
    """``keys``, ``bucket``, ``bitmap`` of the integer column ``value``.

    A row with a null bucket stands for null values of its group.  ``known``: bitmaps of
    earlier loads that are merged in; ``near``: the keys whose rows come to lie together
    (all, if not given)."""
    v = col(value).cast("bigint")
    words = df.select(*[col(k) for k in keys], F.shiftright(v, _POSITIONS).alias(BUCKET),
                      F.expr(f"shiftleft(1L, CAST(`{value}` & {(1 << _POSITIONS) - 1} AS INT))").alias("__w"))
    if known is not None:
        words = words.unionByName(_words(known, keys))
    laid = _merged(words, keys).hint("rebalance", *[col(k) for k in (keys if near is None else near)])
    return _as_bitmaps(laid, keys)


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of a coarser grouping, or of several loads: one row per (keys, bucket)."""
    return _as_bitmaps(_merged(_words(bitmaps, keys), keys), keys)


def bitmap_size() -> Column:
    """Distinct values that a bitmap row stands for (null is one)."""
    return F.when(F.col(BUCKET).isNull(), F.lit(1)).otherwise(F.bitmap_count(F.col(BITMAP))).cast("bigint")


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact distinct values (null counts as one) per ``keys``; no keys: one row, 0 when empty."""
    sizes = merge_bitmaps(bitmaps, keys).select(*[col(k) for k in keys], bitmap_size().alias("__n"))
    if not keys:
        return sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias(name))
    return sizes.groupBy(*[col(k) for k in keys]).agg(F.sum("__n").cast("bigint").alias(name))

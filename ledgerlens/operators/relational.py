"""Joins, filters and projections (DataFrame -> DataFrame).

Broadcasts are left to the planner's byte threshold and to AQE, which also
splits skewed keys.  A hint is given only where the caller can bound the side
by construction (``bounded=True``), never by a row count.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

def join_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]],
            how: str = "inner", null_safe: bool = False, bounded: bool = False,
            keep_right_keys: bool = True) -> DataFrame:
    """Equi-join on (left_name, right_name) pairs.

    * ``null_safe``: keys match with ``<=>`` (null joins null, as pandas
      ``merge`` does).  Spark still plans a hash / sort-merge join for it.
    * Right-side keys are re-aliased before the join, so two frames derived
      from the same parent never produce an ambiguous self-join.
    * When a key has the same name on both sides the right copy is dropped
      (``USING`` semantics); otherwise it is kept unless
      ``keep_right_keys=False``.
    * ``bounded``: the right side's size is bounded by construction, whatever
      the data; it is broadcast.
    """
    tmp = [f"__rk{i}" for i in range(len(pairs))]
    renamed = right
    for (_, r), t in zip(pairs, tmp):
        renamed = renamed.withColumn(t, col(r))
    drop_right = [r for (lname, r) in pairs if lname == r or not keep_right_keys]
    renamed = renamed.drop(*drop_right)
    if bounded:
        renamed = F.broadcast(renamed)
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    cond = reduce(lambda a, b: a & b, [eq(col(lname), F.col(t)) for (lname, _), t in zip(pairs, tmp)])
    return left.join(renamed, cond, how).drop(*tmp)


def null_safe_join(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                   right_on: Sequence[str], how: str = "left", **kw) -> DataFrame:
    """pandas-style ``merge(left_on, right_on, how)``: null keys match."""
    return join_on(left, right, list(zip(left_on, right_on)), how=how, null_safe=True, **kw)


def full_outer_using(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``FULL OUTER JOIN ... USING (key)``: the key is coalesced and first."""
    return left.join(right, on=key, how="full")


def select_renamed(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Select and rename from an ordered (source, target) mapping."""
    return df.select(*[col(s).alias(t) for s, t in mapping])


def all_but(df: DataFrame, *names: str) -> DataFrame:
    """``SELECT * EXCEPT (names)``."""
    return df.drop(*names)


def drop_incomplete(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Drop rows with a null (or NaN) in any of ``subset`` (pandas ``dropna``)."""
    return df.na.drop(how="any", subset=list(subset))


def in_lists(df: DataFrame, **allowed: Sequence | None) -> DataFrame:
    """Conjunctive IN-list slicer: ``c1 IN (...) AND c2 IN (...)``.

    A ``None`` list means "no restriction"; an empty list keeps no rows.
    Null keys never match.
    """
    preds: list[Column] = []
    for name, values in allowed.items():
        if values is None:
            continue
        preds.append(col(name).isin(list(values)) if values else F.lit(False))
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def in_frame(df: DataFrame, values: DataFrame, name: str, bounded: bool = False) -> DataFrame:
    """Keep rows whose ``name`` occurs in the one-column frame ``values`` (a
    left-semi join; ``bounded`` as in :func:`join_on`)."""
    v = values.select(col(values.columns[0]).alias("__v")).where(F.col("__v").isNotNull())
    return df.join(F.broadcast(v) if bounded else v, col(name) == F.col("__v"), "left_semi")

"""Scalar building blocks: Column -> Column.

Every function here is a plain composition of built-in Spark expressions,
so it stays inside whole-stage code generation and never leaves the JVM.
Names of columns may be strings or Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,10)"       # survey amounts: ten decimals


def col(c) -> Column:
    """Accept a column name (blanks, accents and ``?`` allowed) or a Column."""
    return c if isinstance(c, Column) else F.col(f"`{c}`")


# --------------------------------------------------------------------- money
def strict_cast(c, to: str) -> Column:
    """Cast that raises on a value it cannot read, whatever the session's ANSI
    mode; null stays null."""
    x = col(c)
    read = x.try_cast(to)
    error = F.raise_error(F.concat(F.lit(f"cannot read as {to}: "), x.cast("string"))).cast(to)
    return F.when(read.isNull() & x.isNotNull(), error).otherwise(read)


def money_from_text(c) -> Column:
    """Currency text to exact money: strip ``$`` and ``,``, strict cast.

    ``$68,423.46`` -> 68423.46 as ``decimal(18,2)``.  An empty or junk
    string raises.
    """
    return strict_cast(F.regexp_replace(col(c).cast("string"), r"[$,]", ""), MONEY)


def exact_avg(c) -> Column:
    """Mean of a double column as exact decimal sum over count: the same on any
    partitioning, without rounding values to cents (nulls ignored, all-null -> null)."""
    wide = col(c).cast(WIDE)
    n = F.count(wide)
    return F.when(n > 0, F.sum(wide).cast("double") / n)


# --------------------------------------------------------------------- flags
def yes_flag(c) -> Column:
    """``lower(x) == 'yes'``; null stays null (three-valued), no trimming."""
    return F.lower(col(c)) == F.lit("yes")


def is_present(c) -> Column:
    """True when the value is not null (the error flag)."""
    return col(c).isNotNull()


def date_from_parts(y, m, d) -> Column:
    """Date from year / month / day parts; null with a null part, an invalid date raises."""
    parts = [col(x) for x in (y, m, d)]
    text = F.format_string("%04d-%02d-%02d", *parts)
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(known, strict_cast(text, "date"))


# ----------------------------------------------------------------- dashboard
def pct(numerator, denominator) -> Column:
    """``numerator / denominator * 100`` with a zero guard (-> 0.0)."""
    n, d = col(numerator), col(denominator)
    return F.when(d > 0, n / d * F.lit(100)).otherwise(F.lit(0.0))


def period_label(y, m) -> Column:
    """``"{Year}-{Month}"`` without zero padding; null when a part is null."""
    return F.concat(col(y).cast("string"), F.lit("-"), col(m).cast("string"))


def default_to(c, value: str) -> Column:
    """Null default (``fillna`` / ``COALESCE``)."""
    return F.coalesce(col(c), F.lit(value))


def density_class(v, vmax) -> Column:
    """Opacity class of a map cell: 0.4 below half the maximum, else 0.8.

    A maximum of 0 or null counts as 1 (``max or 1``).
    """
    m = F.when(col(vmax).isNull() | (col(vmax) == 0), F.lit(1.0)).otherwise(col(vmax))
    return F.when(col(v) < m / 2, F.lit(0.4)).otherwise(F.lit(0.8))


# ------------------------------------------------------------ dates, strings
def parse_yyyymmdd(c, strict: bool = True) -> Column:
    """``'20210131'`` -> date.  Strict raises on junk; lenient gives null."""
    fmt = "yyyyMMdd"
    return F.to_date(col(c), fmt) if strict else F.try_to_date(col(c), fmt)


def month_of(c) -> Column:
    return F.month(col(c))


def month_start(c) -> Column:
    """``DATE_TRUNC(ts, MONTH)`` in the session time zone (UTC)."""
    return F.date_trunc("month", col(c))


# ----------------------------------------------------------------- hours
# Python's float() grammar for decimal text: optional sign, digits with an
# optional fraction (or a bare fraction), optional exponent, or the words
# inf / infinity / nan.  Surrounding whitespace is allowed.  Spark's own
# cast is more lenient (it also takes "1f", "1.0d"), hence the guard.
_FLOAT_TEXT = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


def lenient_number(c) -> Column:
    """Text to double the way Python's ``float()`` reads it; else null.

    ``' 7 '`` -> 7.0, ``'1e1'`` -> 10.0, ``'08:30'`` / ``'1f'`` -> null,
    ``'nan'`` -> NaN (later dropped like a null).
    """
    t = F.lower(F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", ""))
    # Python reads a signed NaN ("+nan", "-nan"); Spark's cast does not
    unsigned_nan = F.regexp_replace(t, r"^[+-](?=nan$)", "")
    return F.when(t.rlike(_FLOAT_TEXT), unsigned_nan.try_cast("double"))


def daily_hours(open_h, close_h) -> Column:
    """Operating hours with overnight wrap: ``(close + 24) - open`` when
    closing is earlier than opening, else ``close - open``."""
    o, c = col(open_h), col(close_h)
    return F.when(c < o, (c + F.lit(24.0)) - o).otherwise(c - o)

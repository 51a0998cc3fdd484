"""Hexagonal spatial cells as pure Column algebra (no per-row Python).

A planar pointy-top axial hex grid over an equirectangular projection
centred on latitude ``lat0``.  Cells group nearby points the way an H3 cell
does; ids are our own (``hx<edge>_<q>_<r>``), not H3 ids, and cell areas
are equal only near ``lat0``.

Because the edge length is part of the id, centroids and boundaries are
computed from the id alone.  All constants are folded in Python once and
enter the plan as double literals, so an SQL engine evaluating the same
formulas gets the same cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grid definition.
EARTH_RADIUS_M = 6371008.8      # mean Earth radius
DEFAULT_LAT0 = 19.4326          # projection centre (map centre of the survey area)
DEFAULT_EDGE_M = 531.0          # edge length, about an H3 resolution-8 cell

SQRT3 = math.sqrt(3.0)


def grid_constants(lat0: float = DEFAULT_LAT0) -> dict:
    """Metres per degree along y and along x (at ``lat0``)."""
    ky = math.pi / 180.0 * EARTH_RADIUS_M
    kx = ky * math.cos(math.radians(lat0))
    return {"ky": ky, "kx": kx}


def _d(x: float) -> str:
    """An exact double literal of Spark SQL."""
    return f"{float(x)!r}D"


def _rha(x: str) -> str:
    """Nearest integer, halves away from zero, in plain double arithmetic
    (several times cheaper than ``round``, which goes through BigDecimal)."""
    return f"(signum({x}) * floor(abs({x}) + 0.5D))"


def with_hex_cell(df: DataFrame, lat: str, lon: str, out: str = "h3_hex_id",
                  edge_m: float = DEFAULT_EDGE_M, lat0: float = DEFAULT_LAT0) -> DataFrame:
    """``df`` plus the cell id of (lat, lon) in column ``out``.

    Null for null, NaN or out-of-range coordinates.  A chain of projections,
    so every intermediate (fractional and rounded
    axial coordinates, rounding errors) is computed once per row instead of
    being repeated inside nested conditional expressions.
    """
    k = grid_constants(lat0)
    la, lo = f"CAST(`{lat}` AS DOUBLE)", f"CAST(`{lon}` AS DOUBLE)"
    x, y, e = f"({lo} * {_d(k['kx'])})", f"({la} * {_d(k['ky'])})", _d(edge_m)
    valid = (f"{la} IS NOT NULL AND {lo} IS NOT NULL AND NOT isnan({la}) AND NOT isnan({lo}) "
             f"AND abs({la}) <= 90 AND abs({lo}) <= 180")
    tmp = ["__hx_qf", "__hx_rf", "__hx_sf", "__hx_q", "__hx_r", "__hx_s", "__hx_fq", "__hx_fr"]
    steps = (df
             .selectExpr("*", f"({x} * {_d(SQRT3 / 3.0)} - {y} / 3.0D) / {e} AS __hx_qf",
                         f"({y} * {_d(2.0 / 3.0)}) / {e} AS __hx_rf")
             .selectExpr("*", "-__hx_qf - __hx_rf AS __hx_sf", f"{_rha('__hx_qf')} AS __hx_q",
                         f"{_rha('__hx_rf')} AS __hx_r")
             .selectExpr("*", f"{_rha('__hx_sf')} AS __hx_s")
             .selectExpr("*", "abs(__hx_q - __hx_qf) > abs(__hx_r - __hx_rf) AND "
                              "abs(__hx_q - __hx_qf) > abs(__hx_s - __hx_sf) AS __hx_fq")
             .selectExpr("*", "NOT __hx_fq AND abs(__hx_r - __hx_rf) > abs(__hx_s - __hx_sf) "
                              "AS __hx_fr"))
    q2 = "CAST(CASE WHEN __hx_fq THEN -__hx_r - __hx_s ELSE __hx_q END AS BIGINT)"
    r2 = "CAST(CASE WHEN __hx_fr THEN -__hx_q - __hx_s ELSE __hx_r END AS BIGINT)"
    cell = f"CASE WHEN {valid} THEN concat('hx{edge_m:g}_', {q2}, '_', {r2}) END"
    return steps.selectExpr("*", f"{cell} AS `{out}`").drop(*tmp)


def _centre_sql(cell: str) -> tuple[str, str, str]:
    """(edge, x, y) SQL of the planar centre of the cell id in ``cell``."""
    e = f"CAST(substring(split({cell}, '_')[0], 3) AS DOUBLE)"
    q = f"CAST(split({cell}, '_')[1] AS DOUBLE)"
    r = f"CAST(split({cell}, '_')[2] AS DOUBLE)"
    return e, f"(({e} * {_d(SQRT3)}) * ({q} + {r} / 2.0D))", f"(({e} * 1.5D) * {r})"


def _latlon_sql(x: str, y: str, lat0: float, digits: int | None) -> str:
    k = grid_constants(lat0)
    lat, lon = f"({y} / {_d(k['ky'])})", f"({x} / {_d(k['kx'])})"
    if digits is not None:
        lat, lon = f"round({lat}, {int(digits)})", f"round({lon}, {int(digits)})"
    return f"named_struct('lat', {lat}, 'lon', {lon})"


def hex_centroid(cell: str, lat0: float = DEFAULT_LAT0, digits: int | None = 6) -> Column:
    """struct<lat, lon> of the centre of the cell named in a column."""
    _, x, y = _centre_sql(f"`{cell}`")
    return F.expr(_latlon_sql(x, y, lat0, digits))


def hex_boundary(cell: str, lat0: float = DEFAULT_LAT0, digits: int | None = 6) -> Column:
    """array<struct<lat, lon>> of the 6 corners, counter-clockwise from -30°."""
    c = f"`{cell}`"
    e, cx, cy = _centre_sql(c)
    corners = []
    for i in range(6):
        a = math.radians(60.0 * i - 30.0)
        corners.append(_latlon_sql(f"({cx} + {e} * {_d(math.cos(a))})",
                                   f"({cy} + {e} * {_d(math.sin(a))})", lat0, digits))
    return F.expr(f"CASE WHEN {c} IS NOT NULL THEN array({', '.join(corners)}) END")

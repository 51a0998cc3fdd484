"""Hexagonal cells over the whole globe, in pure Column algebra.

The sphere is cut into the 20 spherical triangles of an icosahedron.  Inside one, a
point has three weights: the shares of the triangle's area that the small triangles
opposite its corners take.  Scaled by ``n`` and rounded together, the weights name
the nearest point of a triangular lattice, and the points nearest to one form a
hexagon (a pentagon at the 12 corners): 10 n² + 2 cells whose areas differ by a
third at most, at every latitude.

A cell is named by the corners with non-zero weight, in order: ``ic<n>_<corner>.<weight>…``.
Points on an edge or a corner have the same name from every triangle that meets there, so no
cell is cut at an edge.  The centre follows from the name alone: points with a given
share over one edge lie on a plane (tan of half the area is linear in the point), and
three such planes meet in it.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame

DEFAULT_N = 8317                     # cells of 0.74 km² on average

EARTH_AREA_KM2 = 4 * math.pi * 6371.0088 ** 2
FACE_AREA = math.pi / 5              # of the unit sphere
_GOLD = (1 + math.sqrt(5)) / 2


def corners() -> list[tuple[float, float, float]]:
    """The icosahedron's 12 corners: cyclic changes of (0, ±1, ±golden ratio), on the unit sphere."""
    norm = math.sqrt(1 + _GOLD * _GOLD)
    a, b = 1 / norm, _GOLD / norm
    flat = [(s * a, t * b) for s in (1, -1) for t in (1, -1)]
    return [(0.0, p, q) for p, q in flat] + [(p, q, 0.0) for p, q in flat] + [(q, 0.0, p) for p, q in flat]


def _dot(u, v) -> float:
    return sum(x * y for x, y in zip(u, v))


def _cross(u, v) -> tuple:
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def faces() -> list[tuple[int, int, int]]:
    """The 20 triples of corners that are all neighbours, corner numbers ascending."""
    c = corners()
    near = {(i, j) for i, j in combinations(range(12), 2) if _dot(c[i], c[j]) > 0.3}
    return [f for f in combinations(range(12), 3) if all(e in near for e in combinations(f, 2))]


_EDGE_COS = 1 / math.sqrt(5)         # cosine between neighbouring corners


def _face_tables() -> dict[str, list[float]]:
    """Per face: corner coordinates (a0.. c2), the normals over the opposite edges
    (na0.. nc2, towards the face), the middle (m0.. m2)."""
    c, out = corners(), {}
    for f in faces():
        a, b, d = (c[i] for i in f)
        turn = 1.0 if _dot(_cross(a, b), d) > 0 else -1.0
        middle = tuple(sum(x) for x in zip(a, b, d))
        for name, vector in (("a", a), ("b", b), ("c", d), ("m", middle),
                             ("na", tuple(turn * x for x in _cross(b, d))), ("nb", tuple(turn * x for x in _cross(d, a))),
                             ("nc", tuple(turn * x for x in _cross(a, b)))):
            for i in range(3):
                out.setdefault(f"{name}{i}", []).append(vector[i])
    return out


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def _pick(values: list[float], face: str) -> str:
    return f"element_at(array({', '.join(map(_d, values))}), {face})"


def with_ico_cell(df: DataFrame, lat: str, lon: str, out: str = "cell", n: int = DEFAULT_N) -> DataFrame:
    """``df`` plus the global cell of (lat, lon); null for null, NaN or out-of-range coordinates.

    A chain of projections, so each intermediate is computed once a row."""
    t = _face_tables()
    la, lo = f"CAST(`{lat}` AS DOUBLE)", f"CAST(`{lon}` AS DOUBLE)"
    valid = f"abs({la}) <= 90 AND abs({lo}) <= 180 AND NOT isnan({la}) AND NOT isnan({lo})"
    middles = ", ".join(f"__ic_x * {_d(t['m0'][f])} + __ic_y * {_d(t['m1'][f])} + __ic_z * {_d(t['m2'][f])}" for f in range(20))
    point = lambda name: f"(__ic_x * __ic_{name}0 + __ic_y * __ic_{name}1 + __ic_z * __ic_{name}2)"
    area = lambda own, p, q: (f"atan2({point('n' + own)}, {_d(1 + _EDGE_COS)} + {point(p)} + {point(q)})")
    used = [k for k in t if not k.startswith("m")]
    near = lambda x: f"floor({x} + 0.5D)"
    steps = (df
             .selectExpr("*", f"CASE WHEN {valid} THEN radians({la}) END AS __ic_la", f"radians({lo}) AS __ic_lo")
             .selectExpr("*", "cos(__ic_la) * cos(__ic_lo) AS __ic_x", "cos(__ic_la) * sin(__ic_lo) AS __ic_y", "sin(__ic_la) AS __ic_z")
             .selectExpr("*", f"array({middles}) AS __ic_m")
             .selectExpr("*", "CAST(array_position(__ic_m, array_max(__ic_m)) AS INT) AS __ic_f")
             .selectExpr("*", *[f"{_pick(t[k], '__ic_f')} AS __ic_{k}" for k in used],
                         *[f"element_at(array({', '.join(str(f[i]) for f in faces())}), __ic_f) AS __ic_v{i}" for i in range(3)])
             .selectExpr("*", f"{area('a', 'b', 'c')} AS __ic_ua", f"{area('b', 'c', 'a')} AS __ic_ub", f"{area('c', 'a', 'b')} AS __ic_uc")
             .selectExpr("*", *[f"__ic_u{c} / (__ic_ua + __ic_ub + __ic_uc) * {n} AS __ic_w{c}" for c in "abc"])
             .selectExpr("*", *[f"{near(f'__ic_w{c}')} AS __ic_i{c}" for c in "abc"])
             .selectExpr("*", *[f"abs(__ic_i{c} - __ic_w{c}) AS __ic_e{c}" for c in "abc"])
             # the three add up to n: the one rounded furthest gives way
             .selectExpr("*", "__ic_ea >= __ic_eb AND __ic_ea >= __ic_ec AS __ic_fa")
             .selectExpr("*", "NOT __ic_fa AND __ic_eb >= __ic_ec AS __ic_fb")
             .selectExpr("*", f"CAST(CASE WHEN __ic_fa THEN {n} - __ic_ib - __ic_ic ELSE __ic_ia END AS BIGINT) AS __ic_ka",
                         f"CAST(CASE WHEN __ic_fb THEN {n} - __ic_ia - __ic_ic ELSE __ic_ib END AS BIGINT) AS __ic_kb")
             .selectExpr("*", f"CAST({n} - __ic_ka - __ic_kb AS BIGINT) AS __ic_kc"))
    part = lambda i, c: f"CASE WHEN __ic_k{c} > 0 THEN concat('_', __ic_v{i}, '.', __ic_k{c}) ELSE '' END"
    cell = f"concat('ic{n}', {', '.join(part(i, c) for i, c in enumerate('abc'))})"
    kept = [f"`{c}`" for c in df.columns]
    return steps.selectExpr(*kept, f"CASE WHEN __ic_la IS NOT NULL AND __ic_lo IS NOT NULL THEN {cell} END AS `{out}`")


def _meetings() -> tuple[list[str], list[int]]:
    """Names of the corner sets a cell can have, and a face (from 1) that holds each."""
    names, held = [], []
    for k in (1, 2, 3):
        for i, f in enumerate(faces()):
            for s in combinations(f, k):
                name = ",".join(map(str, s))
                if name not in names:
                    names.append(name)
                    held.append(i + 1)
    return names, held


def with_ico_centre(df: DataFrame, cell: str, lat: str = "lat", lon: str = "lon", digits: int = 6) -> DataFrame:
    """``df`` plus latitude and longitude of the centres of the cells in a column (null for null)."""
    t = _face_tables()
    names, held = _meetings()
    used = [k for k in t if not k.startswith("m")]
    steps = (df
             .selectExpr("*", f"CAST(substring_index(substring(`{cell}`, 3), '_', 1) AS DOUBLE) AS __ic_n",
                         f"str_to_map(substring(`{cell}`, instr(`{cell}`, '_') + 1), '_', '[.]') AS __ic_s")
             .selectExpr("*", f"element_at(array({', '.join(map(str, held))}), CAST(array_position(array("
                              f"{', '.join(repr(x) for x in names)}), array_join(map_keys(__ic_s), ',')) AS INT)) AS __ic_f")
             .selectExpr("*", *[f"{_pick(t[k], '__ic_f')} AS __ic_{k}" for k in used],
                         *[f"coalesce(CAST(try_element_at(__ic_s, CAST(element_at(array({', '.join(str(f[i]) for f in faces())}), __ic_f) "
                           f"AS STRING)) AS DOUBLE), 0D) AS __ic_k{c}" for i, c in enumerate("abc")])
             .selectExpr("*", *[f"tan(__ic_k{c} / __ic_n * {_d(FACE_AREA / 2)}) AS __ic_t{c}" for c in "abc"]))
    # plane of constant area over the edge opposite a corner: (normal - t (p + q)) . x = t (1 + cos edge)
    others = {"a": "bc", "b": "ca", "c": "ab"}
    steps = steps.selectExpr("*", *[f"__ic_n{c}{i} - __ic_t{c} * (__ic_{p}{i} + __ic_{q}{i}) AS __ic_p{c}{i}"
                                    for c, (p, q) in others.items() for i in range(3)],
                             *[f"__ic_t{c} * {_d(1 + _EDGE_COS)} AS __ic_d{c}" for c in "abc"])
    cross = lambda p, q, i: (f"(__ic_p{p}{(i + 1) % 3} * __ic_p{q}{(i + 2) % 3} - __ic_p{p}{(i + 2) % 3} * __ic_p{q}{(i + 1) % 3})")
    steps = steps.selectExpr("*", *[f"__ic_da * {cross('b', 'c', i)} + __ic_db * {cross('c', 'a', i)} + __ic_dc * {cross('a', 'b', i)} "
                                    f"AS __ic_r{i}" for i in range(3)],
                             f"{' + '.join(f'__ic_pa{i} * {cross('b', 'c', i)}' for i in range(3))} AS __ic_det")
    kept = [f"`{c}`" for c in df.columns]
    east = f"round(degrees(atan2(__ic_r1 / __ic_det, __ic_r0 / __ic_det)), {digits})"
    # the antimeridian is named 180
    return steps.selectExpr(*kept, f"CASE WHEN __ic_det IS NOT NULL THEN round(degrees(asin(greatest(-1D, least(1D, __ic_r2 / __ic_det)))), "
                            f"{digits}) + 0D END AS `{lat}`",
                            f"CASE WHEN {east} = -180D THEN 180D ELSE {east} + 0D END AS `{lon}`")

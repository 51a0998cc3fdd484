"""Global hexagonal cells: areas, names across edges, centres."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.icogrid import corners, faces, with_ico_cell, with_ico_centre


def distance(a, b):
    """Central angle of two (lat, lon) points, in radians."""
    p, q = ([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)),
             math.sin(math.radians(la))] for la, lo in (a, b))
    return math.atan2(math.dist([p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]], [0, 0, 0]),
                      sum(x * y for x, y in zip(p, q)))


def cells_of(spark, points, n):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    return [r.cell for r in with_ico_cell(df, "lat", "lon", "cell", n).orderBy("i").collect()]


def centres_of(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "cell string")
    return {r.cell: (r.lat, r.lon) for r in with_ico_centre(df, "cell").collect()}


def test_icosahedron():
    assert len(corners()) == 12 and len(faces()) == 20
    assert all(math.isclose(math.dist(c, (0, 0, 0)), 1) for c in corners())


def test_areas_over_a_world_grid(spark):
    """Cells of a quarter-degree grid, each point weighing its cosine: all cells are met, and areas
    are within 1.5 of each other (hexagons alone within 1.25)."""
    n, steps = 12, 4
    grid = spark.range(0, 180 * steps * 360 * steps).select(
        ((F.floor(F.col("id") / (360 * steps)) + 0.5) / steps - 90).alias("lat"), ((F.col("id") % (360 * steps) + 0.5) / steps - 180).alias("lon"))
    areas = with_ico_cell(grid, "lat", "lon", "cell", n).groupBy("cell").agg(F.sum(F.cos(F.radians("lat"))).alias("a")).collect()
    assert len(areas) == 10 * n * n + 2
    every = [r.a for r in areas]
    hexagons = [r.a for r in areas if r.cell.count("_") > 1 or f".{n}" not in r.cell]
    assert max(every) / min(every) < 1.5 and len(hexagons) == len(every) - 12
    assert max(hexagons) / min(hexagons) < 1.25


@pytest.mark.parametrize("n", [1, 2, 7, 100, 8317])
def test_centres_lie_in_their_cells(spark, n):
    rng = random.Random(n)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(1500)]
    points += [(90.0, 5.0), (-90.0, 0.0), (0.0, 0.0), (0.0, 180.0), (12.0, -180.0), (31.717474, 0.0), (31.717474, 0.000001)]
    names = cells_of(spark, points, n)
    centres = centres_of(spark, sorted(set(names)))
    # no point is further from its centre than a cell's corner can be
    reach = 1.25 * math.sqrt(4 * math.pi / (10 * n * n + 2))
    assert max(distance(p, centres[c]) for p, c in zip(points, names)) < reach
    ordered = sorted(centres)
    assert cells_of(spark, [centres[c] for c in ordered], n) == ordered


def test_nearest_centre(spark):
    """Nearly all points are in the cell whose centre is nearest."""
    n, rng = 5, random.Random(3)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(3000)]
    names = cells_of(spark, points, n)
    centres = centres_of(spark, sorted(set(names)))
    assert len(centres) == 10 * n * n + 2
    nearest = [min(centres, key=lambda c: distance(p, centres[c])) for p in points]
    assert sum(a == b for a, b in zip(nearest, names)) > 0.96 * len(points)


def test_same_name_on_both_sides_of_an_edge(spark):
    """Around lattice points on edges and corners, all sides give the same cell."""
    n = 50
    names = [f"ic{n}_{a}.20_{b}.30" for f in faces() for a, b in (f[:2], f[1:], (f[0], f[2]))] + [f"ic{n}_{v}.{n}" for v in range(12)]
    centres = centres_of(spark, names)
    around = [(c, la + 0.2 * math.sin(t), lo + 0.2 * math.cos(t) / max(0.2, math.cos(math.radians(la))))
              for c, (la, lo) in centres.items() for t in (0, 1, 2, 3, 4, 5, 6) if abs(la) < 85]
    got = cells_of(spark, [(la, (lo + 180) % 360 - 180) for _, la, lo in around], n)
    assert got == [c for c, _, _ in around]


def test_unusable_points_and_other_columns(spark):
    rows = [(None, 1.0, 7), (1.0, None, 7), (float("nan"), 1.0, 7), (91.0, 0.0, 7), (0.5, 181.0, 7), (0.5, -180.0, 7), (0.5, 180.0, 7)]
    df = spark.createDataFrame(rows, "lat double, lon double, `a b` int")
    out = with_ico_cell(df, "lat", "lon", "cell", 30)
    assert out.columns == ["lat", "lon", "a b", "cell"]
    cells = [r.cell for r in out.collect()]
    assert cells[:5] == [None] * 5 and cells[5] == cells[6] is not None
    assert centres_of(spark, [None]) == {None: (None, None)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()

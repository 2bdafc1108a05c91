"""Nearest points on shapes and paths of legs, against plain versions that look at every point."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tramline.config import DEFAULT
from tramline.functions.exprs import METERS_PER_DEGREE
from tramline.operators import planner

SHAPE = "shape_id string, shape_pt_sequence long, shape_pt_lat double, shape_pt_lon double"
POINT = "point_id string, shape_id string, lat double, lon double"
LEG = "leg_id string, shape_id string, from_lat double, from_lon double, to_lat double, to_lon double"


def meters(lat, lon, y, x):
    dy, dx = (y - lat) * METERS_PER_DEGREE, (x - lon) * METERS_PER_DEGREE * math.cos(math.radians(lat))
    return math.sqrt(dy * dy + dx * dx)


def nearest(shape, lat, lon):
    return min((meters(lat, lon, y, x), n) for _, n, y, x in shape)[1]


def walk(rng, name, n, lat, lon, gap):
    """A winding shape with sequence numbers that leave gaps, and places passed twice."""
    rows, seq = [], 0
    for k in range(n):
        if k % 17 == 16:
            lat, lon = rows[-5][2:]
        rows.append((name, seq, lat, lon))
        seq += rng.randint(1, 40)
        lat, lon = round(lat + rng.uniform(-gap, 2 * gap), 5), round(lon + rng.uniform(-gap, 2 * gap), 5)
    return rows


@pytest.fixture(scope="module")
def world():
    rng = random.Random(7)
    shapes = {"city": walk(rng, "city", 400, 44.4, 26.0, 0.0008), "rail": walk(rng, "rail", 60, 44.0, 25.0, 0.02), "north": walk(rng, "north", 200, 78.2, -15.7, 0.002)}
    shapes["south"] = walk(rng, "south", 200, -33.9, -0.05, 0.002)
    shapes["one"] = [("one", 5, 10.0, 10.0)]
    points = []
    for name, rows in shapes.items():
        for spread in (0.0, 0.0003, 0.003, 0.05, 1.5):  # on the shape, beside it, some cells off, far away
            for _ in range(12):
                _, _, y, x = rng.choice(rows)
                points.append((f"{name}{len(points)}", name, y + rng.uniform(-spread, spread), x + rng.uniform(-spread, spread)))
    return shapes, points


@pytest.mark.parametrize("cell_m", [40.0, 250.0, 20000.0])
def test_nearest_is_that_of_all_points(spark, world, cell_m):
    shapes, points = world
    rows = [r for s in shapes.values() for r in s]
    random.Random(1).shuffle(rows)
    got = planner.nearest_shape_index(spark.createDataFrame(points, POINT), spark.createDataFrame(rows, SHAPE), replace(DEFAULT, shape_cell_m=cell_m)).collect()
    assert len(got) == len(points)
    assert {r["point_id"]: r["shape_pt_sequence"] for r in got} == {p: nearest(shapes[s], y, x) for p, s, y, x in points}


def test_first_of_equals_and_cell_edges(spark):
    step = DEFAULT.shape_cell_m / METERS_PER_DEGREE
    # Equal distances on both sides; the nearest just beyond the searched cells; a position passed twice.
    rows = [("t", 9, 0.0, step), ("t", 3, 0.0, -step), ("t", 4, 0.0, -step), ("e", 1, 0.0, 2 * step), ("e", 0, -1.999 * step, 0.0)]
    points = [("tie", "t", 0.0, 0.0), ("edge", "e", 0.999 * step, 0.999 * step), ("low", "e", 0.0, 0.0), ("same", "t", 0.0, -step), ("same too", "t", 0.0, -step)]
    got = planner.nearest_shape_index(spark.createDataFrame(points, POINT), spark.createDataFrame(rows, SHAPE)).collect()
    shapes = {s: [r for r in rows if r[0] == s] for s in "te"}
    want = {p: nearest(shapes[s], y, x) for p, s, y, x in points}
    assert {r["point_id"]: r["shape_pt_sequence"] for r in got} == want and want["tie"] == 3 and want["same"] == want["same too"] == 3


def test_missing_positions_and_empty_tables(spark):
    shapes = spark.createDataFrame([("s", 0, None, 26.0), ("s", 1, 44.0, 26.0), ("s", None, 44.0, 26.0), (None, 0, 44.0, 26.0), ("n", 0, None, None)], SHAPE)
    points = spark.createDataFrame([("a", "s", 44.1, 26.0), ("b", "s", None, 26.0), ("c", "n", 44.0, 26.0), ("d", None, 44.0, 26.0), ("e", "other", 44.0, 26.0), (None, "s", 44.0, 26.0)], POINT)
    got = {(r["point_id"], r["shape_pt_sequence"]) for r in planner.nearest_shape_index(points, shapes).collect()}
    assert got == {("a", 1), (None, 1)}
    assert planner.nearest_shape_index(points, shapes.limit(0)).count() == planner.nearest_shape_index(points.limit(0), shapes).count() == 0


def test_near_points_meet_their_cells_only(spark):
    n = 20000
    name = F.concat(F.lit("s"), F.col("id") % 1).alias("shape_id")  # no literal, which would turn the join by shape into one without keys
    line = spark.range(n).select(name, F.col("id").alias("shape_pt_sequence"), (44 + F.col("id") * 1e-4).alias("shape_pt_lat"), F.lit(26.0).alias("shape_pt_lon"))
    spots = spark.range(50).select(name, (44 + F.col("id") * 0.03).alias("lat"), F.lit(26.0003).alias("lon"))
    index = planner._shape_index(line, DEFAULT.shape_cell_m)
    met = planner._ring(spots, index, DEFAULT.shape_cell_m).filter("shape_pt_sequence is not null").count()
    a_cell = DEFAULT.shape_cell_m / METERS_PER_DEGREE / 1e-4  # points of the line in a cell
    assert 50 <= met <= 50 * 3 * (a_cell + 1) < 50 * n / 250
    # A spot far off is left few of the shape's cells by the bounds.
    off = spark.createDataFrame([("s0", 44.9, 26.5, None)], "shape_id string, lat double, lon double, best double")
    cells, left = index.select("cy", "cx").distinct().count(), planner._reachable(off, index).count()
    assert cells > 800 and left < cells / 5
    plan = planner.nearest_on_shapes(spots, line)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("size", [1, 7, 64])
def test_paths_are_slices_of_their_shape(spark, world, size):
    shapes, points = world
    rng = random.Random(3)
    by = {s: [p for p in points if p[1] == s] for s in shapes}
    legs = []
    for s, some in by.items():
        for _ in range(15):
            a, b = rng.choice(some), rng.choice(some)
            legs.append((f"{s}{len(legs)}", s, *a[2:], *b[2:]))
    legs += [("none", None, 1.0, 1.0, 2.0, 2.0), ("other", "other", 1.0, 1.0, 1.0, 1.0), ("open", "city", None, None, 44.4, 26.0)]

    def path(s, a, b):
        rows = sorted(shapes.get(s, []), key=lambda r: r[1])
        inner = []
        if len(rows) >= 2 and None not in (*a, *b):
            p, q = nearest(rows, *a), nearest(rows, *b)
            inner = [[y, x] for _, n, y, x in rows if min(p, q) <= n <= max(p, q)]
            inner = inner[::-1] if p > q else inner
        whole = [list(a), *inner, list(b)]
        return [p for k, p in enumerate(whole) if not k or p != whole[k - 1]]

    rows = [r for s in shapes.values() for r in s]
    rng.shuffle(rows)
    got = planner.leg_geometry(spark.createDataFrame(legs, LEG), spark.createDataFrame(rows, SHAPE), replace(DEFAULT, shape_part=size)).collect()
    assert len(got) == len(legs)
    assert {r["leg_id"]: r["geometry"] for r in got} == {leg: path(s, (a, b), (c, d)) for leg, s, a, b, c, d in legs}

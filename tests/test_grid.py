import math
import random

import pytest
from pyspark.sql import functions as F

from wildgrid.operators.grid import assign_cells, cell_sets, cover_polygons
from conftest import rows


def width(row):
    return max(1, math.floor(360.0 * math.cos(math.radians(row - 89.5)) + 0.5))


def test_cells_nest_and_stay_in_range(spark):
    random.seed(5)
    points = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(500)]
    points += [(90.0, 180.0), (-90.0, -180.0), (0.0, 180.0), (90.0, 0.0)]
    df = assign_cells(spark.createDataFrame(points, "latitude double, longitude double"))
    for r in df.collect():
        row, column = map(int, r.h3_r3.split("_"))
        assert r.h3_r5.startswith(r.h3_r3 + "_")
        assert 0 <= row <= 179 and 0 <= column < width(row)
        assert all(0 <= int(x) <= 6 for x in r.h3_r5.split("_")[2:])
        assert row == min(math.floor(r.latitude + 90), 179)


def test_missing_coordinates_have_no_cell(spark):
    df = assign_cells(spark.createDataFrame([(None, 1.0), (1.0, None)], "latitude double, longitude double"))
    assert rows(df, "h3_r3", "h3_r5") == [(None, None), (None, None)]


def inside(rings, x, y):
    crossings = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= y < y2) or (y2 <= y < y1):
                crossings += x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
    return crossings % 2 == 1


def brute_cover(parts, split):
    cells = set()
    for line in range(180 * split):
        y = (line + 0.5) / split - 90.0
        row = line // split
        n = width(row) * split
        for column in range(n):
            x = -180.0 + (column + 0.5) / n * 360.0
            if any(inside(rings, x, y) for rings in parts):
                name = f"{row}_{column}" if split == 1 else f"{row}_{column // split}_{line % split}_{column % split}"
                cells.add(name)
    return cells


def star(x, y, size, points, seed):
    random.seed(seed)
    corners = [
        [x + random.uniform(0.3, 1) * size * math.cos(2 * math.pi * i / points),
         y + random.uniform(0.3, 1) * size * math.sin(2 * math.pi * i / points)]
        for i in range(points)
    ]
    return corners + [corners[0]]


SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
ON_CENTRES = [[0.5, 0.5], [8.5, 0.5], [8.5, 7.5], [4.5, 3.5], [0.5, 7.5], [0.5, 0.5]]
HOLE = [[3.0, 3.0], [7.0, 3.0], [7.0, 7.0], [3.0, 7.0], [3.0, 3.0]]
SHAPES = {
    "square": [[SQUARE]],
    "vertices on centre lines": [[ON_CENTRES]],
    "hole": [[SQUARE, HOLE]],
    "overlapping parts": [[SQUARE], [[[5.0 + x, 5.0 + y] for x, y in SQUARE]]],
    "star": [[star(-60, -10, 25, 40, 1)]],
    "polar": [[star(20, 84, 5.5, 25, 2)]],
    "world edge": [[[[-180.0, -5.0], [-170.0, -5.0], [-170.0, 5.0], [-180.0, 5.0], [-180.0, -5.0]]],
                   [[[170.0, -5.0], [180.0, -5.0], [180.0, 5.0], [170.0, 5.0], [170.0, -5.0]]]],
    "bow tie": [[[[0.0, 0.0], [12.0, 9.0], [12.0, 0.0], [0.0, 9.0], [0.0, 0.0]]]],
}
PARTS = "eco_id int, parts array<array<array<array<double>>>>"


def test_cover_equals_testing_every_centre(spark):
    names = list(SHAPES)
    df = spark.createDataFrame([(i, SHAPES[n]) for i, n in enumerate(names)], PARTS)
    got = {}
    for r in cover_polygons(df).collect():
        got.setdefault(r.eco_id, []).append(r.h3_r3)
    for i, name in enumerate(names):
        assert len(got.get(i, [])) == len(set(got.get(i, []))), name
        assert set(got.get(i, [])) == brute_cover(SHAPES[name], 1), name


def test_fine_cover(spark):
    shape = [[star(-60, -10, 3, 12, 4)]]
    df = spark.createDataFrame([(1, shape)], PARTS)
    got = {r.h3_r5 for r in cover_polygons(df, resolution=5).collect()}
    assert got == brute_cover(shape, 7)


def test_one_polygon_with_very_many_edges(spark):
    """Crossings of one row are combined before they are ordered."""
    shape = [[star(10, 10, 20, 20000, 9)]]
    df = spark.createDataFrame([(1, shape)], PARTS)
    got = cell_sets(cover_polygons(df)).first()
    assert got["eco_id"] == 1 and got["cells"] == sorted(set(got["cells"]))
    sample = random.Random(1).sample(sorted(got["cells"]), 20)
    for cell in sample:
        row, column = map(int, cell.split("_"))
        assert inside(shape[0], -180.0 + (column + 0.5) / width(row) * 360.0, row - 89.5)

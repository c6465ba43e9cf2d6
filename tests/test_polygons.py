"""Spans of many polygons against the test of single ones, cell by cell."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import named
from terracell.grid import GridSpec
from terracell.operators import polygons, subset

GRIDS = [GridSpec("EPSG:4326", -3.0, -2.0, 0.5, 0.75, 23, 17), GridSpec("EPSG:4326", -3.0, 9.0, 0.5, -0.75, 23, 17)]


def shapes(spark, rings_by_id):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in rings_by_id.items()], "polygon_id long, rings array<array<struct<x:double,y:double>>>")


def lattice(spark, grid):
    return Cube(grid.lattice(spark).withColumn("v", F.lit(1)), grid)


def check(spark, rings_by_id, grid):
    cube = lattice(spark, grid)
    runs = polygons.spans(polygons.edges(shapes(spark, rings_by_id)), grid)
    got = {(r["polygon_id"], r["iy"], r["ix"]) for r in polygons.labelled(cube, runs).collect()}
    want = set()
    for k, rings in rings_by_id.items():
        hit = cube.df.where(subset.inside(grid.x(F.col("ix")), grid.y(F.col("iy")), [[tuple(map(float, c)) for c in r] for r in rings]))
        want |= {(k, r["iy"], r["ix"]) for r in hit.collect()}
    assert got == want
    assert {(r["iy"], r["ix"]) for r in polygons.masked(cube, runs).df.collect()} == {w[1:] for w in want} and polygons.masked(cube, runs).df.count() == len({w[1:] for w in want})


@pytest.mark.parametrize("grid", GRIDS)
def test_like_single_polygons(spark, grid):
    rng = np.random.default_rng(1)
    own = {k: [rng.uniform(-4, 9, (int(rng.integers(3, 9)), 2)).tolist()] for k in range(6)}
    own[10] = [[(-2, -1), (6, -1), (6, 6), (-2, 6)], [(0, 0), (3, 0), (3, 3), (0, 3)]]
    own[11] = [[(-2.75, -1.625), (0.25, -1.625), (0.25, 0.625), (-2.75, 0.625)]]  # borders on centres
    own[12] = [[(100, 100), (110, 100), (105, 120)]]
    check(spark, own, grid)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 9), st.integers(-3, 10)), min_size=3, max_size=8))
def test_corners_on_a_lattice(spark, ring):
    check(spark, {1: [[(x / 2, y * 0.375) for x, y in ring]]}, GRIDS[0])


def test_edges_bend_when_projected(spark):
    box = {1: [[(0, 50), (20, 50), (20, 60), (0, 60)]]}
    grid = GridSpec("EPSG:3035", 3_500_000.0, 2_800_000.0, 20_000.0, 20_000.0, 90, 80)
    cube = lattice(spark, grid)
    t = named("EPSG:3035")
    lon, lat = t.inverse_columns(grid.x(F.col("ix")), grid.y(F.col("iy")))
    want = {(r["iy"], r["ix"]) for r in cube.df.where(lon.between(0, 20) & lat.between(50, 60)).collect()}
    cells = lambda step: {(r["iy"], r["ix"]) for r in polygons.masked(cube, polygons.spans(polygons.edges(shapes(spark, box), t, step), grid)).df.collect()}
    assert len(cells(0.05) ^ want) <= 4 < len(cells(None) ^ want)
    with pytest.raises(Exception, match="outside of the projection"):
        polygons.edges(shapes(spark, {1: [[(-170, -52), (0, 0), (1, 1)]]}), t).collect()


def test_no_polygons_and_wide_spans(spark):
    wide = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 2000, 3)
    check(spark, {1: [[(3.2, -1), (1700.7, -1), (1700.7, 5), (3.2, 5)]], 2: [[(1, 1), (2, 2)]]}, wide)
    none = polygons.spans(polygons.edges(shapes(spark, {})), wide)
    assert polygons.masked(lattice(spark, wide), none).df.count() == 0 and polygons.labelled(lattice(spark, wide), none).count() == 0


def test_many_polygons_over_each_other_are_one_mask(spark):
    grid = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 600, 4)
    boxes = {k: [[(k % 7, -1), (k % 7 + 20, -1), (k % 7 + 20, 9), (k % 7, 9)]] for k in range(300)}
    boxes |= {300: [[(26, 0), (290, 0), (290, 2), (26, 2)]], 301: [[(400, 0), (401, 0), (401, 2), (400, 2)]]}
    runs = polygons.spans(polygons.edges(shapes(spark, boxes)), grid)
    assert {(r["iy"], r["first"], r["last"]) for r in polygons.united(runs).collect()} == {(y, 0, 289 if y < 2 else 25) for y in range(4)} | {(y, 400, 400) for y in range(2)}
    # Rows that share a cell all stay, each once.
    cells = lattice(spark, grid).df.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    got = polygons.masked(Cube(cells, grid), runs).df
    assert got.columns == ["iy", "ix", "v"]
    assert sorted(map(tuple, got.collect())) == sorted((y, x, v) for y in range(4) for x in range(600) for v in (1, 2) if x < (290 if y < 2 else 26) or x == 400 and y < 2)

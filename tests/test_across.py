"""Resampling between CRSs: exact areas, what lies outside of a projection, seams of longitudes, and the source's part that is read."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import TransverseMercator, named
from terracell.grid import GridSpec
from terracell.operators import across
from terracell.operators.reproject import METHODS, reproject

#: The same places as EPSG:4326 under another name, so that the general path is taken.
LONLAT = "+proj=longlat +datum=WGS84"


def filled(spark, grid, value=None):
    return Cube(grid.lattice(spark).withColumn("v", (F.col("iy") * 100 + F.col("ix")).cast("double") if value is None else value), grid)


def rows(cube):
    return {(r["iy"], r["ix"]): r["v"] for r in cube.df.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_the_same_crs_by_another_name(spark, method):
    source = filled(spark, GridSpec("EPSG:4326", 10.0, 20.0, 0.5, -0.5, 9, 8))
    for target in (GridSpec("EPSG:4326", 10.3, 19.9, 0.7, -0.8, 5, 6), GridSpec("EPSG:4326", 9.0, 15.0, 1.1, 1.3, 6, 5)):
        if method in ("cubic", "cubic_spline", "lanczos", "bilinear"):
            target = GridSpec("EPSG:4326", 10.9, 19.3, 0.4, -0.4, 6, 6)  # finer than the source: kernels widen otherwise
        want = rows(reproject(source, target, method))
        got = rows(reproject(source, GridSpec(LONLAT, *[getattr(target, k) for k in ("x0", "y0", "dx", "dy", "width", "height")]), method))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_sums_are_kept_and_shares_fill_cells(spark):
    source = GridSpec("EPSG:4326", 8.0, 50.0, 0.3, 0.3, 12, 9)
    target = GridSpec("EPSG:3035", 3_900_000.0, 3_600_000.0, 33_000.0, -47_000.0, 30, 30)
    ones = filled(spark, source, F.lit(1.0))
    got = rows(reproject(ones, target, "sum"))
    assert sum(got.values()) == pytest.approx(108, rel=1e-9) and all(v > 0 for v in got.values())
    inner = across.overlaps(ones, target).groupBy("iy", "ix").agg(F.sum("_w").alias("w")).collect()
    assert max(r["w"] for r in inner) == pytest.approx(1.0, abs=1e-9) and sum(abs(r["w"] - 1) < 1e-9 for r in inner) > 10
    back = rows(reproject(filled(spark, target, F.lit(1.0)), GridSpec("EPSG:4326", 7.0, 49.0, 1.0, 1.0, 6, 6), "sum"))
    assert back[(1, 1)] > 0 and max(back.values()) < 10


def test_far_cells_have_no_value(spark):
    world = filled(spark, GridSpec("EPSG:4326", -180.0, -90.0, 10.0, 10.0, 36, 18))
    target = GridSpec("EPSG:3035", 4_321_000.0 - 11_500_000, 3_210_000.0 - 11_500_000, 500_000.0, 500_000.0, 46, 46)
    got = rows(reproject(world, target, "nearest"))
    t = named("EPSG:3035")
    want = {}
    for iy in range(46):
        for ix in range(46):
            try:
                lon, lat = t.inverse_point(target.x0 + target.dx * (ix + 0.5), target.y0 + target.dy * (iy + 0.5))
            except ValueError:
                continue
            want[iy, ix] = math.floor((lat + 90) / 10) * 100.0 + math.floor((lon + 180) / 10) % 36
    assert got == want and len(want) < 46 * 46 and sum(v == 0 for v in got.values()) < 5
    unit = filled(spark, GridSpec("EPSG:3035", 4_321_000.0 - 15_000_000, 3_210_000.0 - 15_000_000, 2_500_000.0, 2_500_000.0, 12, 12), F.lit(1.0))
    total = rows(reproject(unit, GridSpec("EPSG:4326", -180.0, -90.0, 90.0, 90.0, 4, 2), "sum"))
    assert sum(total.values()) < 144 and max(total.values()) < 30


def test_seams_of_longitudes(spark):
    turned = filled(spark, GridSpec("EPSG:4326", 0.0, -60.0, 10.0, 10.0, 36, 12))
    target = GridSpec(LONLAT, -180.0, -60.0, 10.0, 10.0, 36, 12)
    for method in ("nearest", "average", "max", "sum"):
        got = rows(reproject(turned, target, method))
        assert got == {(y, x): pytest.approx(100.0 * y + (x + 18) % 36) for y in range(12) for x in range(36)}, method
    half = GridSpec(LONLAT, -175.0, -60.0, 10.0, 10.0, 36, 12)
    got = rows(reproject(filled(spark, GridSpec("EPSG:4326", -180.0, -60.0, 10.0, 10.0, 36, 12), F.lit(1.0)), half, "sum"))
    assert len(got) == 432 and all(v == pytest.approx(1.0) for v in got.values())
    fiji = GridSpec("EPSG:32760", 0.0, 7_500_000.0, 100_000.0, 100_000.0, 9, 9)
    got = rows(reproject(filled(spark, GridSpec("EPSG:4326", -180.0, -40.0, 1.0, 1.0, 360, 60)), fiji, "nearest"))
    assert len(got) == 81 and {int(v % 100) for v in got.values()} != {0}


def test_only_the_footprint_is_read(spark, tmp_path):
    world = GridSpec("EPSG:4326", -180.0, -90.0, 1.0, 1.0, 360, 180)
    filled(spark, world).df.write.parquet(str(tmp_path / "world"))
    cube = Cube(spark.read.parquet(str(tmp_path / "world")), world)
    target = GridSpec("EPSG:3035", 4_300_000.0, 3_200_000.0, 10_000.0, 10_000.0, 20, 20)
    for method in ("nearest", "average", "cubic"):
        df = reproject(cube, target, method).df
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ix,18", plan) and "Join" not in plan
        assert df.count() == 400
    box = across.footprint(world, target)
    assert box[1] - box[0] < 12 and box[3] - box[2] < 12
    assert across.footprint(world, GridSpec("EPSG:3035", -2e7, -2e7, 1e6, 1e6, 40, 40)) is None


@settings(max_examples=60, deadline=None)
@given(st.floats(-50, 50), st.floats(-84, 84), st.sampled_from([9.0, -177.0, 177.0]))
def test_transverse_mercator_far_from_its_meridian(turn, lat, lon0):
    t = TransverseMercator(lon0)
    lon, back = t.inverse_point(*t.point(lon0 + turn, lat))
    assert abs((lon - lon0 - turn + 180) % 360 - 180) < 2e-8 and back == pytest.approx(lat, abs=2e-8)
    with pytest.raises(ValueError):
        t.point(lon0 + 90, lat)


def test_columns_are_null_outside(spark):
    df = spark.createDataFrame([(9.0, 50.0), (120.0, 0.0), (-170.0, -52.0)], "lon double, lat double")
    for crs, valid in (("EPSG:32632", [True, False, False]), ("EPSG:3035", [True, True, False])):
        x, y = named(crs).columns(F.col("lon"), F.col("lat"))
        assert [r["x"] is not None and r["y"] is not None for r in df.select(x.alias("x"), y.alias("y")).collect()] == valid
    x, y = named("EPSG:3035").inverse_columns(F.col("lon") * 1e6, F.col("lat") * 1e6)
    assert [r["x"] is not None for r in df.select(x.alias("x"), y.alias("y")).collect()] == [False, False, False]


def brute_area(quad, n=400):
    """Share of the unit cell inside a quadrilateral, on a fine lattice."""
    at = (np.arange(n) + 0.5) / n
    x, y = np.meshgrid(at, at)
    inside = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(quad, [*quad[1:], quad[0]]):
        crosses = (ay > y) != (by > y)
        inside ^= crosses & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax)
    return inside.mean()


def test_shared_areas_of_any_quadrilateral(spark):
    rng = np.random.default_rng(2)
    quads = [rng.uniform(-1, 2, (4, 2)) for _ in range(150)] + [np.array(q, float) for q in ([(0, 0), (1, 0), (1, 1), (0, 1)], [(-1, -1), (2, -1), (2, 2), (-1, 2)], [(0.5, -1), (0.5, 0.5), (2, 0.5), (2, -1)], [(3, 3), (4, 3), (4, 4), (3, 4)])]
    simple = [q for q in quads if not _crossing(q)]
    df = spark.createDataFrame([(k, 0, 0, *map(float, q.T.ravel())) for k, q in enumerate(simple)], ["k", "ix", "iy", *[f"_u{k}" for k in range(4)], *[f"_v{k}" for k in range(4)]])
    for r in across.shared_area(df).collect():
        assert r["_w"] == pytest.approx(brute_area(simple[r["k"]].tolist()), abs=0.01)


def _crossing(q):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    meet = lambda a, b, c, d: side(a, b, c) != side(a, b, d) and side(c, d, a) != side(c, d, b)
    return meet(q[0], q[1], q[2], q[3]) or meet(q[1], q[2], q[3], q[0])

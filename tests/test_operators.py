"""Hand-computed grids, edges, ties, missing data and errors."""

import warnings

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import EqualAreaConic, TransverseMercator, named
from terracell.grid import GridSpec, half_even, snapped
from terracell.operators import subset, values
from terracell.operators.coarsen import coarsen
from terracell.operators.merge import merge
from terracell.operators.reduce import compared, dominant, interquartile, over_time, peak
from terracell.operators.reproject import AREA, KERNELS, reproject
from terracell.plans.align import Aligner, methods_of

GRID = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 4, 4)


def cube(spark, cells, kind="double", grid=GRID):
    return Cube(spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], f"iy long, ix long, v {kind}"), grid)


def square(spark, kind="double"):
    cells = {(y, x): kind == "double" and float(4 * y + x + 1) or 4 * y + x + 1 for y in range(4) for x in range(4)}
    cells[(1, 1)] = None
    return cube(spark, cells, kind)


def table(c, v="v"):
    return {(r["iy"], r["ix"]): r[v] for r in c.df.collect()}


@pytest.mark.parametrize(
    ("method", "first", "last"),
    [("first", 1, 11), ("min", 1, 11), ("max", 5, 16), ("sum", 8, 54), ("mean", 8 / 3, 13.5), ("median", 2, 13.5), ("mode", 1, 11)],
)
def test_coarsen_by_two(spark, method, first, last):
    got = table(coarsen(square(spark), 2, method))
    assert len(got) == 4
    assert got[(0, 0)] == pytest.approx(first)
    assert got[(1, 1)] == pytest.approx(last)


def test_coarsen_casts_integers_toward_zero_and_keeps_edges(spark):
    got = table(coarsen(square(spark, "int"), 3, "mean"))
    assert got == {(0, 0): 6, (0, 1): 8, (1, 0): 14, (1, 1): 16}  # 48 / 8, without the NULL
    halves = table(coarsen(square(spark, "int"), 2, "mean"))
    assert (halves[(0, 0)], halves[(1, 1)]) == (2, 13)  # 8 / 3 and 54 / 4
    assert coarsen(square(spark), 3).grid.width == 2


def test_coarsen_of_nulls_and_ties(spark):
    c = cube(spark, {(0, 0): None, (0, 1): None, (1, 0): None, (1, 1): None, (0, 2): 7, (0, 3): 3, (1, 2): 3, (1, 3): 7}, "int")
    for method in ("min", "mean", "mode", "median", "sum"):
        assert table(coarsen(c, 2, method))[(0, 0)] is None
    assert table(coarsen(c, 2, "mode"))[(0, 1)] == 3


def test_coarsen_rules(spark):
    c = square(spark)
    with pytest.raises(ValueError, match="unknown method"):
        coarsen(c, 2, "variance")
    with pytest.raises(ValueError, match="1 or more"):
        coarsen(c, 0)
    both = c.having(c.df.withColumn("n", F.lit(3)))
    assert {r["n"] for r in coarsen(both, 2, {"*": "sum", "v": "max"}).df.collect()} == {12}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), min_size=16, max_size=16), st.integers(1, 5))
def test_coarsened_sums_add_up(spark, vs, factor):
    c = cube(spark, {(k // 4, k % 4): v for k, v in enumerate(vs)}, "long")
    assert sum(table(coarsen(c, factor, "sum")).values()) == sum(vs)
    assert table(coarsen(c, 1, "sum")) == table(c)


def test_nearest_onto_itself_and_constants(spark):
    assert table(reproject(square(spark), GRID)) == table(square(spark))
    flat = cube(spark, {(y, x): 5.0 for y in range(4) for x in range(4)})
    for w in (2, 3, 8):
        target = GridSpec("EPSG:4326", 0.0, 0.0, 4 / w, 4 / w, w, w)
        for method in (*KERNELS, *AREA):
            got = table(reproject(flat, target, method))
            assert len(got) == w * w, method
            want = 5.0 * (4 / w) ** 2 if method == "sum" else 5.0
            assert all(v == pytest.approx(want) for v in got.values()), method


def test_area_methods_by_hand(spark):
    target = GridSpec("EPSG:4326", 0.0, 0.0, 2.0, 2.0, 2, 2)
    got = {m: table(reproject(square(spark), target, m))[(0, 0)] for m in AREA}
    assert got["average"] == pytest.approx(8 / 3)
    assert got["sum"] == 8
    assert got["rms"] == pytest.approx((30 / 3) ** 0.5)
    assert (got["max"], got["min"], got["med"], got["q1"], got["q3"], got["mode"]) == (5, 1, 2, 1.5, 3.5, 1)


def test_rms_of_integers_whose_squares_exceed_a_long(spark):
    large = cube(spark, {(0, 0): 7 * 10**9, (0, 1): 10**9}, "long")
    got = table(reproject(large, GridSpec("EPSG:4326", 0.0, 0.0, 2.0, 2.0, 2, 2), "rms"))
    assert got[(0, 0)] == pytest.approx(5e9)


def test_dense_and_outside(spark):
    target = GridSpec("EPSG:4326", 2.0, 2.0, 1.0, 1.0, 4, 4)
    assert len(table(reproject(square(spark), target))) == 4
    dense = table(reproject(square(spark), target, dense=True))
    assert len(dense) == 16 and dense[(3, 3)] is None and dense[(0, 0)] == 11


def test_between_projections(spark):
    source = GridSpec("EPSG:4326", 8.0, 50.0, 0.5, 0.5, 8, 8)
    c = cube(spark, {(y, x): float(10 * y + x) for y in range(8) for x in range(8)}, grid=source)
    x, y = named("EPSG:3035").point(10.25, 52.25)
    target = GridSpec("EPSG:3035", x - 500, y - 500, 1000.0, 1000.0, 1, 1)
    assert table(reproject(c, target)) == {(0, 0): 44.0}
    assert table(reproject(c, target, "bilinear"))[(0, 0)] == pytest.approx(44.0, abs=1e-3)
    for name in ("u", "w"):  # names that resampling might want for itself
        assert table(reproject(subset.renamed(c, {"v": name}), target, "bilinear"), name)[(0, 0)] == pytest.approx(44.0, abs=1e-3)


def test_area_methods_between_projections(spark):
    source = GridSpec("EPSG:4326", 9.0, 51.0, 0.01, 0.01, 20, 20)
    flat = cube(spark, {(y, x): 5.0 for y in range(20) for x in range(20)}, grid=source)
    x, y = named("EPSG:3035").point(9.1, 51.1)
    target = GridSpec("EPSG:3035", x - 3000, y - 3000, 3000.0, 3000.0, 2, 2)
    for method in AREA:
        got = table(reproject(flat, target, method))
        assert len(got) == 4, method
        if method != "sum":
            assert all(v == pytest.approx(5.0) for v in got.values()), method
    ramp = cube(spark, {(y, x): float(x) for y in range(20) for x in range(20)}, grid=source)
    fine = [(4 * cx + a, 4 * cy + b) for cx in range(20) for cy in range(20) for a in range(4) for b in range(4)]
    places = {p: named("EPSG:3035").point(9 + 0.01 * (p[0] + 0.5) / 4, 51 + 0.01 * (p[1] + 0.5) / 4) for p in fine}
    inside = [p[0] // 4 for p, (px, py) in places.items() if x - 3000 <= px < x and y - 3000 <= py < y]
    assert table(reproject(ramp, target, "average"))[(0, 0)] == pytest.approx(sum(inside) / len(inside), rel=0.02)
    assert table(reproject(ramp, target, "sum"))[(0, 0)] == pytest.approx(sum(inside) / 16, rel=0.02)


def test_projections_give_published_points():
    assert named("EPSG:3035").point(10, 52) == (4321000, 3210000)
    assert named("3035").point(5, 50) == pytest.approx((3962799.45, 2999718.85), abs=0.01)
    clarke = (6378206.4, 294.978698213898)
    assert EqualAreaConic(29.5, 45.5, 23, -96, ellipsoid=clarke).point(-75, 35) == pytest.approx((1885472.7, 1535925.0), abs=0.1)
    assert TransverseMercator(-75, easting=0, ellipsoid=clarke).point(-73.5, 40.5) == pytest.approx((127106.5, 4484124.4), abs=0.1)
    with pytest.raises(ValueError):
        named("EPSG:1")


@settings(max_examples=60, deadline=None)
@given(st.floats(-2.9, 2.9), st.floats(-60, 60), st.sampled_from(["EPSG:32632", "EPSG:25830", "EPSG:31983", "EPSG:3035"]))
def test_projections_turn_back(dx, lat, crs):
    t = named(crs)
    if crs == "EPSG:3035":
        lat = 35 + (lat + 60) / 4
    lon0 = t.lon0 + dx
    lon, back = t.inverse_point(*t.point(lon0, lat))
    assert (lon, back) == pytest.approx((lon0, lat), abs=1e-6)


def test_merge(spark):
    a, b = cube(spark, {(0, 0): 1.0, (0, 1): None}), cube(spark, {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0})
    assert table(merge([a, b])) == table(merge([b, a])) == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0}
    with pytest.raises(Exception, match="conflicting values of v"):
        merge([a, cube(spark, {(0, 0): 9.0})]).df.collect()
    with pytest.raises(ValueError):
        merge([])
    with pytest.raises(ValueError):
        merge([a, cube(spark, {(0, 0): 1.0}, grid=GridSpec("EPSG:4326", 0, 0, 2, 2, 2, 2))])


def test_align(spark):
    fine = cube(spark, {(y, x): 1.0 for y in range(4) for x in range(4)})
    coarse = Cube(spark.createDataFrame([(0, 0, 7)], "iy long, ix long, w int"), GridSpec("EPSG:4326", 0, 0, 2, 2, 2, 2))
    got = Aligner("coarse", resampling={"fine": "sum"}).align({"fine": fine, "coarse": coarse})
    assert {(r["iy"], r["ix"]): (r["v"], r["w"]) for r in got.df.collect()} == {(0, 0): (4.0, 7), (0, 1): (4.0, None), (1, 0): (4.0, None), (1, 1): (4.0, None)}
    assert Aligner("coarse", coarsen_first=2).factor(fine.grid, coarse.grid) == 2
    for bad, error in (({}, ValueError), ({"a": 1}, ValueError), ({"coarse": coarse, "b": 2}, TypeError)):
        with pytest.raises(error):
            Aligner("coarse").align(bad)


def test_resampling_specs():
    assert methods_of("a", ["x", "y"], None) == {"x": "nearest", "y": "nearest"}
    assert methods_of("a", ["x", "y"], {"a": {"default": "MAX", "vars": {"y": "q1", "z": "med"}}}) == {"x": "max", "y": "q1"}
    with pytest.raises(ValueError):
        methods_of("a", ["x"], "smooth")
    with pytest.raises(TypeError):
        methods_of("a", ["x"], {"a": 3})


def test_grids():
    assert [half_even(v) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert snapped(0.3, 1.0, "nearest_multiple") == pytest.approx(0.9)
    assert snapped(0.25, 1.0000000001, "auto") == 1.0 and snapped(0.3, 1.0, "auto") == 1.0 and snapped(0, 5, "nearest_multiple") == 5
    assert GRID.at_resolution(3.0).width == 2
    with pytest.raises(ValueError):
        GRID.at_resolution(2.0, crs="EPSG:3035")
    assert GRID.digest() == GridSpec("EPSG:4326", 1e-12, 0.0, 1.0, 1.0, 4, 4).digest() != GRID.coarsened(2).digest()


def test_boxes_are_closed_and_work_downwards(spark):
    assert len(table(subset.bbox(square(spark), 0.5, 1.5, 1.5, 1.5))) == 2
    assert len(table(subset.bbox(square(spark), 0.51, 0, 1.49, 4))) == 0
    down = square(spark).having(square(spark).df, grid=GridSpec("EPSG:4326", 0.0, 4.0, 1.0, -1.0, 4, 4))
    assert {k[0] for k in table(subset.bbox(down, 0, 3, 4, 4))} == {0}


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    assert len(table(subset.polygon(square(spark), [ring]))) == 16
    assert set(table(subset.polygon(square(spark), [ring], mask=True))) == {(y, x) for y in range(4) for x in range(4) if x + y < 3}
    with pytest.raises(ValueError):
        subset.polygon(square(spark), [ring[:2]])


def test_time_periods(spark):
    c = Cube(spark.sql("SELECT 0L iy, 0L ix, TIMESTAMP_NTZ '2020-12-31 23:59:59.999999' t, 1 v UNION ALL SELECT 0L, 0L, TIMESTAMP_NTZ '2021-01-01', 2"), GRID, "t")
    for end in ("2020", "2020-12", "2020-12-31", "2020-12-31T23:59:59"):
        assert [r["v"] for r in subset.time_range(c, None, end).df.collect()] == [1], end
    assert subset.time_range(c, "2021").df.count() == 1
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert subset.time_range(square(spark), "2020").df.count() == 16
        assert len(seen) == 1
    with pytest.raises(ValueError):
        subset.time_range(c, "soon")


def test_fill(spark):
    df = spark.createDataFrame([(v,) for v in (float("nan"), float("inf"), float("-inf"), None, 0.0, -3.9)], "v double")
    assert [r[0] for r in df.select(values.filled_as(F.col("v"), -9999, "int")).collect()] == [-9999] * 4 + [0, -3]


@pytest.mark.parametrize(("code", "month"), [(0, -1), (None, -1), (20004, 600), (20366, 611), (21366, -1), (20000, -1), (20400, -1)])
def test_date_codes(spark, code, month):
    df = spark.createDataFrame([(code,)], "c int")
    assert df.select(values.month_index(F.col("c"))).first()[0] == month


def test_reductions(spark):
    c = Cube(spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, None), (0, 1, 1, 5.0)], "iy long, ix long, t int, v double"), GRID, "t")
    assert table(over_time(c)) == {(0, 0): 2.0, (0, 1): 5.0}
    assert peak(spark.createDataFrame([(2001, 4), (2000, 4), (1999, 1)], "y int, n int"), "y", "n").first()["y"] == 2000
    e = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 2.0)], "k string, p int, e double")
    assert dominant(e, ["k"], "p", "e").first()["p"] == 1
    assert interquartile(e, ["k"], "e").first()["iqr"] == pytest.approx(1.25)
    r = compared(cube(spark, {(0, 0): 1.0, (0, 1): float("nan"), (0, 2): 4.0}), cube(spark, {(0, 0): 3.0, (0, 1): 1.0, (0, 2): 4.0}), "v", "v").first()
    assert (r["n"], r["mean_difference"], r["rmsd"]) == (2, -1.0, pytest.approx(2**0.5))


def test_box_reaches_the_scan(spark, tmp_path):
    from terracell.sources.store import read, write

    write(square(spark), str(tmp_path / "c"), (2, 2))
    plan = subset.bbox(read(spark, str(tmp_path / "c")), 0, 0, 2, 2).df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(ix,1)" in plan


def test_polygons_with_holes_and_many_edges(spark):
    import math

    from terracell.operators import subset

    grid = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 10, 10)
    cube = Cube(grid.lattice(spark).withColumn("v", F.lit(1)), grid)
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    cells = lambda c: {(r["iy"], r["ix"]) for r in c.df.collect()}
    box = lambda a, b: {(y, x) for y in range(a, b) for x in range(a, b)}
    assert cells(subset.polygon(cube, [square(1, 9), square(3, 6)], mask=True)) == box(1, 9) - box(3, 6)
    assert cells(subset.polygon(cube, [[square(1, 5)], [square(3, 8)]], mask=True)) == box(1, 5) | box(3, 8)
    circle = [(5 + 4 * math.cos(k / 500 * math.tau), 5 + 4 * math.sin(k / 500 * math.tau)) for k in range(500)]
    assert cells(subset.polygon(cube, [circle], mask=True)) == {(y, x) for y in range(10) for x in range(10) if (x - 4.5) ** 2 + (y - 4.5) ** 2 < 16}
    times = Cube(spark.createDataFrame([(0, 0, t, t * t) for t in (3, 5, 9)], "iy long, ix long, t int, v int"), grid, "t")
    assert [subset.at_index(times, k).df.first()["v"] for k in (0, 1, -1)] == [9, 25, 81]
    with pytest.raises(IndexError):
        subset.at_index(times, 3)


def test_area_methods_between_crss_leave_no_gaps(spark):
    from terracell.catalog.products import AMAZON_ALBERS
    from terracell.functions.crs import named
    from terracell.operators.reproject import reproject

    source = GridSpec("EPSG:4326", 9.5, 51.5, 0.1, 0.1, 10, 10)
    cube = Cube(source.lattice(spark).withColumn("v", F.lit(7.0)), source)
    target = GridSpec("EPSG:3035", 4_310_000.0, 3_200_000.0, 1000.0, 1000.0, 20, 20)
    for method in ("average", "max", "mode"):
        rows = reproject(cube, target, method).df.collect()
        assert len(rows) == 400 and all(r["v"] == pytest.approx(7.0) for r in rows)
    x, y = named(AMAZON_ALBERS).point(-54.0, -12.0)
    assert (round(x, 3), round(y, 3)) == (5_000_000.0, 10_000_000.0)
    with pytest.raises(ValueError):
        named("+proj=merc +ellps=WGS84")


def test_digests_of_columns(spark):
    from terracell.grid import digests

    grids = [GridSpec("EPSG:4326", x, -0.0, 0.1, -1 / 3, w, 7) for x, w in ((1.5, 3), (-2.0, 4), (1e-12, 5))]
    df = spark.createDataFrame([(g.x0, g.y0, g.dx, g.dy, g.width, g.height) for g in grids], "x0 double, y0 double, dx double, dy double, width int, height int")
    got = df.select(digests("EPSG:4326", *[F.col(c) for c in ("x0", "y0", "dx", "dy", "width", "height")]).alias("d")).collect()
    assert [r["d"] for r in got] == [g.digest() for g in grids]

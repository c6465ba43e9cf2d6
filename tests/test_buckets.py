"""Stores in buckets of chunks: same rows as the plain operators, and no shuffle between them."""

import pytest
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.operators import coarsen as C
from terracell.operators.merge import merge
from terracell.sources import buckets as B

GRID = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 24, 24)


@pytest.fixture(scope="module")
def cubes(spark):
    cells = spark.range(24 * 24).select(F.expr("id div 24").alias("iy"), (F.col("id") % 24).alias("ix"))
    first = cells.where("ix < 20").withColumns({"v": (F.col("iy") * 100 + F.col("ix")).cast("int"), "w": F.col("iy") / 2})
    second = cells.where("iy > 3").select("iy", "ix", F.when(F.col("ix") % 5 != 0, F.col("iy") * 100 + F.col("ix")).cast("int").alias("v"), (F.col("ix") % 3).cast("int").alias("m"))
    return Cube(first, GRID), Cube(second, GRID)


@pytest.fixture(scope="module")
def stores(spark, cubes, tmp_path_factory):
    base = tmp_path_factory.mktemp("buckets")
    for k, c in enumerate(cubes):
        B.write(c, f"{base}/it's {k}", (4, 8), 4)
    return [B.read(spark, f"{base}/it's {k}") for k in range(2)]


@pytest.fixture
def together(spark):
    """A session that lets buckets meet, and doesn't broadcast these small tables instead."""
    own = {B.SETTING[0]: B.SETTING[1], "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(cube):
    return sorted((tuple(sorted(r.asDict().items())) for r in cube.df.collect()), key=str)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_round_trip(spark, cubes, stores):
    assert rows(stores[0].plain()) == rows(cubes[0]) and stores[0].cube.grid == GRID


def test_merge(cubes, stores, together):
    both = B.merge(stores)
    assert shuffles(both.cube.df) == 0
    assert rows(both.plain()) == rows(merge(list(cubes)))


def test_merge_without_the_setting(spark, cubes, stores, together):
    """Spark shuffles then, to the same rows; so do plain joins on cells only."""
    spark.conf.set(B.SETTING[0], "true")
    both = B.merge(stores)
    assert shuffles(both.cube.df) == 2 and rows(both.plain()) == rows(merge(list(cubes)))
    assert shuffles(merge([s.plain() for s in stores]).df) == 2


def test_conflicts_fail(stores):
    other = stores[1].having(stores[1].cube.df.withColumn("v", F.col("v") + 1))
    with pytest.raises(Exception, match="conflicting values of v"):
        B.merge([stores[0], other]).cube.df.collect()


def test_mask(cubes, stores, together):
    some = B.masked(stores[0], stores[1], "m", [1])
    assert shuffles(some.cube.df) == 0
    want = cubes[0].df.join(cubes[1].df.where("m = 1").select("iy", "ix"), ["iy", "ix"], "left_semi")
    assert rows(some.plain()) == rows(cubes[0].having(want))


@pytest.mark.parametrize("methods", ["auto", "sum", {"v": "max", "*": "mean"}])
def test_coarsen(cubes, stores, together, methods):
    coarse = B.coarsened(stores[0], 4, methods)
    assert shuffles(coarse.cube.df) == 0 and coarse.chunk == (1, 2)
    want = C.coarsen(cubes[0], 4, methods)
    assert rows(coarse.plain()) == rows(want) and coarse.cube.grid == want.grid


def test_coarsened_stores_meet(stores, together):
    """Coarse rows still lie in the buckets of their chunks."""
    other = stores[1].having(stores[1].cube.df.drop("v"))
    both = B.merge([B.coarsened(s, 2, "max") for s in (stores[0], other)])
    assert shuffles(both.cube.df) == 0
    assert rows(both.plain()) == rows(merge([C.coarsen(s.plain(), 2, "max") for s in (stores[0], other)]))


def test_refusals(stores):
    with pytest.raises(ValueError, match="divide"):
        B.coarsened(stores[0], 3)
    with pytest.raises(ValueError, match="mode"):
        B.coarsened(stores[0], 2, "mode")
    with pytest.raises(ValueError, match="share"):
        B.merge([stores[0], B.Stored(stores[1].cube, (4, 4), 4)])
    with pytest.raises(ValueError, match="nothing"):
        B.merge([])


def test_written_again_and_clashes(spark, cubes, tmp_path):
    path = str(tmp_path / "cube")
    B.write(cubes[0], path, (4, 4), 2)
    B.write(cubes[1], path, (8, 8), 3)
    assert rows(B.read(spark, path).plain()) == rows(cubes[1]) and B.read(spark, path, ["m"]).variables == ["m"]
    with pytest.raises(ValueError, match="no variable"):
        B.read(spark, path, ["z"])
    with pytest.raises(ValueError, match="can't be called"):
        B.write(cubes[0].having(cubes[0].df.withColumn("cx", F.lit(1))), path)


def test_another_session(spark, cubes, tmp_path):
    path = str(tmp_path / "cube")
    B.write(cubes[0], path, (4, 4), 2)
    spark.sql(f"DROP TABLE {B._table(path)}")
    assert rows(B.read(spark, path).plain()) == rows(cubes[0])


def test_empty(spark, cubes, tmp_path):
    path = str(tmp_path / "empty")
    B.write(cubes[0].having(cubes[0].df.where("false")), path, (4, 4), 2)
    assert B.read(spark, path).cube.df.count() == 0


def test_time_meets_cell_by_cell_and_time(spark, cubes, tmp_path, together):
    years = spark.range(2000, 2003).select(F.make_timestamp_ntz(F.col("id").cast("int"), *[F.lit(x) for x in (1, 1, 0, 0, 0)]).alias("t"))
    v = Cube(cubes[0].df.select("iy", "ix", "v").crossJoin(years).withColumn("v", F.col("v") + F.year("t")), GRID, "t")
    w = Cube(cubes[1].df.select("iy", "ix", F.col("m").alias("w")).crossJoin(years.where("year(t) > 2000")), GRID, "t")
    paths = [str(tmp_path / n) for n in "vwm"]
    for c, p in zip((v, w, cubes[1].select("m")), paths):
        B.write(c, p, (8, 8), 3)
    a, b, mask = (B.read(spark, p) for p in paths)
    both = B.merge([a, b])
    assert shuffles(both.cube.df) == 0 and rows(both.plain()) == rows(merge([v, w]))
    some = B.coarsened(B.masked(a, mask, "m", 1), 4, "sum")
    kept = v.having(v.df.join(cubes[1].df.where("m = 1").select("iy", "ix"), ["iy", "ix"], "left_semi"))
    assert shuffles(some.cube.df) == 0 and rows(some.plain()) == rows(C.coarsen(kept, 4, "sum"))
    with pytest.raises(ValueError, match="static"):
        B.masked(a, b, "w", 1)

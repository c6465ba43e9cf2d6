"""Operators on cells that hold an array over members and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.operators import axes
from terracell.operators import coarsen as C
from terracell.operators.merge import merge
from terracell.operators.reduce import over_time
from terracell.operators.reproject import reproject
from terracell.queries import query
from terracell.queries.cubes import table

#: 16 cells to a row, and as many rows as there are vectors for; 8 members by 8 classes.
GRID = GridSpec("EPSG:3035", 0.0, 0.0, 1.0, 1.0, 16, 1 << 20)
THIRDS = GridSpec("EPSG:3035", 0.0, 0.0, 1.5, 1.5, 10, 1 << 20)
SHAPE = (8, 8)


def members(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, e): vectors as arrays of cells."""
    df = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("iy"), (F.col("vec_id") % 16).alias("ix"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return Cube(df, GRID, None, {"axes": {"e": {"names": ["members", "classes"], "lengths": list(SHAPE)}}})


def _long(cube: Cube, array: str = "e") -> DataFrame:
    """One row for an entry, in millionths."""
    return cube.df.select(*cube.keys, F.posexplode(array).alias("pos", "x")).select(*cube.keys, "pos", F.floor(F.col("x") * 1_000_000 + 0.314).alias("millionths"))


_CELLS = "cells AS (SELECT vec_id // 16 AS iy, vec_id % 16 AS ix, CAST(pos AS INTEGER) AS pos, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))"
_ROUNDED = "CAST(floor({} * 1000000 + 0.314) AS BIGINT) AS millionths"


@query(f"WITH {_CELLS} SELECT iy // 2 AS iy, ix // 2 AS ix, pos, {_ROUNDED.format('avg(e)')} FROM cells GROUP BY 1, 2, 3")
def coarsen_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(axes.by_entry(members(spark, sf_dir), lambda c: C.coarsen(c, 2, "mean")))


@query(f"""WITH {_CELLS}, y AS (SELECT s, t, least(s + 1, (t + 1) * 1.5::DOUBLE) - greatest(s, t * 1.5::DOUBLE) AS w FROM (SELECT s, unnest([CAST(floor(s / 1.5) AS BIGINT), CAST(floor(s / 1.5) AS BIGINT) + 1]) AS t FROM (SELECT DISTINCT iy AS s FROM cells UNION SELECT DISTINCT ix FROM cells)) WHERE least(s + 1, (t + 1) * 1.5::DOUBLE) - greatest(s, t * 1.5::DOUBLE) > 1e-6)
  SELECT a.t AS iy, b.t AS ix, pos, {_ROUNDED.format('sum(e * a.w * b.w) / sum(a.w * b.w)')} FROM cells JOIN y a ON a.s = iy JOIN y b ON b.s = ix WHERE b.t < 10 GROUP BY 1, 2, 3""")
def reproject_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(axes.by_entry(members(spark, sf_dir), lambda c: reproject(c, THIRDS, axes.methods_by_entry({"e": "average"}, axes.lengths_of(members(spark, sf_dir))))))


@query(f"WITH {_CELLS} SELECT iy, ix, pos, {_ROUNDED.format('CASE WHEN iy % 2 = 0 THEN e ELSE 2 * e END')} FROM cells")
def merge_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes with arrays of one name on other cells, merged."""
    cube = members(spark, sf_dir)
    even, odd = cube.having(cube.df.where("iy % 2 = 0")), cube.having(cube.df.where("iy % 2 = 1").withColumn("e", F.transform("e", lambda x: 2 * x)))
    return _long(merge([even, odd]))


@query(f"""WITH {_CELLS}, m AS (SELECT iy, ix, pos % 8 AS c, avg(e) AS mean, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS iqr FROM cells GROUP BY 1, 2, 3)
  SELECT iy, ix, CAST(c AS INTEGER) AS c, {_ROUNDED.format('mean')}, CAST(floor(iqr * 1000000 + 0.314) AS BIGINT) AS iqr, CAST(first_value(c) OVER (PARTITION BY iy, ix ORDER BY mean DESC, c) AS INTEGER) AS best FROM m""")
def members_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and interquartile range over members by class, and the class of the greatest mean, in each cell."""
    e = F.col("e")
    spread = F.zip_with(axes.reduced(e, SHAPE, 0, axes.quantile(0.75)), axes.reduced(e, SHAPE, 0, axes.quantile(0.25)), lambda a, b: a - b)
    rows = members(spark, sf_dir).df.select("iy", "ix", axes.reduced(e, SHAPE, 0).alias("mean"), spread.alias("spread"))
    rows = rows.select("iy", "ix", axes.dominant(F.col("mean")).alias("best"), F.posexplode(F.arrays_zip("mean", "spread")).alias("c", "x"))
    return rows.select("iy", "ix", "c", F.floor(F.col("x.mean") * 1_000_000 + 0.314).alias("millionths"), F.floor(F.col("x.spread") * 1_000_000 + 0.314).alias("iqr"), "best")


@query(f"WITH {_CELLS} SELECT ix AS iy, 0 AS ix, pos, {_ROUNDED.format('sum(e)')} FROM cells GROUP BY 1, 3")
def array_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of vectors as times: arrays of a cell summed over them, entry by entry."""
    cube = members(spark, sf_dir)
    timed = Cube(cube.df.select(F.col("ix").alias("iy"), F.lit(0).cast("bigint").alias("ix"), F.col("iy").alias("t"), "e"), GRID, "t", cube.attributes)
    return _long(axes.by_entry(timed, over_time))

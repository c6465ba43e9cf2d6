"""Subsetting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import polygons, subset
from terracell.queries import query
from terracell.queries.cubes import EVENTS, NORTH_UP, OBS, STATIC, events, observations, static, table

RING = [(4.2, 3.1), (28.7, 5.9), (24.4, 27.3), (9.8, 22.6)]
_EDGES = " + ".join(
    f"CAST((({ya} > iy + 0.5) <> ({yb} > iy + 0.5)) AND ix + 0.5 < {xa} + (iy + 0.5 - {ya}) * ({xb} - {xa}) / ({yb} - {ya}) AS INTEGER)" for (xa, ya), (xb, yb) in zip(RING, RING[1:] + RING[:1])
)


@query(f"WITH {OBS} SELECT * FROM obs WHERE ix + 0.5 BETWEEN 3.5 AND 20.4 AND iy + 0.5 BETWEEN 7.5 AND 15.5")
def subset_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.bbox(observations(spark, sf_dir), 3.5, 7.5, 20.4, 15.5).df


@query(f"WITH {STATIC} SELECT iy, ix, v, CAST(ix + 0.5 AS DOUBLE) AS longitude, CAST(32 - (iy + 0.5) AS DOUBLE) AS latitude FROM static WHERE ix + 0.5 BETWEEN 3 AND 9 AND 32 - (iy + 0.5) BETWEEN 20.5 AND 24")
def subset_bbox_north_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = static(spark, sf_dir).select("v")
    return subset.bbox(cube.having(cube.df, grid=NORTH_UP), 3, 20.5, 9, 24).located()


@query(f"WITH {EVENTS} SELECT * FROM evt WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'")
def subset_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.time_range(events(spark, sf_dir), "2024-01-10", "2024-01-20").df


@query(f"WITH {STATIC} SELECT * FROM static WHERE ix + 0.5 BETWEEN 4.2 AND 28.7 AND iy + 0.5 BETWEEN 3.1 AND 27.3")
def subset_geom_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.polygon(static(spark, sf_dir), [RING]).df


@query(f"WITH {STATIC} SELECT * FROM static WHERE ({_EDGES}) % 2 = 1")
def mask_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.polygon(static(spark, sf_dir), [RING], mask=True).df


@query(f"WITH {EVENTS} SELECT * FROM evt WHERE ix * 2 + 1 BETWEEN 4 AND 25 AND iy * 2 + 1 BETWEEN 2 AND 30 AND ts < TIMESTAMP '2024-02-01'")
def subset_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.combined(events(spark, sf_dir), box=(4, 2, 25, 30), start=None, end="2024-01").df


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, 'EPSG:4326') AS crs FROM part""")
def metadata_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = [F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.lit("EPSG:4326")]
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*stated).alias("crs"))


@query(f"WITH {OBS} SELECT iy, ix, v, q FROM obs WHERE yr = 1998")
def select_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.at_label(observations(spark, sf_dir), 1998).df


@query(f"WITH {OBS} SELECT iy, ix, yr, CASE WHEN q > 25 THEN v ELSE -1 END AS v FROM obs")
def where_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = observations(spark, sf_dir)
    return cube.df.select(*cube.keys, F.when(F.col("q") > 25, F.col("v")).otherwise(F.lit(-1).cast("bigint")).alias("v"))


@query(f"WITH {OBS} SELECT iy, ix, yr, CASE WHEN (iy + ix) % 3 = 1 THEN v ELSE -9999 END AS v, CASE WHEN (iy + ix) % 3 = 1 THEN q ELSE -9999 END AS q FROM obs")
def mask_by_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = static(spark, sf_dir).df.where("(iy + ix) % 3 != 0").select("iy", "ix", ((F.col("iy") + F.col("ix")) % 3).alias("forest"))
    return subset.masked_by(observations(spark, sf_dir), mask, "forest", keep=1, fill=-9999).df


@query(f"WITH {STATIC} SELECT iy, ix, v AS aboveground_biomass, 2020 AS yr FROM static")
def rename_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.expanded(subset.renamed(static(spark, sf_dir).select("v"), {"v": "aboveground_biomass"}), "yr", F.lit(2020)).df


@query(f"WITH {OBS} SELECT iy, ix, yr, v FROM obs WHERE yr IN (1996, 1999)")
def concat_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = observations(spark, sf_dir).select("v")
    return subset.stacked([cube.having(cube.df.where(F.col("yr") == y)) for y in (1996, 1999)]).df


_RING = [(-1.0, -0.9), (1.1, -0.8), (1.3, 0.4), (0.1, 1.2), (-1.2, 0.5)]
_HOLE = [(-0.4, -0.3), (0.5, -0.2), (0.1, 0.5)]


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(polygon_id, rings): a polygon for a supplier, every third with a hole."""
    cx, cy, r = (F.col("s_suppkey") % 32) + 0.3, (F.col("s_suppkey") * 7 % 32) + 0.2, (F.col("s_suppkey") % 4 + 1).cast("double")
    ring = lambda points: F.array(*[F.struct((cx + r * x).alias("x"), (cy + r * y).alias("y")) for x, y in points])
    rings = F.when(F.col("s_suppkey") % 3 == 0, F.array(ring(_RING), ring(_HOLE))).otherwise(F.array(ring(_RING)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("polygon_id"), rings.alias("rings"))


def _shape_edges() -> str:
    corners = ", ".join(f"({h}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for h, ring in ((0, _RING), (1, _HOLE)) for a, b in zip(ring, ring[1:] + ring[:1]))
    place = "(s_suppkey % 32 + 0.3::DOUBLE)", "(s_suppkey * 7 % 32 + 0.2::DOUBLE)", "CAST(s_suppkey % 4 + 1 AS DOUBLE)"
    columns = ", ".join(f"{place[k % 2]} + {place[2]} * {c} AS {c}" for k, c in enumerate(("xa", "ya", "xb", "yb")))
    return f"""borders AS (SELECT s_suppkey AS polygon_id, {columns} FROM supplier, (VALUES {corners}) e(hole, xa, ya, xb, yb) WHERE hole = 0 OR s_suppkey % 3 = 0),
      within AS (SELECT polygon_id, iy, ix, any_value(v) AS v FROM static JOIN borders ON (iy + 0.5 < ya) <> (iy + 0.5 < yb) AND ix + 0.5 < xa + (iy + 0.5 - ya) * ((xb - xa) / (yb - ya)) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query(f"WITH {STATIC}, {_shape_edges()} SELECT polygon_id, count(*) AS n_cells, CAST(sum(v) AS BIGINT) AS v FROM within GROUP BY 1")
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and their sum in each of many polygons."""
    cube = static(spark, sf_dir).select("v")
    runs = polygons.spans(polygons.edges(_shapes(spark, sf_dir)), cube.grid)
    return polygons.labelled(cube, runs).groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("v").alias("v"))


@query(f"WITH {STATIC}, {_shape_edges()} SELECT DISTINCT iy, ix, v FROM within WHERE polygon_id % 5 = 1")
def mask_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in any polygon of the suppliers of one kind."""
    cube = static(spark, sf_dir).select("v")
    chosen = _shapes(spark, sf_dir).where("polygon_id % 5 = 1")
    return polygons.masked(cube, polygons.spans(polygons.edges(chosen), cube.grid)).df

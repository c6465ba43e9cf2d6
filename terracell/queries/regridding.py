"""Coarsening, resampling, alignment and merging. The SQL gathers source cells for each target; the operators scatter them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.catalog.products import AMAZON_ALBERS
from terracell.cube import Cube
from terracell.functions.crs import GRS80, WGS84, named
from terracell.grid import GridSpec, cells_across, digests, snapped_column
from terracell.operators import coarsen as C
from terracell.operators.merge import merge
from terracell.operators.across import overlaps
from terracell.operators.reproject import projected, reproject
from terracell.plans.align import Aligner, methods_of
from terracell.queries import query
from terracell.queries.cubes import EVENT_CELLS, GRID, STATIC, event_cells, static, table

COARSE = GridSpec("EPSG:3035", 0.0, 0.0, 1.6, 1.6, 20, 20)
FINE = GridSpec("EPSG:3035", 0.0, 0.0, 0.8, 0.8, 40, 40)
FLIPPED = GridSpec("EPSG:3035", 0.0, 32.0, 1.6, -1.6, 20, 20)


def _whole(v: str) -> Column:
    """A value in whole cents; the shift keeps values that lie half way, which kernels and overlaps make, off the edge between two."""
    return F.floor(F.col(v) + 0.314).cast("bigint")


@query("""SELECT s_suppkey, CAST(greatest(2, round_even(abs(s_acctbal / (s_suppkey % 7 + 0.5)), 0)) AS BIGINT) AS width FROM supplier""")
def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", cells_across(F.col("s_acctbal"), F.col("s_suppkey") % 7 + 0.5).alias("width"))


@query("""SELECT p_partkey, round(greatest(1, round_even(p_retailprice / p_size, 0)) * p_size, 6) AS nearest_multiple,
  round(CASE WHEN abs(greatest(1, round_even(p_retailprice / p_size, 0)) * p_size - p_retailprice) <= 0.01 * greatest(1, abs(p_retailprice)) THEN greatest(1, round_even(p_retailprice / p_size, 0)) * p_size ELSE p_retailprice END, 6) AS auto FROM part""")
def snap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(snapped_column(s, t, "nearest_multiple"), 6).alias("nearest_multiple"), F.round(snapped_column(s, t, "auto", 0.01), 6).alias("auto"))


@query("""SELECT p_partkey, sha256('EPSG:3035|' || printf('%.9f', CAST(p_size AS DOUBLE)) || '|' || printf('%.9f', p_retailprice) || '|0.250000000|-0.250000000|10|' || p_partkey || '|latitude|longitude') AS digest FROM part""")
def grid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each part, told apart by its digest."""
    digest = digests("EPSG:3035", F.col("p_size"), F.col("p_retailprice"), F.lit(0.25), F.lit(-0.25), F.col("p_partkey"), F.lit(10))
    return table(spark, sf_dir, "part").select("p_partkey", digest.alias("digest"))


def _coarsen(method: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.coarsen(static(spark, sf_dir).select("v"), 5, method).df

    query(f"WITH {STATIC} SELECT iy // 5 AS iy, ix // 5 AS ix, CAST({sql} AS BIGINT) AS v FROM static GROUP BY 1, 2", f"coarsen_{method}")(run)


for _m, _sql in (("first", "arg_min(v, iy * 1000 + ix)"), ("min", "min(v)"), ("max", "max(v)"), ("mean", "trunc(sum(v) / count(v))"), ("median", "trunc(median(v))"), ("sum", "sum(v)")):
    _coarsen(_m, _sql)


@query(f"""WITH {STATIC}, n AS (SELECT iy // 5 AS iy, ix // 5 AS ix, q, count(*) AS n FROM static GROUP BY 1, 2, 3)
  SELECT iy, ix, q FROM (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, q) AS r FROM n) WHERE r = 1""")
def coarsen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coarsen(static(spark, sf_dir).select("q"), 5, "mode").df


@query(f"WITH {STATIC} SELECT iy // 4 AS iy, ix // 4 AS ix, arg_min(q, iy * 1000 + ix) AS q, round(avg(CAST(v AS DOUBLE)), 4) AS d, max(v) AS v FROM static GROUP BY 1, 2")
def coarsen_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = static(spark, sf_dir)
    cube = cube.having(cube.df.withColumn("d", F.col("v").cast("double")))
    return C.coarsen(cube, 4, {"*": "auto", "v": "max"}).df.withColumn("d", F.round("d", 4))


@query(f"""WITH {STATIC}, lattice AS (SELECT iy, ix FROM range(20) a(iy), range(20) b(ix))
  SELECT l.iy, l.ix, s.v FROM lattice l LEFT JOIN static s ON s.iy = CAST(floor((l.iy + 0.5) * 1.6) AS BIGINT) AND s.ix = CAST(floor((l.ix + 0.5) * 1.6) AS BIGINT)""")
def reproject_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(static(spark, sf_dir).select("v"), COARSE, "nearest", dense=True).df


@query(f"""WITH {STATIC}, lattice AS (SELECT iy, ix FROM range(20) a(iy), range(20) b(ix))
  SELECT l.iy, l.ix, s.v FROM lattice l JOIN static s ON s.iy = CAST(floor(32 - (l.iy + 0.5) * 1.6) AS BIGINT) AND s.ix = CAST(floor((l.ix + 0.5) * 1.6) AS BIGINT)""")
def reproject_nearest_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(static(spark, sf_dir).select("v"), FLIPPED, "nearest").df


_KERNELS = {
    "bilinear": ("1", "greatest(0, 1 - abs(d))"),
    "cubic": ("2", "CASE WHEN abs(d) < 1 THEN 1.5 * pow(abs(d), 3) - 2.5 * d * d + 1 WHEN abs(d) < 2 THEN -0.5 * pow(abs(d), 3) + 2.5 * d * d - 4 * abs(d) + 2 ELSE 0 END"),
    "cubic_spline": ("2", "CASE WHEN abs(d) < 1 THEN pow(abs(d), 3) / 2 - d * d + 2.0::DOUBLE / 3 WHEN abs(d) < 2 THEN pow(2 - abs(d), 3) / 6 ELSE 0 END"),
    "lanczos": ("3", "CASE WHEN abs(d) < 1e-12 THEN 1 WHEN abs(d) < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d) ELSE 0 END"),
}


def _kernel(method: str, reach: str, weight: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reproject(static(spark, sf_dir).select("v"), FINE, method).df.withColumn("v", _whole("v"))

    query(
        f"""WITH {STATIC}, w AS (SELECT t, s, CAST({weight} AS DOUBLE) AS w FROM (SELECT t, s, CAST((t + 0.5) * 0.8 - (s + 0.5) AS DOUBLE) AS d FROM range(40) a(t), range(32) b(s)) WHERE abs(d) < {reach})
        SELECT y.t AS iy, x.t AS ix, CAST(floor(sum(v * x.w * y.w) / sum(x.w * y.w) + 0.314) AS BIGINT) AS v FROM static JOIN w x ON x.s = ix JOIN w y ON y.s = iy WHERE x.w * y.w <> 0 GROUP BY 1, 2""",
        f"reproject_{method}",
    )(run)


for _m, (_reach, _weight) in _KERNELS.items():
    _kernel(_m, _reach, _weight)

_OVERLAP = "w AS (SELECT t, s, least(s + 1, (t + 1) * 1.6::DOUBLE) - greatest(s, t * 1.6::DOUBLE) AS w FROM range(20) a(t), range(32) b(s) WHERE least(s + 1, (t + 1) * 1.6::DOUBLE) - greatest(s, t * 1.6::DOUBLE) > 1e-6)"
_PARTS = f"{_OVERLAP}, p AS (SELECT y.t AS iy, x.t AS ix, x.w * y.w AS w, v, q FROM static JOIN w x ON x.s = ix JOIN w y ON y.s = iy)"


def _area(method: str, sql: str, variable: str = "v") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = reproject(static(spark, sf_dir).select(variable), COARSE, method).df
        return df if method in ("max", "min") else df.withColumn(variable, _whole(variable))

    value = sql if method in ("max", "min") else f"CAST(floor({sql} + 0.314) AS BIGINT)"
    query(f"WITH {STATIC}, {_PARTS} SELECT iy, ix, {value} AS {variable} FROM p GROUP BY 1, 2", f"reproject_{method}")(run)


for _m, _sql in (
    ("average", "sum(v * w) / sum(w)"), ("sum", "sum(v * w)"), ("rms", "sqrt(sum(CAST(v AS DOUBLE) * v * w) / sum(w))"), ("max", "max(v)"), ("min", "min(v)"),
    ("med", "quantile_cont(CAST(v AS DOUBLE), 0.5)"), ("q1", "quantile_cont(CAST(v AS DOUBLE), 0.25)"), ("q3", "quantile_cont(CAST(v AS DOUBLE), 0.75)"),
):
    _area(_m, _sql)


@query(f"""WITH {STATIC}, {_PARTS} SELECT iy, ix, q FROM (SELECT iy, ix, q, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, q) AS r FROM (SELECT iy, ix, q, round(sum(w), 6) AS n FROM p GROUP BY 1, 2, 3)) WHERE r = 1""")
def reproject_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(static(spark, sf_dir).select("q"), COARSE, "mode").df


@query(f"""WITH {STATIC}, {_PARTS}, a AS (SELECT iy, ix, CAST(floor(sum(v * w) / sum(w) + 0.314) AS BIGINT) AS v FROM p GROUP BY 1, 2), m AS (SELECT iy, ix, q FROM (SELECT iy, ix, q, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, q) AS r FROM (SELECT iy, ix, q, round(sum(w), 6) AS n FROM p GROUP BY 1, 2, 3)) WHERE r = 1)
  SELECT a.iy, a.ix, a.v, m.q FROM a JOIN m ON a.iy = m.iy AND a.ix = m.ix""")
def resampling_per_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = static(spark, sf_dir)
    methods = methods_of("static", cube.variables, {"static": {"default": "Average", "vars": {"q": "MODE", "absent": "nearest"}}})
    return reproject(cube, COARSE, methods).df.withColumn("v", _whole("v"))


def _laea_constants() -> tuple[float, float, float, float, float, float]:
    """e squared, e, q at the pole, authalic latitude of the centre, its radius, and D of EPSG:3035."""
    a, f = GRS80[0], 1 / GRS80[1]
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0 = math.sin(math.radians(52))
    qp = q(1.0)
    b1, rq = math.asin(q(s0) / qp), a * math.sqrt(qp / 2)
    return e2, e, qp, b1, rq, a * math.cos(math.radians(52)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b1))


def _laea_sql() -> str:
    """xy: pts (lon, lat, ...) with x, y of EPSG:3035, from its published formulas with its constants as numbers."""
    e2, e, qp, b1, rq, d = _laea_constants()
    return f"""b AS (SELECT *, radians(lon - 10) AS l, asin({1 - e2!r}::DOUBLE * (sin(radians(lat)) / (1 - {e2!r}::DOUBLE * pow(sin(radians(lat)), 2)) - ln((1 - {e!r}::DOUBLE * sin(radians(lat))) / (1 + {e!r}::DOUBLE * sin(radians(lat)))) / {2 * e!r}::DOUBLE) / {qp!r}::DOUBLE) AS b FROM pts),
      k AS (SELECT *, {rq!r}::DOUBLE * sqrt(2 / (1 + {math.sin(b1)!r}::DOUBLE * sin(b) + {math.cos(b1)!r}::DOUBLE * cos(b) * cos(l))) AS k FROM b),
      xy AS (SELECT *, 4321000 + k * {d!r}::DOUBLE * cos(b) * sin(l) AS x, 3210000 + k / {d!r}::DOUBLE * ({math.cos(b1)!r}::DOUBLE * sin(b) - {math.sin(b1)!r}::DOUBLE * cos(b) * cos(l)) AS y FROM k)"""


_POINTS = "pts AS (SELECT c_custkey, CAST((c_custkey % 400) / 10.0 - 10 AS DOUBLE) AS lon, CAST(35 + (c_custkey % 350) / 10.0 AS DOUBLE) AS lat FROM customer)"


@query(f"WITH {_POINTS}, {_laea_sql()} SELECT c_custkey, round(x, 2) AS x, round(y, 2) AS y FROM xy")
def crs_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 400) / 10.0 - 10).alias("lon"), (35 + (F.col("c_custkey") % 350) / 10.0).alias("lat"))
    return projected(points, named("EPSG:3035")).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("SELECT c_custkey, round(CAST((c_custkey % 400) / 10.0 - 10 AS DOUBLE), 6) AS lon, round(CAST(35 + (c_custkey % 350) / 10.0 AS DOUBLE), 6) AS lat FROM customer")
def crs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = named("EPSG:3035")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 400) / 10.0 - 10).alias("lon"), (35 + (F.col("c_custkey") % 350) / 10.0).alias("lat"))
    lon, lat = to.inverse_columns(F.col("x"), F.col("y"))
    return projected(points, to).select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""WITH {STATIC}, {EVENT_CELLS} SELECT coalesce(s.iy, e.iy) AS iy, coalesce(s.ix, e.ix) AS ix, s.v AS static_v, s.q AS static_q, e.c AS events_c
  FROM static s FULL OUTER JOIN (SELECT c.iy * 2 + y AS iy, c.ix * 2 + x AS ix, c.c FROM cells c, range(2) a(y), range(2) b(x)) e ON s.iy = e.iy AND s.ix = e.ix""")
def align_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Aligner("static", prefix=True).align({"static": static(spark, sf_dir), "events": event_cells(spark, sf_dir)}).df


@query(f"""WITH {STATIC}, {EVENT_CELLS}, s AS (SELECT iy // 2 AS iy, ix // 2 AS ix, CAST(sum(v) AS BIGINT) AS v FROM static GROUP BY 1, 2)
  SELECT coalesce(s.iy, e.iy) AS iy, coalesce(s.ix, e.ix) AS ix, s.v AS static_v, e.c AS events_c FROM s FULL OUTER JOIN cells e ON s.iy = e.iy AND s.ix = e.ix""")
def align_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes: dict[str, Cube] = {"static": static(spark, sf_dir).select("v"), "events": event_cells(spark, sf_dir)}
    return Aligner("events", coarsen_first=2, coarsen_methods={"v": "sum"}, prefix=True).align(cubes).df


@query(f"WITH {STATIC} SELECT iy, ix, v, CASE WHEN iy >= 10 THEN q END AS q FROM static")
def merge_no_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = static(spark, sf_dir)
    return merge([cube.having(cube.df.where("iy < 20").select("iy", "ix", "v")), cube.having(cube.df.where("iy >= 10"))]).df


#: A lattice of degrees, and one of 20 km under it.
DEGREES = GridSpec("EPSG:4326", 4.0, 46.0, 0.25, 0.25, 32, 32)
METRES = GridSpec("EPSG:3035", 3_900_000.0, 2_500_000.0, 20_000.0, 20_000.0, 40, 40)
#: A lattice as fine as a fifth of a degree's cell, within its middle.
FINE_METRES = GridSpec("EPSG:3035", 4_200_000.0, 2_900_000.0, 5_000.0, 5_000.0, 32, 32)


def _on(spark: SparkSession, sf_dir: str, grid: GridSpec) -> Cube:
    cube = static(spark, sf_dir).select("v")
    return cube.having(cube.df, grid=grid)


@query(f"""WITH {STATIC}, pts AS (SELECT ix, iy, 4 + 0.25::DOUBLE * (ix + 0.5) AS lon, 46 + 0.25::DOUBLE * (iy + 0.5) AS lat FROM range(32) a(ix), range(32) b(iy)), {_laea_sql()}
  SELECT xy.iy, xy.ix, s.v FROM xy JOIN static s ON s.ix = CAST(floor((x - 3900000) / 20000) AS BIGINT) AND s.iy = CAST(floor((y - 2500000) / 20000) AS BIGINT)""")
def reproject_across_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(_on(spark, sf_dir, METRES), DEGREES, "nearest").df


def _clipped_sql(grid: GridSpec) -> str:
    """areas (sy, sx, v, iy, ix, w): what projected cells of DEGREES share with cells of grid.

    The common polygon's corners (corners of one inside the other, and crossings) are put in order by their angle
    around their mean, and its area follows from these.
    """
    return f"""pts AS (SELECT iy AS sy, ix AS sx, v, c, 4 + 0.25::DOUBLE * (ix + cx) AS lon, 46 + 0.25::DOUBLE * (iy + cy) AS lat FROM static, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) q(c, cx, cy)), {_laea_sql()},
      quads AS (SELECT sy, sx, v, list((x - {grid.x0!r}::DOUBLE) / {grid.dx!r}::DOUBLE ORDER BY c) AS us, list((y - {grid.y0!r}::DOUBLE) / {grid.dy!r}::DOUBLE ORDER BY c) AS vs FROM xy GROUP BY 1, 2, 3),
      wide AS (SELECT *, unnest(range(CAST(greatest(floor(list_min(us)), 0) AS BIGINT), CAST(least(ceil(list_max(us)), {grid.width}) AS BIGINT))) AS ix FROM quads),
      cand AS (SELECT *, unnest(range(CAST(greatest(floor(list_min(vs)), 0) AS BIGINT), CAST(least(ceil(list_max(vs)), {grid.height}) AS BIGINT))) AS iy FROM wide),
      unit AS (SELECT sy, sx, v, iy, ix, list_transform(us, lambda z: z - ix) AS us, list_transform(vs, lambda z: z - iy) AS vs FROM cand),
      edges AS (SELECT sy, sx, iy, ix, us[k] AS xa, vs[k] AS ya, us[k % 4 + 1] AS xb, vs[k % 4 + 1] AS yb FROM unit, range(1, 5) r(k)),
      corners AS (
        SELECT sy, sx, iy, ix, xa AS x, ya AS y FROM edges WHERE xa BETWEEN 0 AND 1 AND ya BETWEEN 0 AND 1
        UNION ALL SELECT sy, sx, iy, ix, x, y FROM edges, (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1, 0), (1, 1), (0, 1)) b(x, y) GROUP BY ALL HAVING min((xb - xa) * (y - ya) - (yb - ya) * (x - xa)) >= 0
        UNION ALL SELECT sy, sx, iy, ix, z, ya + (z - xa) / (xb - xa) * (yb - ya) FROM edges, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) b(z) WHERE xa <> xb AND (z - xa) / (xb - xa) BETWEEN 0 AND 1 AND ya + (z - xa) / (xb - xa) * (yb - ya) BETWEEN 0 AND 1
        UNION ALL SELECT sy, sx, iy, ix, xa + (z - ya) / (yb - ya) * (xb - xa), z FROM edges, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) b(z) WHERE ya <> yb AND (z - ya) / (yb - ya) BETWEEN 0 AND 1 AND xa + (z - ya) / (yb - ya) * (xb - xa) BETWEEN 0 AND 1),
      centred AS (SELECT sy, sx, iy, ix, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y FROM corners WINDOW g AS (PARTITION BY sy, sx, iy, ix)),
      rings AS (SELECT sy, sx, iy, ix, list({{'x': x, 'y': y}} ORDER BY atan2(y, x)) AS p FROM centred GROUP BY 1, 2, 3, 4),
      sized AS (SELECT sy, sx, iy, ix, list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k].x * p[k % len(p) + 1].y - p[k % len(p) + 1].x * p[k].y)) / 2 AS w FROM rings),
      areas AS (SELECT sized.*, quads.v FROM sized JOIN quads ON sized.sy = quads.sy AND sized.sx = quads.sx WHERE w > 1e-8)"""


@query(f"WITH {STATIC}, {_clipped_sql(METRES)} SELECT sy, sx, iy, ix, CAST(floor(w * 1000000 + 0.314) AS BIGINT) AS millionths FROM areas")
def overlaps_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlaps(_on(spark, sf_dir, DEGREES), METRES).where("_w > 1e-8")
    return rows.select(F.col("_sy").alias("sy"), F.col("_sx").alias("sx"), "iy", "ix", F.floor(F.col("_w") * 1_000_000 + 0.314).alias("millionths"))


def _across(name: str, method: str, grid: GridSpec, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reproject(_on(spark, sf_dir, DEGREES), grid, method).df.withColumn("v", F.col("v") / 1000).withColumn("v", _whole("v"))

    query(f"WITH {STATIC}, {_clipped_sql(grid)} SELECT iy, ix, CAST(floor(({sql}) / 1000 + 0.314) AS BIGINT) AS v FROM areas GROUP BY 1, 2", name)(run)


_across("reproject_across_average", "average", METRES, "sum(v * w) / sum(w)")
_across("reproject_across_sum", "sum", METRES, "sum(v * w / (SELECT list_sum(list_transform(range(1, 5), lambda k: us[k] * vs[k % 4 + 1] - us[k % 4 + 1] * vs[k])) / 2 FROM quads q WHERE q.sy = areas.sy AND q.sx = areas.sx))")
_across("reproject_across_max", "max", METRES, "max(v)")
_across("reproject_across_finer", "average", FINE_METRES, "sum(v * w) / sum(w)")

#: The whole globe, and a lattice of 500 km that goes beyond the projection's domain on all sides.
GLOBE = GridSpec("EPSG:4326", -180.0, -90.0, 11.25, 5.625, 32, 32)
FAR = GridSpec("EPSG:3035", 4_321_000.0 - 15_000_000, 3_210_000.0 + 15_000_000, 500_000.0, -500_000.0, 60, 60)


def _laea_back_sql() -> str:
    """geo: xy (x, y, ...) with lon, lat of EPSG:3035, where there are any."""
    e2, _, _, b1, rq, d = _laea_constants()
    return f"""r AS (SELECT *, (x - 4321000) / {d!r}::DOUBLE AS u, (y - 3210000) * {d!r}::DOUBLE AS w, sqrt(pow((x - 4321000) / {d!r}::DOUBLE, 2) + pow((y - 3210000) * {d!r}::DOUBLE, 2)) + 1e-12 AS rho FROM xy),
      c AS (SELECT *, 2 * asin(rho / {2 * rq!r}::DOUBLE) AS c FROM r WHERE rho <= {2 * rq!r}::DOUBLE),
      t AS (SELECT *, asin(cos(c) * {math.sin(b1)!r}::DOUBLE + w * sin(c) * {math.cos(b1)!r}::DOUBLE / rho) AS beta, degrees(atan2(u * sin(c), rho * {math.cos(b1)!r}::DOUBLE * cos(c) - w * {math.sin(b1)!r}::DOUBLE * sin(c))) + 10 AS lon FROM c),
      geo AS (SELECT *, degrees(beta + {e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040!r}::DOUBLE * sin(2 * beta) + {23 * e2**2 / 360 + 251 * e2**3 / 3780!r}::DOUBLE * sin(4 * beta) + {761 * e2**3 / 45360!r}::DOUBLE * sin(6 * beta)) AS lat FROM t)"""


_FAR_XY = f"xy AS (SELECT iy, ix, {FAR.x0!r}::DOUBLE + {FAR.dx!r}::DOUBLE * (ix + 0.5) AS x, {FAR.y0!r}::DOUBLE + {FAR.dy!r}::DOUBLE * (iy + 0.5) AS y FROM range({FAR.height}) a(iy), range({FAR.width}) b(ix))"


@query(f"WITH {STATIC}, {_FAR_XY}, {_laea_back_sql()} SELECT g.iy, g.ix, s.v FROM geo g JOIN static s ON s.ix = CAST(floor((g.lon + 180) / 11.25) AS BIGINT) % 32 AND s.iy = CAST(floor((g.lat + 90) / 5.625) AS BIGINT)")
def reproject_across_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(_on(spark, sf_dir, GLOBE), FAR, "nearest").df


_HALF = GridSpec("EPSG:4326", 5.0, 53.0, 0.5, -0.5, 14, 13)


@query(f"""WITH {STATIC}, pts AS (SELECT ix, iy, 5 + 0.5::DOUBLE * (ix + 0.5) AS lon, 53 - 0.5::DOUBLE * (iy + 0.5) AS lat FROM range(14) a(ix), range(13) b(iy)), {_laea_sql()},
  p AS (SELECT iy, ix, (x - 3900000) / 20000::DOUBLE AS u, (y - 2500000) / 20000::DOUBLE AS w FROM xy),
  n AS (SELECT p.iy, p.ix, s.v, (1 - abs(u - s.ix - 0.5)) * (1 - abs(w - s.iy - 0.5)) AS k FROM p JOIN static s ON abs(u - s.ix - 0.5) < 1 AND abs(w - s.iy - 0.5) < 1)
  SELECT iy, ix, CAST(floor(sum(v * k) / sum(k) / 1000 + 0.314) AS BIGINT) AS v FROM n GROUP BY 1, 2""")
def reproject_across_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(_on(spark, sf_dir, METRES), _HALF, "bilinear").df.withColumn("v", F.col("v") / 1000).withColumn("v", _whole("v"))


def _utm_sql() -> str:
    """Zone 32 of EPSG:326xx by Krueger's series, with its constants as numbers."""
    a, f = WGS84[0], 1 / WGS84[1]
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    unit = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    north = " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(series, 1))
    east = " + ".join(f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(series, 1))
    return f"""pts AS (SELECT c_custkey, CAST((c_custkey % 360) - 180 AS DOUBLE) AS lon, CAST(-80 + (c_custkey % 161) AS DOUBLE) AS lat FROM customer),
      t AS (SELECT c_custkey, radians(lon - 9) AS turn, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM pts WHERE abs(lon - 9) < 70),
      g AS (SELECT c_custkey, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM t),
      u AS (SELECT c_custkey, round({unit!r}::DOUBLE * (eta + {east}) + 500000, 2) AS x, round({unit!r}::DOUBLE * (xi + {north}), 2) AS y FROM g)
      SELECT p.c_custkey, u.x, u.y FROM pts p LEFT JOIN u ON p.c_custkey = u.c_custkey"""


@query(f"WITH {_utm_sql()}")
def crs_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points all over the globe in one zone: NULL beyond the projection's reach."""
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 161 - 80).cast("double").alias("lat"))
    return projected(points, named("EPSG:32632")).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def _albers_sql() -> str:
    """The projection of AMAZON_ALBERS from its published formulas, with its constants as numbers."""
    a, f = GRS80[0], 1 / GRS80[1]
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m = lambda v: math.cos(math.radians(v)) / math.sqrt(1 - e2 * math.sin(math.radians(v)) ** 2)
    q1, q2, q0 = (q(math.sin(math.radians(v))) for v in (-2, -22, -12))
    n = (m(-2) ** 2 - m(-22) ** 2) / (q2 - q1)
    c = m(-2) ** 2 + n * q1
    s = "sin(radians(lat))"
    return f"""pts AS (SELECT c_custkey, CAST((c_custkey % 300) / 10.0 - 70 AS DOUBLE) AS lon, CAST((c_custkey % 250) / 10.0 - 20 AS DOUBLE) AS lat FROM customer),
      p AS (SELECT c_custkey, {n!r}::DOUBLE * radians(lon + 54) AS t, {a!r}::DOUBLE * sqrt({c!r}::DOUBLE - {n!r}::DOUBLE * {1 - e2!r}::DOUBLE * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s}) - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / {2 * e!r}::DOUBLE)) / {n!r}::DOUBLE AS rho FROM pts)
      SELECT c_custkey, round(5000000 + rho * sin(t), 2) AS x, round(10000000 + {a * math.sqrt(c - n * q0) / n!r}::DOUBLE - rho * cos(t), 2) AS y FROM p"""


@query(f"WITH {_albers_sql()}")
def crs_albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 300) / 10.0 - 70).alias("lon"), ((F.col("c_custkey") % 250) / 10.0 - 20).alias("lat"))
    return projected(points, named(AMAZON_ALBERS)).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def lattice_of_lines(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, v in cents): line items by order and line, a lattice that grows with the table."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ix"), F.col("l_linenumber").cast("bigint").alias("iy")).agg(F.sum(cents).alias("v"))
    return Cube(df, GridSpec("EPSG:3035", 0.0, 0.0, 1.0, 1.0, 1 << 40, 8))


_LINES = "lines AS (SELECT l_orderkey AS ix, CAST(l_linenumber AS BIGINT) AS iy, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_LINES} SELECT iy // 4 AS iy, ix // 4 AS ix, CAST(sum(v) AS BIGINT) AS v FROM lines GROUP BY 1, 2")
def coarsen_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coarsen(lattice_of_lines(spark, sf_dir), 4, "sum").df


@query(f"WITH {_LINES} SELECT t.iy, t.ix, s.v FROM (SELECT * FROM range(4) a(iy), (SELECT unnest(range((SELECT max(ix) // 2 + 1 FROM lines))) AS ix)) t JOIN lines s ON s.iy = t.iy * 2 + 1 AND s.ix = t.ix * 2 + 1")
def reproject_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproject(lattice_of_lines(spark, sf_dir), GridSpec("EPSG:3035", 0.0, 0.0, 2.0, 2.0, 1 << 39, 4), "nearest").df


@query(f"WITH {_LINES} SELECT iy, ix, v, CASE WHEN iy >= 3 THEN v % 7 END AS w FROM lines")
def merge_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lattice_of_lines(spark, sf_dir)
    return merge([cube, cube.having(cube.df.where("iy >= 3").select("iy", "ix", (F.col("v") % 7).alias("w")))]).df

"""Resampling onto a target grid.

Source cells are scattered to the target cells that they contribute to: the range of targets and the weight
follow from grid arithmetic on each axis, so a resampling is a projection and one grouped aggregate, without
a join. Between grids of different CRSs, cells are scattered by their projected outlines; see across.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import Transform
from terracell.grid import GridSpec
from terracell.operators.across import around, holds, overlaps

KERNELS = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}
AREA = ("average", "sum", "rms", "mode", "max", "min", "med", "q1", "q3")
METHODS = ("nearest", *KERNELS, *AREA)


def kernel(method: str, d: Column) -> Column:
    """Weight at a distance in source cells (or target cells, where these are larger)."""
    a = F.abs(d)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if method == "cubic":  # Catmull-Rom, a = -1/2
        return F.when(a < 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)
    if method == "cubic_spline":
        return F.when(a < 1, (0.5 * a - 1) * a * a + 2 / 3).when(a < 2, F.pow(2 - a, F.lit(3.0)) / 6).otherwise(0.0)
    p = a * math.pi
    return F.when(a < 1e-12, 1.0).when(a < 3, 3 * F.sin(p) * F.sin(p / 3) / (p * p)).otherwise(0.0)


def _axis(index: str, out: str, weight: str, method: str, s0: float, sd: float, t0: float, td: float, n: int) -> tuple[Column, Column]:
    """(targets, weight): target indices that a source index reaches, as an array, and a weight given both.

    Positions are in units of source cells along the axis: a target t covers [a + r t, a + r (t + 1)].
    """
    i = F.col(index).cast("double")
    a, r = (t0 - s0) / sd, td / sd
    flip = r < 0
    if flip:  # the axes run against each other: number targets from the other end
        a, r = a + r * n, -r
    t = F.col(out)
    number = (F.lit(n - 1) - t) if flip else t
    if method == "nearest":
        low, high = F.ceil((i - a) / r - 0.5), F.ceil((i + 1 - a) / r - 0.5) - 1
        value = F.lit(1.0)
    elif method in KERNELS:
        reach = KERNELS[method] * max(1.0, r)
        low, high = F.floor((i + 0.5 - reach - a) / r - 0.5) + 1, F.ceil((i + 0.5 + reach - a) / r - 0.5) - 1
        value = kernel(method, (a + r * (number + 0.5) - (i + 0.5)) / max(1.0, r))
    else:
        low, high = F.floor((i - a) / r), F.ceil((i + 1 - a) / r) - 1
        value = F.least(i + 1, a + r * (number + 1)) - F.greatest(i, a + r * number)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
    if flip:
        low, high = n - 1 - high, n - 1 - low
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), value.alias(weight)


def contributions(cube: Cube, target: GridSpec, method: str) -> DataFrame:
    """Rows of the cube for each target cell that they contribute to, with iy, ix of the target and a weight _w (not 0)."""
    s, keep = cube.grid, [*([cube.time] if cube.time else []), *cube.variables]
    xs, wx = _axis("_sx", "ix", "_wx", method, s.x0, s.dx, target.x0, target.dx, target.width)
    ys, wy = _axis("_sy", "iy", "_wy", method, s.y0, s.dy, target.y0, target.dy, target.height)
    rows = cube.df.withColumnsRenamed({"ix": "_sx", "iy": "_sy"})
    rows = rows.withColumn("ix", F.explode(xs)).withColumn("iy", F.explode(ys))
    rows = rows.select("iy", "ix", *keep, (wx * wy).alias("_w"))
    least = 1e-9 if method in AREA else 0.0
    return rows.where(F.abs("_w") > least)


def _reduced(method: str, v: Column, w: Column) -> Column:
    valid = F.when(v.isNotNull(), w)
    if method == "sum":
        return F.sum(v * w)
    if method == "rms":
        return F.sqrt(F.sum(v.cast("double") * v * w) / F.sum(valid))  # squares of large integers exceed a long
    if method in ("max", "min"):
        return getattr(F, method)(v)
    if method in ("med", "q1", "q3"):
        return F.percentile(v.cast("double"), {"med": 0.5, "q1": 0.25, "q3": 0.75}[method])
    return F.sum(v * w) / F.sum(valid)


def reproject(cube: Cube, target: GridSpec, methods: str | dict[str, str] = "nearest", dense: bool = False) -> Cube:
    """The cube on the target grid; methods: one for all variables, or by variable.

    nearest takes the source cell that holds the target's centre. Kernels widen when the target is coarser.
    NULLs are left out and the other weights made to sum to 1; average, sum and rms weigh by overlap; mode is
    the value with most overlap, the smallest on a tie; max, min, med, q1 and q3 are of all cells that
    overlap, quartiles interpolated. dense: cells that nothing reaches are rows of NULLs (static cubes only).
    """
    table = {v: methods if isinstance(methods, str) else methods.get(v, "nearest") for v in cube.variables}
    for m in table.values():
        if m not in METHODS:
            raise ValueError(f"unknown resampling {m!r}; there are {METHODS}")
    keys = cube.keys
    out = None
    for method in dict.fromkeys(table.values()):
        names = [v for v, m in table.items() if m == method]
        part = _across(cube.select(*names), target, method, keys) if target.crs != cube.grid.crs else _within(cube.select(*names), target, method, keys)
        out = part if out is None else out.join(part, keys, "full_outer")
    if dense and not cube.time:
        out = target.lattice(out.sparkSession).join(out, ["iy", "ix"], "left")
    return cube.having(out.select(*keys, *cube.variables), grid=target)


def _within(cube: Cube, target: GridSpec, method: str, keys: list[str]) -> DataFrame:
    rows = contributions(cube, target, method)
    if method == "nearest":
        return rows.select(*keys, *cube.variables)
    return _gathered(rows, cube.variables, method, keys)


def _gathered(rows: DataFrame, variables: list[str], method: str, keys: list[str]) -> DataFrame:
    """Contributions (with a weight _w) reduced to one row for a target cell."""
    if method == "mode":
        out = rows.select(*keys).distinct()
        for v in variables:
            weighed = rows.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.round(F.sum("_w"), 9).alias("_total"))
            out = out.join(weighed.groupBy(*keys).agg(F.min_by(v, F.struct(-F.col("_total"), F.col(v))).alias(v)), keys, "left")
        return out
    return rows.groupBy(*keys).agg(*[_reduced(method, F.col(v), F.col("_w")).alias(v) for v in variables])


def _across(cube: Cube, target: GridSpec, method: str, keys: list[str]) -> DataFrame:
    """Between CRSs: by the areas that cells share, the cell that holds a target's centre, or the cells around it."""
    if method in AREA:
        return _gathered(overlaps(cube, target, share=method == "sum"), cube.variables, method, keys)
    if method == "nearest":
        return around(cube, target, 0.5, holds).select(*keys, *cube.variables)
    weight = lambda du, dv: kernel(method, du) * kernel(method, dv)
    return _gathered(around(cube, target, KERNELS[method], weight), cube.variables, method, keys)


def projected(cells: DataFrame, transform: Transform, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """cells with x, y of their longitude and latitude."""
    x, y = transform.columns(F.col(lon), F.col(lat))
    return cells.withColumns({"x": x, "y": y})

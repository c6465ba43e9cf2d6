"""Subsets of cubes: boxes, polygons, times, labels, masks."""

from __future__ import annotations

import re
import warnings
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import Transform

Ring = list[tuple[float, float]]
#: Edges of a polygon up to which its test is one expression.
EDGES = 64


def bbox(cube: Cube, west: float, south: float, east: float, north: float) -> Cube:
    """Cells whose centres lie in the closed box, in the cube's CRS.

    The box becomes ranges of ix and iy, which Parquet row groups and files are skipped by.
    """
    (x1, x2), (y1, y2) = cube.grid.columns(west, east), cube.grid.rows(south, north)
    return cube.having(cube.df.where(F.col("ix").between(x1, x2) & F.col("iy").between(y1, y2)))


def inside(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Even-odd rule: whether a ray to the right of (x, y) crosses the rings' edges an odd number of times, so a ring inside another is a hole.

    Few edges are an expression of their own; of more, an array that one function runs over.
    """
    edges = [(xa, ya, yb, (xb - xa) / (yb - ya)) for r in rings for (xa, ya), (xb, yb) in zip(r, r[1:] + r[:1]) if ya != yb]
    crosses = lambda xa, ya, yb, slope: (((y < ya) != (y < yb)) & (x < xa + (y - ya) * slope)).cast("int")
    if len(edges) <= EDGES:
        return sum((crosses(*[F.lit(float(v)) for v in e]) for e in edges), F.lit(0)) % 2 == 1
    columns = F.arrays_zip(*[F.lit([float(e[k]) for e in edges]).alias(n) for k, n in enumerate(("xa", "ya", "yb", "slope"))])
    return F.aggregate(columns, F.lit(0), lambda n, e: n + crosses(e["xa"], e["ya"], e["yb"], e["slope"])) % 2 == 1


def polygon(cube: Cube, rings: list[Ring] | list[list[Ring]], mask: bool = False, transform: Transform | None = None) -> Cube:
    """Cells in the box around all rings; with mask, only those whose centre is inside.

    rings: those of a polygon, holes included, or a list of polygons, which may overlap. They are (longitude,
    latitude) unless transform is None; it projects their corners to the cube's CRS.
    """
    polygons = rings if rings and rings[0] and isinstance(rings[0][0][0], (list, tuple)) else [rings]
    if any(not p or any(len(r) < 3 for r in p) for p in polygons):
        raise ValueError("a polygon needs rings of three corners or more")
    if transform is not None:
        polygons = [[[transform.point(*c) for c in r] for r in p] for p in polygons]
    xs, ys = [c[0] for p in polygons for r in p for c in r], [c[1] for p in polygons for r in p for c in r]
    boxed = bbox(cube, min(xs), min(ys), max(xs), max(ys))
    if not mask:
        return boxed
    x, y = cube.grid.x(F.col("ix")), cube.grid.y(F.col("iy"))
    hit = inside(x, y, polygons[0])
    for p in polygons[1:]:
        hit = hit | inside(x, y, p)
    return boxed.having(boxed.df.where(hit))


_PARTS = re.compile(r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?)?)?)?)?$")


def period(text: str) -> tuple[datetime, datetime]:
    """Start, and start of what follows, of the year, month, day, ... that a partial date names."""
    m = _PARTS.match(text.strip())
    if not m:
        raise ValueError(f"not a date or part of one: {text!r}")
    y, mo, d, h, mi, s, frac = m.groups()
    start = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int(round(float(frac or 0) * 1e6)))
    if mo is None:
        return start, datetime(start.year + 1, 1, 1)
    if d is None:
        return start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    step = timedelta(days=1) if h is None else timedelta(hours=1) if mi is None else timedelta(minutes=1) if s is None else timedelta(seconds=1) if frac is None else timedelta(microseconds=1)
    return start, start + step


def time_range(cube: Cube, start: str | None = None, end: str | None = None) -> Cube:
    """Rows from the start of one period to the end of another, both whole; None leaves a side open.

    A cube without a time column is returned as it is, with a warning.
    """
    if start is None and end is None:
        return cube
    if cube.time is None:
        warnings.warn("the cube has no time dimension; its time subset is the cube itself", UserWarning, stacklevel=2)
        return cube
    df, t = cube.df, F.col(cube.time)
    if start is not None:
        df = df.where(t >= F.lit(period(start)[0]).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(t < F.lit(period(end)[1]).cast("timestamp_ntz"))
    return cube.having(df)


def combined(cube: Cube, box: tuple[float, float, float, float] | None = None, rings: list[Ring] | None = None, start: str | None = None, end: str | None = None, mask: bool = False, transform: Transform | None = None) -> Cube:
    """Box, then polygon, then time; all of them conditions on one scan."""
    if box is not None:
        cube = bbox(cube, *box)
    if rings is not None:
        cube = polygon(cube, rings, mask, transform)
    return time_range(cube, start, end)


def at_label(cube: Cube, label: object) -> Cube:
    """The slice at exactly this time, without a time column."""
    return cube.having(cube.df.where(F.col(cube.time) == F.lit(label)).drop(cube.time), time=None)


def at_index(cube: Cube, place: int) -> Cube:
    """The slice at a place in the order of times (from 0; negative ones count from the last), without a time column."""
    times = cube.df.select(cube.time).where(F.col(cube.time).isNotNull()).distinct()
    first = times.orderBy(F.col(cube.time).asc() if place >= 0 else F.col(cube.time).desc()).limit(place + 1 if place >= 0 else -place).collect()
    if len(first) < (place + 1 if place >= 0 else -place):
        raise IndexError(f"no time slice {place}")
    return at_label(cube, first[-1][0])


def where(cube: Cube, condition: Column, other: object = None) -> Cube:
    """Variables where the condition holds, `other` elsewhere; all cells stay."""
    return cube.having(cube.df.withColumns({v: F.when(condition, F.col(v)).otherwise(F.lit(other)) for v in cube.variables}))


def masked_by(cube: Cube, mask: DataFrame | None, column: str, keep: int = 1, fill: object = None) -> Cube:
    """Variables where another raster (iy, ix, column) equals keep, fill elsewhere and where it has no cell; no mask changes nothing."""
    if mask is None:
        return cube
    on = mask.select("iy", "ix", F.col(column).alias("_mask"))
    rows = cube.df.join(on, ["iy", "ix"], "left")
    kept = rows.withColumns({v: F.when(F.col("_mask") == keep, F.col(v)).otherwise(F.lit(fill)) for v in cube.variables})
    return cube.having(kept.select(*cube.df.columns))


def renamed(cube: Cube, names: dict[str, str]) -> Cube:
    return cube.having(cube.df.withColumnsRenamed(names))


def expanded(cube: Cube, time: str, label: Column) -> Cube:
    """The cube with a time dimension of one step."""
    return cube.having(cube.df.withColumn(time, label), time=time)


def stacked(cubes: list[Cube]) -> Cube:
    """Cubes of one grid behind each other in time."""
    if len({c.grid for c in cubes}) != 1 or len({c.time for c in cubes}) != 1:
        raise ValueError("cubes to stack must share their grid and time column")
    df = cubes[0].df
    for c in cubes[1:]:
        df = df.unionByName(c.df)
    return cubes[0].having(df)

"""Resampling between grids of different CRSs.

A source cell's corners are projected into the target's index space, and the row is scattered to the target cells in
reach: by the exact area that the projected quadrilateral shares with each (area methods), or by where a target
cell's centre falls when it is mapped back (nearest and kernels). Nothing is joined and there is no lattice; the
source is read within the target's footprint only, and what lies outside of a projection drops out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.crs import COLUMNS, Geographic, named, wrapped
from terracell.grid import GridSpec

#: Places along each axis of the target at which it is mapped back, on the driver, to find its footprint and how far edges bend.
PROBES = 33
#: Least shared area, in target cells.
LEAST = 1e-9
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def turn_of(grid: GridSpec) -> float | None:
    """Cells in a full turn, for grids of longitudes."""
    return 360.0 / grid.dx if isinstance(named(grid.crs), Geographic) else None


def fixed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows, whose columns of these names are computed once: conditions on them aren't pushed below, expression and all."""
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))


def placed(rows: DataFrame, points: dict[str, tuple[Column, Column]], source: GridSpec, target: GridSpec) -> DataFrame:
    """rows with _u{k}, _v{k} for points by k: positions in cells of source as such in cells of target; NULL outside of either projection."""
    back, to = named(source.crs), named(target.crs)
    steps: dict[str, Column] = {}
    for k, (u, v) in points.items():
        x, y = F.lit(source.x0) + F.lit(source.dx) * u, F.lit(source.y0) + F.lit(source.dy) * v
        if isinstance(back, Geographic):
            y = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), y))
        steps[f"_lon{k}"], steps[f"_lat{k}"] = back.inverse_columns(x, y)
    rows, out = fixed(rows.withColumns(steps), list(steps)), {}
    for k in points:
        x, y = to.columns(F.col(f"_lon{k}"), F.col(f"_lat{k}"))
        out |= {f"_u{k}": (x - target.x0) / target.dx, f"_v{k}": (y - target.y0) / target.dy}
    return fixed(rows.withColumns(out).drop(*steps), list(out))


def spot(u: float, v: float, source: GridSpec, target: GridSpec) -> tuple[float, float] | None:
    """placed() of numbers."""
    back, to = named(source.crs), named(target.crs)
    x, y = source.x0 + source.dx * u, source.y0 + source.dy * v
    try:
        x, y = to.point(*back.inverse_point(x, max(-90.0, min(90.0, y)) if isinstance(back, Geographic) else y))
    except ValueError:
        return None
    turn = turn_of(target)
    u, v = (x - target.x0) / target.dx, (y - target.y0) / target.dy
    return (u if turn is None else u - turn * math.floor(u / turn)), v


def _probes(target: GridSpec, source: GridSpec) -> list[list[tuple[float, float] | None]]:
    steps = [k / (PROBES - 1) for k in range(PROBES)]
    return [[spot(target.width * i, target.height * j, target, source) for i in steps] for j in steps]


def footprint(source: GridSpec, target: GridSpec, reach: float = 1.0) -> tuple[int, int, int, int] | None:
    """First and last ix, first and last iy of source that may reach target; None: not known, so all.

    A lattice of the target's places is mapped back. What lies between them is covered by a margin of the
    largest step; where places are outside of a projection, or steps go round the globe, nothing is ruled out.
    """
    probes = _probes(target, source)
    if any(p is None for row in probes for p in row):
        return None
    pairs = [(p, q) for row in probes for p, q in zip(row, row[1:])] + [(p, q) for a, b in zip(probes, probes[1:]) for p, q in zip(a, b)]
    du, dv = (max(abs(p[k] - q[k]) for p, q in pairs) for k in (0, 1))
    turn = turn_of(source)
    if turn is not None and du > turn / 4:
        return None
    us, vs = ([p[k] for row in probes for p in row] for k in (0, 1))
    box = math.floor(min(us) - du - reach), math.ceil(max(us) + du + reach), math.floor(min(vs) - dv - reach), math.ceil(max(vs) + dv + reach)
    if turn is not None and (box[0] < 0 or box[1] >= turn):  # over the seam of longitudes
        box = (0, source.width - 1, *box[2:])
    return max(box[0], 0), min(box[1], source.width - 1), max(box[2], 0), min(box[3], source.height - 1)


def bend(source: GridSpec, target: GridSpec, reach: float) -> float:
    """How far, in target cells, edges of projected boxes of source cells may be from the straight line between their corners."""
    most, turn = 0.0, turn_of(target)
    for row in _probes(target, source):
        for p in row:
            if p is None:
                continue
            u, v = math.floor(p[0]), math.floor(p[1])
            low, high = -reach + 0.5, reach + 0.5
            for (a, b), (c, d) in (((low, low), (high, low)), ((high, low), (high, high)), ((high, high), (low, high)), ((low, high), (low, low))):
                ends = [spot(u + x, v + y, source, target) for x, y in ((a, b), (c, d), ((a + c) / 2, (b + d) / 2))]
                if None not in ends:
                    gap = [abs((ends[0][k] + ends[1][k]) / 2 - ends[2][k]) for k in (0, 1)]
                    if turn is None or gap[0] < turn / 8:
                        most = max(most, *gap)
    return 2 * most + 0.01


def _cornered(rows: DataFrame, source: GridSpec, target: GridSpec, low: float, high: float) -> DataFrame:
    """rows (_sy, _sx) with _u0.._u3, _v0.._v3: corners of the box from low to high of each cell, in target cells.

    Boxes that are partly outside of a projection are left out, and so are those that hold a pole of a grid of
    longitudes. Over the seam of longitudes a box stays whole, and comes once for each turn at which it meets the
    target.
    """
    rows = placed(rows, {str(k): (F.col("_sx") + (high if a else low), F.col("_sy") + (high if b else low)) for k, (a, b) in enumerate(CORNERS)}, source, target)
    rows = rows.where(" and ".join(f"_u{k} is not null" for k in range(4)))
    turn = turn_of(target)
    u, v = [F.col(f"_u{k}") for k in range(4)], [F.col(f"_v{k}") for k in range(4)]
    if turn is not None:
        around = sum((wrapped(u[(k + 1) % 4] - u[k], COLUMNS, turn) for k in range(1, 4)), wrapped(u[1] - u[0], COLUMNS, turn))
        rows = rows.where(F.abs(around) < turn / 2).withColumns({f"_u{k}": u[0] + wrapped(u[k] - u[0], COLUMNS, turn) for k in range(1, 4)})
        rows = fixed(rows, [f"_u{k}" for k in range(1, 4)])
        first, last = F.ceil(-F.greatest(*u) / turn), F.floor((target.width - F.least(*u)) / turn)
        rows = rows.where(first <= last).withColumn("_turn", F.explode(F.sequence(first, last))).withColumns({f"_u{k}": u[k] + F.col("_turn") * turn for k in range(4)})
        rows = fixed(rows, [f"_u{k}" for k in range(4)])
    return rows


def _sized(rows: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """rows with corners and _area, in target cells. Cells cut by a projection's edge, whose corners run the wrong way round, are left out."""
    u, v = [F.col(f"_u{k}") for k in range(4)], [F.col(f"_v{k}") for k in range(4)]
    doubled = sum((u[k] * v[(k + 1) % 4] - u[(k + 1) % 4] * v[k] for k in range(1, 4)), u[0] * v[1] - u[1] * v[0])
    return fixed(rows.withColumn("_area", doubled * (math.copysign(1.0, source.dy * target.dy) / 2)), ["_area"]).where("_area > 0")


def _candidates(rows: DataFrame, target: GridSpec, margin: float) -> DataFrame:
    """rows for each target cell (iy, ix) in the box around their corners."""
    for axis, name, n in (("u", "ix", target.width), ("v", "iy", target.height)):
        at = [F.col(f"_{axis}{k}") for k in range(4)]
        low = F.floor(F.greatest(F.least(*at) - margin, F.lit(0.0)))
        high = F.ceil(F.least(F.greatest(*at) + margin, F.lit(float(n)))) - 1
        rows = fixed(rows.withColumns({f"_{name}a": low, f"_{name}b": high}), [f"_{name}a", f"_{name}b"]).where(f"_{name}a <= _{name}b")
    return rows.withColumn("ix", F.explode(F.sequence("_ixa", "_ixb"))).withColumn("iy", F.explode(F.sequence("_iya", "_iyb")))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def shared_area(rows: DataFrame) -> DataFrame:
    """rows with _w: the area that the quadrilateral of corners shares with the unit cell (iy, ix).

    The height of the quadrilateral within the cell, integrated along x: each edge adds the integral of its own
    height, cut to the cell, with the sign of its direction. Heights are linear, so the integral is a closed form.
    """
    ends, heights, edges = {}, {}, []
    for k in range(4):
        n = (k + 1) % 4
        ua, ub = F.col(f"_u{k}") - F.col("ix"), F.col(f"_u{n}") - F.col("ix")
        ends |= {f"_a{k}": _unit(ua), f"_b{k}": _unit(ub)}
        slope = F.try_divide(F.col(f"_v{n}") - F.col(f"_v{k}"), ub - ua)
        start = F.col(f"_v{k}") - F.col("iy")
        heights |= {f"_p{k}": start + slope * (F.col(f"_a{k}") - ua), f"_q{k}": start + slope * (F.col(f"_b{k}") - ua)}
        p, q, run = F.col(f"_p{k}"), F.col(f"_q{k}"), F.col(f"_b{k}") - F.col(f"_a{k}")
        rise = q - p
        inside, above = _unit(q) - _unit(p), F.greatest(q, F.lit(1.0)) - F.greatest(p, F.lit(1.0))
        mean = F.when(F.abs(rise) < 1e-12, _unit(p)).otherwise((inside * (_unit(p) + _unit(q)) / 2 + above) / rise)
        edges.append(F.when(run == 0, 0.0).otherwise(run * mean))
    rows = fixed(rows.withColumns(ends).withColumns(heights), [*ends, *heights])
    rows = rows.withColumn("_w", F.abs(edges[0] + edges[1] + edges[2] + edges[3])).drop(*ends, *heights)
    return fixed(rows, ["_w"])


def _source(cube: Cube, target: GridSpec, reach: float) -> DataFrame:
    """The cube's rows within the target's footprint, their cells named _sy, _sx."""
    box, rows = footprint(cube.grid, target, reach), cube.df
    if box is not None:
        rows = rows.where(F.col("ix").between(box[0], box[1]) & F.col("iy").between(box[2], box[3]))
    return rows.withColumnsRenamed({"ix": "_sx", "iy": "_sy"})


def overlaps(cube: Cube, target: GridSpec, share: bool = False) -> DataFrame:
    """Rows of the cube for each target cell (iy, ix) that they overlap; _w: the area they share, in target cells.

    Cells are the quadrilaterals between their projected corners, so neighbours leave neither gaps nor overlaps.
    share: _w is a part of the source cell instead. Needs about as many rows as there are overlapping pairs.
    """
    rows = _sized(_cornered(_source(cube, target, 1.0), cube.grid, target, 0.0, 1.0), cube.grid, target)
    rows = shared_area(_candidates(rows, target, 0.0)).where(F.col("_w") > LEAST)
    weight = F.col("_w") / F.col("_area") if share else F.col("_w")
    return rows.select(*cube.keys, *cube.variables, weight.alias("_w"), "_sy", "_sx")


def around(cube: Cube, target: GridSpec, reach: float, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of the cube for each target cell (iy, ix) whose centre falls within reach of their own; _w: weight(du, dv), not 0.

    du, dv: from the source cell's centre to the target cell's, in source cells. Candidates come from the
    projected box of what is in reach, and each is mapped back, so the box decides nothing but the work.
    """
    s = cube.grid
    rows = _candidates(_cornered(_source(cube, target, reach + 1), s, target, 0.5 - reach, 0.5 + reach), target, bend(s, target, reach))
    rows = placed(rows.drop(*[f"_{x}{k}" for x in "uv" for k in range(4)]), {"c": (F.col("ix") + 0.5, F.col("iy") + 0.5)}, target, s)
    turn, du = turn_of(s), F.col("_uc") - (F.col("_sx") + 0.5)
    rows = rows.withColumns({"_du": du if turn is None else wrapped(du, COLUMNS, turn), "_dv": F.col("_vc") - (F.col("_sy") + 0.5)})
    rows = fixed(rows, ["_du", "_dv"]).where((F.col("_du") >= -reach) & (F.col("_du") <= reach) & (F.col("_dv") >= -reach) & (F.col("_dv") <= reach))
    return rows.select(*cube.keys, *cube.variables, weight(F.col("_du"), F.col("_dv")).alias("_w"), "_sy", "_sx").where("_w != 0")


def holds(du: Column, dv: Column) -> Column:
    """1 for the cell that holds a centre, its low edges included."""
    return ((du >= -0.5) & (du < 0.5) & (dv >= -0.5) & (dv < 0.5)).cast("double")

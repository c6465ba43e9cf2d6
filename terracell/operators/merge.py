"""Merging aligned cubes without silent conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.cube import Cube


def no_conflict(a: Column, b: Column, name: str) -> Column:
    """The value of either where they are equal or one is NULL; otherwise the query fails."""
    return F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b)).otherwise(F.raise_error(F.lit(f"conflicting values of {name}")))


def pair(left: Cube, right: Cube) -> Cube:
    if left.grid != right.grid or left.keys != right.keys:
        raise ValueError("cubes to merge must share their grid and dimensions")
    keys, shared = left.keys, [v for v in left.variables if v in right.variables]
    other = right.df.withColumnsRenamed({v: f"_r_{v}" for v in shared})
    rows = left.df.join(other, keys, "full_outer")
    columns = [no_conflict(F.col(v), F.col(f"_r_{v}"), v).alias(v) if v in shared else F.col(v) for v in [*left.variables, *[v for v in right.variables if v not in shared]]]
    return left.having(rows.select(*keys, *columns))


def merge(cubes: list[Cube]) -> Cube:
    """All cells and variables of the cubes: outer joins on the cell keys, one after the other, on one partitioning."""
    if not cubes:
        raise ValueError("nothing to merge")
    return reduce(pair, cubes)


def prefixed(cube: Cube, prefix: str) -> Cube:
    """Variables named apart, for cubes whose equal names mean different things."""
    return cube.having(cube.df.withColumnsRenamed({v: f"{prefix}_{v}" for v in cube.variables}))

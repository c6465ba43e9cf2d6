"""Variables that are arrays over axes besides place and time, such as members of an ensemble and age classes.

An array has a fixed length, in the order of its axes, with NULL for missing entries. Operators on cells work on it
entry by entry: the entries become columns of the same row, so a cell stays one row, and its array is never exploded.
Reductions along an axis look at one row only and shuffle nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.cube import Cube

#: Between a variable's name and an entry's number.
MARK = "__"


def lengths_of(cube: Cube) -> dict[str, int]:
    """Lengths of array variables, from the cube's attribute `axes` (as a store's reader leaves it)."""
    return {v: math.prod(a["lengths"]) for v, a in cube.attributes.get("axes", {}).items() if v in cube.variables}


def unstacked(cube: Cube, lengths: Mapping[str, int]) -> Cube:
    """The cube with a column for each entry of the arrays; a NULL array is one of NULLs. Other variables stay."""
    columns = [F.col(v) for v in cube.variables if v not in lengths]
    columns += [F.try_element_at(F.col(v), F.lit(k + 1)).alias(f"{v}{MARK}{k}") for v, n in lengths.items() for k in range(n)]
    return cube.having(cube.df.select(*cube.keys, *columns))


def stacked(cube: Cube, lengths: Mapping[str, int]) -> Cube:
    """The reverse of unstacked(): an array whose entries are all NULL is NULL."""
    own = {f"{v}{MARK}{k}" for v, n in lengths.items() for k in range(n)}
    arrays = []
    for v, n in lengths.items():
        entries = [F.col(f"{v}{MARK}{k}") for k in range(n)]
        arrays.append(F.when(F.coalesce(*entries).isNotNull(), F.array(*entries)).alias(v))
    return cube.having(cube.df.select(*cube.keys, *[v for v in cube.variables if v not in own], *arrays))


def methods_by_entry(methods: str | Mapping[str, str], lengths: Mapping[str, int]) -> str | dict[str, str]:
    """Methods by variable as methods by entry."""
    if isinstance(methods, str):
        return methods
    return {**{k: m for k, m in methods.items() if k not in lengths}, **{f"{v}{MARK}{k}": methods[v] for v, n in lengths.items() if v in methods for k in range(n)}}


def by_entry(cube: Cube, work: Callable[[Cube], Cube], lengths: Mapping[str, int] | None = None) -> Cube:
    """work (coarsen, reproject, a reduction over time, ...) on a cube whose arrays are columns, and the arrays of its result.

    lengths: of the array variables; else those that the cube's attributes have.
    """
    known = lengths_of(cube) if lengths is None else dict(lengths)
    return stacked(work(unstacked(cube, known)), known)


def entries(array: Column, shape: tuple[int, ...], along: int, rest: Column) -> Column:
    """Entries along one axis, NULLs left out; rest: the number of the place on the other axes, in their order."""
    step, n = math.prod(shape[along + 1 :]), shape[along]
    start = (rest - rest % step) * n + rest % step
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(array, (start + k * step).cast("int") + 1)), lambda x: x.isNotNull())


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def quantile(q: float) -> Callable[[Column], Column]:
    """Linearly interpolated, for reduced()."""

    def of(values: Column) -> Column:
        place = (F.size(values) - 1) * q
        low = F.floor(place).cast("int")
        part = lambda s: F.element_at(s, low + 1) + (place - low) * (F.element_at(s, F.least(low + 2, F.size(s))) - F.element_at(s, low + 1))
        return F.when(F.size(values) > 0, F.element_at(F.transform(F.array(F.array_sort(values)), part), 1))

    return of


def reduced(array: Column, shape: tuple[int, ...], along: int, how: Callable[[Column], Column] = mean) -> Column:
    """The array over the other axes of what `how` makes of the entries along one axis; NULL where there are none."""
    rest = math.prod(shape) // shape[along]
    return F.when(array.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(rest - 1)), lambda r: how(entries(array, shape, along, r))))


def dominant(array: Column) -> Column:
    """The first position (from 0) of the greatest entry; NULL if all are."""
    top = F.array_max(array)
    return F.when(top.isNotNull(), (F.array_position(array, top) - 1).cast("int"))

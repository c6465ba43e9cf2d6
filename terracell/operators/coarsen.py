"""Coarsening by a whole factor: one grouped aggregate over windows of factor x factor cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegralType

from terracell.cube import Cube

METHODS = ("first", "min", "max", "mean", "median", "mode", "sum")


def aggregate(method: str, v: Column, order: Column) -> Column:
    """The aggregate of a method; NULLs are left out, except that first is the window's first cell, whatever it holds."""
    if method == "first":
        return F.min_by(v, order)
    if method == "median":
        return F.median(v.cast("double"))
    if method not in ("min", "max", "mean", "sum"):
        raise ValueError(f"unknown method {method!r}; there are {METHODS}")
    return getattr(F, method)(v)


def automatic(kind: DataType) -> str:
    """first for integers, mean for floats."""
    return "first" if isinstance(kind, IntegralType) else "mean"


def chosen(cube: Cube, methods: str | Mapping[str, str]) -> dict[str, str]:
    """Method of each variable: one for all, "auto", or by name, with "*" for the rest; a name beats "*" in any order."""
    table = {"*": methods} if isinstance(methods, str) else dict(methods)
    kinds = {f.name: f.dataType for f in cube.df.schema.fields}
    out = {}
    for v in cube.variables:
        method = table.get(v, table.get("*", "auto"))
        out[v] = automatic(kinds[v]) if method == "auto" else method
        if out[v] not in METHODS:
            raise ValueError(f"unknown method {method!r}; there are {METHODS}")
    return out


def modes(df: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """(keys, variable): its most frequent value that isn't NULL, the smallest on a tie. Values are counted first, so a group's rows never meet."""
    counts = df.where(F.col(variable).isNotNull()).groupBy(*keys, variable).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(variable, F.struct(-F.col("_n"), F.col(variable))).alias(variable))


def recast(v: Column, kind: DataType) -> Column:
    """v in its source's type; for integers toward zero."""
    return v if isinstance(kind, DoubleType) else v.cast(kind)


def coarsen(cube: Cube, factor: int, methods: str | Mapping[str, str] = "auto") -> Cube:
    """The cube with factor x factor cells made one; windows at the far edges may be partial.

    Windows are (iy div factor, ix div factor); values are cast back to their source's type, integers toward
    zero. A window of NULLs only gives NULL; a window without rows gives none.
    """
    if factor < 1:
        raise ValueError("the factor must be 1 or more")
    kinds, method = {f.name: f.dataType for f in cube.df.schema.fields}, chosen(cube, methods)
    keys = cube.keys
    order = F.struct("_iy", "_ix")
    cells = cube.df.withColumnsRenamed({"iy": "_iy", "ix": "_ix"}).withColumns({"iy": F.floor(F.col("_iy") / factor), "ix": F.floor(F.col("_ix") / factor)})
    plain = [recast(aggregate(m, F.col(v), order), kinds[v]).alias(v) for v, m in method.items() if m != "mode"]
    out = cells.groupBy(*keys).agg(*plain) if plain else cells.select(*keys).distinct()
    for v, m in method.items():
        if m == "mode":
            out = out.join(modes(cells, keys, v), keys, "left")
    return cube.having(out.select(*keys, *cube.variables), grid=cube.grid.coarsened(factor))

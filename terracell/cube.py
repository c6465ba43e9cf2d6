"""A cube: a DataFrame with one row for a cell (and time) and one column for a variable, with its grid."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.grid import GridSpec

CELL = ("iy", "ix")


@dataclass(frozen=True)
class Cube:
    """df has iy, ix (BIGINT), the time column if there is one, and the variables. NULL is missing data.

    time: name of the time column, or None; a single epoch is an attribute, not a dimension.
    """

    df: DataFrame
    grid: GridSpec
    time: str | None = None
    attributes: dict = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [*CELL, *([self.time] if self.time else [])]

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def select(self, *variables: str) -> Cube:
        missing = [v for v in variables if v not in self.variables]
        if missing:
            raise ValueError(f"no variable {missing}; there are {self.variables}")
        return self.having(self.df.select(*self.keys, *variables))

    def having(self, df: DataFrame, **changes) -> Cube:
        return replace(self, df=df, **changes)

    def located(self) -> DataFrame:
        """df with the cell centres, named as the grid names them."""
        return self.df.withColumns({self.grid.x_name: self.grid.x(F.col("ix")), self.grid.y_name: self.grid.y(F.col("iy"))})

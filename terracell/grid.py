"""Grids: where cells lie, how resolutions snap, and how a target grid is chosen."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def half_even(v: float) -> int:
    """Nearest integer, halves to even."""
    return int(Decimal(v).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))


@dataclass(frozen=True)
class GridSpec:
    """A regular grid. Cell (iy, ix) is centred at x0 + dx * (ix + 1/2), y0 + dy * (iy + 1/2); dy < 0 runs north to south."""

    crs: str
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    x_name: str = "longitude"
    y_name: str = "latitude"

    def __post_init__(self) -> None:
        if not self.dx > 0 or self.dy == 0 or self.width < 1 or self.height < 1:
            raise ValueError(f"not a grid: dx {self.dx}, dy {self.dy}, {self.width} x {self.height}")

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.dx), abs(self.dy)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """min x, min y, max x, max y of the outer edges."""
        y1 = self.y0 + self.dy * self.height
        return self.x0, min(self.y0, y1), self.x0 + self.dx * self.width, max(self.y0, y1)

    def x(self, ix: Column) -> Column:
        return F.lit(self.x0) + F.lit(self.dx) * (ix + 0.5)

    def y(self, iy: Column) -> Column:
        return F.lit(self.y0) + F.lit(self.dy) * (iy + 0.5)

    def digest(self) -> str:
        """The same for grids alike to 9 decimals, in any process."""
        parts = [self.crs, *(f"{round(v, 9) + 0.0:.9f}" for v in (self.x0, self.y0, self.dx, self.dy)), str(self.height), str(self.width), self.y_name, self.x_name]
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    def columns(self, low: float, high: float) -> tuple[int, int]:
        """First and last ix whose centre lies in the closed interval; first > last if none does."""
        return _inside(self.x0, self.dx, low, high, self.width)

    def rows(self, low: float, high: float) -> tuple[int, int]:
        return _inside(self.y0, self.dy, low, high, self.height)

    def lattice(self, spark: SparkSession) -> DataFrame:
        """(iy, ix) of all cells, made by the executors from one range."""
        n = F.col("id")
        return spark.range(self.width * self.height).select(F.floor(n / self.width).alias("iy"), (n % self.width).alias("ix"))

    def at_resolution(self, dx: float, dy: float | None = None, crs: str | None = None) -> GridSpec:
        """The grid over the same extent with other cells: sizes are extents over resolution, halves to even, at least 2.

        Another CRS would keep this one's units, so it is refused.
        """
        if crs is not None and crs != self.crs:
            raise ValueError("a CRS alone doesn't make a grid: give a whole GridSpec in that CRS")
        dy = dx if dy is None else dy
        if dx <= 0 or dy <= 0:
            raise ValueError("resolutions must be positive")
        west, south, east, north = self.bounds
        width, height = max(2, half_even(abs(east - west) / dx)), max(2, half_even(abs(north - south) / dy))
        return replace(self, dx=dx, dy=math.copysign(dy, self.dy), width=width, height=height)

    def coarsened(self, factor: int) -> GridSpec:
        return replace(self, dx=self.dx * factor, dy=self.dy * factor, width=-(-self.width // factor), height=-(-self.height // factor))


def digests(crs: str, x0: Column, y0: Column, dx: Column, dy: Column, width: Column, height: Column, x_name: str = "longitude", y_name: str = "latitude") -> Column:
    """GridSpec.digest() for columns of grids."""
    numbers = [F.format_string("%.9f", F.round(v.cast("double"), 9) + F.lit(0.0)) for v in (x0, y0, dx, dy)]
    return F.sha2(F.concat_ws("|", F.lit(crs), *numbers, height.cast("string"), width.cast("string"), F.lit(y_name), F.lit(x_name)), 256)


def _inside(origin: float, step: float, low: float, high: float, n: int) -> tuple[int, int]:
    a, b = (low - origin) / step - 0.5, (high - origin) / step - 0.5
    a, b = min(a, b), max(a, b)
    first, last = max(0, math.ceil(a) - 1), min(n - 1, math.floor(b) + 1)
    centre = lambda i: origin + step * (i + 0.5)  # noqa: E731  edges are decided on the centres themselves
    while first <= last and not low <= centre(first) <= high:
        first += 1
    while last >= first and not low <= centre(last) <= high:
        last -= 1
    return first, last


def snapped(source: float, target: float, mode: str = "auto", tolerance: float = 1e-6) -> float:
    """A target resolution, moved to the nearest whole multiple of the source's.

    off: never. nearest_multiple: always. auto: only within tolerance * max(1, |target|) of it. A source of 0
    or less leaves the target alone.
    """
    if mode not in ("off", "auto", "nearest_multiple"):
        raise ValueError(f"unknown snapping: {mode}")
    if mode == "off" or source <= 0:
        return target
    multiple = max(1, half_even(target / source)) * source
    return multiple if mode == "nearest_multiple" or abs(multiple - target) <= tolerance * max(1.0, abs(target)) else target


def snapped_column(source: Column, target: Column, mode: str = "auto", tolerance: float = 1e-6) -> Column:
    """snapped() for columns of resolutions."""
    multiple = F.greatest(F.lit(1.0), F.bround(target / source)) * source
    near = F.lit(True) if mode == "nearest_multiple" else F.abs(multiple - target) <= F.greatest(F.lit(1.0), F.abs(target)) * tolerance
    return F.when((source > 0) & F.lit(mode != "off") & near, multiple).otherwise(target)


def cells_across(extent: Column, resolution: Column) -> Column:
    """Cells that a resolution makes of an extent: halves to even, at least 2."""
    return F.greatest(F.lit(2), F.bround(F.abs(extent / resolution)).cast("long"))

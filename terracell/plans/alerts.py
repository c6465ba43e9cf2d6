"""Dated alert rasters as a cube: static layers, and a slice for each month."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.operators import values as V
from terracell.sources import store

FILL = -9999


def layers(raw: Cube, code: str = "alert", mask: str = "forest_mask") -> Cube:
    """forest_mask (0, 1, or FILL outside of its domain) and alert_yydoy (the code as it is)."""
    return raw.having(raw.df.select(*raw.keys, V.in_domain(F.col(mask), fill=FILL).cast("smallint").alias("forest_mask"), F.col(code).cast("int").alias("alert_yydoy")))


def occurrence(raw: Cube, first: str, last: str, code: str = "alert", mask: str = "forest_mask") -> Cube:
    """disturbance_occurrence by month: 1 in the month of a forest cell's alert, 0 in others and outside of forests, FILL outside of the mask's domain.

    A cell is repeated for each month where it stands; nothing is joined.
    """
    cells = raw.df.select(*raw.keys, V.month_index(F.col(code)).alias("_month"), F.when(V.is_finite(F.col(mask)), F.col(mask)).alias("_mask"))
    rows = V.monthly(cells, "_month", "_mask", V.months(raw.df.sparkSession, first, last), "disturbance_occurrence", FILL)
    return raw.having(rows.select(*raw.keys, F.col("t").alias("time"), "disturbance_occurrence"), time="time")


def ingest(raw: Cube, path: str, first: str = "2020-01-01", last: str = "2023-12-01", chunk: tuple[int, int] = (2048, 2048), code: str = "alert", mask: str = "forest_mask") -> None:
    """Writes a raster of YYddd codes and its mask as a store: the static layers in place of what is there, then the months.

    Later months are appended by calling store.write with their occurrence().
    """
    store.write(layers(raw, code, mask), path, chunk)
    store.write(occurrence(raw, first, last, code, mask), path, chunk, append=True)

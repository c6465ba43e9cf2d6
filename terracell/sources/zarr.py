"""Zarr stores (version 2) as cubes: the description says which chunk files a box needs, and only those are opened.

Chunk files are rows of a binary scan, so any file system that Spark knows will do. Files of one place of all variables
that share their chunks meet in one row (of compressed bytes), are decoded together, and give cells with a column for
each variable; nothing is joined cell by cell. Axes other than place and time (members, classes) become arrays.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.metadata import CRS_VARIABLES, X_NAMES, Y_NAMES, axis, crs_of
from terracell.grid import GridSpec
from terracell.operators.subset import period
from terracell.session import importable
from terracell.sources.arrays import inflated, small_file

Box = Mapping[str, tuple[int, int]]
SQL_TYPES = {"b": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint", "f2": "float", "f4": "float", "f8": "double"}
ARROW_TYPES = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
SECONDS = {"days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}


@dataclass(frozen=True)
class Described:
    """An array as its metadata has it."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    codec: dict | None
    fill: object
    separator: str
    order: str
    dims: tuple[str, ...]
    attributes: dict = field(default_factory=dict)

    @property
    def sql(self) -> str:
        return SQL_TYPES["b" if self.dtype.kind == "b" else f"{self.dtype.kind}{self.dtype.itemsize}"]

    @classmethod
    def of(cls, name: str, meta: dict, attributes: dict) -> Described:
        if meta.get("zarr_format", 2) != 2 or meta.get("filters"):
            raise ValueError(f"{name}: format {meta.get('zarr_format')} with filters {meta.get('filters')} can't be read")
        shape = tuple(meta["shape"])
        dims = tuple(attributes.get("_ARRAY_DIMENSIONS") or [f"d{k}" for k in range(len(shape))])
        return cls(name, shape, tuple(meta["chunks"]), np.dtype(meta["dtype"]), meta["compressor"], meta.get("fill_value"), meta.get("dimension_separator", "."), meta.get("order", "C"), dims, {k: v for k, v in attributes.items() if k != "_ARRAY_DIMENSIONS"})


def described(spark: SparkSession, store: str, names: list[str] | None = None) -> tuple[dict[str, Described], dict]:
    """The arrays of a store by name, and its attributes, from its consolidated metadata, or of named arrays from their own."""

    def text(path: str) -> dict | None:
        try:
            return json.loads(small_file(spark, f"{store}/{path}"))
        except Exception as e:
            if "FileNotFound" in str(e) or "NoSuchFile" in str(e):
                return None
            raise

    whole = text(".zmetadata")
    if whole is None:
        if names is None:
            raise FileNotFoundError(f"{store} has no consolidated metadata: name its arrays")
        own = {n: (text(f"{n}/.zarray"), text(f"{n}/.zattrs")) for n in names}
        missing = [n for n, (a, _) in own.items() if a is None]
        if missing:
            raise FileNotFoundError(f"no array {missing} below {store}")
        return {n: Described.of(n, a, b or {}) for n, (a, b) in own.items()}, text(".zattrs") or {}
    meta = whole["metadata"]
    arrays = {k.rpartition("/")[0]: v for k, v in meta.items() if k.endswith("/.zarray")}
    return {n: Described.of(n, a, meta.get(f"{n}/.zattrs", {})) for n, a in arrays.items()}, meta.get(".zattrs", {})


def chunk_files(spark: SparkSession, store: str, array: Described, box: Box | None = None) -> DataFrame | None:
    """(path, content) of the array's chunks that a box of index ranges (both ends included) by dimension needs; None if there are none.

    The ranges go into the path's pattern, so other chunks are neither opened nor rows.
    """
    parts = []
    for dim, n, c in zip(array.dims, array.shape, array.chunks):
        low, high = (box or {}).get(dim, (0, n - 1))
        first, last = max(low, 0) // c, min(high, n - 1) // c
        if first > last:
            return None
        parts.append("[0-9]*" if (first, last) == (0, (n - 1) // c) else "{" + ",".join(map(str, range(first, last + 1))) + "}")
    try:
        return importable(spark).read.format("binaryFile").load(f"{store}/{array.name}/" + array.separator.join(parts or ["0"])).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def chunk_of(path: str, array: Described) -> list[int]:
    """The numbers of a chunk along each dimension, from its file's path."""
    tail = path.rstrip("/").split("/")
    return [int(k) for k in (tail[-1].split(array.separator) if array.separator != "/" else tail[-max(len(array.shape), 1) :])][: len(array.shape)]


def decoded(raw: bytes, array: Described) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's values and where they are valid."""
    values = np.frombuffer(inflated(raw, array.codec), array.dtype).reshape(array.chunks, order=array.order)
    valid = ~np.isnan(values) if values.dtype.kind == "f" else np.ones(values.shape, bool)
    if isinstance(array.fill, (int, float)) and not isinstance(array.fill, bool):
        valid &= values != array.fill
    return values, valid


def cells(spark: SparkSession, store: str, arrays: list[Described], box: Box | None = None, axes: tuple[str, ...] = ()) -> DataFrame:
    """(a column for each dimension that isn't in axes, one for each array): entries in the box that are valid in any array.

    All arrays share dimensions, shape and chunks. Values keep their type (unsigned ones the next wider), fill values and
    NaN are NULL. axes: dimensions that become arrays in the order of the axes; a chunk has to hold the whole of these.
    """
    first = arrays[0]
    if any((a.dims, a.shape, a.chunks) != (first.dims, first.shape, first.chunks) for a in arrays):
        raise ValueError(f"arrays {[a.name for a in arrays]} don't share their chunks")
    places = [k for k, d in enumerate(first.dims) if d not in axes]
    inner = [first.dims.index(d) for d in axes]
    if any(first.chunks[k] < first.shape[k] for k in inner):
        raise ValueError(f"axes {axes} are cut into chunks")
    columns = [first.dims[k] for k in places]
    schema = ", ".join([*(f"`{c}` bigint" for c in columns), *(f"`{a.name}` {f'array<{a.sql}>' if axes else a.sql}" for a in arrays)])
    found = [(k, chunk_files(spark, store, a, box)) for k, a in enumerate(arrays)]
    files = None
    for k, rows in found:
        if rows is not None:
            rows = rows.select("path", "content", F.lit(k).alias("which"))
            files = rows if files is None else files.unionByName(rows)
    if files is None:
        return spark.createDataFrame([], schema)
    bounds = [(max(low, 0), min(high, n - 1)) for n, (low, high) in ((n, (box or {}).get(d, (0, n - 1))) for d, n in zip(first.dims, first.shape))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in b.column(0).to_pylist():
                start = [k * c for k, c in zip(chunk_of(group[0]["path"], arrays[group[0]["which"]]), first.chunks)]
                cut = tuple(slice(max(low - s, 0), max(min(high + 1 - s, c), 0)) for s, c, (low, high) in zip(start, first.chunks, bounds))
                blocks = {g["which"]: tuple(np.moveaxis(x[cut], inner, range(-len(inner), 0)) if inner else x[cut] for x in decoded(g["content"], arrays[g["which"]])) for g in group}
                shape = next(iter(blocks.values()))[0].shape
                count, wide = shape[: len(places)], math.prod(shape[len(places) :])
                any_valid = np.logical_or.reduce([v.reshape(-1, wide).any(axis=1) for _, v in blocks.values()])
                at = np.flatnonzero(any_valid)
                index = np.unravel_index(at, count) if count else ()
                out = [pa.array(x + start[k] + cut[k].start, pa.int64()) for x, k in zip(index, places)]
                for k, a in enumerate(arrays):
                    kind = ARROW_TYPES[a.sql]
                    if k not in blocks:
                        out.append(pa.nulls(len(at), pa.list_(kind) if axes else kind))
                        continue
                    values, valid = (x.reshape(-1, wide)[at].ravel() for x in blocks[k])
                    flat = pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=~valid)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * wide, pa.int32()), flat) if axes else flat)
                yield pa.RecordBatch.from_arrays(out, [*columns, *(a.name for a in arrays)])

    if len(arrays) == 1:
        grouped = files.select(F.array(F.struct("path", "content", "which")).alias("chunk"))
    else:  # the same place of all variables: so many bytes a row, and as many rows as places
        parts = F.split("path", "/")
        place = F.element_at(parts, -1) if first.separator != "/" else F.array_join(F.slice(parts, -len(first.shape), len(first.shape)), "/")
        grouped = files.groupBy(place.alias("place")).agg(F.collect_list(F.struct("path", "content", "which")).alias("chunk")).select("chunk")
    return grouped.mapInArrow(decode, schema)


def variable(spark: SparkSession, store: str, name: str, box: Box | None = None) -> DataFrame:
    """One array: a column d0, d1, ... for each dimension, with positions, and value. box: ranges by these names."""
    array = described(spark, store, [name])[0][name]
    array = replace(array, dims=tuple(f"d{k}" for k in range(len(array.shape))))
    return cells(spark, store, [array], box).withColumnRenamed(name, "value")


def time_origin(units: str) -> tuple[float, datetime]:
    """Seconds of a unit, and the moment it counts from: of `days since 1970-01-01` and the like."""
    unit, _, since = units.partition(" since ")
    if unit not in SECONDS or not since:
        raise ValueError(f"times in {units!r} can't be read")
    return SECONDS[unit], period(since.strip().removesuffix("Z")[:19])[0]


def _regular(spark: SparkSession, store: str, array: Described) -> tuple[float, float]:
    """Where a regular coordinate's first cell begins, and its step; its first two entries are read."""
    rows = dict(cells(spark, store, [replace(array, dims=("n",))], {"n": (0, 1)}).collect())
    step = float(rows[1] - rows[0]) if len(rows) > 1 else 1.0
    return rows[0] - step / 2, step


def _times(spark: SparkSession, store: str, array: Described) -> DataFrame:
    """(n, time) of a time coordinate."""
    unit, origin = time_origin(array.attributes["units"])
    moment = F.timestamp_add("SECOND", F.round(F.col(array.name) * unit).cast("int"), F.lit(origin).cast("timestamp_ntz"))
    return cells(spark, store, [replace(array, dims=("n",))]).select("n", moment.alias("_t"))


def opened(spark: SparkSession, store: str, variables: list[str] | None = None, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, crs: str | None = None, names: list[str] | None = None) -> Cube:
    """A store as a cube, in a box (west, south, east, north) and from one period to another, both whole.

    Only the description and two entries of each coordinate are read now; later, only chunks that the box and the
    periods touch. Coordinates are regular, and found by their names. Times become timestamps; a dimension without a
    coordinate of its own keeps its positions. Other dimensions are axes: their variables are arrays over them, and the
    cube's attribute `axes` has, by variable, the axes' names and lengths. names: arrays, where there is no consolidated
    metadata. ValueError if a variable isn't there.
    """
    arrays, attributes = described(spark, store, names)
    gridded = {n: a for n, a in arrays.items() if any(d in X_NAMES for d in a.dims) and any(d in Y_NAMES for d in a.dims)}
    chosen = list(gridded) if variables is None else variables
    missing = [v for v in chosen if v not in gridded]
    if missing or not chosen:
        raise ValueError(f"no variable {missing}; there are {sorted(gridded)}")
    dims = list(gridded[chosen[0]].dims)
    x, y = axis(dims, X_NAMES), axis(dims, Y_NAMES)
    (x0, dx), (y0, dy) = _regular(spark, store, arrays[x]), _regular(spark, store, arrays[y])
    sizes = dict(zip(dims, gridded[chosen[0]].shape))
    mapping = {v: arrays[v].attributes for v in CRS_VARIABLES if v in arrays}
    grid = GridSpec(crs_of(mapping, attributes, crs), x0, y0, dx, dy, sizes[x], sizes[y], x, y)
    ranges: dict[str, tuple[int, int]] = {}
    if box is not None:
        ranges |= {x: grid.columns(box[0], box[2]), y: grid.rows(box[1], box[3])}
    times = _times(spark, store, arrays["time"]) if "time" in arrays and any("time" in gridded[v].dims for v in chosen) else None
    if times is not None and (start is not None or end is not None):
        for text, side, test in ((start, 0, F.col("_t").__ge__), (end, 1, F.col("_t").__lt__)):
            times = times if text is None else times.where(test(F.lit(period(text)[side]).cast("timestamp_ntz")))
        first, last = times.agg(F.min("n"), F.max("n")).first()
        ranges["time"] = (1, 0) if first is None else (first, last)
    groups: dict[tuple, list[Described]] = defaultdict(list)
    for v in chosen:
        groups[gridded[v].dims, gridded[v].shape, gridded[v].chunks, gridded[v].separator].append(gridded[v])
    out, axes = None, {}
    for own in groups.values():
        extra = tuple(d for d in own[0].dims if d not in (x, y, "time"))
        axes |= {a.name: {"names": list(extra), "lengths": [a.shape[a.dims.index(d)] for d in extra]} for a in own if extra}
        rows = cells(spark, store, own, ranges, extra).withColumnsRenamed({x: "ix", y: "iy"})
        keys = ["iy", "ix"]
        if "time" in own[0].dims:
            keys.append("time")
            if times is not None:
                rows = rows.join(times, F.col("time") == F.col("n")).drop("time", "n").withColumnRenamed("_t", "time")
        rows = rows.select(*keys, *[a.name for a in own])
        out = rows if out is None else out.join(rows, [k for k in keys if k in out.columns], "full_outer")
    kept = {**attributes, **({"axes": axes} if axes else {})}
    return Cube(out, grid, "time" if "time" in out.columns else None, kept)

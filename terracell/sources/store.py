"""Cubes as Parquet: written by chunk and time slice, committed by a record in a log, opened through the catalog.

A cube's folder holds `data` (layers in time) and `static` (layers without), with a folder for each commit, partitioned
by time and sorted by chunk, and `log`, with one JSON row for each commit: its files' folders, variables and types, the
grid and attributes. Rows count from the moment that their record is there; a write that failed has none and is not
seen. Chunk columns cy, cx stand in the data, so that a box reads the row groups of its chunks only.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terracell.catalog import discovery
from terracell.catalog.tables import Catalog
from terracell.cube import Cube
from terracell.functions.metadata import kept
from terracell.grid import GridSpec

#: How a commit meets what is there: start anew; take the place of its slices' (or static) layers of the same names; lay its cells over them.
MODES = ("overwrite", "replace", "add")
#: Key of static layers among slices.
STATIC = ""


def chunked(cube: Cube, chunk: tuple[int, int]) -> DataFrame:
    return cube.df.withColumns({"cy": F.floor(F.col("iy") / chunk[0]), "cx": F.floor(F.col("ix") / chunk[1])})


def history(spark: SparkSession, path: str) -> list[dict]:
    """Records of all commits that count, in order: those from the last that started anew. Empty if there is no cube."""
    try:
        rows = spark.read.text(f"{path}/log").collect()  # one for each commit
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    records = sorted((json.loads(r["value"]) for r in rows), key=lambda r: (r["seq"], r["id"]))
    first = max((k for k, r in enumerate(records) if r["mode"] == "overwrite"), default=0)
    return records[first:]


def _types(records: list[dict]) -> dict[str, str]:
    return {v: t for r in records for v, t in r["variables"].items()}


def _checked(cube: Cube, old: list[dict], path: str) -> dict[str, str]:
    """Types of the cube's variables; ValueError if it doesn't go with what is there."""
    fields = {f.name: f.dataType.json() for f in cube.df.schema.fields}
    types = {v: fields[v] for v in cube.variables}
    time = next((r["time"] for r in old if r["time"]), None)
    if old and (GridSpec(**old[-1]["grid"]) != cube.grid or cube.time and time and [cube.time, fields[cube.time]] != time):
        raise ValueError(f"the cube at {path} has another grid or time column")
    there = _types(old)
    other = [v for v in types if v in there and there[v] != types[v]]
    if other:
        raise ValueError(f"the cube at {path} has variables of other types: {other}")
    return types


def write(cube: Cube, path: str, chunk: tuple[int, int] = (2048, 2048), append: bool = False, mode: str | None = None, note: dict | None = None) -> None:
    """Writes a cube in place of what is there, or with append adds the layers that it has, in one commit.

    Rows are range-partitioned by chunk, so each file covers few chunks. Appended layers replace those of their
    names, in their slices (or the static ones) only: a slice that is written again isn't there twice, and other
    variables, slices and static layers stay. mode="add" instead lays cells over a slice: cells and variables that
    the cube doesn't have, or has NULLs for, stay as well. Variables that a slice lacks are NULL in it. note goes
    into the record. ValueError, before anything is written, if an appended cube has another grid, another time
    column or another type of a variable than what is there. Commits at one moment are ordered by their ids.
    """
    spark, name = cube.df.sparkSession, "data" if cube.time else "static"
    mode = mode or ("replace" if append else "overwrite")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    old = history(spark, path)
    seq, own = 1 + max((r["seq"] for r in old), default=0), uuid.uuid4().hex
    old = [] if mode == "overwrite" else old
    types = _checked(cube, old, path)
    chunk = tuple(old[0]["chunk"]) if old else chunk
    order = [*([cube.time] if cube.time else []), "cy", "cx"]
    writer = chunked(cube, chunk).repartitionByRange(*order).sortWithinPartitions(*order, "iy", "ix").write.option("compression", "zstd")
    folder = f"{name}/commit={seq:08d}-{own}"
    (writer.partitionBy(cube.time) if cube.time else writer).parquet(f"{path}/{folder}")
    schema = StructType([f for f in chunked(cube, chunk).schema.fields if f.name != cube.time])
    files = spark.read.schema(schema).parquet(f"{path}/{folder}").inputFiles()
    slices = sorted({f.split("/")[-2] for f in files}) if cube.time else [STATIC]
    record = {
        "seq": seq, "id": own, "mode": mode, "folder": folder, "slices": slices, "variables": types, "time": [cube.time, cube.df.schema[cube.time].dataType.json()] if cube.time else None,
        "grid": asdict(cube.grid), "chunk": chunk, "attributes": {**(old[-1]["attributes"] if old else {}), **kept(cube.attributes)}, "note": note,
    }
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(f"{path}/log")


def _layers(records: list[dict], wanted: set[str]) -> dict[str, list[tuple[int, tuple[str, ...]]]]:
    """For each slice, the commits (places in records) that count, oldest first, each with its variables that do."""
    out: dict[str, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
    for k, r in enumerate(records):
        own = set(r["variables"])
        for s in r["slices"]:
            before = out[s] if r["mode"] == "add" else [(j, tuple(v for v in vs if v not in own)) for j, vs in out[s]]
            out[s] = [(j, vs) for j, vs in before if vs] + [(k, tuple(sorted(own & wanted)))]
    return {s: [(j, vs) for j, vs in layers if vs] for s, layers in out.items() if any(vs for _, vs in layers)}


def _scan(spark: SparkSession, path: str, records: list[dict], group: dict[str, list[int]], variables: list[str]) -> DataFrame:
    """Rows of slices, by slice the commits to read them from; variables that a commit lacks are NULL."""
    first = records[next(iter(group.values()))[0]]
    table, types = first["folder"].split("/")[0], _types(records)
    keys = [("iy", '"long"'), ("ix", '"long"')] + ([tuple(first["time"])] if first["time"] else [])
    schema = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": json.loads(t), "nullable": True, "metadata": {}} for n, t in [*keys, *((v, types[v]) for v in variables)]]})
    paths = [f"{path}/{records[k]['folder']}/{s}".rstrip("/") for s, ks in group.items() for k in ks]
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*paths)


def _table(spark: SparkSession, path: str, records: list[dict], wanted: set[str]) -> DataFrame | None:
    """Rows of one table's records: slices of one commit each are one scan, those that several make up are laid over each other by cell."""
    layers = _layers(records, wanted)
    if not layers:
        return None
    names = sorted({v for ls in layers.values() for _, vs in ls for v in vs})
    keys = ["iy", "ix", *([records[-1]["time"][0]] if records[-1]["time"] else [])]
    plain = {s: [ls[0][0]] for s, ls in layers.items() if len(ls) == 1 and set(ls[0][1]) == set(records[ls[0][0]]["variables"]) & set(names)}
    parts = [_scan(spark, path, records, plain, names).select(*keys, *names)] if plain else []
    groups: dict[tuple, list[str]] = defaultdict(list)
    for s, ls in layers.items():
        if s not in plain:
            groups[tuple(ls)].append(s)
    for ls, slices in groups.items():
        rows = None
        for k, vs in ls:
            one = _scan(spark, path, records, {s: [k] for s in slices}, list(vs)).select(*keys, *vs, F.lit(k).alias("_k"))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        there = sorted({v for _, vs in ls for v in vs})
        rows = rows.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_k"))).alias(v) for v in there])
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, variables: list[str] | None = None, as_of: int | None = None) -> Cube:
    """The cube at a path, with the variables asked for; nothing but its log is read yet.

    Static layers stand beside each time slice of their cell; a cell that only they have is one row without a time.
    Where the variables asked for are all static or all in time, only those tables are read. as_of: the number of
    the last commit that counts.
    """
    records = [r for r in history(spark, path) if as_of is None or r["seq"] <= as_of]
    if not records:
        raise FileNotFoundError(f"no cube at {path}")
    grid, attributes = GridSpec(**records[-1]["grid"]), records[-1]["attributes"]
    timed, flat = [r for r in records if r["time"]], [r for r in records if not r["time"]]
    missing = [v for v in variables or [] if v not in _types(records)]
    if missing:
        raise ValueError(f"no variable {missing}; there are {sorted(_types(records))}")
    in_time = set(_types(timed)) & set(variables or _types(timed))
    data = _table(spark, path, timed, in_time) if in_time or not variables and timed else None
    # of layers of one name, those in time count
    static = _table(spark, path, flat, (set(_types(flat)) - set(_types(timed))) & set(variables or _types(flat)))
    time = timed[0]["time"][0] if timed else None
    if data is not None and dict(data.dtypes)[time] in ("date", "timestamp", "string"):
        data = data.withColumn(time, F.col(time).cast("timestamp_ntz"))
    if data is None or static is None:
        cube = Cube(static if data is None else data, grid, None if data is None else time, attributes)
    else:
        cube = Cube(data.join(static, ["iy", "ix"], "full_outer"), grid, time, attributes)
    return cube.select(*(variables or cube.variables))


def compacted(spark: SparkSession, path: str) -> int:
    """Writes slices that several commits make up as one, and returns how many there were; reading gives the same."""
    records = [r for r in history(spark, path) if r["time"]]
    torn = [s for s, ls in _layers(records, set(_types(records))).items() if len(ls) > 1]
    if torn:
        whole = read(spark, path, sorted(_types(records)))
        only = [{**r, "slices": [s for s in r["slices"] if s in torn]} for r in records]
        rows = _table(spark, path, [r for r in only if r["slices"]], set(_types(records)))
        write(whole.having(rows, time=records[0]["time"][0]), path, append=True, note={"compacted": len(torn)})
    return len(torn)


def write_all(cubes: dict[str, Cube], base: str, chunks: dict[str, tuple[int, int]] | None = None) -> dict[str, str]:
    """Writes a region's cubes, one for a resolution, below a folder; their paths by resolution."""
    paths = {r: f"{base}_{r}.parquet" for r in cubes}
    for resolution, cube in cubes.items():
        write(cube, paths[resolution], (chunks or {}).get(resolution, (1024, 1024)))
    return paths


def open_item(spark: SparkSession, catalog: Catalog, collection: str, version: str, resolution: str | None = None, variables: list[str] | None = None, asset_key: str = "zarr", region: str | None = None) -> Cube:
    """The cube of a collection's version; a resolution stands for its own asset, whatever asset_key says.

    ValueErrors say what there is: versions of the collection, assets of the item, variables of the cube.
    """
    discovery.collection(catalog, collection)
    rows = catalog.items.where((F.col("collection_id") == collection) & (F.col("version") == version))
    rows = rows.where(F.col("region") == region) if region else rows
    found = rows.orderBy("item_id").take(2)
    if not found:
        there = sorted(r["version"] for r in discovery.versions(catalog, collection).collect())
        raise ValueError(f"{collection} has no version {version!r}{f' for {region!r}' if region else ''}; there are {there}")
    if len(found) > 1:
        raise ValueError(f"{collection} {version} has several regions; name one")
    item, key = found[0]["item_id"], f"{asset_key.split('_')[0]}_{resolution}" if resolution else asset_key
    assets = catalog.assets.where(F.col("item_id") == item)
    asset = assets.where(F.col("asset_key") == key).first()
    if asset is None:
        raise ValueError(f"{item} has no asset {key!r}; there are {sorted(r['asset_key'] for r in assets.select('asset_key').take(50))}")
    return read(spark, asset["href"], variables)


def files_of(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(path, year): files whose name matches a pattern with a group for the year, in order; FileNotFoundError if none does."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    year = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    rows = found.withColumn("_y", year).where("_y != ''").select("path", F.col("_y").cast("int").alias("year")).orderBy("year", "path")
    if not rows.take(1):
        raise FileNotFoundError(f"no file like {pattern} below {directory}")
    return rows


def layers(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("iy", "ix")) -> DataFrame:
    """One DataFrame with a column for each layer (iy, ix, value), by full outer joins on the cell keys."""
    out = None
    for name, df in parts.items():
        part = df.select(*keys, F.col("value").alias(name))
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out



"""Cubes stored in buckets of chunks: merges, masks and coarsening of such stores read them where they lie, without a shuffle.

A store's rows are hashed by chunk (cy, cx) into a fixed number of buckets when they are written, which is the one
shuffle. Stores of one grid, chunk and number of buckets then agree on where a cell lies. Spark meets two of them bucket
by bucket if the session has SETTING; otherwise it shuffles, with the same rows. A chunk has a bounded number of cells,
so buckets differ by the number of their chunks only.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce
from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terracell.cube import Cube
from terracell.functions.metadata import kept
from terracell.grid import GridSpec
from terracell.operators import coarsen as C
from terracell.operators.merge import no_conflict

#: Lets joins on chunk and cell use rows that are hashed by chunk alone.
SETTING = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
CHUNK = ("cy", "cx")


@dataclass(frozen=True)
class Stored:
    """A cube whose df has the chunk columns cy and cx as well, and how it lies."""

    cube: Cube
    chunk: tuple[int, int]
    buckets: int

    @property
    def keys(self) -> list[str]:
        return [*CHUNK, *self.cube.keys]

    @property
    def variables(self) -> list[str]:
        return [v for v in self.cube.variables if v not in CHUNK]

    def plain(self) -> Cube:
        """The cube without chunk columns."""
        return self.cube.having(self.cube.df.drop(*CHUNK))

    def having(self, df: DataFrame, **changes) -> Stored:
        return Stored(self.cube.having(df, **changes), self.chunk, self.buckets)


def write(cube: Cube, path: str, chunk: tuple[int, int] = (2048, 2048), buckets: int = 256) -> None:
    """Writes a cube in buckets below a path, in place of what is there. One file holds a bucket, sorted by chunk and cell.

    ValueError for variables that are called like the chunk columns.
    """
    if clash := sorted(set(CHUNK) & set(cube.df.columns)):
        raise ValueError(f"variables can't be called {clash}")
    spark = cube.df.sparkSession
    rows = cube.df.withColumns({"cy": F.floor(F.col("iy") / chunk[0]), "cx": F.floor(F.col("ix") / chunk[1])})
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    order = [*CHUNK, *cube.keys]
    writer = rows.repartition(buckets, *CHUNK).sortWithinPartitions(*order).write.mode("overwrite").format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, *CHUNK).option("path", f"{path}/data").saveAsTable(name)
    about = {"grid": asdict(cube.grid), "time": cube.time, "chunk": list(chunk), "buckets": buckets, "schema": rows.schema.json(), "attributes": kept(cube.attributes)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read(spark: SparkSession, path: str, variables: list[str] | None = None) -> Stored:
    """The cube at a path, with the variables asked for; other sessions' stores can be read as well."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    schema = StructType.fromJson(json.loads(about["schema"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    location = f"{path}/data".replace("'", "\\'")
    name = _table(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (cy, cx) INTO {about['buckets']} BUCKETS LOCATION '{location}'")
    out = Stored(Cube(spark.table(name), GridSpec(**about["grid"]), about["time"], about["attributes"]), tuple(about["chunk"]), about["buckets"])
    if missing := sorted(set(variables or []) - set(out.variables)):
        raise ValueError(f"no variable {missing}; there are {out.variables}")
    return out.having(out.cube.df.select(*out.keys, *(variables or out.variables)))


def _table(path: str) -> str:
    """A session's name for the table at a path."""
    return f"terracell_{uuid5(NAMESPACE_URL, path).hex}"


def _alike(parts: list[Stored]) -> Stored:
    if not parts:
        raise ValueError("nothing to merge")
    first = parts[0]
    for p in parts[1:]:
        if (p.cube.grid, p.cube.keys, p.chunk, p.buckets) != (first.cube.grid, first.cube.keys, first.chunk, first.buckets):
            raise ValueError("stores to merge must share their grid, dimensions, chunk and number of buckets")
    return first


def merge(parts: list[Stored]) -> Stored:
    """All cells and variables of the stores; variables that several have must not conflict (no_conflict)."""
    _alike(parts)
    return reduce(_pair, parts)


def _pair(left: Stored, right: Stored) -> Stored:
    keys, shared = left.keys, [v for v in left.variables if v in right.variables]
    l, r = left.cube.df.alias("l"), right.cube.df.alias("r")
    both = l.join(r, reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]), "full_outer")
    own = [F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys]
    values = [no_conflict(F.col(f"l.`{v}`"), F.col(f"r.`{v}`"), v).alias(v) if v in shared else F.col(f"l.`{v}`") for v in left.variables]
    return left.having(both.select(*own, *values, *[F.col(f"r.`{v}`") for v in right.variables if v not in shared]))


def masked(store: Stored, mask: Stored, variable: str, keep: int | list[int]) -> Stored:
    """Cells of a store where a static mask's variable has one of the values of keep; other cells go."""
    if (mask.cube.grid, mask.chunk, mask.buckets) != (store.cube.grid, store.chunk, store.buckets) or mask.cube.time:
        raise ValueError("a mask must be static and share the store's grid, chunk and number of buckets")
    wanted = mask.cube.df.where(F.col(f"`{variable}`").isin(keep if isinstance(keep, list) else [keep])).select(*CHUNK, "iy", "ix")
    return store.having(store.cube.df.join(wanted, [*CHUNK, "iy", "ix"], "left_semi"))


def coarsened(store: Stored, factor: int, methods: str | Mapping[str, str] = "auto") -> Stored:
    """The store with factor x factor cells made one, as operators.coarsen does, within buckets.

    The factor must divide the chunk, so that no window lies in two of them; mode, which counts by another key, is
    for coarsen() itself.
    """
    if factor < 1 or any(c % factor for c in store.chunk):
        raise ValueError(f"the factor must divide the chunk {store.chunk}")
    plain = store.plain()
    method, kinds = C.chosen(plain, methods), {f.name: f.dataType for f in plain.df.schema.fields}
    if by_count := sorted(v for v, m in method.items() if m == "mode"):
        raise ValueError(f"no mode within buckets: {by_count}")
    cells = store.cube.df.withColumnsRenamed({"iy": "_iy", "ix": "_ix"}).withColumns({"iy": F.floor(F.col("_iy") / factor), "ix": F.floor(F.col("_ix") / factor)})
    values = [C.recast(C.aggregate(m, F.col(v), F.struct("_iy", "_ix")), kinds[v]).alias(v) for v, m in method.items()]
    out = Stored(store.cube.having(cells.groupBy(*store.keys).agg(*values), grid=store.cube.grid.coarsened(factor)), store.chunk, store.buckets)
    return Stored(out.cube, (store.chunk[0] // factor, store.chunk[1] // factor), store.buckets)

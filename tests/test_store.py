"""The store's commits: other variables, slices in several parts, failures, replays, and what each read sees."""

import pytest
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.sources import store
from terracell.streaming.slices import ingest

GRID = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 4, 4)


def slices(spark, rows, columns="v int"):
    return Cube(spark.createDataFrame(rows, f"iy long, ix long, t int, {columns}"), GRID, "t")


def rows_of(cube):
    return {tuple(r[k] for k in cube.keys): tuple(r[v] for v in sorted(cube.variables)) for r in cube.df.collect()}


def test_slices_with_other_variables(spark, tmp_path):
    path = str(tmp_path / "c")
    store.write(slices(spark, [(0, 0, 1, 10), (0, 1, 1, 11), (0, 0, 2, 20)]), path, (2, 2))
    store.write(slices(spark, [(0, 0, 3, 30, 3.5)], "v int, w double"), path, append=True)
    assert rows_of(store.read(spark, path)) == {(0, 0, 1): (10, None), (0, 1, 1): (11, None), (0, 0, 2): (20, None), (0, 0, 3): (30, 3.5)}
    store.write(slices(spark, [(0, 1, 2, 2.5), (3, 3, 1, 1.5)], "w double"), path, append=True)
    want = {(0, 0, 1): (10, None), (0, 1, 1): (11, None), (3, 3, 1): (None, 1.5), (0, 0, 2): (20, None), (0, 1, 2): (None, 2.5), (0, 0, 3): (30, 3.5)}
    assert rows_of(store.read(spark, path)) == want
    assert rows_of(store.read(spark, path, ["w"])) == {k: (w,) for k, (_, w) in want.items() if k in ((0, 1, 2), (3, 3, 1), (0, 0, 3))}
    assert rows_of(store.read(spark, path, as_of=1)) == {(0, 0, 1): (10,), (0, 1, 1): (11,), (0, 0, 2): (20,)}
    assert store.compacted(spark, path) == 2 and store.compacted(spark, path) == 0
    assert rows_of(store.read(spark, path)) == want
    store.write(slices(spark, [(1, 1, 9, 99)]), path)
    assert rows_of(store.read(spark, path)) == {(1, 1, 9): (99,)}


def test_static_layers_one_by_one(spark, tmp_path):
    path = str(tmp_path / "s")
    layer = lambda name, cells: Cube(spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], f"iy long, ix long, {name} int"), GRID)
    store.write(layer("a", {(0, 0): 1, (0, 1): 2}), path, (2, 2))
    store.write(layer("b", {(0, 1): 3, (2, 2): 4}), path, append=True)
    assert rows_of(store.read(spark, path)) == {(0, 0): (1, None), (0, 1): (2, 3), (2, 2): (None, 4)}
    store.write(layer("a", {(0, 0): 9}), path, append=True)
    assert rows_of(store.read(spark, path)) == {(0, 0): (9, None), (0, 1): (None, 3), (2, 2): (None, 4)}
    store.write(slices(spark, [(0, 0, 5, 7)]), path, append=True)
    got = store.read(spark, path)
    assert sorted((r["iy"], r["ix"], r["t"], r["v"], r["a"], r["b"]) for r in got.df.collect() if r["t"]) == [(0, 0, 5, 7, 9, None)] and got.df.count() == 3


def test_what_does_not_go_together(spark, tmp_path):
    path = str(tmp_path / "c")
    store.write(slices(spark, [(0, 0, 1, 10)]), path, (2, 2))
    for bad in (slices(spark, [(0, 0, 2, "x")], "v string"), Cube(slices(spark, [(0, 0, 2, 1)]).df.withColumnRenamed("t", "u"), GRID, "u"), Cube(slices(spark, [(0, 0, 2, 1)]).df.withColumn("t", F.col("t").cast("long")), GRID, "t")):
        with pytest.raises(ValueError):
            store.write(bad, path, append=True)
    with pytest.raises(ValueError):
        store.write(slices(spark, []), path, mode="merge")
    assert rows_of(store.read(spark, path)) == {(0, 0, 1): (10,)} and len(store.history(spark, path)) == 1


def test_a_failed_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "c")
    store.write(slices(spark, [(0, 0, 1, 10)]), path, (2, 2))
    bad = slices(spark, [(0, 0, 1, 11), (0, 1, 1, 12)])
    for name, append in (("replaced", True), ("anew", False)):
        broken = bad.having(bad.df.withColumn("v", F.when(F.col("v") == 12, F.raise_error(F.lit(name)).cast("int")).otherwise(F.col("v"))))
        with pytest.raises(Exception, match=name):
            store.write(broken, path, append=append)
        assert rows_of(store.read(spark, path)) == {(0, 0, 1): (10,)}
    (tmp_path / "c" / "data" / "commit=00000009-x" / "t=1").mkdir(parents=True)
    assert rows_of(store.read(spark, path)) == {(0, 0, 1): (10,)}


def test_batches_are_laid_over_slices(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df = slices(spark, []).df
    for part in ([(0, 0, 1, 1), (0, 1, 1, 2)], [(1, 0, 1, 3), (0, 1, 1, None)], [(0, 0, 1, 4), (0, 0, 2, 5)], []):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(source)
        assert ingest(spark, source, df.schema, GRID, "t", path, progress).awaitTermination(120) is not False
    want = {(0, 0, 1): (4,), (0, 1, 1): (2,), (1, 0, 1): (3,), (0, 0, 2): (5,)}
    assert rows_of(store.read(spark, path)) == want
    n = len(store.history(spark, path))
    last = store.history(spark, path)[-1]["note"]
    assert last["stream"] == progress
    # The batch that ended last is run again, as after a failure between its commit and the stream's own record of it.
    (tmp_path / "ck" / "commits" / str(last["batch"])).unlink()
    (tmp_path / "ck" / "commits" / f".{last['batch']}.crc").unlink(missing_ok=True)
    for later in (tmp_path / "ck" / "commits").glob("*"):
        if later.name.strip(".").split(".")[0].isdigit() and int(later.name.strip(".").split(".")[0]) > last["batch"]:
            later.unlink()
    ingest(spark, source, df.schema, GRID, "t", path, progress).awaitTermination(120)
    assert len(store.history(spark, path)) == n and rows_of(store.read(spark, path)) == want

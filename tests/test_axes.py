"""Arrays over axes: entry by entry as separate variables would be, and reductions in a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.operators import axes
from terracell.operators.coarsen import coarsen
from terracell.operators.reproject import reproject

GRID = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 6, 5)


def arrays(spark, values):
    rows = [(int(y), int(x), None if values[y][x] is None else [None if v is None or np.isnan(v) else float(v) for v in values[y][x]], y * 10 + x) for y in range(5) for x in range(6)]
    return Cube(spark.createDataFrame(rows, "iy long, ix long, v array<float>, plain int"), GRID, None, {"axes": {"v": {"names": ["m", "c"], "lengths": [2, 3]}}})


def data():
    values = np.random.default_rng(0).random((5, 6, 6)).astype("f4")
    values[0, 0, 2] = values[1, 1, :] = np.nan
    out = values.tolist()
    out[4][5] = None
    return out


@pytest.mark.parametrize("work", [lambda c: coarsen(c, 2, "mean"), lambda c: coarsen(c, 3, "max"), lambda c: reproject(c, GridSpec("EPSG:4326", 0.2, 0.1, 1.3, 1.7, 4, 3), "average"), lambda c: reproject(c, GridSpec("+proj=longlat +datum=WGS84", 0.5, 0.5, 2.0, 1.0, 3, 3), "nearest")])
def test_entries_are_like_variables(spark, work):
    cube = arrays(spark, data())
    got = {(r["iy"], r["ix"]): r for r in axes.by_entry(cube, work).df.collect()}
    for k in range(6):
        alone = work(Cube(cube.df.select("iy", "ix", F.col("v")[k].alias("v"), "plain"), GRID))
        for r in alone.df.collect():
            own = got[r["iy"], r["ix"]]["v"]
            assert (None if own is None else own[k]) == (None if r["v"] is None else pytest.approx(r["v"])) and got[r["iy"], r["ix"]]["plain"] == r["plain"]


def test_reductions_in_a_row(spark):
    values = data()
    e = F.col("v")
    df = arrays(spark, values).df.select("iy", "ix", axes.reduced(e, (2, 3), 0).alias("by_class"), axes.reduced(e, (2, 3), 1, axes.quantile(0.25)).alias("by_member"), axes.dominant(e).alias("best"), axes.reduced(e, (1, 6), 1, axes.quantile(0.6)).alias("all"))
    for r in df.collect():
        v = values[r["iy"]][r["ix"]]
        if v is None:
            assert r["by_class"] is None and r["by_member"] is None and r["best"] is None
            continue
        m = np.array(v, float).reshape(2, 3)
        for axis, got, f in ((0, r["by_class"], np.mean), (1, r["by_member"], lambda x: np.quantile(x, 0.25))):
            for k, x in enumerate(got):
                entries = [y for y in (m[:, k] if axis == 0 else m[k]) if not np.isnan(y)]
                assert (x is None) if not entries else x == pytest.approx(f(entries))
        assert r["best"] == (None if np.isnan(m).all() else int(np.nanargmax(m)))
        assert r["all"] == [None if np.isnan(m).all() else pytest.approx(np.nanquantile(m, 0.6))]


def test_methods_by_name():
    assert axes.methods_by_entry({"v": "max", "w": "min"}, {"v": 2}) == {"w": "min", "v__0": "max", "v__1": "max"} and axes.methods_by_entry("mean", {"v": 2}) == "mean"

"""Alerts as a store, and legends of codes."""

from datetime import datetime

from terracell.catalog import products
from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.plans import alerts
from terracell.plans.recipes import RECIPES
from terracell.sources import store

GRID = GridSpec("EPSG:3035", 0.0, 0.0, 1.0, 1.0, 4, 4)


def test_alerts_as_a_store(spark, tmp_path):
    cells = [(0, 0, 20032, 1.0), (0, 1, 20032, 0.0), (0, 2, 20032, float("nan")), (0, 3, 21366, 1.0), (1, 0, None, 1.0), (1, 1, 20060, 7.0), (1, 2, 20366, 1.0)]
    raw = Cube(spark.createDataFrame(cells, "iy long, ix long, alert int, forest_mask double"), GRID)
    alerts.ingest(raw, str(tmp_path / "a"), "2020-01-01", "2020-12-01", (2, 2))
    rows = store.read(spark, str(tmp_path / "a")).df.collect()
    assert len(rows) == 7 * 12
    hits = {(r["iy"], r["ix"], r["time"]) for r in rows if r["disturbance_occurrence"] == 1}
    assert hits == {(0, 0, datetime(2020, 2, 1)), (1, 2, datetime(2020, 12, 1))}
    assert {(r["iy"], r["ix"]) for r in rows if r["disturbance_occurrence"] == -9999} == {(0, 2), (1, 1)} == {(r["iy"], r["ix"]) for r in rows if r["forest_mask"] == -9999}
    assert {(r["iy"], r["ix"]): r["alert_yydoy"] for r in rows} == {(y, x): c for y, x, c, _ in cells}
    store.write(alerts.occurrence(raw, "2021-01-01", "2021-02-01"), str(tmp_path / "a"), append=True)
    assert store.read(spark, str(tmp_path / "a")).df.count() == 7 * 14


def test_legends():
    assert [len(products.LEGENDS[k]) for k in ("moist_forest_subtypes", "moist_forest_annual", "age_class", "moist_forest")] == [15, 6, 12, 9]
    named = {v.legend for r in RECIPES.values() for v in r.variables if v.legend}
    assert named <= set(products.LEGENDS) and "RADD_EUROPE" in RECIPES

"""Catalog invariants, discovery, recipes, stores, arrays, rasters and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.catalog import discovery, products, rules, tables
from terracell.cube import Cube
from terracell.functions import metadata
from terracell.grid import GridSpec
from terracell.plans.recipes import RECIPES, alert_layers, missing_variables
from terracell.sources import arrays, store, zarr
from terracell.streaming.slices import ingest

GRID = GridSpec("EPSG:4326", 0.0, 0.0, 1.0, 1.0, 8, 8)


@pytest.fixture(scope="module")
def catalog(spark):
    return tables.standard(spark)


def test_catalog_has_all_products(catalog):
    assert catalog.themes.count() == 5 and catalog.collections.count() == 17 and catalog.items.count() == 25
    assert tables.repeated(catalog.items, "item_id").count() == 0
    assert tables.orphans(catalog.assets, catalog.items, "item_id").count() == 0
    assert catalog.assets.groupBy("item_id").count().count() == 25


def test_discovery(catalog):
    assert [r["theme_id"] for r in discovery.themes(catalog).collect()] == sorted(products.THEMES)
    assert discovery.theme(catalog, "nowhere") is None
    assert [r["collection_id"] for r in discovery.collections(catalog, "biomass-carbon").collect()] == sorted(products.THEMES["biomass-carbon"][1])
    with pytest.raises(ValueError, match="als-lidar"):
        discovery.collections(catalog, "")
    with pytest.raises(KeyError, match="als-lidar"):
        discovery.collections(catalog, "nowhere")
    row = discovery.collections_table(catalog, "structure-demography").where("collection_id = 'GAMI'").first()
    assert row["versions"] == ["2.0", "2.1", "3.0", "3.1"] and row["n_versions"] == 4
    assert discovery.collection_ids(catalog).count() == 17
    with pytest.raises(KeyError, match="GAMI"):
        discovery.item(catalog, "GAMI", "GAMI_v9")
    assert discovery.item(catalog, "GAMI", "GAMI_v2.1")["version"] == "2.1"


def test_versions_sort_as_numbers(spark, catalog):
    rows = [(f"X_v{v}", "X", None, None) for v in ("2.0", "2.1", "10.0", "2.1.1", "0.0.1", "beta")]
    items = spark.createDataFrame(rows, "item_id string, collection_id string, version string, region string")
    own = tables.Catalog(catalog.themes, catalog.collections, items, catalog.assets, catalog.bands)
    assert [r[0] for r in discovery.versions(own, "X").collect()] == ["0.0.1", "2.0", "2.1", "2.1.1", "10.0", "beta"]
    assert discovery.versions(own, "X", "zarr").count() == 0


def test_broken_references(spark, catalog):
    lost = catalog.collections.withColumn("theme_id", F.lit("nowhere"))
    with pytest.raises(KeyError, match="nowhere"):
        tables.intact(tables.Catalog(catalog.themes, lost, catalog.items, catalog.assets, catalog.bands))
    with pytest.raises(ValueError, match="more than one theme"):
        tables.intact(tables.Catalog(catalog.themes, catalog.collections.unionByName(catalog.collections), catalog.items, catalog.assets, catalog.bands))
    with pytest.raises(ValueError, match="no theme"):
        tables.standard(spark, versions={**products.VERSIONS, "OTHER": ["1"]})


def test_keys_of_one_table_only_in_tasks_of_bounded_rows(spark, monkeypatch):
    a, b = [1, 1, 2, None, *range(100, 400)], [2, 3, None, None, 3, *range(200, 500)]
    left, right = (spark.createDataFrame([(k,) for k in keys], "k long") for keys in (a, b))
    want = sorted([(1, "left"), (3, "right"), *[(k, "left") for k in range(100, 200)], *[(k, "right") for k in range(400, 500)]])
    for rows, tasks in ((1 << 19, 1), (50, 13)):
        monkeypatch.setattr(tables, "DIFFERING_ROWS", rows)
        got = tables.differing(left, right, "k")
        found = [tuple(r) for r in got.collect()]
        assert sorted(r for r in found if r[0] is not None) == want
        assert sorted(r[1] for r in found if r[0] is None) == ["left", "right"]
        assert got.rdd.getNumPartitions() == tasks


def test_tree_of_files(spark, catalog, tmp_path):
    n = tables.written(tables.documents(catalog, f"file://{tmp_path}"))
    assert n == 1 + 5 + 17 + 25
    assert {r["media_type"] for r in catalog.assets.collect()} == {"application/vnd.zarr"}
    root = json.loads((tmp_path / "catalog.json").read_text())
    assert len(root["links"]) == 5
    item = json.loads(next(tmp_path.glob("als-lidar/ALS_PRODUCTS/ALS_SPAIN_PNOA_v1.0/item.json")).read_text())
    assert set(item["assets"]) == {"zarr_1m", "zarr_10m", "zarr_100m"}
    kinds = {r["type"]: r["count"] for r in tables.read_documents(spark, str(tmp_path)).groupBy("type").count().collect()}
    assert kinds == {"Catalog": 6, "Collection": 17, "Feature": 25}


def test_rules(spark):
    good = ("a", "t", "d", None, [0.0, 0.0, 1.0, 1.0], None, None, ["k"], [("cite-as", "h", None, None)], ["v"], ["v", "w"])
    bad = ("b", "t", "d", "not a licence!", [1.0, 0.0, 0.0], None, None, [], None, ["v", "x"], ["v"])
    rows = rules.checked(spark.createDataFrame([good, bad], rules.CONFIG)).orderBy("id").collect()
    assert rows[0]["broken"] == [] and rows[1]["broken"] == ["bbox", "license", "keywords", "citation", "bands"]
    with pytest.raises(ValueError, match="b: bbox"):
        rules.validated(spark.createDataFrame([good, bad], rules.CONFIG))


def test_recipes(spark):
    raw = Cube(spark.createDataFrame([(0, 0, 0.0), (0, 1, float("nan")), (0, 2, 123.7)], "iy long, ix long, agb double"), GRID)
    done = RECIPES["SAATCHI_BIOMASS"].apply(raw)
    assert [r["aboveground_biomass"] for r in done.df.orderBy("ix").collect()] == [-9999, -9999, 123]
    assert done.attributes == {"time": "2020-01-01"}
    assert [r["aboveground_biomass"] for r in RECIPES["SAATCHI_BIOMASS"].readable(done).df.orderBy("ix").collect()] == [None, None, pytest.approx(12.3)]
    heights = Cube(spark.createDataFrame([(0, 0, 0.0), (0, 1, -2.0), (0, 2, 7.5)], "iy long, ix long, canopy_height double"), GRID)
    assert [r["canopy_height"] for r in RECIPES["POTAPOV_HEIGHT"].apply(heights).df.orderBy("ix").collect()] == [-9999.0, -9999.0, 7.5]
    with pytest.raises(ValueError, match="agb"):
        RECIPES["SAATCHI_BIOMASS"].apply(heights)
    assert missing_variables("GAMI", heights) == ["forest_age"]
    losses = Cube(spark.createDataFrame([(0, 0, 5, 1, 1, 90), (0, 1, 0, 0, 1, 3)], "iy long, ix long, lossyear int, gain int, datamask int, treecover2000 int"), GRID)
    assert [r["loss_year"] for r in RECIPES["HANSEN_GFC"].apply(losses).df.orderBy("ix").collect()] == [2005, 0]


def test_mask_and_alerts(spark):
    raw = Cube(spark.createDataFrame([(0, 0, 1, 3), (0, 1, 1, 2)], "iy long, ix long, disturbance_occurrence int, disturbance_agent int"), GRID)
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "iy long, ix long, forest_mask int")
    got = RECIPES["EFDA"].apply(raw, mask)
    assert [(r["disturbance_occurrence"], r["disturbance_agent"]) for r in got.df.orderBy("ix").collect()] == [(1, 3), (-9999, -9999)]
    assert [r["meaning"] for r in RECIPES["EFDA"].decoded(got, "disturbance_agent").orderBy("ix").collect()] == ["harvest", None]
    layers = alert_layers(spark.createDataFrame([(0, 20032, 1), (1, 20032, 7), (2, 0, 0)], "ix long, alert int, forest_mask int")).orderBy("ix").collect()
    assert [(r["forest_mask"], r["month_index"]) for r in layers] == [(1, 601), (-9999, -9999), (0, -1)]


def test_store_and_slices(spark, tmp_path, catalog):
    path = str(tmp_path / "cube")
    rows = spark.createDataFrame([(y, x, t, y * 10 + x + t) for t in (1, 2) for y in range(4) for x in range(4)], "iy long, ix long, t int, v int")
    cube = Cube(rows, GRID, "t", {"crs": "x"})
    store.write(cube, path, (2, 2))
    again = cube.having(rows.where("t = 2").withColumn("v", F.lit(0)))
    store.write(again, path, (2, 2), append=True)
    back = store.read(spark, path)
    assert back.grid == GRID and back.df.count() == 32 and back.df.where("t = 2").agg(F.sum("v")).first()[0] == 0
    assert store.read(spark, path, ["v"]).variables == ["v"]
    with pytest.raises(ValueError, match="no variable"):
        store.read(spark, path, ["w"])
    own = tables.Catalog(catalog.themes, catalog.collections, catalog.items, catalog.assets.withColumn("href", F.lit(path)), catalog.bands)
    assert store.open_item(spark, own, "GAMI", "3.0").df.count() == 32
    assert store.open_item(spark, own, "ALS_PRODUCTS", "1.0", resolution="10m", region="spain_pnoa").df.count() == 32
    for bad, text in ((("GAMI", "9"), "3.1"), (("GAMI", "3.0", "7m"), "zarr"), (("ALS_PRODUCTS", "1.0", "1m"), "regions")):
        with pytest.raises(ValueError, match=text):
            store.open_item(spark, own, *bad)


def test_static_and_time_layers(spark, tmp_path):
    static = Cube(spark.createDataFrame([(y, x, y + x) for y in range(4) for x in range(4)], "iy long, ix long, s int"), GRID, None, {"a": 1})
    slices = Cube(spark.createDataFrame([(y, x, t, t) for t in (1, 2) for y in range(2) for x in range(4)], "iy long, ix long, t int, v int"), GRID, "t", {"b": 2})
    for name, (first, then) in {"x": (static, slices), "y": (slices, static)}.items():
        path = str(tmp_path / name)
        store.write(first, path, (2, 2))
        store.write(then, path, (2, 2), append=True)
        store.write(then, path, (2, 2), append=True)
        back = store.read(spark, path)
        rows = sorted((r["iy"], r["ix"], r["t"] or 0, r["v"], r["s"]) for r in back.df.collect())
        assert back.time == "t" and back.attributes == {"a": 1, "b": 2} and len(rows) == 16 + 8
        assert rows == sorted([(y, x, t, t, y + x) for t in (1, 2) for y in range(2) for x in range(4)] + [(y, x, 0, None, y + x) for y in (2, 3) for x in range(4)])
        assert store.read(spark, path, ["s"]).time is None and store.read(spark, path, ["s"]).df.count() == 16 and store.read(spark, path, ["v"]).df.count() == 16
        store.write(static, path, (2, 2))
        assert store.read(spark, path).variables == ["s"]
    with pytest.raises(ValueError, match="another grid"):
        store.write(Cube(static.df, GridSpec("EPSG:4326", 0.0, 0.0, 2.0, 2.0, 4, 4)), path, append=True)
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "nowhere"))


def test_stream_of_slices(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame([(0, 0, 2001, 5), (0, 1, 2001, 6)], "iy long, ix long, yr int, v int")
    df.coalesce(1).write.parquet(str(source))
    for _ in range(2):
        q = ingest(spark, str(source), df.schema, GRID, "yr", str(target), str(tmp_path / "ck"))
        q.awaitTermination(60)
        df.withColumn("yr", F.lit(2002)).coalesce(1).write.mode("append").parquet(str(source))
    rows = spark.read.parquet(f"{target}/data")
    assert rows.count() == 4 and {r["yr"] for r in rows.select("yr").distinct().collect()} == {2001, 2002}


def test_zarr(spark, tmp_path):
    data = np.arange(20, dtype="<i2").reshape(4, 5)
    data[0, 0] = -1
    (tmp_path / "v").mkdir()
    (tmp_path / "v/.zarray").write_text(json.dumps({"shape": [4, 5], "chunks": [3, 3], "dtype": "<i2", "compressor": {"id": "zlib"}, "fill_value": -1, "order": "C", "filters": None, "zarr_format": 2}))
    for a in range(2):
        for b in range(2):
            block = np.full((3, 3), -1, "<i2")
            part = data[3 * a : 3 * a + 3, 3 * b : 3 * b + 3]
            block[: part.shape[0], : part.shape[1]] = part
            (tmp_path / f"v/{a}.{b}").write_bytes(zlib.compress(block.tobytes()))
    got = {(r["d0"], r["d1"]): r["value"] for r in zarr.variable(spark, str(tmp_path), "v").collect()}
    assert got == {(y, x): float(data[y, x]) for y in range(4) for x in range(5) if (y, x) != (0, 0)}
    with pytest.raises(ValueError, match="lzma"):
        arrays.inflated(b"", {"id": "lzma"})


def tiff(values: np.ndarray, rows: int, nodata: bytes) -> bytes:
    """A little-endian TIFF in deflated strips."""
    strips = [zlib.compress(values[k : k + rows].tobytes()) for k in range(0, len(values), rows)]
    tags = {256: (4, [values.shape[1]]), 257: (4, [values.shape[0]]), 258: (3, [values.dtype.itemsize * 8]), 259: (3, [8]), 277: (3, [1]), 278: (4, [rows]), 339: (3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]])}
    at = 8 + 2 + 12 * (len(tags) + 3) + 4
    offsets, data = [], nodata
    where = at + len(nodata)
    for s in strips:
        offsets.append(where)
        where += len(s)
    data += b"".join(strips)
    tags[273], tags[279] = (4, offsets), (4, [len(s) for s in strips])
    extra, head = b"", struct.pack("<2sHIH", b"II", 42, 8, len(tags) + 1)
    for tag in sorted([*tags, 42113]):
        if tag == 42113:
            head += struct.pack("<HHII", tag, 2, len(nodata), at)
            continue
        kind, v = tags[tag]
        if len(v) == 1:
            head += struct.pack("<HHII", tag, kind, 1, v[0])
        else:
            head += struct.pack("<HHII", tag, kind, len(v), where + len(extra))
            extra += struct.pack(f"<{len(v)}I", *v)
    head += struct.pack("<I", 0)
    return head.ljust(at, b"\0") + data + extra


def test_rasters_and_names(spark, tmp_path):
    values = np.array([[1, 2, 3], [4, -9, 6], [7, 8, 9]], "<i2")
    (tmp_path / "AGB_2015.tif").write_bytes(tiff(values, 2, b"-9\0\0\0\0"))
    got = {(r["iy"], r["ix"]): r["value"] for r in arrays.rasters(spark, str(tmp_path)).collect()}
    assert got == {(y, x): float(values[y, x]) for y in range(3) for x in range(3) if (y, x) != (1, 1)}
    assert arrays.rasters(spark, str(tmp_path), masked=False).count() == 9
    assert [r["year"] for r in store.files_of(spark, str(tmp_path), r"AGB_(\d+)\.tif").collect()] == [2015]
    with pytest.raises(FileNotFoundError):
        store.files_of(spark, str(tmp_path), r"STD_(\d+)\.tif")
    parts = {n: spark.createDataFrame(r, "iy long, ix long, value double") for n, r in {"a": [(0, 0, 1.0)], "b": [(0, 0, 2.0), (0, 1, 3.0)]}.items()}
    assert sorted((r["ix"], r["a"], r["b"]) for r in store.layers(parts).collect() if r["a"]) == [(0, 1.0, 2.0)]


def test_collections_and_items_of_configurations(spark):
    row = ("a", "Title", "d", None, [0.0, 0.0, 1.0, 1.0], None, None, None, [("cite-as", "h", None, None), ("child", "i", None, None)], ["v"], ["v"])
    configs = spark.createDataFrame([row], rules.CONFIG).withColumn("theme_id", F.lit("t"))
    c = tables.collections_of(configs).first()
    assert c["license"] == "CC-BY-4.0" and c["keywords"] == [] and c["collection_id"] == "a"
    items = tables.items_of(tables.collections_of(configs), spark.createDataFrame([("a", "1.0")], "collection_id string, version string"))
    i = tables.described(items, configs).first()
    assert i["item_id"] == "a_v1.0" and i["product_name"] == "Title" and [x["rel"] for x in i["links"]] == ["cite-as"]


def test_metadata():
    assert metadata.axes(["time", "y", "x"]) == ("x", "y") and metadata.axes(["lat", "longitude", "x"]) == ("longitude", "lat")
    with pytest.raises(ValueError):
        metadata.axes(["a"])
    assert metadata.crs_of({"crs": {"spatial_ref": "B"}}, {"crs": "C"}) == "B" and metadata.crs_of({}, {"crs": "C"}, "A") == "A"
    with pytest.raises(ValueError):
        metadata.crs_of({}, {})
    assert metadata.kept({"a": None, "_FillValue": 3, "b": 1}) == {"b": 1}


def test_all_resolutions(spark, tmp_path):
    cubes = {r: Cube(spark.createDataFrame([(0, 0, 1.0)], "iy long, ix long, v double"), GRID) for r in ("10m", "100m")}
    paths = store.write_all(cubes, str(tmp_path / "region"))
    assert all(store.read(spark, p).df.count() == 1 for p in paths.values())
    assert tables.rebased(spark.createDataFrame([("s3://a/b",)], "href string"), "href", "s3://a", "https://c").first()[0] == "https://c/b"

"""Trees of documents and their bodies: any depth, two bases, missing fields, nodes that nothing leads to."""

import json

import pytest
from pyspark.sql import functions as F

from terracell.catalog import bodies, tables, tree


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, parent string, kind string")


DEEP = [("root", None, "catalog"), ("a", "root", "catalog"), ("b", "a", "catalog"), ("c", "b", "collection"), ("i", "c", "item"), ("j", "c", "item"), ("d", "root", "collection")]


def test_paths_and_links(spark):
    got = {r["id"]: r for r in tree.paths(nodes(spark, DEEP)).collect()}
    assert {k: (r["depth"], r["path"]) for k, r in got.items()} == {
        "root": (0, "catalog.json"), "a": (1, "a/catalog.json"), "b": (2, "a/b/catalog.json"), "c": (3, "a/b/c/collection.json"), "i": (4, "a/b/c/i/item.json"), "j": (4, "a/b/c/j/item.json"), "d": (1, "d/collection.json"),
    }
    links = {(r["id"], r["rel"], r["href"]) for r in tree.links(tree.paths(nodes(spark, DEEP)), "https://x/").collect()}
    assert {x[1:] for x in links if x[0] == "c"} == {("self", "https://x/a/b/c/collection.json"), ("root", "https://x/catalog.json"), ("parent", "https://x/a/b/catalog.json"), ("item", "https://x/a/b/c/i/item.json"), ("item", "https://x/a/b/c/j/item.json")}
    assert {x[1:] for x in links if x[0] == "root"} == {("self", "https://x/catalog.json"), ("root", "https://x/catalog.json"), ("child", "https://x/a/catalog.json"), ("child", "https://x/d/collection.json")}


def test_nodes_that_nothing_leads_to(spark):
    odd = [*DEEP, ("lost", "nobody", "item"), ("x", "y", "catalog"), ("y", "x", "catalog")]
    assert {r["id"] for r in tree.unreached(nodes(spark, odd)).collect()} == {"lost", "x", "y"}
    assert tree.unreached(nodes(spark, DEEP)).count() == 0 and tree.paths(nodes(spark, [])).count() == 0


def configs(spark):
    full = ("P", "Product", "About it", [1.0, 2.0, 3.0, 4.0], ["v", "w"], {"v": "m"}, {"v": ("int16", "-1")}, [("cite-as", "https://doi.org/1", None, "Paper"), ("via", "https://s", None, None)], {"zarr": ("Cube", "All of it", "application/vnd.zarr", ["data", "cube"])}, "2001-01-01", "2002-02-02", 30.0, 3035)
    bare = ("Q", "Q", "q", None, None, None, None, None, None, None, None, None, None)
    schema = "id string, title string, description string, bbox array<double>, variables array<string>, units map<string,string>, raster_bands map<string,struct<data_type:string,nodata:string>>, links array<struct<rel:string,href:string,type:string,title:string>>, item_assets map<string,struct<title:string,description:string,type:string,roles:array<string>>>, start_datetime string, end_datetime string, gsd double, epsg int"
    return spark.createDataFrame([full, bare], schema)


def test_bodies_and_their_files(spark, tmp_path):
    cfg = configs(spark)
    items = tables.items_of(cfg.select(F.col("id").alias("collection_id")), spark.createDataFrame([("P", "1.0"), ("Q", "2")], "collection_id string, version string"))
    assets = tables.assets_of(items.where("collection_id = 'P'"), spark.createDataFrame([("P", "10m")], "collection_id string, resolution string"), "https://d")
    tops = spark.createDataFrame([("root", "All", None), ("t", "Theme", "A theme")], "id string, title string, description string")
    rows = [("root", None, "catalog"), ("t", "root", "catalog"), ("P", "t", "collection"), ("Q", "t", "collection"), ("P_v1.0", "P", "item"), ("Q_v2", "Q", "item")]
    made = [bodies.catalog_bodies(tops, {"license": F.lit("MIT")}), bodies.collection_bodies(cfg), bodies.item_bodies(items, cfg, assets).select(F.col("item_id").alias("id"), "body")]
    docs = tree.documents(nodes(spark, rows), made, str(tmp_path), "https://pub")
    assert tables.written(docs) == 6
    read = lambda p: json.loads((tmp_path / p).read_text())
    p, item, q, bare = read("t/P/collection.json"), read("t/P/P_v1.0/item.json"), read("t/Q/collection.json"), read("t/Q/Q_v2/item.json")
    assert p["extent"] == {"spatial": {"bbox": [[1.0, 2.0, 3.0, 4.0]]}, "temporal": {"interval": [["2001-01-01T00:00:00Z", "2002-02-02T00:00:00Z"]]}} and p["license"] == "CC-BY-4.0" and p["summaries"]["units_by_variable"] == {"v": "m"}
    assert p["links"][-2:] == [{"rel": "cite-as", "href": "https://doi.org/1", "title": "Paper"}, {"rel": "via", "href": "https://s"}] and {"rel": "parent", "href": "https://pub/t/catalog.json"} in p["links"]
    assert item["properties"] == {"product_name": "Product", "version": "1.0", "datetime": "2002-02-02T00:00:00Z", "start_datetime": "2001-01-01T00:00:00Z", "end_datetime": "2002-02-02T00:00:00Z", "eo:gsd": 30.0, "proj:epsg": 3035, "variables": ["v", "w"], "units": {"v": "m"}}
    assert item["geometry"]["coordinates"] == [[[1.0, 2.0], [1.0, 4.0], [3.0, 4.0], [3.0, 2.0], [1.0, 2.0]]] and item["collection"] == "P"
    assert item["assets"]["zarr_10m"] == {"href": "https://d/P/P_v1.0_10m.zarr", "type": "application/vnd.zarr", "title": "Cube", "description": "All of it", "roles": ["data", "cube"], "raster:bands": [{"name": "v", "unit": "m", "data_type": "int16", "nodata": "-1"}, {"name": "w"}]}
    assert [x["rel"] for x in item["links"]] == ["parent", "root", "self", "cite-as"]
    assert "bbox" not in bare and bare["assets"] == {} and bare["properties"] == {"product_name": "Q", "version": "2"} and q["keywords"] == [] and q["providers"] == []
    assert read("catalog.json")["license"] == "MIT" and read("t/catalog.json")["description"] == "A theme" and read("catalog.json")["description"] == "All"


def test_configurations_must_have_a_title(spark):
    with pytest.raises(Exception):  # noqa: B017
        bodies.collection_bodies(spark.createDataFrame([("a", "x")], "id string, bbox string")).collect()

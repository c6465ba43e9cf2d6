"""Configurations of products: rules, regions, and full documents of the standard catalog."""

import json

import pytest
from pyspark.sql import functions as F

from terracell.catalog import configurations as C
from terracell.catalog import products, tables


@pytest.fixture(scope="module")
def configs(spark):
    return C.configurations(spark)


@pytest.fixture(scope="module")
def documents(spark, configs):
    rows = C.published(tables.standard(spark, "s3://data"), configs, "s3://w", "https://p").collect()
    assert len(rows) == len({r["path"] for r in rows}) == 1 + 5 + 17 + 25
    return {r["path"]: json.loads(r["body"]) for r in rows}


def test_all_products_keep_the_rules(spark, configs):
    assert {r["id"] for r in configs.select("id").collect()} >= set(products.VERSIONS) and configs.count() == 19
    assert [(r["id"], r["broken"]) for r in C.broken(configs).collect()] == [("ALS_PRODUCTS", ["citation"])]
    assert C.broken(C.configurations(spark, {"ALS_PRODUCTS": "https://doi.org/x"})).count() == 0
    with pytest.raises(KeyError, match="GAMI_AGECLASS"):
        C.configurations(spark, {"NOTHING": "x"})


def test_variables_of_several_resolutions(configs):
    names = {r["id"]: r["variables"] for r in configs.select("id", "variables").collect()}
    assert names["ALS_PRODUCTS"] == products.ALS_SURFACES + products.ALS_STRUCTURE and names["ULS_PRODUCTS"] == products.ULS_BANDS


def test_bands(configs):
    bands = {(r["id"], r["name"]): r for r in tables.bands_of(configs).collect()}
    assert bands["LIU_BIOMASS", "canopy_cover"]["data_type"] == "uint8" and bands["LIU_BIOMASS", "canopy_height"]["data_type"] == "float32"
    assert bands["ULS_PRODUCTS", "n_segments"]["data_type"] == "int32" and bands["ULS_PRODUCTS", "ba_rrmse"]["unit"] == "percent"
    assert bands["ALS_PRODUCTS", "pv_0_2"]["unit"] is None and bands["CCI_BIOMASS", "aboveground_biomass"]["nodata"] == "-9999"


def test_documents_of_collections(documents):
    cci = documents["s3://w/biomass-carbon/CCI_BIOMASS/collection.json"]
    assert cci["extent"]["temporal"]["interval"] == [["2005-01-01T00:00:00Z", "2024-12-31T00:00:00Z"]] and cci["license"] == "Open-access"
    assert {x["rel"] for x in cci["links"]} == {"self", "root", "parent", "item", "cite-as"} and cci["summaries"]["variables"] == ["aboveground_biomass", "aboveground_biomass_std"]
    assert documents["s3://w/catalog.json"]["id"] == "root"


def test_documents_of_versions_and_regions(documents):
    at = "s3://w/biomass-carbon/CCI_BIOMASS/CCI_BIOMASS_v6.0/item.json"
    assert documents[at]["properties"]["start_datetime"] == "2007-01-01T00:00:00Z" and documents[at]["properties"]["datetime"] == "2022-12-31T00:00:00Z"
    brazil = documents["s3://w/als-lidar/ALS_PRODUCTS/ALS_BRAZIL_EBA_v1.0/item.json"]
    assert brazil["bbox"] == [-73.0, -15.0, -44.0, 5.0] and brazil["properties"]["proj:epsg"] == 31983 and brazil["properties"]["start_datetime"] == "2016-01-01T00:00:00Z"
    assert {k: len(a["raster:bands"]) for k, a in brazil["assets"].items()} == {"zarr_1m": 3, "zarr_10m": 19, "zarr_100m": 19}
    assert brazil["assets"]["zarr_1m"]["href"] == "s3://data/ALS_PRODUCTS/ALS_BRAZIL_EBA_1m_v1.0.zarr"
    ages = documents["s3://w/structure-demography/GAMI_AGECLASS/GAMI_AGECLASS_v3.1/item.json"]["assets"]
    assert set(ages) == {"zarr_1deg", "zarr_0.5deg", "zarr_0.25deg", "zarr_0.1deg", "zarr_0.0833deg"}


def test_unknown_collections_have_no_document(spark, configs):
    catalog = tables.standard(spark)
    some = C.published(catalog, configs.where(F.col("id") != "GAMI"), "s3://w")
    assert some.where(F.col("path").contains("/GAMI/")).count() == 0


def test_standard_catalog(spark, configs):
    catalog = C.standard(spark, "s3://data", configs)
    row = catalog.collections.where("collection_id = 'ULS_PRODUCTS'").first()
    assert row["theme_id"] == "als-lidar" and row["license"] == "EUPL-1.2" and row["title"].startswith("ULS Products") and row["bbox"] == [-10.0, 35.0, 32.0, 70.0]
    assert catalog.collections.count() == 17 and "Potapov_LCLUC" not in {r[0] for r in catalog.collections.select("collection_id").collect()}
    n = {(r["item_id"], r["asset_key"]): r["count"] for r in catalog.bands.groupBy("item_id", "asset_key").count().collect()}
    assert n["ALS_SPAIN_PNOA_v1.0", "zarr_1m"] == 3 and n["ALS_SPAIN_PNOA_v1.0", "zarr_10m"] == 19 and n["ULS_HAINICH_v1.0", "zarr_20m"] == 28 and n["JRC_TMF_v2024", "zarr"] == 6
    assert len(n) == catalog.assets.count() == 45
    lulc = catalog.bands.where("name = 'lulc'").first()
    assert (lulc["unit"], lulc["data_type"], lulc["nodata"]) == (None, "uint8", "255")
    with pytest.raises(KeyError, match="GAMI"):
        C.standard(spark, configs=configs.where(F.col("id") != "GAMI"))

"""Configurations of the registered products: extent, period, variables with units, types and missing values, as rows.

What stands in the tables below are fixed values that data and users count on. Descriptions and keywords are this
library's own words. Products that have no DOI have no citation; rules.checked() names them, and completed
configurations take one from `citations`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.catalog import bodies, products, rules, tables, tree
from terracell.catalog.tables import Catalog

WORLD = (-180.0, -90.0, 180.0, 90.0)
EUROPE = (-25.0, 34.0, 45.0, 72.0)
MEDIA = "application/vnd.zarr"


@dataclass(frozen=True)
class Product:
    """units: a unit (or None) for each variable, in order; bands: (type, missing value) of all variables, others: of those that differ."""

    title: str
    description: str
    bbox: tuple[float, float, float, float]
    first: str
    last: str
    license: str
    every: str
    gsd: float | None
    epsg: int | None
    doi: str | None
    keywords: tuple[str, ...]
    units: Mapping[str, str | None]
    bands: tuple[str, str]
    others: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    producers: tuple[tuple[str, str], ...] = ()


def _all(names: list[str], unit: str | None) -> dict[str, str | None]:
    return {n: unit for n in names}


# Titles, extents, periods, licences, sampling, CRSs, citations, variables, units, types and missing values.
PRODUCTS = {
    "CCI_BIOMASS": Product(
        "ESA CCI Biomass – Global annual aboveground biomass (100 m)", "Aboveground biomass of the world, by year, with its standard deviation.", WORLD, "2005-01-01", "2024-12-31", "Open-access", "annual", 100.0, 4326,
        "https://doi.org/10.5285/6429d1aafe1e43b9b414e4a5a7f8b903", ("biomass", "carbon", "global"), _all(["aboveground_biomass", "aboveground_biomass_std"], "Mg ha-1"), ("int32", "-9999"),
        producers=(("ESA Climate Change Initiative (CCI)", "https://climate.esa.int"),),
    ),
    "SAATCHI_BIOMASS": Product(
        "Saatchi & Yu - 2020 Global aboveground biomass (100 m)", "Aboveground biomass of the world in 2020.", WORLD, "2020-01-01", "2020-12-31", "CC-BY-4.0", "static", 100.0, 4326,
        "https://doi.org/10.5281/zenodo.15858551", ("biomass", "carbon", "global"), {"aboveground_biomass": "Mg ha-1"}, ("int32", "-9999"),
        producers=(("Jet Propulsion Laboratory (Caltech) – Saatchi et al.", "https://www.jpl.nasa.gov/"),),
    ),
    "LIU_BIOMASS": Product(
        "Liu et al. – Europe aboveground biomass, canopy cover, and canopy height (30 m)", "Biomass, cover and height of Europe's trees in 2019, those outside of forests too.", EUROPE, "2019-01-01", "2019-12-31", "proprietary", "static", 30.0, 3035,
        "https://doi.org/10.5281/zenodo.8154445", ("biomass", "canopy", "Europe"), {"canopy_cover": "percent", "canopy_height": "m", "aboveground_biomass": "Mg ha-1"}, ("float32", "0"), {"canopy_cover": ("uint8", "0")},
        producers=(("University of Copenhagen (dataset authors: Liu et al.)", "https://zenodo.org/records/8154445"),),
    ),
    "ROBINSON_CR": Product(
        "Robinson et al. – Chapman-Richards growth-curve parameters for secondary-forest aboveground carbon dynamics (1 km)", "Parameters of growth curves of regrowing forests' carbon, with their errors.", WORLD, "2025-01-01", "2025-12-31", "CC-BY-4.0", "static", 1000.0, 4326,
        "https://doi.org/10.5281/zenodo.15090826", ("regrowth", "carbon", "growth curve"),
        {"cr_a": "Mg C ha-1", "cr_b": "adimensional", "cr_k": "adimensional", "cr_a_error": "Mg C ha-1", "cr_b_error": "adimensional", "cr_k_error": "adimensional", "max_rate": "Mg C ha-1 yr-1", "age_at_max_rate": "years", "max_removal_potential_benefit_25": "%"},
        ("float32", "-9999.0"), producers=(("CIFOR-ICRAF (World Agroforestry Centre)", "https://www.cifor-icraf.org"), ("The Nature Conservancy (TNC)", "https://www.nature.org")),
    ),
    "EFDA": Product(
        "European Forest Disturbance Atlas (EFDA) - Annual disturbance maps for Europe (30 m)", "Where and by what Europe's forests were disturbed, by year.", EUROPE, "1985-01-01", "2023-12-31", "CC-BY-4.0", "annual", 30.0, 3035,
        "https://doi.org/10.5194/essd-17-2373-2025", ("disturbance", "Europe"), {"disturbance_agent": "categorical", "disturbance_occurrence": "binary"}, ("int16", "-9999"),
        producers=(("Technical University of Munich (TUM) - Earth Observation for Ecosystem Management", "https://www.lss.ls.tum.de/en/eoem/"),),
    ),
    "JRC_TMF": Product(
        "JRC Tropical Moist Forests (TMF) - Forest change (degradation, deforestation, regrowth) (30 m)", "Change of tropical moist forests: transitions, years of degradation and deforestation, and classes by year.", (-180.0, -30.0, 180.0, 30.0), "1990-01-01", "2024-12-31", "various", "annual", 30.0, 4326,
        "https://doi.org/10.1126/sciadv.abe1603", ("tropical forest", "deforestation", "degradation"),
        {"AnnualChange": "categorical", "DeforestationYear": "year", "DegradationYear": "year", "TransitionMap_MainClasses": "categorical", "TransitionMap_Subtypes": "categorical", "UndisturbedDegradedForest": "binary"},
        ("int16", "-9999"), {"TransitionMap_MainClasses": ("uint8", "0"), "TransitionMap_Subtypes": ("uint8", "0"), "UndisturbedDegradedForest": ("uint8", "0")},
        (("European Commission – Joint Research Centre (JRC)", "https://forobs.jrc.ec.europa.eu/TMF"),),
    ),
    "HANSEN_GFC": Product(
        "Hansen Global Forest Change (GFC) – Tree cover and annual loss/gain (30 m)", "Tree cover of 2000, and its loss by year and gain since.", WORLD, "2000-01-01", "2024-12-31", "various", "annual", 30.0, 4326,
        "https://doi.org/10.1126/science.1244693", ("tree cover", "forest loss", "global"), {"treecover2000": "percent", "loss": "binary", "lossyear": "year", "gain": "binary", "datamask": "binary"}, ("uint8", "0"),
        producers=(("University of Maryland (GLAD), Department of Geographical Sciences", "https://glad.umd.edu"),),
    ),
    "JRC_GFC2020": Product(
        "JRC Global Forest Cover 2020 (GFC2020) – Forest presence/absence (10 m)", "Where there was forest in 2020.", WORLD, "2020-01-01", "2020-12-31", "various", "static", 10.0, 4326,
        "https://doi.org/10.2760/262532", ("forest cover", "global"), {"forest": "binary"}, ("uint8", "255"), producers=(("European Commission – Joint Research Centre (JRC)", "https://forobs.jrc.ec.europa.eu/GFC"),),
    ),
    "RADD_EUROPE": Product(
        "RADD Europe - Monthly forest disturbance occurrence (Sentinel-1, 10 m)", "Radar alerts of forest disturbance in Europe, by month.", EUROPE, "2020-01-01", "2025-12-31", "proprietary", "monthly", 10.0, 3035,
        "https://doi.org/10.1088/1748-9326/ad2d82", ("disturbance", "radar", "Europe"), {"disturbance_occurrence": "binary", "alert_yydoy": "YYddd", "forest_mask": "binary"}, ("int32", "-1"),
        producers=(("Wageningen University & Research (WUR)", "https://www.wur.nl"),),
    ),
    "GAMI": Product(
        "Global Age Mapping Integration (GAMI) – Global forest age ensemble (100 m)", "Age of the world's forests, as an ensemble of 20 members.", WORLD, "2010-01-01", "2020-12-31", "various", "multi-epoch", 100.0, 4326,
        "https://doi.org/10.5880/GFZ.1.4.2023.006", ("forest age", "ensemble", "global"), {"forest_age": "years"}, ("int16", "-9999"),
    ),
    "GAMI_AGECLASS": Product(
        "GAMI - Global Forest Age-Class Fractions (multi-resolution)", "Share of each of 12 classes of forest age, as an ensemble of 20 members, in several resolutions.", WORLD, "2010-01-01", "2020-12-31", "CC-BY-4.0", "multi-epoch", None, 4326,
        "https://doi.org/10.5880/GFZ.1.4.2023.006", ("forest age", "age class", "global"), {"forest_age": "fraction"}, ("float32", "-9999.0"),
    ),
    "POTAPOV_HEIGHT": Product(
        "Global Canopy Height (Potapov et al.) (30 m)", "Canopy height of the world, every five years.", WORLD, "2000-01-01", "2020-12-31", "various", "multi-epoch", 30.0, 4326,
        "https://doi.org/10.1016/j.rse.2020.112165", ("canopy height", "global"), {"canopy_height": None}, ("float32", "-9999"), producers=(("University of Maryland (GLAD), Department of Geographical Sciences", "https://glad.umd.edu/"),),
    ),
    "FORESTPATHS_GENUS": Product(
        "ForestPaths – European Tree Genus Map 2020 (10 m)", "Genus of Europe's trees in 2020.", (-35.0, 34.0, 45.0, 72.0), "2020-01-01", "2020-12-31", "various", "static", 10.0, 3035,
        "https://doi.org/10.5281/zenodo.13341104", ("genus", "Europe"), {"genus": None}, ("uint16", "255"), producers=(("ForestPaths Consortium", "https://forestpaths.eu"), ("VITO – Flemish Institute for Technological Research", "https://vito.be")),
    ),
    "WANG_FORESTAGE": Product(
        "Global 30m Forest Age Map - Natural and Planted Forests (Wang et al.)", "Age of natural and of planted forests.", WORLD, "1985-01-01", "2024-12-31", "CC-BY-4.0", "static (Landsat time series 1985-2024)", 30.0, 4326,
        "https://doi.org/10.5194/essd-2025-674", ("forest age", "plantation", "global"), {"natural_forest_age": "years", "planted_forest_age": "years"}, ("int16", "-9999"), producers=(("China Agricultural University", "https://www.cau.edu.cn"),),
    ),
    "ALS_PRODUCTS": Product(
        "ALS Products – Airborne laser scanning gridded products [Experimental]", "Surfaces and structure of forests from airborne laser scanning, by region, in three resolutions.", WORLD, "2015-01-01", "2023-12-31", "EUPL-1.2", "multi-year", None, 25830,
        None, ("lidar", "airborne", "forest structure"),
        {"chm": "m", "dtm": "m", "dsm": "m", "gap": "fraction", "lai": "m2 m-2", "biomass": "Mg ha-1", "h50": "m", "h75": "m", "h95": "m", "hmax": "m", "hmean": "m", "cc": "fraction", "density": "pts m-2", "fhd": "nats", "vci": "dimensionless", "crr": "dimensionless",
         "pv_0_2": None, "pv_2_5": None, "pv_5_10": None, "pv_10_20": None, "pv_20_40": None, "pv_above40": None},
        ("float32", "-9999.0"),
    ),
    "ULS_PRODUCTS": Product(
        "ULS Products – UAV laser scanning gridded products [Experimental]", "Trees and stands from laser scanning by drones, by site, in three resolutions.", (-10.0, 35.0, 32.0, 70.0), "2023-01-01", "9999-12-31", "EUPL-1.2", "campaign", None, 4326,
        "https://meta.icos-cp.eu/objects/M1ET1IeG31p-6n4BFjDb3ZO7", ("lidar", "drone", "forest structure"),
        {"n_segments": "count", "n_valid_dbh": "count", "dbh_m_mean": "m", "dbh_median": "m", "dbh_m_min": "m", "dbh_m_max": "m", "h_m_mean": "m", "h_m_median": "m", "h_m_min": "m", "h_m_max": "m",
         "crown_radius_m_mean": "m", "crown_radius_m_median": "m", "crown_radius_m_min": "m", "crown_radius_m_max": "m", "volume_m3_sum": "m3", "volume_m3_ha": "m3 ha-1", "basal_area_m2_sum": "m2", "basal_area_m2_ha": "m2 ha-1",
         "dbh_sd": "m", "height_sd": "m", "dbh_rmse": "m", "dbh_rrmse": "percent", "dbh_perc_rrmse": "percent", "dbh_bias": "m", "ba_rmse": "m2", "ba_rrmse": "percent", "ba_perc_rrmse": "percent", "ba_bias": "m2"},
        ("float32", "-9999.0"), {"n_segments": ("int32", "-9999"), "n_valid_dbh": ("int32", "-9999")},
    ),
    "RESTOR_LANDUSE": Product(
        "Annual Land Use and Land Cover maps for the Brazilian Amazon (2000 - 2022)(30 m)", "Land use and cover of the Brazilian Amazon, by year.", (-74.6193, -16.4822, -42.8267, 5.8892), "2000-01-01", "2022-12-31", "Open-access", "annual", 30.0, None,
        "https://zenodo.org/records/18716512", ("land use", "land cover", "Amazon"), {"lulc": None}, ("uint8", "255"), producers=(("National Institute for Space Research (INPE)", "https://www3.inpe.br/50anos/english/presentation.php"),),
    ),
    "GEDI_L4D": Product(
        "GEDI L4D Imputed Forest Structure (30 m)", "Relative heights of canopies, imputed between lidar footprints.", (-180.0, -51.99, 180.0, 51.99), "2019-04-18", "2023-03-16", "proprietary", "static (2019-04-18 to 2023-03-16)", 30.0, 4326,
        "https://doi.org/10.3334/ORNLDAAC/2455", ("canopy height", "lidar"), _all(["rh10", "rh20", "rh30", "rh40", "rh50", "rh60", "rh70", "rh80", "rh90", "rh95", "rh98"], "m"), ("float32", "-9999"), producers=(("NASA ORNL DAAC", "https://daac.ornl.gov"),),
    ),
    "Potapov_LCLUC": Product(
        "Potapov Land Cover and Land Use Change 2000-2020", "Land cover and use of the world every five years, and its change.", WORLD, "2000-01-01", "2020-12-31", "Open-access", "Land cover/use every 4 years and change over 20 years", 30.0, 4326,
        "https://doi.org/10.3389/frsen.2022.856903", ("land cover", "land use", "global"), _all(["LCLU2000", "LCLU2005", "LCLU2010", "LCLU2015", "LCLU2020", "LCLUC2000-2020change"], "Categorical"), ("float32", "-9999"), producers=(("University of Maryland", "https://glad.umd.edu/dataset/GLCLUC2020"),),
    ),
}

# Periods of versions that differ from their collection's.
PERIODS = {("CCI_BIOMASS", "6.0"): ("2007-01-01", "2022-12-31"), ("CCI_BIOMASS", "7.0"): ("2005-01-01", "2024-12-31")}


def _day(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _row(name: str, p: Product, citation: str | None) -> dict:
    bands = {v: {"data_type": kind, "nodata": nodata} for v in p.units for kind, nodata in (p.others.get(v, p.bands),)}
    return {
        "id": name, "title": p.title, "description": p.description, "license": p.license, "bbox": list(p.bbox), "start_datetime": _day(p.first), "end_datetime": _day(p.last), "keywords": list(p.keywords),
        "providers": [{"name": n, "roles": ["producer"], "url": u} for n, u in p.producers], "links": [{"rel": "cite-as", "href": citation, "type": "text/html", "title": None}] if citation else [],
        "variables": list(p.units), "units": {v: u for v, u in p.units.items() if u}, "raster_bands": bands, "data_format": ["zarr"], "temporal_resolution": [p.every],
        "item_assets": {"zarr": {"title": "Zarr dataset", "description": p.description, "type": MEDIA, "roles": ["data"]}}, "gsd": p.gsd, "epsg": p.epsg,
    }


def configurations(spark: SparkSession, citations: Mapping[str, str] | None = None) -> DataFrame:
    """A row of bodies.CONFIG for each product. citations: links of products, before those that the table has."""
    given = citations or {}
    if unknown := sorted(set(given) - set(PRODUCTS)):
        raise KeyError(f"no such products: {unknown}; there are {sorted(PRODUCTS)}")
    types = {c: t for c, t in bodies.CONFIG.items() if c != "stac_extensions"}
    rows = [_row(n, p, given.get(n, p.doi)) for n, p in PRODUCTS.items()]
    return bodies.completed(spark.createDataFrame([tuple(r[c] for c in types) for r in rows], ", ".join(f"`{c}` {t}" for c, t in types.items())))


def broken(configs: DataFrame) -> DataFrame:
    """(id, broken): configurations that break rules, and which."""
    as_rules = configs.withColumn("raster_bands", F.map_keys("raster_bands"))
    return rules.checked(as_rules).where(F.size("broken") > 0).select("id", "broken")


def periods(spark: SparkSession) -> DataFrame:
    """(collection_id, version, start, end) of versions that have a period of their own."""
    return spark.createDataFrame([(c, v, _day(a), _day(b)) for (c, v), (a, b) in PERIODS.items()], "collection_id string, version string, start timestamp_ntz, end timestamp_ntz")


def regions(spark: SparkSession) -> DataFrame:
    """(collection_id, region, stem, bbox, epsg, start, end): places that a collection's items stand for, with what an item's id begins with."""
    rows = [(c, r.name, r.stem, list(r.bbox), r.epsg, _day(r.first), _day(r.last)) for c, rs in products.REGIONS.items() for r in rs]
    return spark.createDataFrame(rows, "collection_id string, region string, stem string, bbox array<double>, epsg int, start timestamp_ntz, end timestamp_ntz")


def _with_variables(catalog: Catalog) -> DataFrame:
    """A catalog's assets with their collection_id and variables: those of a resolution that lists some, else NULL for all."""
    listed = [(c, r, v) for c, rs in products.RESOLUTIONS.items() for r, v in rs.items()]
    own = catalog.assets.sparkSession.createDataFrame(listed, "collection_id string, resolution string, variables array<string>")
    return catalog.assets.join(catalog.items.select("item_id", "collection_id"), "item_id").join(own, ["collection_id", "resolution"], "left")


def standard(spark: SparkSession, base: str = "s3://data", configs: DataFrame | None = None) -> Catalog:
    """The catalog of all registered products, with what their configurations say of collections and bands.

    Collections have title, description, licence, bbox, period, keywords and links; bands of each asset have unit,
    type and missing value. KeyError if a registered product has no configuration.
    """
    plain, configs = tables.standard(spark, base), configurations(spark) if configs is None else configs
    where = plain.collections.select(F.col("collection_id").alias("_c"), "theme_id")
    if lost := tables.orphans(where.withColumnRenamed("_c", "id"), configs, "id").take(20):
        raise KeyError(f"no configuration of {sorted(r['id'] for r in lost)}")
    collections = tables.collections_of(configs.join(where, F.col("id") == F.col("_c")))
    bands = _with_variables(plain).join(tables.bands_of(configs), F.col("collection_id") == F.col("id"))
    bands = bands.where(F.col("variables").isNull() | F.array_contains("variables", F.col("name")))
    return tables.intact(Catalog(plain.themes, collections, plain.items, plain.assets, bands.select("item_id", "asset_key", "pos", "name", "unit", "data_type", "nodata")))


def nodes(catalog: Catalog, root: str) -> DataFrame:
    """(id, parent, kind) of a catalog's themes, collections and items below a root."""
    top = catalog.themes.sparkSession.createDataFrame([(root, None, "catalog")], "id string, parent string, kind string")
    levels = [
        catalog.themes.select(F.col("theme_id").alias("id"), F.lit(root).alias("parent"), F.lit("catalog").alias("kind")),
        catalog.collections.select(F.col("collection_id").alias("id"), F.col("theme_id").alias("parent"), F.lit("collection").alias("kind")),
        catalog.items.select(F.col("item_id").alias("id"), F.col("collection_id").alias("parent"), F.lit("item").alias("kind")),
    ]
    for level in levels:
        top = top.unionByName(level)
    return top


def published(catalog: Catalog, configs: DataFrame, write_base: str, publish_base: str | None = None, root: tuple[str, str] = ("root", "Gridded products")) -> DataFrame:
    """(path, body): full documents of a catalog's root, themes, collections and items, of products' configurations.

    Items of a region have its bbox, CRS and period; items of a version that has a period of its own have that one.
    Assets of a resolution have its variables as bands. Paths lie under write_base, links under publish_base. Collections without a configuration have no document.
    """
    spark = catalog.themes.sparkSession
    assets = _with_variables(catalog)
    plain = catalog.themes.select(F.col("theme_id").alias("id"), "title", F.lit(None).cast("string").alias("description"))
    plain = plain.unionByName(spark.createDataFrame([(*root, None)], "id string, title string, description string"))
    kinds = [
        bodies.catalog_bodies(plain),
        bodies.collection_bodies(configs),
        bodies.item_bodies(catalog.items, configs, assets, periods(spark), regions(spark)).select(F.col("item_id").alias("id"), "body"),
    ]
    return tree.documents(nodes(catalog, root[0]), kinds, write_base, publish_base)

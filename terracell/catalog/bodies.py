"""Full bodies of collections, items and catalogs, as structs of Columns that to_json writes.

Configurations are rows; what a configuration lacks is NULL and isn't in the JSON. Names of fields are the standard's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.catalog.tables import ITEM_LINKS, LICENSE, item_id

STAC_VERSION = "1.1.0"
LINKS = "array<struct<rel:string,href:string,type:string,title:string>>"
#: Columns of a configuration, with their types; id, title and description have to be there, others may be missing.
CONFIG = {
    "id": "string", "title": "string", "description": "string", "license": "string", "bbox": "array<double>", "start_datetime": "timestamp_ntz", "end_datetime": "timestamp_ntz",
    "keywords": "array<string>", "providers": "array<struct<name:string,roles:array<string>,url:string>>", "links": LINKS, "stac_extensions": "array<string>",
    "variables": "array<string>", "units": "map<string,string>", "raster_bands": "map<string,struct<data_type:string,nodata:string>>", "data_format": "array<string>", "temporal_resolution": "array<string>",
    "item_assets": "map<string,struct<title:string,description:string,type:string,roles:array<string>>>", "gsd": "double", "epsg": "int",
}


def completed(configs: DataFrame) -> DataFrame:
    """configs with all columns of CONFIG in their types; missing ones are NULL."""
    return configs.select(*[(F.col(c) if c in configs.columns else F.lit(None)).cast(t).alias(c) for c, t in CONFIG.items()], *[c for c in configs.columns if c not in CONFIG])


def moment(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def outline(bbox: Column) -> Column:
    """The polygon of a bbox (west, south, east, north)."""
    w, s, e, n = (bbox[k] for k in range(4))
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (w, n), (e, n), (e, s), (w, s))])
    return F.when(bbox.isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def _filled(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def collection_bodies(configs: DataFrame) -> DataFrame:
    """(id, body): a collection's own fields; links to other documents are the tree's."""
    c = completed(configs)
    extent = F.struct(F.struct(F.array("bbox").alias("bbox")).alias("spatial"), F.struct(F.array(F.array(moment(F.col("start_datetime")), moment(F.col("end_datetime")))).alias("interval")).alias("temporal"))
    summaries = F.struct(_filled(F.col("variables")).alias("variables"), F.col("units").alias("units_by_variable"), _filled(F.col("data_format")).alias("data_format"), _filled(F.col("temporal_resolution")).alias("temporal_resolution"))
    body = F.struct(
        F.lit("Collection").alias("type"), F.lit(STAC_VERSION).alias("stac_version"), "id", "title", "description", F.coalesce("license", F.lit(LICENSE)).alias("license"),
        F.coalesce("providers", F.array().cast(CONFIG["providers"])).alias("providers"), extent.alias("extent"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        _filled(F.col("stac_extensions")).alias("stac_extensions"), summaries.alias("summaries"), F.col("item_assets"), F.coalesce("links", F.array().cast(LINKS)).alias("links"),
    )
    return c.select("id", body.alias("body"))


def item_bodies(items: DataFrame, configs: DataFrame, assets: DataFrame, periods: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(item_id, collection_id, body): items (item_id, collection_id, version, region) of configurations, with their assets.

    assets: (item_id, asset_key, resolution, href, media_type). Roles and titles of an asset are those that the
    configuration's item_assets has for its key (or the key's first word), else the role data. Its bands are the
    configuration's variables, with unit, type and nodata. periods (collection_id, version, start, end) go before the
    configuration's, and regions (collection_id, region, bbox, epsg, start, end) before both. An asset with a column
    variables has the bands that it lists only (NULL: all). An item is dated at its end and keeps only some kinds of
    links. Items without assets stay.
    """
    c = completed(configs)
    band = F.transform(
        "variables",
        lambda v: F.struct(v.alias("name"), F.try_element_at("units", v).alias("unit"), F.try_element_at("raster_bands", v)["data_type"].alias("data_type"), F.try_element_at("raster_bands", v)["nodata"].alias("nodata")),
    )
    named = F.col("item_id") if "item_id" in items.columns else item_id(F.col("collection_id"), F.col("version"), F.col("region"))
    rows = items.select(named.alias("item_id"), F.col("collection_id").alias("of"), "version", "region").join(c, F.col("of") == F.col("id"))
    if periods is not None:
        own = periods.select(F.col("collection_id").alias("_c"), F.col("version").alias("_v"), F.col("start").cast("timestamp_ntz").alias("_s"), F.col("end").cast("timestamp_ntz").alias("_e"))
        rows = rows.join(own, (F.col("of") == F.col("_c")) & (F.col("version") == F.col("_v")), "left").withColumns({"start_datetime": F.coalesce("_s", "start_datetime"), "end_datetime": F.coalesce("_e", "end_datetime")}).drop("_c", "_v", "_s", "_e")
    if regions is not None:
        there = regions.select(F.col("collection_id").alias("_c"), F.col("region").alias("_r"), *[F.col(n).alias(f"_{n}") for n in ("bbox", "epsg", "start", "end")])
        rows = rows.join(there, (F.col("of") == F.col("_c")) & (F.col("region") == F.col("_r")), "left")
        rows = rows.withColumns({n: F.coalesce(f"_{m}", n) for n, m in (("bbox", "bbox"), ("epsg", "epsg"), ("start_datetime", "start"), ("end_datetime", "end"))}).drop("_c", "_r", "_bbox", "_epsg", "_start", "_end")
    about = rows.select("item_id", "title", "item_assets", band.alias("bands"))
    said = F.coalesce(F.try_element_at("item_assets", F.col("asset_key")), F.try_element_at("item_assets", F.split("asset_key", "_")[0]))
    listed = F.col("variables") if "variables" in assets.columns else F.lit(None).cast("array<string>")
    described = assets.select("item_id", "asset_key", "resolution", "href", "media_type", listed.alias("_listed")).join(about, "item_id")
    described = described.withColumn("bands", F.filter("bands", lambda b: F.col("_listed").isNull() | F.array_contains("_listed", b["name"])))
    asset = F.struct(
        "href", F.col("media_type").alias("type"), F.coalesce(said["title"], F.concat_ws(" ", "title", F.concat(F.lit("("), F.col("resolution"), F.lit(")")))).alias("title"),
        said["description"].alias("description"), F.coalesce(said["roles"], F.array(F.lit("data"))).alias("roles"), _filled(F.col("bands")).alias("raster:bands"),
    )
    grouped = described.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_key", asset.alias("v"))))).alias("assets"))
    properties = F.struct(
        F.col("title").alias("product_name"), "version", "region", moment(F.col("end_datetime")).alias("datetime"), moment(F.col("start_datetime")).alias("start_datetime"), moment(F.col("end_datetime")).alias("end_datetime"),
        F.col("gsd").alias("eo:gsd"), F.col("epsg").alias("proj:epsg"), F.element_at(_filled(F.col("temporal_resolution")), 1).alias("temporal_resolution"), _filled(F.col("variables")).alias("variables"), "units",
    )
    kept = F.filter(F.coalesce("links", F.array().cast(LINKS)), lambda x: x["rel"].isin(*ITEM_LINKS))
    body = F.struct(
        F.lit("Feature").alias("type"), F.lit(STAC_VERSION).alias("stac_version"), F.col("item_id").alias("id"), outline(F.col("bbox")).alias("geometry"), "bbox", properties.alias("properties"),
        F.col("of").alias("collection"), _filled(F.col("stac_extensions")).alias("stac_extensions"), F.coalesce("assets", F.from_json(F.lit("{}"), grouped.schema["assets"].dataType)).alias("assets"), kept.alias("links"),
    )
    return rows.join(grouped, "item_id", "left").select("item_id", F.col("of").alias("collection_id"), body.alias("body"))


def catalog_bodies(rows: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(id, body) of plain catalogs (id, title, description); extra: further fields, such as license, keywords or providers."""
    text = F.coalesce("description", "title", "id")
    body = F.struct(F.lit("Catalog").alias("type"), F.lit(STAC_VERSION).alias("stac_version"), "id", "title", text.alias("description"), *[c.alias(n) for n, c in (extra or {}).items()], F.array().cast(LINKS).alias("links"))
    return rows.select("id", body.alias("body"))

"""Building the catalog's tables, checking that they hang together, and writing them as a tree of JSON files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.catalog import products

LICENSE = "CC-BY-4.0"
ITEM_LINKS = ("cite-as", "about", "license")
MEDIA_TYPES = {
    "zarr": "application/vnd.zarr", "parquet": "application/vnd.apache.parquet", "netcdf": "application/x-netcdf",
    "cog": "image/tiff; application=geotiff; profile=cloud-optimized", "geotiff": "image/tiff; application=geotiff",
}


@dataclass(frozen=True)
class Catalog:
    """Five tables: themes (theme_id, title), collections (collection_id, theme_id, title, ...), items (item_id,
    collection_id, version, region), assets (item_id, asset_key, resolution, href, media_type), bands (item_id, asset_key, pos, name, ...)."""

    themes: DataFrame
    collections: DataFrame
    items: DataFrame
    assets: DataFrame
    bands: DataFrame


def item_id(collection: Column, version: Column, region: Column | None = None) -> Column:
    """collection[_region]_vVersion."""
    head = collection if region is None else F.concat_ws("_", collection, region)
    return F.concat(head, F.lit("_v"), version)


def items_of(collections: DataFrame, versions: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One item for a version of a collection, and for each of its regions if it has some; a region's stem, if it has one, begins the item's id."""
    rows = collections.select("collection_id").join(versions.select("collection_id", "version"), "collection_id")
    if regions is not None:
        stem = "stem" if "stem" in regions.columns else F.lit(None).cast("string").alias("stem")
        rows = rows.join(regions.select("collection_id", "region", stem), "collection_id", "left")
    else:
        rows = rows.withColumns({"region": F.lit(None).cast("string"), "stem": F.lit(None).cast("string")})
    own = F.coalesce(item_id(F.col("stem"), F.col("version")), item_id(F.col("collection_id"), F.col("version"), F.col("region")))
    return rows.select(own.alias("item_id"), "collection_id", "version", "region")


def collections_of(configs: DataFrame) -> DataFrame:
    """Collections of configurations (columns of rules.CONFIG and theme_id): the licence has a default, citations and other links stay."""
    none = F.array().cast("array<string>")
    return configs.select(
        F.col("id").alias("collection_id"), "theme_id", "title", "description", F.coalesce("license", F.lit(LICENSE)).alias("license"), "bbox", "start_datetime", "end_datetime",
        F.coalesce("keywords", none).alias("keywords"), "links",
    )


def described(items: DataFrame, configs: DataFrame) -> DataFrame:
    """items with what their configuration says of them: product name, period, dated at its end, bbox, variables, and the links that an item keeps."""
    kept = F.filter("links", lambda x: x["rel"].isin(*ITEM_LINKS))
    says = configs.select(F.col("id").alias("collection_id"), F.col("title").alias("product_name"), "bbox", "start_datetime", "end_datetime", F.col("end_datetime").alias("datetime"), "variables", kept.alias("links"))
    return items.join(says, "collection_id")


def with_period(items: DataFrame, own: DataFrame, first: str, last: str) -> DataFrame:
    """items with start and end: the version's own (own: collection_id, version, start, end) or else the collection's."""
    rows = items.join(own.withColumnsRenamed({"start": "_s", "end": "_e"}), ["collection_id", "version"], "left")
    return rows.withColumns({"start": F.coalesce("_s", F.col(first)), "end": F.coalesce("_e", F.col(last))}).drop("_s", "_e")


def assets_of(items: DataFrame, resolutions: DataFrame, base: str, kind: str = "zarr", version_last: bool = False) -> DataFrame:
    """An asset for each resolution of an item's collection (resolutions: collection_id, resolution), or one without any.

    A resolution stands behind the item's id in the store's name, or, with version_last, before the id's version.
    """
    rows = items.join(resolutions.select("collection_id", "resolution"), "collection_id", "left")
    key = F.concat_ws("_", F.lit(kind), F.col("resolution"))
    head = F.left("item_id", F.length("item_id") - F.length("version") - 2) if version_last else F.col("item_id")
    tail = F.concat(F.lit("_v"), "version") if version_last else F.lit("")
    name = F.concat(head, F.coalesce(F.concat(F.lit("_"), F.col("resolution")), F.lit("")), tail, F.lit(f".{kind}"))
    href = F.concat_ws("/", F.lit(base.rstrip("/")), "collection_id", name)
    return rows.select("item_id", key.alias("asset_key"), "resolution", href.alias("href"), F.lit(MEDIA_TYPES[kind]).alias("media_type"))


def bands_of(configs: DataFrame) -> DataFrame:
    """(id, pos, name, unit, data_type, nodata): the bands of configs (id, variables, units map, raster_bands map), in the order of variables.

    Unit, type and nodata are NULL where the configuration doesn't give them.
    """
    rows = configs.select("id", F.posexplode("variables").alias("pos", "name"), "units", "raster_bands")
    band = F.try_element_at("raster_bands", F.col("name"))
    return rows.select("id", "pos", "name", F.try_element_at("units", F.col("name")).alias("unit"), band["data_type"].alias("data_type"), band["nodata"].alias("nodata"))


def bands_at(bands: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Bands of each resolution: those that it lists (resolutions: id, resolution, variables), all where it lists none."""
    rows = bands.join(resolutions, "id")
    return rows.where(F.col("variables").isNull() | F.array_contains("variables", F.col("name"))).drop("variables")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tree(themes: DataFrame, collections: DataFrame, items: DataFrame) -> DataFrame:
    """Each item with its collection and theme: the tree as one table (theme_id, collection_id, item_id, and other columns)."""
    return themes.join(collections, "theme_id").join(items, "collection_id")


#: Rows of both tables that a task of differing() groups, about.
DIFFERING_ROWS = 1 << 19


def differing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table only. A null key is like no other, so it is of one table only in each.

    Both tables are dealt out together, to as many tasks as their rows need, and grouped once: a task's memory
    doesn't grow with the tables, as it does where tasks are merged by their compressed bytes.
    """
    k, sides = F.col(f"`{key}`"), [d.select(F.col(f"`{key}`"), F.lit(s).alias("_side")) for d, s in ((left, "left"), (right, "right"))]
    both = sides[0].unionByName(sides[1])
    tasks = max(1, -(-both.count() // DIFFERING_ROWS))
    groups = both.repartition(tasks, k).groupBy(k, F.when(k.isNull(), F.col("_side")).alias("_null")).agg(F.min("_side").alias("side"), F.max("_side").alias("_last"))
    return groups.where(F.col("side") == F.col("_last")).select(k, "side")


def intact(catalog: Catalog) -> Catalog:
    """The catalog; KeyError for references to nothing, ValueError for products in two themes and repeated ids."""
    c = catalog
    for child, parent, key, what in ((c.collections, c.themes, "theme_id", "theme"), (c.items, c.collections, "collection_id", "collection"), (c.assets, c.items, "item_id", "item")):
        bad = [r[0] for r in orphans(child, parent, key).select(key).distinct().orderBy(key).take(20)]
        if bad:
            raise KeyError(f"no such {what}: {bad}")
    if twice := repeated(c.collections, "collection_id").take(20):
        raise ValueError(f"in more than one theme: {[r['collection_id'] for r in twice]}")
    for df, key in ((c.items, ["item_id"]), (c.assets, ["item_id", "asset_key"])):
        if twice := repeated(df, *key).take(20):
            raise ValueError(f"repeated: {[tuple(r)[:-1] for r in twice]}")
    return catalog


def standard(spark: SparkSession, base: str = "s3://data", versions: dict[str, list[str]] | None = None) -> Catalog:
    """The catalog of all registered products."""
    versions = versions or products.VERSIONS
    themes = spark.createDataFrame([(k, t) for k, (t, _) in products.THEMES.items()], "theme_id string, title string")
    where = [(p, k) for k, (_, ps) in products.THEMES.items() for p in ps]
    if missing := sorted(p for p, _ in where if p not in versions):
        raise KeyError(f"no versions of {missing}")
    if extra := sorted(set(versions) - {p for p, _ in where}):
        raise ValueError(f"in no theme: {extra}")
    collections = spark.createDataFrame([(p, k, p.replace("_", " ").title(), LICENSE) for p, k in where], "collection_id string, theme_id string, title string, license string")
    vs = spark.createDataFrame([(p, v) for p, xs in versions.items() for v in xs], "collection_id string, version string")
    regions = spark.createDataFrame([(c, r.name, r.stem) for c, rs in products.REGIONS.items() for r in rs], "collection_id string, region string, stem string")
    res = spark.createDataFrame([(p, r, v) for p, rs in products.RESOLUTIONS.items() for r, v in rs.items()], "collection_id string, resolution string, variables array<string>")
    items = items_of(collections, vs, regions)
    names = {"ALS_PRODUCTS": products.ALS_SURFACES + products.ALS_STRUCTURE, "ULS_PRODUCTS": products.ULS_BANDS}
    bands = spark.createDataFrame([(p, k, n) for p, ns in names.items() for k, n in enumerate(ns)], "id string, pos int, name string")
    at = bands_at(bands, res.withColumnRenamed("collection_id", "id"))
    assets = assets_of(items, res, base, version_last=True)
    keyed = assets.withColumnRenamed("resolution", "_r").join(items.select("item_id", "collection_id"), "item_id")
    band_rows = keyed.join(at, (keyed["collection_id"] == at["id"]) & (keyed["_r"] == at["resolution"])).select("item_id", "asset_key", "pos", "name")
    return intact(Catalog(themes, collections, items, assets, band_rows))


def rebased(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """df with an href's base exchanged."""
    return df.withColumn(column, F.regexp_replace(column, "^" + re.escape(old), F.lit(new)))


def documents(catalog: Catalog, base: str) -> DataFrame:
    """(path, body): the JSON files of the tree, root, themes, collections and items, linked to each other, with their assets."""
    base = base.rstrip("/")
    theme_path = F.concat(F.lit(f"{base}/"), "theme_id", F.lit("/catalog.json"))
    coll_path = F.concat(F.lit(f"{base}/"), "theme_id", F.lit("/"), "collection_id", F.lit("/collection.json"))
    item_path = F.concat(F.lit(f"{base}/"), "theme_id", F.lit("/"), "collection_id", F.lit("/"), "item_id", F.lit("/item.json"))
    root = f"{base}/catalog.json"
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    up = F.array(link("root", F.lit(root)))
    children = catalog.collections.groupBy("theme_id").agg(F.array_sort(F.collect_list(link("child", coll_path))).alias("_kids"))
    themes = catalog.themes.join(children, "theme_id", "left").select(
        theme_path.alias("path"), F.to_json(F.struct(F.lit("Catalog").alias("type"), F.col("theme_id").alias("id"), "title", F.concat(up, F.coalesce("_kids", F.array().cast("array<struct<rel:string,href:string>>"))).alias("links"))).alias("body")
    )
    located = catalog.items.join(catalog.collections.select("collection_id", "theme_id"), "collection_id")
    kids = located.groupBy("collection_id").agg(F.array_sort(F.collect_list(link("item", item_path))).alias("_kids"))
    colls = catalog.collections.join(kids, "collection_id", "left").select(
        coll_path.alias("path"), F.to_json(F.struct(F.lit("Collection").alias("type"), F.col("collection_id").alias("id"), "title", "license", F.concat(up, F.array(link("parent", theme_path)), F.coalesce("_kids", F.array().cast("array<struct<rel:string,href:string>>"))).alias("links"))).alias("body")
    )
    assets = catalog.assets.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_key", F.struct("href", F.col("media_type").alias("type")).alias("v"))))).alias("assets"))
    items = located.join(assets, "item_id", "left").select(
        item_path.alias("path"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("item_id").alias("id"), F.col("collection_id").alias("collection"), F.struct("version", "region").alias("properties"), F.concat(up, F.array(link("parent", coll_path))).alias("links"), "assets")).alias("body")
    )
    tops = catalog.themes.groupBy().agg(F.array_sort(F.collect_list(link("child", theme_path))).alias("links"))
    top = tops.select(F.lit(root).alias("path"), F.to_json(F.struct(F.lit("Catalog").alias("type"), F.lit("root").alias("id"), "links")).alias("body"))
    return top.unionByName(themes).unionByName(colls).unionByName(items)


def written(documents: DataFrame) -> int:
    """Writes each body, indented, at its path, from the executors; the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if re.match("s3a?:/*$|s3a?:///", path):
                    raise ValueError(f"no bucket in {path!r}")
                system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as f:
                    f.write(json.dumps(json.loads(body), indent=2, ensure_ascii=False).encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return documents.select("path", "body").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """The JSON files below base, one row each."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(base)

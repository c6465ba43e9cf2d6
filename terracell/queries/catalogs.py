"""Catalog and discovery operators; regions stand for themes, nations for collections, suppliers and parts for items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.catalog import bodies, discovery, rules, tables, tree
from terracell.queries import query
from terracell.queries.cubes import table

VERSIONS = "VALUES ('1.0'), ('2.0'), ('10.1')"


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("collection_id"), F.col("n_regionkey").alias("theme_id"), F.col("n_name").alias("title"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.createDataFrame([("1.0",), ("2.0",), ("10.1",)], "version string")
    return collections(spark, sf_dir).select("collection_id").crossJoin(every)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.items_of(collections(spark, sf_dir), _versions(spark, sf_dir))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN false ELSE c_nationkey - 10 <= 10 AND c_acctbal / 100 <= 50 END AS valid FROM customer""")
def validate_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    west, south = F.col("c_nationkey").cast("double") - 10, F.col("c_acctbal") / 100
    four, three = F.array(west, south, F.lit(10.0), F.lit(50.0)), F.array(west, south, F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.bbox_in_order(F.when(F.col("c_custkey") % 7 == 0, three).otherwise(four)).alias("valid"))


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN s_nationkey > 20 THEN 'bbox' END, CASE WHEN s_nationkey % 3 = 1 THEN 'license' END, CASE WHEN s_suppkey % 4 = 0 THEN 'keywords' END,
  CASE WHEN s_suppkey % 5 = 0 THEN 'citation' END, CASE WHEN s_suppkey % 6 = 0 THEN 'bands' END, CASE WHEN s_acctbal < 0 THEN 'period' END) AS broken FROM supplier""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    day = lambda text: F.lit(text).cast("timestamp")
    configs = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.array(F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(20.0), F.lit(1.0)).alias("bbox"),
        F.when(F.col("s_nationkey") % 3 == 1, "no licence!").when(F.col("s_nationkey") % 3 == 0, "CC-BY-4.0").alias("license"),
        F.when(s % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("forest"))).alias("keywords"),
        F.array(F.struct(F.when(s % 5 == 0, "about").otherwise("cite-as").alias("rel"))).alias("links"),
        F.array(F.lit("a"), F.when(s % 6 == 0, "c").otherwise("b")).alias("variables"),
        F.array(F.lit("a"), F.lit("b")).alias("raster_bands"),
        day("2020-01-01").alias("start_datetime"),
        F.when(F.col("s_acctbal") < 0, day("2019-01-01")).otherwise(day("2021-01-01")).alias("end_datetime"),
    )
    return rules.checked(configs).select("s_suppkey", F.array_join("broken", ",").alias("broken"))


@query("""SELECT p_partkey AS id, 0 AS pos, p_brand AS name, 'u' || p_size AS unit, NULL AS data_type, CAST(NULL AS DOUBLE) AS nodata FROM part
  UNION ALL SELECT p_partkey, 1, p_type, NULL, 'int16', CAST(p_size AS DOUBLE) FROM part""")
def bands_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array("p_brand", "p_type").alias("variables"),
        F.create_map(F.col("p_brand"), F.concat(F.lit("u"), F.col("p_size").cast("string"))).alias("units"),
        F.create_map(F.col("p_type"), F.struct(F.lit("int16").alias("data_type"), F.col("p_size").cast("double").alias("nodata"))).alias("raster_bands"),
    )
    return tables.bands_of(configs)


@query(f"""SELECT n_name || '_v' || v AS item_id, n_name AS collection_id, v AS version FROM nation, ({VERSIONS}) t(v)""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", "collection_id", "version")


@query(f"""SELECT n_name || '_v' || v AS item_id, 'zarr_' || r AS asset_key, r AS resolution, 's3://data/' || n_name || '/' || n_name || '_v' || v || '_' || r || '.zarr' AS href, 'application/vnd.zarr' AS media_type
  FROM nation, ({VERSIONS}) t(v), (VALUES ('10m'), ('100m')) s(r)""")
def asset_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.createDataFrame([("10m",), ("100m",)], "resolution string")
    res = collections(spark, sf_dir).select("collection_id").crossJoin(sizes)
    return tables.assets_of(_items(spark, sf_dir), res, "s3://data").select("item_id", "asset_key", "resolution", "href", "media_type")


@query("""SELECT p_partkey AS id, 'fine' AS resolution, p_brand AS name FROM part UNION ALL SELECT p_partkey, 'coarse', p_brand FROM part UNION ALL SELECT p_partkey, 'coarse', p_type FROM part""")
def bands_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    bands = parts.select(F.col("p_partkey").alias("id"), F.explode(F.array("p_brand", "p_type")).alias("name"))
    fine = parts.select(F.col("p_partkey").alias("id"), F.lit("fine").alias("resolution"), F.array("p_brand").alias("variables"))
    coarse = parts.select(F.col("p_partkey").alias("id"), F.lit("coarse").alias("resolution"), F.lit(None).cast("array<string>").alias("variables"))
    return tables.bands_at(bands, fine.unionByName(coarse)).select("id", "resolution", "name")


@query(f"""SELECT n_name || '_v' || v AS item_id, CASE WHEN v = '10.1' THEN 2015 ELSE 2000 END AS "start", CASE WHEN v = '10.1' THEN 2022 ELSE 2020 END AS "end" FROM nation, ({VERSIONS}) t(v)""")
def version_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumns({"first": F.lit(2000), "last": F.lit(2020)})
    own = items.where("version = '10.1'").select("collection_id", "version", F.lit(2015).alias("start"), F.lit(2022).alias("end"))
    return tables.with_period(items, own, "first", "last").select("item_id", "start", "end")


@query("""SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def fk_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT r_name, n_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("theme_id"), "r_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("collection_id"), F.col("n_regionkey").alias("theme_id"), "n_name")
    return tables.tree(themes, nations, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("collection_id"), "s_name")).select("r_name", "n_name", "s_name")


@query("""SELECT k, side FROM (SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer))""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.differing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("""SELECT r_regionkey AS theme_id, CASE WHEN r_regionkey = 2 THEN '2' ELSE r_name END AS title FROM region""")
def dim_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("theme_id"), F.when(F.col("r_regionkey") == 2, "").otherwise(F.col("r_name")).alias("title"))
    return discovery.titled(themes, "theme_id")


@query("""SELECT n_name AS collection_id, n_name AS title FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)""")
def collections_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("theme_id"))
    return discovery.titled(discovery.in_theme(collections(spark, sf_dir), chosen, "theme_id"), "collection_id")


@query("""SELECT s_nationkey, array_to_string(list_sort(list_distinct(list('v' || (s_suppkey % 5)))), ',') AS versions, count(DISTINCT s_suppkey % 5) AS n_versions FROM supplier GROUP BY 1""")
def collections_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("v"), (F.col("s_suppkey") % 5).cast("string")).alias("version"))
    return discovery.version_lists(items, "s_nationkey", "version").withColumn("versions", F.array_join("versions", ","))


@query("""SELECT DISTINCT p_brand AS collection_id FROM part""")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.ids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection_id")), "collection_id")


@query("""SELECT version, CAST(row_number() OVER (ORDER BY CAST(split_part(version, '.', 1) AS INTEGER), CAST(split_part(version, '.', 2) AS INTEGER)) AS INTEGER) AS place
  FROM (SELECT DISTINCT p_size || '.' || (p_partkey % 13) AS version FROM part)""")
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"))
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("P_v"), stated).alias("id"), F.when(F.col("p_partkey") % 2 == 0, stated).alias("v"))
    found = items.select(discovery.version_of(F.col("id"), F.lit("P"), F.col("v")).alias("version")).distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy(discovery.version_key(F.col("version")))))


@query("""SELECT p_brand, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel') GROUP BY 1""")
def text_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = discovery.containing(table(spark, sf_dir, "part"), "A", ["p_name"])
    right = discovery.containing(table(spark, sf_dir, "part"), "Steel", ["p_type"])
    both = left.unionByName(right).select("p_partkey", "p_brand").distinct()
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root, a catalog for a region, and suppliers as a tree of their own: each half as far from the first, the last of a branch an item."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("parent"), F.lit("catalog").alias("kind"))
    k = F.col("s_suppkey")
    parent = F.when(k > 1, F.concat(F.lit("S"), F.floor(k / 2).cast("string"))).otherwise(F.lit("R0"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("_n", F.lit(table(spark, sf_dir, "supplier").count())).select(F.concat(F.lit("S"), k.cast("string")).alias("id"), parent.alias("parent"), F.when(2 * k > F.col("_n"), "item").otherwise("collection").alias("kind"))
    return regions.unionByName(suppliers).unionByName(spark.createDataFrame([("root", None, "catalog")], "id string, parent string, kind string"))


_NODES = """nodes AS (SELECT 'R' || r_regionkey AS id, 'root' AS parent, 'catalog' AS kind FROM region
    UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_suppkey > 1 THEN 'S' || (s_suppkey // 2) ELSE 'R0' END, CASE WHEN 2 * s_suppkey > (SELECT count(*) FROM supplier) THEN 'item' ELSE 'collection' END FROM supplier
    UNION ALL SELECT 'root', NULL, 'catalog'),
  reached AS (SELECT id, parent, kind, 0 AS depth, '' AS folder FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, n.kind, r.depth + 1, r.folder || n.id || '/' FROM nodes n JOIN reached r ON n.parent = r.id),
  located AS (SELECT *, folder || kind || '.json' AS path FROM reached)"""


@query(f"WITH RECURSIVE {_NODES} SELECT id, parent, kind, depth, path FROM located")
def tree_of_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(_nodes(spark, sf_dir)).select("id", "parent", "kind", "depth", "path")


@query(f"""WITH RECURSIVE {_NODES} SELECT 's3://w/' || l.path AS written, rel, 'https://p/' || href AS href FROM located l JOIN (
    SELECT id, 'self' AS rel, path AS href FROM located UNION ALL SELECT id, 'root', 'catalog.json' FROM located UNION ALL SELECT c.id, 'parent', p.path FROM located c JOIN located p ON c.parent = p.id
    UNION ALL SELECT c.parent, CASE WHEN c.kind = 'item' THEN 'item' ELSE 'child' END, c.path FROM located c WHERE c.parent IS NOT NULL) x ON l.id = x.id""")
def tree_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents that are written under one base and published under another, out of their JSON."""
    nodes = _nodes(spark, sf_dir)
    plain = bodies.catalog_bodies(nodes.select("id", F.col("id").alias("title"), F.lit(None).cast("string").alias("description")))
    docs = tree.documents(nodes, [plain], "s3://w", "https://p/")
    link = F.explode(F.from_json(F.get_json_object("body", "$.links"), "array<struct<rel:string,href:string>>"))
    return docs.select(F.col("path").alias("written"), link.alias("l")).select("written", "l.rel", "l.href")


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for a nation, with some fields missing in some."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    some = lambda k, c: F.when(n % k != 0, c)
    return table(spark, sf_dir, "nation").select(
        name.alias("id"), F.concat(F.lit("Nation "), name).alias("title"), F.concat(F.lit("About "), name).alias("description"), some(2, F.lit("MIT")).alias("license"),
        F.array(n - 10.5, n - 20.5, n + 10.5, n + 20.5).cast("array<double>").alias("bbox"), F.make_timestamp_ntz(2000 + n, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start_datetime"),
        F.make_timestamp_ntz(2001 + n, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("end_datetime"), some(3, F.array(name, F.lit("nation"))).alias("keywords"),
        F.array(F.lit("agb"), F.lit("sd")).alias("variables"), F.create_map(F.lit("agb"), F.lit("Mg/ha")).alias("units"), some(4, n.cast("double") * 10).alias("gsd"),
        F.array(F.struct(F.lit("cite-as").alias("rel"), F.concat(F.lit("https://doi.org/"), name).alias("href")), F.struct(F.lit("via").alias("rel"), F.lit("https://x").alias("href"))).alias("_links"),
    ).withColumn("links", F.transform("_links", lambda x: F.struct(x["rel"].alias("rel"), x["href"].alias("href"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("title")))).drop("_links")


def _fields(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    return df.select(*[F.get_json_object("body", p).alias(n) for n, p in paths.items()])


@query("""SELECT n_name AS id, 'Collection' AS type, 'Nation ' || n_name AS title, 'About ' || n_name AS description, CASE WHEN n_nationkey % 2 <> 0 THEN 'MIT' ELSE 'CC-BY-4.0' END AS license,
  '[' || CAST(n_nationkey - 10.5 AS DECIMAL(9,1)) || ',' || CAST(n_nationkey - 20.5 AS DECIMAL(9,1)) || ',' || CAST(n_nationkey + 10.5 AS DECIMAL(9,1)) || ',' || CAST(n_nationkey + 20.5 AS DECIMAL(9,1)) || ']' AS bbox,
  (2000 + n_nationkey) || '-01-01T00:00:00Z' AS start, (2001 + n_nationkey) || '-12-31T00:00:00Z' AS ends, CASE WHEN n_nationkey % 3 <> 0 THEN '["' || n_name || '","nation"]' ELSE '[]' END AS keywords,
  '["agb","sd"]' AS variables, 'Mg/ha' AS unit, 'https://doi.org/' || n_name AS doi, 'via' AS second FROM nation""")
def collections_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bodies.collection_bodies(_configs(spark, sf_dir)).select(F.to_json("body").alias("body"))
    return _fields(docs, {
        "id": "$.id", "type": "$.type", "title": "$.title", "description": "$.description", "license": "$.license", "bbox": "$.extent.spatial.bbox[0]", "start": "$.extent.temporal.interval[0][0]", "ends": "$.extent.temporal.interval[0][1]",
        "keywords": "$.keywords", "variables": "$.summaries.variables", "unit": "$.summaries.units_by_variable.agb", "doi": "$.links[0].href", "second": "$.links[1].rel",
    })


@query("""SELECT n_name || '_v' || v AS id, n_name AS collection, 'Feature' AS type, 'Nation ' || n_name AS product_name, v AS version,
  CASE WHEN v = '2.0' THEN '1990-01-01T00:00:00Z' ELSE (2000 + n_nationkey) || '-01-01T00:00:00Z' END AS start, CASE WHEN v = '2.0' THEN '1999-12-31T00:00:00Z' ELSE (2001 + n_nationkey) || '-12-31T00:00:00Z' END AS dated,
  CASE WHEN n_nationkey % 4 <> 0 THEN CAST(CAST(n_nationkey * 10 AS DECIMAL(9,1)) AS VARCHAR) END AS gsd, CAST(CAST(n_nationkey + 20.5 AS DECIMAL(9,1)) AS VARCHAR) AS north,
  'c/' || n_name || '/' || n_name || '_v' || v || '_1m.zarr' AS href, 'application/vnd.zarr' AS media_type, 'Nation ' || n_name || ' (1m)' AS asset_title, '["data"]' AS roles, 'agb' AS band, 'Mg/ha' AS unit, 'cite-as' AS link, NULL AS second
  FROM nation, (VALUES ('1.0'), ('2.0')) q(v)""")
def items_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _configs(spark, sf_dir)
    versions = configs.select(F.col("id").alias("collection_id"), F.explode(F.array(F.lit("1.0"), F.lit("2.0"))).alias("version"))
    items = tables.items_of(configs.select(F.col("id").alias("collection_id")), versions)
    assets = tables.assets_of(items, configs.select(F.col("id").alias("collection_id"), F.lit("1m").alias("resolution")), "c")
    periods = versions.where("version = '2.0'").withColumns({"start": F.lit("1990-01-01").cast("timestamp_ntz"), "end": F.lit("1999-12-31").cast("timestamp_ntz")})
    docs = bodies.item_bodies(items, configs, assets, periods).select(F.to_json("body").alias("body"))
    return _fields(docs, {
        "id": "$.id", "collection": "$.collection", "type": "$.type", "product_name": "$.properties.product_name", "version": "$.properties.version", "start": "$.properties.start_datetime", "dated": "$.properties.datetime",
        "gsd": "$.properties['eo:gsd']", "north": "$.geometry.coordinates[0][1][1]", "href": "$.assets.zarr_1m.href", "media_type": "$.assets.zarr_1m.type", "asset_title": "$.assets.zarr_1m.title", "roles": "$.assets.zarr_1m.roles",
        "band": "$.assets.zarr_1m['raster:bands'][0].name", "unit": "$.assets.zarr_1m['raster:bands'][0].unit", "link": "$.links[0].rel", "second": "$.links[1].rel",
    })


@query("SELECT 'root' AS id, 'Catalog' AS type, 'All' AS title, 'MIT' AS license, CAST(count(*) AS BIGINT) AS children, 'https://p/R0/catalog.json' AS first FROM region")
def root_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's document: its own fields, and a link to each region's catalog."""
    nodes = _nodes(spark, sf_dir).where("kind = 'catalog'")
    top = bodies.catalog_bodies(spark.createDataFrame([("root", "All", None)], "id string, title string, description string"), {"license": F.lit("MIT")})
    docs = tree.documents(nodes, [top], "s3://w", "https://p")
    link = F.from_json(F.get_json_object("body", "$.links"), "array<struct<rel:string,href:string>>")
    children = F.filter(link, lambda x: x["rel"] == "child")
    return docs.select(*[F.get_json_object("body", f"$.{n}").alias(n) for n in ("id", "type", "title", "license")], F.size(children).cast("bigint").alias("children"), F.array_sort(F.transform(children, lambda x: x["href"]))[0].alias("first"))

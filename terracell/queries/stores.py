"""Stores: cubes written below the shared folder and read back, through the catalog, in layers, and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.catalog.tables import Catalog, assets_of, items_of
from terracell.cube import Cube
from terracell.functions.dates import day_code
from terracell.grid import digests
from terracell.operators import coarsen as C
from terracell.operators import subset
from terracell.plans import alerts
from terracell.queries import query
from terracell.queries.cubes import GRID, HALF, OBS, STATIC, observations, static, table
from terracell.session import shared_folder
from terracell.sources import buckets, store
from terracell.streaming.slices import ingest


@query(f"WITH {STATIC} SELECT iy, ix, v, q FROM static")
def store_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "store")
    store.write(static(spark, sf_dir), path, (8, 8))
    return store.read(spark, path).df.select("iy", "ix", "v", "q")


@query(f"WITH {OBS} SELECT iy, ix, yr, CASE WHEN yr = 1997 THEN -v ELSE v END AS v FROM obs")
def store_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices in two parts, one year of which is written again with other values."""
    path, cube = shared_folder(spark, "store"), observations(spark, sf_dir).select("v")
    store.write(cube.having(cube.df.where("yr <= 1997")), path, (8, 8))
    store.write(cube.having(cube.df.where("yr > 1997")), path, (8, 8), append=True)
    store.write(cube.having(cube.df.where("yr = 1997").withColumn("v", -F.col("v"))), path, (8, 8), append=True)
    return store.read(spark, path, ["v"]).df


@query(f"WITH {STATIC} SELECT coalesce(o.iy, s.iy) AS iy, coalesce(o.ix, s.ix) AS ix, o.yr, o.v AS yearly, s.v, s.q FROM (SELECT * FROM obs WHERE iy < 24) o FULL JOIN static s ON o.iy = s.iy AND o.ix = s.ix")
def store_static_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static layers, beside which slices are appended; cells of the last rows have static layers only."""
    path, slices = shared_folder(spark, "store"), observations(spark, sf_dir).select("v")
    store.write(static(spark, sf_dir), path, (8, 8))
    store.write(slices.having(slices.df.where("iy < 24").withColumnRenamed("v", "yearly")), path, (8, 8), append=True)
    return store.read(spark, path).df.select("iy", "ix", "yr", "yearly", "v", "q")


@query(f"WITH {OBS} SELECT iy, ix, yr, CASE WHEN yr <> 1998 THEN v END AS v, CASE WHEN yr >= 1998 THEN v % 100 END AS w FROM obs")
def store_new_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices to which later ones bring a second variable: one slice with the new one only, others with both, one of these in two commits."""
    path, cube = shared_folder(spark, "store"), observations(spark, sf_dir).select("v")
    more = cube.having(cube.df.withColumn("w", F.col("v") % 100))
    store.write(cube.having(cube.df.where("yr < 1998 or yr = 2000")), path, (8, 8))
    store.write(more.having(more.df.where("yr = 1998").drop("v")), path, (8, 8), append=True)
    store.write(more.having(more.df.where("yr > 1998 and yr <> 2000")), path, (8, 8), append=True)
    store.write(more.having(more.df.where("yr = 2000").drop("v")), path, (8, 8), append=True)
    return store.read(spark, path).df.select("iy", "ix", "yr", "v", "w")


@query(f"WITH {STATIC} SELECT iy, ix, CASE WHEN iy < 20 THEN -v END AS v, CASE WHEN ix < 9 THEN q END AS q FROM static WHERE iy < 20 OR ix < 9")
def store_second_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static layers that are appended one by one, the first of which is written again."""
    path, cube = shared_folder(spark, "store"), static(spark, sf_dir)
    store.write(cube.select("v"), path, (8, 8))
    store.write(cube.having(cube.df.where("ix < 9").select("iy", "ix", "q")), path, (8, 8), append=True)
    store.write(cube.having(cube.df.where("iy < 20").select("iy", "ix", (-F.col("v")).alias("v"))), path, (8, 8), append=True)
    return store.read(spark, path).df.select("iy", "ix", "v", "q")


@query(f"WITH {STATIC} SELECT '1' AS resolution, iy, ix, v FROM static UNION ALL SELECT '4', iy // 4, ix // 4, CAST(sum(v) AS BIGINT) FROM static GROUP BY 2, 3")
def store_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = static(spark, sf_dir).select("v")
    paths = store.write_all({"1": fine, "4": C.coarsen(fine, 4, "sum")}, shared_folder(spark, "region"))
    parts = [store.read(spark, p).df.select(F.lit(r).alias("resolution"), "iy", "ix", "v") for r, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query(f"WITH {STATIC} SELECT iy, ix, v FROM static WHERE ix BETWEEN 3 AND 9 AND iy BETWEEN 5 AND 20")
def scan_by_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable of an item's asset, found by collection, version and resolution, in a box."""
    base = shared_folder(spark, "catalog")
    themes = spark.createDataFrame([("t", "T")], "theme_id string, title string")
    collections = spark.createDataFrame([("SUMS", "t", "Sums")], "collection_id string, theme_id string, title string")
    items = items_of(collections, spark.createDataFrame([("SUMS", "1.0")], "collection_id string, version string"))
    assets = assets_of(items, spark.createDataFrame([("SUMS", "10m")], "collection_id string, resolution string"), base, "parquet")
    store.write(static(spark, sf_dir), assets.first()["href"], (8, 8))
    catalog = Catalog(themes, collections, items, assets, assets.select("item_id", "asset_key"))
    return subset.bbox(store.open_item(spark, catalog, "SUMS", "1.0", "10m", ["v"], "parquet"), 3.5, 5.5, 9.5, 20.5).df


@query(f"WITH {STATIC} SELECT coalesce(a.iy, b.iy) AS iy, coalesce(a.ix, b.ix) AS ix, a.v AS upper, b.v AS lower FROM (SELECT * FROM static WHERE iy < 20) a FULL JOIN (SELECT * FROM static WHERE iy >= 10) b ON a.iy = b.iy AND a.ix = b.ix")
def layers_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = static(spark, sf_dir).df.select("iy", "ix", F.col("v").alias("value"))
    return store.layers({"upper": cells.where("iy < 20"), "lower": cells.where("iy >= 10")})


@query(f"WITH {OBS} SELECT iy, ix, yr, v FROM obs")
def slices_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of observations taken up as they come, each slice once, although the stream is started twice."""
    source, target, progress = (shared_folder(spark, n) for n in ("in", "out", "progress"))
    df = observations(spark, sf_dir).df.select("iy", "ix", "yr", "v")
    for part in ("yr <= 1998", "yr > 1998"):
        df.where(part).write.mode("append").parquet(source)
        ingest(spark, source, df.schema, GRID, "yr", target, progress).awaitTermination(120)
    return store.read(spark, target, ["v"]).df


@query(f"WITH {OBS} SELECT iy, ix, yr, CASE WHEN iy BETWEEN 10 AND 19 THEN -v ELSE v END AS v FROM obs")
def slices_in_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices come in two batches that overlap; where they do, the second counts. A third start finds nothing new."""
    source, target, progress = (shared_folder(spark, n) for n in ("in", "out", "progress"))
    df = observations(spark, sf_dir).df.select("iy", "ix", "yr", "v")
    for part in (df.where("iy < 20"), df.where("iy >= 10").withColumn("v", F.when(F.col("iy") < 20, -F.col("v")).otherwise(F.col("v"))), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        ingest(spark, source, df.schema, GRID, "yr", target, progress).awaitTermination(120)
    store.compacted(spark, target)
    return store.read(spark, target, ["v"]).df


@query("SELECT '32x32' AS shape, 64 AS digits, (SELECT count(DISTINCT n_regionkey) FROM nation) AS kinds")
def grid_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of grids that differ by their origin only, one for a region, are as many."""
    origins = table(spark, sf_dir, "nation").select("n_regionkey")
    digest = digests(GRID.crs, F.col("n_regionkey"), F.lit(0), F.lit(1), F.lit(1), F.lit(GRID.width), F.lit(GRID.height))
    df = origins.select(F.lit(f"{GRID.width}x{GRID.height}").alias("shape"), digest.alias("digest"))
    return df.groupBy("shape").agg(F.max(F.length("digest")).alias("digits"), F.countDistinct("digest").alias("kinds"))


@query("""WITH cells AS (SELECT o_custkey % 16 AS iy, o_custkey // 16 % 16 AS ix, max(CAST(strftime(o_orderdate, '%y%j') AS INTEGER)) AS code FROM orders GROUP BY 1, 2),
  known AS (SELECT *, CASE ix % 5 WHEN 4 THEN NULL WHEN 3 THEN 9 ELSE ix % 2 END AS mask, make_date(2000 + code // 1000, 1, 1) + (code % 1000 - 1) AS day FROM cells)
  SELECT iy, ix, CAST(make_date(2099, CAST(m AS INTEGER), 1) AS DATE) AS t, CAST(CASE WHEN mask IS NULL OR mask = 9 THEN -9999 WHEN mask = 1 AND year(day) = 2099 AND month(day) = m THEN 1 ELSE 0 END AS SMALLINT) AS disturbance_occurrence,
    CAST(CASE WHEN mask IN (0, 1) THEN mask ELSE -9999 END AS SMALLINT) AS forest_mask, code AS alert_yydoy FROM known, range(1, 13) r(m)""")
def alert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated alerts (the last order's date of each cell) ingested as static layers and monthly slices of a store, and read back."""
    custkey = F.col("o_custkey")
    cells = table(spark, sf_dir, "orders").groupBy((custkey % 16).alias("iy"), (F.floor(custkey / 16) % 16).alias("ix")).agg(F.max(day_code(F.col("o_orderdate"))).alias("alert"))
    mask = F.when(F.col("ix") % 5 == 4, F.lit(None)).when(F.col("ix") % 5 == 3, 9).otherwise(F.col("ix") % 2)
    path = shared_folder(spark, "alerts")
    alerts.ingest(Cube(cells.withColumn("forest_mask", mask.cast("double")), HALF), path, "2099-01-01", "2099-12-01", (8, 8))
    return store.read(spark, path).df.select("iy", "ix", F.to_date("time").alias("t"), "disturbance_occurrence", "forest_mask", "alert_yydoy")


@query(f"""WITH {STATIC} SELECT coalesce(a.iy, b.iy) AS iy, coalesce(a.ix, b.ix) AS ix, a.v, b.q FROM (SELECT * FROM static WHERE iy % 3 <> 0) a
  FULL JOIN (SELECT * FROM static WHERE ix % 4 <> 0) b ON a.iy = b.iy AND a.ix = b.ix""")
def buckets_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores in buckets of chunks, which hold other cells, as one cube."""
    cube, parts = static(spark, sf_dir), []
    for variable, rows in (("v", "iy % 3 <> 0"), ("q", "ix % 4 <> 0")):
        path = shared_folder(spark, "buckets")
        buckets.write(cube.having(cube.df.where(rows)).select(variable), path, (8, 8), 8)
        parts.append(buckets.read(spark, path))
    return buckets.merge(parts).plain().df.select("iy", "ix", "v", "q")


@query(f"WITH {STATIC} SELECT iy // 4 AS iy, ix // 4 AS ix, CAST(sum(v) AS BIGINT) AS v FROM static WHERE q % 2 = 0 GROUP BY 1, 2")
def buckets_masked_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets, masked by another and made coarser, in its buckets."""
    cube, paths = static(spark, sf_dir), [shared_folder(spark, "buckets") for _ in range(2)]
    buckets.write(cube.select("v"), paths[0], (8, 8), 8)
    even = cube.having(cube.df.select("iy", "ix", (F.col("q") % 2).cast("int").alias("odd")))
    buckets.write(even, paths[1], (8, 8), 8)
    cells, mask = (buckets.read(spark, p) for p in paths)
    return buckets.coarsened(buckets.masked(cells, mask, "odd", 0), 4, "sum").plain().df

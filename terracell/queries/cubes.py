"""Cubes derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.cube import Cube
from terracell.functions.dates import day_code
from terracell.grid import GridSpec

SIZE = 32
GRID = GridSpec("EPSG:3035", 0.0, 0.0, 1.0, 1.0, SIZE, SIZE)
NORTH_UP = GridSpec("EPSG:3035", 0.0, 32.0, 1.0, -1.0, SIZE, SIZE)
HALF = GridSpec("EPSG:3035", 0.0, 0.0, 2.0, 2.0, 16, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, yr, v in cents, q): line items by part and supplier, summed over a year."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    df = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % SIZE).alias("iy"), (F.col("l_partkey") % SIZE).alias("ix"), F.year("l_shipdate").alias("yr"))
        .agg(F.sum(cents).alias("v"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    )
    return Cube(df, GRID, "yr")


def static(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, v, q): the observations of all years."""
    obs = observations(spark, sf_dir)
    return Cube(obs.df.groupBy("iy", "ix").agg(F.sum("v").alias("v"), F.max("q").alias("q")), GRID)


def events(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, ts, event_id, value, event_type): one row for an event."""
    df = table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("iy"), (F.col("user_id") % 16).alias("ix"), "ts", "event_id", "value", "event_type")
    return Cube(df, HALF, "ts")


def event_cells(spark: SparkSession, sf_dir: str) -> Cube:
    """(iy, ix, c in cents): event values summed over time, on cells twice as wide."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return Cube(events(spark, sf_dir).df.groupBy("iy", "ix").agg(F.sum(cents).alias("c")), HALF)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, pos, e): embeddings as an axis of 64 positions."""
    from terracell.operators.reduce import exploded

    return exploded(table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e")), "e", "pos", "e")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, o_orderkey, code): dates as YYddd."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("ix"), "o_orderkey", day_code(F.col("o_orderdate")).alias("code"))


OBS = """obs AS (SELECT l_suppkey % 32 AS iy, l_partkey % 32 AS ix, CAST(year(l_shipdate) AS INTEGER) AS yr,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2, 3)"""
STATIC = OBS + """, static AS (SELECT iy, ix, CAST(sum(v) AS BIGINT) AS v, max(q) AS q FROM obs GROUP BY 1, 2)"""
EVENTS = """evt AS (SELECT event_id % 16 AS iy, user_id % 16 AS ix, ts, event_id, value, event_type FROM events)"""
EVENT_CELLS = EVENTS + """, cells AS (SELECT iy, ix, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM evt GROUP BY 1, 2)"""
ENSEMBLE = """ens AS (SELECT label, CAST(pos AS INTEGER) AS pos, CAST(e AS DOUBLE) AS e FROM (SELECT label, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))"""
ALERTS = """alerts AS (SELECT o_custkey % 16 AS ix, o_orderkey, CAST(strftime(o_orderdate, '%y%j') AS INTEGER) AS code FROM orders)"""

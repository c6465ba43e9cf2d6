"""Value transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.catalog.products import LEGENDS
from terracell.operators import values as V
from terracell.queries import query
from terracell.queries.cubes import ALERTS, STATIC, alerts, static, table

_ODD = "CASE event_type WHEN 'error' THEN 'NaN'::DOUBLE WHEN 'signup' THEN 'Infinity'::DOUBLE WHEN 'purchase' THEN NULL ELSE value END"
_AGENTS = ", ".join(f"({k}, '{v}')" for k, v in LEGENDS["agent"].items() if k != 3)


def _odd() -> F.Column:
    return F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("inf")).when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.col("value"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN -9999 ELSE value END AS v FROM events")
def fill_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.filled(_odd(), -9999.0).alias("v"))


@query("SELECT event_id, nullif(user_id % 4, 0) AS v FROM events")
def zero_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.zero_missing(F.col("user_id") % 4).alias("v"))


@query("SELECT event_id, CASE WHEN value >= 100 THEN value END AS v FROM events")
def clamp_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.at_least(F.col("value"), 100).alias("v"))


@query("SELECT event_id, CAST(CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN -9999 ELSE trunc(value) END AS INTEGER) AS v FROM events")
def fill_then_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.filled_as(_odd(), -9999, "int").alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN CAST(l_quantity AS INTEGER) % 24 > 0 THEN CAST(l_quantity AS INTEGER) % 24 + 2000 ELSE 0 END AS SMALLINT) AS loss_year FROM lineitem")
def loss_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.loss_year(F.col("l_quantity").cast("int") % 24).alias("loss_year"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE (CASE WHEN year(o_orderdate) < 2000 THEN year(o_orderdate) + 100 ELSE year(o_orderdate) END - 1970) * 12 + month(
  CASE WHEN year(o_orderdate) < 2000 THEN make_date(CAST(year(o_orderdate) + 100 AS INTEGER), 1, 1) ELSE make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) END + CAST(dayofyear(o_orderdate) - 1 AS INTEGER)) - 1 END AS INTEGER) AS month_index
  FROM orders""")
def yyddd_month_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("code", F.when(F.col("o_orderkey") % 11 == 0, F.floor(F.col("code") / 1000) * 1000 + 400).otherwise(F.col("code")))
    return rows.select("o_orderkey", V.month_index(F.col("code")).alias("month_index"))


_STEPS = "SELECT CAST(d AS DATE) AS t, (year(d) - 1970) * 12 + month(d) - 1 AS month FROM generate_series(DATE '2000-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) s(d)"


@query(f"""WITH {ALERTS}, cells AS (SELECT ix, max(code) FILTER (code < 2000) AS code, CASE ix % 4 WHEN 3 THEN NULL WHEN 2 THEN 7 ELSE ix % 4 END AS mask FROM alerts GROUP BY ix),
  dated AS (SELECT ix, mask, (2000 + code // 1000 - 1970) * 12 + month(make_date(2000 + code // 1000, 1, 1) + (code % 1000 - 1)) - 1 AS idx FROM cells), steps AS ({_STEPS})
  SELECT ix, t, CAST(CASE WHEN mask IS NULL OR mask NOT IN (0, 1) THEN -9999 WHEN mask = 0 THEN 0 WHEN idx = month THEN 1 ELSE 0 END AS SMALLINT) AS occurrence FROM dated, steps""")
def alert_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.when(F.col("ix") % 4 == 3, F.lit(None)).when(F.col("ix") % 4 == 2, 7).otherwise(F.col("ix") % 4)
    cells = alerts(spark, sf_dir).groupBy("ix").agg(F.max(F.when(F.col("code") < 2000, F.col("code"))).alias("code")).select("ix", V.month_index(F.col("code")).alias("idx"), mask.alias("mask"))
    return V.monthly(cells, "idx", "mask", V.months(spark, "2000-01-01", "2001-12-01"), "occurrence").select("ix", "t", "occurrence")


@query("SELECT event_id, CASE WHEN user_id % 5 IN (0, 1) THEN user_id % 5 ELSE -9999 END AS mask FROM events")
def domain_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.in_domain(F.col("user_id") % 5).alias("mask"))


@query("""SELECT CAST(d AS DATE) AS t, CAST((year(d) - 1970) * 12 + month(d) - 1 AS INTEGER) AS month, count(o_orderkey) AS n
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS d FROM orders) s LEFT JOIN orders ON date_trunc('month', o_orderdate) = d GROUP BY 1, 2""")
def month_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each month from the first to the last, months without any included."""
    orders = table(spark, sf_dir, "orders")
    first, last = orders.agg(F.date_format(F.trunc(F.min("o_orderdate").cast("date"), "month"), "yyyy-MM-dd"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()
    counts = orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return V.months(spark, first, last).join(counts, "t", "left").select("t", "month", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT m AS meaning, count(*) AS n FROM lineitem LEFT JOIN (VALUES {_AGENTS}) t(k, m) ON CAST(l_quantity AS INTEGER) % 4 = k GROUP BY 1")
def legend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") % 4).alias("agent"))
    return V.decoded(rows, "agent", {k: v for k, v in LEGENDS["agent"].items() if k != 3}).groupBy("meaning").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATIC} SELECT iy, ix, CAST(round(v * 0.1 + 2, 4) AS DOUBLE) AS v FROM static")
def scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static(spark, sf_dir).df.select("iy", "ix", F.round(V.scaled(F.col("v"), 0.1, 2), 4).alias("v"))


@query("SELECT event_id, CASE WHEN value BETWEEN 5 AND 400 THEN value END AS v FROM events")
def valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.within(F.col("value"), 5, 400).alias("v"))

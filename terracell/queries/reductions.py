"""Reductions over time, space, ensembles and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import coarsen, subset
from terracell.operators import reduce as R
from terracell.queries import query
from terracell.queries.cubes import ENSEMBLE, OBS, STATIC, ensemble, observations, static, table


@query(f"WITH {STATIC} SELECT iy, ix, v, CAST(q AS BIGINT) AS q FROM (SELECT iy, ix, CAST(sum(v) AS BIGINT) AS v, sum(q) AS q FROM obs GROUP BY 1, 2)")
def sum_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.over_time(observations(spark, sf_dir), "sum").df


@query(f"WITH {OBS} SELECT yr, count(*) FILTER (q > 40) AS n FROM obs GROUP BY 1")
def annual_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by_time(observations(spark, sf_dir), F.col("q") > 40)


@query(f"WITH {OBS} SELECT yr, count(*) FILTER (q > 40) AS n FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def worst_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.peak(R.counts_by_time(observations(spark, sf_dir), F.col("q") > 40), "yr", "n")


@query(f"WITH {ENSEMBLE} SELECT label, pos, round(avg(e), 8) AS mean FROM ens GROUP BY 1, 2")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.axis_mean(ensemble(spark, sf_dir), ["label", "pos"], "e").withColumn("mean", F.round("mean", 8))


@query(f"WITH {ENSEMBLE}, m AS (SELECT label, pos, round(avg(e), 8) AS mean FROM ens GROUP BY 1, 2) SELECT label, pos, mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, pos) AS r FROM m) WHERE r = 1")
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dominant(ensemble_mean(spark, sf_dir), ["label"], "pos", "mean")


@query(f"WITH {STATIC} SELECT q, round(avg(v), 4) AS mean FROM static GROUP BY 1")
def regional_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.axis_mean(static(spark, sf_dir).df, ["q"], "v").withColumn("mean", F.round("mean", 4))


@query(f"WITH {ENSEMBLE} SELECT label, pos, round(quantile_cont(e, 0.25), 8) AS q25, round(quantile_cont(e, 0.75), 8) AS q75, round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 8) AS iqr FROM ens GROUP BY 1, 2")
def ensemble_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.interquartile(ensemble(spark, sf_dir), ["label", "pos"], "e")
    return rows.select("label", "pos", *[F.round(c, 8).alias(c) for c in ("q25", "q75", "iqr")])


@query(f"WITH {OBS} SELECT iy, ix, median(CAST(v AS DOUBLE)) AS median, round(avg(v), 4) AS mean FROM obs GROUP BY 1, 2")
def reduce_for_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).df.groupBy("iy", "ix").agg(F.median(F.col("v").cast("double")).alias("median"), F.round(F.avg("v"), 4).alias("mean"))


@query(f"WITH {OBS} SELECT min(v) AS min_value, max(v) AS max_value FROM obs")
def minmax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extremes(observations(spark, sf_dir), "v")


@query(f"""WITH {OBS}, a AS (SELECT iy, ix, v FROM obs WHERE yr = 1997), b AS (SELECT iy, ix, v FROM obs WHERE yr = 1999)
  SELECT count(*) AS n, round(avg(CAST(a.v - b.v AS DOUBLE)), 2) AS mean_difference, round(sqrt(avg(CAST(a.v - b.v AS DOUBLE) * (a.v - b.v))), 2) AS rmsd FROM a JOIN b ON a.iy = b.iy AND a.ix = b.ix""")
def compare_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = observations(spark, sf_dir).select("v")
    rows = R.compared(subset.at_label(cube, 1997), subset.at_label(cube, 1999), "v", "v")
    return rows.select("n", F.round("mean_difference", 2).alias("mean_difference"), F.round("rmsd", 2).alias("rmsd"))


@query(f"WITH {OBS} SELECT iy // 4 AS iy, ix // 4 AS ix, yr, CAST(trunc(sum(v) / count(v)) AS BIGINT) AS v FROM obs WHERE ix + 0.5 BETWEEN 0 AND 24 AND yr BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3")
def flagship_subset_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and a range of years of the time cube, made coarser by four."""
    cube = subset.bbox(observations(spark, sf_dir).select("v"), 0, 0, 24, 32)
    return coarsen.coarsen(cube.having(cube.df.where(F.col("yr").between(1996, 2000))), 4, "mean").df


@query("""SELECT quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.5) AS middle, quantile_cont(v, 0.95) AS high FROM (SELECT CAST(round(l_extendedprice * 100) AS DOUBLE) AS v FROM lineitem)""")
def quantiles_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all line items' prices in cents, one group of all rows."""
    prices = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") * 100).alias("v"))
    return R.selected(prices, [], "v", {"low": 0.05, "middle": 0.5, "high": 0.95})


@query("""SELECT l_returnflag, l_linestatus, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM (SELECT l_returnflag, l_linestatus, CAST(l_partkey AS DOUBLE) AS v FROM lineitem) GROUP BY 1, 2""")
def quantiles_of_few_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.selected(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey", {"q25": 0.25, "q75": 0.75})

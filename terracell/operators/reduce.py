"""Reductions over time, space, ensembles and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.cube import CELL, Cube
from terracell.session import shared_folder


def over_time(cube: Cube, how: str = "sum") -> Cube:
    """One row for a cell: an aggregate of each variable over all times, NULLs left out."""
    return cube.having(cube.df.groupBy(*CELL).agg(*[getattr(F, how)(v).alias(v) for v in cube.variables]), time=None)


def counts_by_time(cube: Cube, condition: Column, out: str = "n") -> DataFrame:
    """Cells that meet a condition at each time; times at which none does count 0."""
    return cube.df.groupBy(cube.time).agg(F.count_if(condition).alias(out))


def peak(df: DataFrame, label: str, value: str) -> DataFrame:
    """The one row with the greatest value, the first label on a tie."""
    return df.orderBy(F.col(value).desc(), F.col(label)).limit(1)


def exploded(df: DataFrame, array: str, position: str = "pos", value: str = "value") -> DataFrame:
    """One row for an entry of an array column, such as an ensemble member or an age class."""
    rest = [F.col(c) for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(position, value))


def axis_mean(df: DataFrame, keys: list[str], value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(out))


def dominant(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """(keys, position, value): the position with the greatest value in each group, the first on a tie."""
    best = F.min_by(F.struct(position, value), F.struct(-F.col(value), F.col(position)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{position}", f"_b.{value}")


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group, one column for each. A task holds a group's distinct values; of large groups, take selected()."""
    return df.groupBy(*keys).agg(*[F.percentile(F.col(value).cast("double"), q).alias(n) for n, q in at.items()])


def selected(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """quantiles() of groups of any size, all rows in one group (no keys) included: nothing holds a group.

    Equal values are counted first. Values are range-sorted, by key, and written; counts of each part of a key say
    which part holds a wanted rank, and only these parts are looked through. NULLs are left out; a group of NULLs only
    has no row.
    """
    spark = df.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    path = shared_folder(spark, "quantiles")
    rows.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    sums = parts.groupBy(*names, "_part").agg(F.sum("_n").alias("_m"))
    own = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # a row for each part of a key
    sums = sums.withColumns({"_total": F.sum("_m").over(own), "_before": F.coalesce(F.sum("_m").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    places = {n: F.lit(float(q)) * (F.col("_total") - 1) for n, q in at.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places.values()])))
    wanted = sums.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))).where(F.size("_ranks") > 0)
    wanted = wanted.select(*[F.col(n).alias(f"_w{n}") for n in names], F.col("_part").alias("_p"), "_ranks", "_before", "_total")
    same = F.col("_part") == F.col("_p")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_w{n}"))
    found = parts.join(wanted, same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_upto", upto).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))))
    held = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"), F.max("_total").alias("_total"))  # two ranks for each quantile at most
    take = lambda r: F.element_at("_at", r)
    out = [(take(F.floor(p)) + (p - F.floor(p)) * (take(F.ceil(p)) - take(F.floor(p)))).alias(n) for n, p in places.items()]
    return held.where("_total is not null").select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *out)


def interquartile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75}).withColumn("iqr", F.col("q75") - F.col("q25"))


def extremes(cube: Cube, variable: str) -> DataFrame:
    return cube.df.agg(F.min(variable).alias("min_value"), F.max(variable).alias("max_value"))


def compared(left: Cube, right: Cube, a: str, b: str) -> DataFrame:
    """(n, mean_difference, rmsd) over cells where both are finite."""
    x, y = left.df.select(*CELL, F.col(a).cast("double").alias("_a")), right.df.select(*CELL, F.col(b).cast("double").alias("_b"))
    d = F.col("_a") - F.col("_b")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return x.join(y, list(CELL)).where(finite(F.col("_a")) & finite(F.col("_b"))).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.sqrt(F.avg(d * d)).alias("rmsd"))

"""Value transforms: missing data, recoding, legends, date codes. All are Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    d = v.cast("double")
    return v.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def filled(v: Column, fill: object) -> Column:
    """v, with fill for NULL, NaN and both infinities."""
    return F.when(is_finite(v), v).otherwise(F.lit(fill))


def filled_as(v: Column, fill: object, kind: str) -> Column:
    """filled(), then cast toward zero: in this order, as NaN can't be an integer."""
    return filled(v, fill).cast(kind)


def finite_or_null(v: Column) -> Column:
    return F.when(is_finite(v), v)


def zero_missing(v: Column) -> Column:
    return F.when(v != 0, v)


def at_least(v: Column, least: float) -> Column:
    """v where it is at least `least`; smaller values are missing, not clipped."""
    return F.when(v >= least, v)


def within(v: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.when(ok, v)


def scaled(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return v * scale + offset


def loss_year(code: Column, fill: int = 0) -> Column:
    """Calendar year of a loss code (years since 2000); codes that aren't positive, or missing, give fill."""
    return F.when(code > 0, code + 2000).otherwise(F.lit(fill)).cast("smallint")


def month_index(code: Column, missing: int = -1) -> Column:
    """Months since 1970-01 of a two-digit year and day of the year (YYddd); missing for codes that name no day."""
    c = code.cast("int")
    year, day = F.floor(c / 1000) + 2000, c % 1000
    start = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    last = F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31)))
    at = F.date_add(start, (day - 1).cast("int"))
    months = (F.year(at) - 1970) * 12 + F.month(at) - 1
    return F.when((c > 0) & (c < 100_000) & (day >= 1) & (day <= last), months).otherwise(F.lit(missing)).cast("int")


def month_number(day: date) -> int:
    return (day.year - 1970) * 12 + day.month - 1


def in_domain(mask: Column, allowed: tuple[int, ...] = (0, 1), fill: int = -9999) -> Column:
    """A mask's value where it is finite and allowed, fill elsewhere."""
    return F.when(is_finite(mask) & mask.isin(*allowed), mask).otherwise(F.lit(fill))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(t, month): month starts from first to last and their months since 1970-01."""
    t = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month")))
    return spark.range(1).select(t.alias("t")).withColumn("month", ((F.year("t") - 1970) * 12 + F.month("t") - 1).cast("int"))


def monthly(cells: DataFrame, index: str, mask: str, every: DataFrame, out: str, fill: int = -9999) -> DataFrame:
    """One row for a cell and month: 1 in the month of its index, 0 otherwise and outside the forest, fill outside the mask's domain.

    every: months(), tens of rows, made from the arguments; each cell is repeated for them where it stands.
    """
    steps = F.array(*[F.struct(F.lit(r["t"]).alias("t"), F.lit(r["month"]).alias("month")) for r in every.orderBy("t").collect()])
    rows = cells.withColumn("_m", F.explode(steps))
    hit = F.when(F.col(index) == F.col("_m.month"), 1).otherwise(0)
    value = F.when(~F.col(mask).isin(0, 1) | F.col(mask).isNull(), F.lit(fill)).when(F.col(mask) == 0, 0).otherwise(hit)
    return rows.select(*cells.columns, F.col("_m.t").alias("t"), value.cast("smallint").alias(out))


def legend(spark: SparkSession, entries: dict[int, str]) -> DataFrame:
    """(code, meaning) of a legend."""
    return spark.createDataFrame(sorted(entries.items()), "code int, meaning string")


def decoded(df: DataFrame, column: str, entries: dict[int, str], out: str = "meaning") -> DataFrame:
    """df with what a legend says of a code, NULL for codes that it lacks. A legend is a literal of the plan: a lookup, no join."""
    table = F.create_map(*[F.lit(x) for k, v in sorted(entries.items()) for x in (k, v)])
    return df.withColumn(out, F.try_element_at(table, F.col(column).cast("int")))

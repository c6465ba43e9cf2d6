"""Rules that product configurations must meet, as boolean Columns over a table of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that the rules read.
CONFIG = (
    "id string, title string, description string, license string, bbox array<double>, start_datetime timestamp, end_datetime timestamp, "
    "keywords array<string>, links array<struct<rel:string,href:string,type:string,title:string>>, variables array<string>, raster_bands array<string>"
)


def bbox_in_order(bbox: Column) -> Column:
    """Four numbers: west, south, east, north; west at most east, south at most north."""
    return F.when(F.size(bbox) == 4, (F.get(bbox, 0) <= F.get(bbox, 2)) & (F.get(bbox, 1) <= F.get(bbox, 3))).otherwise(False)


def spdx_like(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[\w\-\.+]+$"), F.lit(False))


def has_citation(links: Column) -> Column:
    return F.coalesce(F.exists(links, lambda x: x["rel"] == "cite-as"), F.lit(False))


def bands_cover(variables: Column, bands: Column) -> Column:
    """Every declared variable is a band; nothing to hold where one of the lists is missing."""
    return F.coalesce(F.size(F.array_except(variables, bands)) == 0, F.lit(True))


RULES = {
    "bbox": lambda: bbox_in_order(F.col("bbox")),
    "license": lambda: spdx_like(F.coalesce("license", F.lit("CC-BY-4.0"))),
    "keywords": lambda: F.coalesce(F.size("keywords") > 0, F.lit(False)),
    "citation": lambda: has_citation(F.col("links")),
    "bands": lambda: bands_cover(F.col("variables"), F.col("raster_bands")),
    "period": lambda: F.coalesce(F.col("start_datetime") <= F.col("end_datetime"), F.lit(True)),
}


def checked(configs: DataFrame) -> DataFrame:
    """configs with `broken`: names of the rules that a row breaks."""
    return configs.withColumn("broken", F.filter(F.array(*[F.when(~rule(), F.lit(name)) for name, rule in RULES.items()]), lambda x: x.isNotNull()))


def validated(configs: DataFrame) -> DataFrame:
    """configs; raises ValueError with up to 20 broken rows."""
    bad = checked(configs).where(F.size("broken") > 0).select("id", "broken").orderBy("id").take(20)
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {', '.join(r['broken'])}" for r in bad))
    return configs

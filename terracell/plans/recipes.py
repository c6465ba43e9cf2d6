"""Ingest recipes: what turns raw layers into a product's cube, as data instead of code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.catalog import products
from terracell.cube import Cube
from terracell.operators import values as V
from terracell.operators.subset import masked_by

Step = Callable[[Column], Column]
INT8, INT16, INT32, FLOAT = "smallint", "smallint", "int", "float"  # unsigned bytes need the next signed type


@dataclass(frozen=True)
class Variable:
    """A stored variable: its raw layer (its own name if None), steps in order, sentinel, type, and what readers undo."""

    name: str
    kind: str
    fill: float | None
    source: str | None = None
    steps: tuple[Step, ...] = ()
    scale: float = 1.0
    legend: str | None = None
    cast_first: bool = False

    def column(self) -> Column:
        v = F.col(self.source or self.name)
        for step in self.steps:
            v = step(v)
        if self.fill is None:
            return V.finite_or_null(v).cast(self.kind).alias(self.name)
        stored = V.filled(v.cast(self.kind), self.fill).cast(self.kind) if self.cast_first else V.filled_as(v, self.fill, self.kind)
        return stored.alias(self.name)


@dataclass(frozen=True)
class Recipe:
    """crs and chunk (rows, columns) of a product, its variables, the time rule, and the mask that variables are kept under.

    time: None, "year" (a slice for January 1st of each year), or "month". scalar_year: the single epoch that
    is an attribute of the cube and no dimension.
    """

    product: str
    crs: str
    variables: tuple[Variable, ...]
    chunk: tuple[int, int] = (2048, 2048)
    time: str | None = None
    scalar_year: int | None = None
    mask: str | None = None
    attributes: dict = field(default_factory=dict)

    def apply(self, raw: Cube, mask: DataFrame | None = None) -> Cube:
        """The product's cube from raw layers (columns by layer name) on one grid.

        Layers that are missing give a ValueError that names them. Sentinels are stored as the recipe says;
        readable() turns them back into NULLs.
        """
        if missing := [v.source or v.name for v in self.variables if (v.source or v.name) not in raw.variables]:
            raise ValueError(f"{self.product} lacks {missing}")
        cube = raw
        if self.mask is not None and mask is not None:
            cube = masked_by(raw, mask, self.mask, keep=1)
        done = cube.df.select(*cube.keys, *[v.column() for v in self.variables])
        attributes = {**self.attributes, **({"time": f"{self.scalar_year}-01-01"} if self.scalar_year else {})}
        return cube.having(done, attributes={k: v for k, v in attributes.items() if v is not None})

    def readable(self, cube: Cube) -> Cube:
        """Sentinels as NULLs, scales applied."""
        out = {}
        for v in self.variables:
            if v.name in cube.variables:
                c = F.col(v.name) if v.fill is None else F.nullif(F.col(v.name), F.lit(v.fill).cast(v.kind))
                out[v.name] = c if v.scale == 1.0 else V.scaled(c, v.scale)
        return cube.having(cube.df.withColumns(out))

    def decoded(self, cube: Cube, variable: str, out: str = "meaning") -> DataFrame:
        legend = next((v.legend for v in self.variables if v.name == variable), None)
        if legend is None:
            raise ValueError(f"{variable} has no legend")
        return V.decoded(cube.df, variable, products.LEGENDS[legend], out)


def _same(names: list[str], kind: str, fill: float | None, **more) -> tuple[Variable, ...]:
    return tuple(Variable(n, kind, fill, **more) for n in names)


def _height() -> tuple[Step, ...]:
    return V.zero_missing, lambda v: V.at_least(v, 0)


GEOGRAPHIC, EUROPE = "EPSG:4326", "EPSG:3035"

# Names, types, sentinels, steps and layouts of each product.
RECIPES = {
    r.product: r
    for r in (
        Recipe("CCI_BIOMASS", GEOGRAPHIC, _same(["aboveground_biomass", "aboveground_biomass_std"], INT32, -9999), time="year"),
        Recipe("SAATCHI_BIOMASS", GEOGRAPHIC, (Variable("aboveground_biomass", INT32, -9999, "agb", (V.zero_missing,), scale=0.1),), (500, 500), scalar_year=2020),
        Recipe("LIU_BIOMASS", EUROPE, (Variable("aboveground_biomass", FLOAT, None), Variable("canopy_cover", INT8, None), Variable("canopy_height", FLOAT, None)), scalar_year=2019),
        Recipe("ROBINSON_CR", GEOGRAPHIC, _same(["cr_a", "cr_b", "cr_k", "cr_a_error", "cr_b_error", "cr_k_error", "max_rate", "age_at_max_rate", "max_removal_potential_benefit_25"], FLOAT, -9999.0)),
        Recipe("EFDA", EUROPE, (Variable("disturbance_occurrence", INT16, -9999), Variable("disturbance_agent", INT16, -9999, legend="agent")), (1000, 1000), time="year", mask="forest_mask"),
        Recipe("JRC_TMF", GEOGRAPHIC, (Variable("TransitionMap_MainClasses", INT16, None, legend="moist_forest"), Variable("TransitionMap_Subtypes", INT16, None, legend="moist_forest_subtypes"), Variable("DegradationYear", INT16, None), Variable("DeforestationYear", INT16, None), Variable("UndisturbedDegradedForest", INT8, None))),
        Recipe("JRC_TMF_ANNUAL", GEOGRAPHIC, (Variable("AnnualChange", INT8, 0, legend="moist_forest_annual"),), time="year"),
        Recipe("HANSEN_GFC", GEOGRAPHIC, (Variable("tree_cover", INT8, None, "treecover2000"), Variable("gain", INT8, None), Variable("data_mask", INT8, None, "datamask"), Variable("loss_year", INT16, 0, "lossyear", (V.loss_year,)))),
        Recipe("RADD_EUROPE", EUROPE, (Variable("disturbance_occurrence", INT16, -9999), Variable("forest_mask", INT16, -9999), Variable("alert_yydoy", INT32, None)), time="month"),
        Recipe("JRC_GFC2020", GEOGRAPHIC, (Variable("forest_cover", INT8, 255),), scalar_year=2020),
        Recipe("GAMI", GEOGRAPHIC, (Variable("forest_age", INT16, -9999),), (500, 500)),
        Recipe("GAMI_AGECLASS", GEOGRAPHIC, (Variable("forest_age", FLOAT, -9999.0, legend="age_class", cast_first=True),), (90, 180)),
        Recipe("POTAPOV_HEIGHT", GEOGRAPHIC, (Variable("canopy_height", FLOAT, -9999.0, steps=_height()),), (2048, 2048), time="year"),
        Recipe("POTAPOV_LCLUC", GEOGRAPHIC, (Variable("canopy_height", FLOAT, -9999.0, steps=_height()),), (2048, 2048), time="year"),
        Recipe("FORESTPATHS_GENUS", EUROPE, (Variable("genus", INT32, 255, legend="genus"),), scalar_year=2020),
        Recipe("WANG_FORESTAGE", GEOGRAPHIC, _same(["natural_forest_age", "planted_forest_age"], INT16, -9999), (500, 500), time="year"),
        Recipe("GEDI_L4D", GEOGRAPHIC, _same(["rh10", "rh20", "rh30", "rh40", "rh50", "rh60", "rh70", "rh80", "rh90", "rh95", "rh98"], FLOAT, -9999.0), (500, 500)),
        Recipe("RESTOR_LANDUSE", products.AMAZON_ALBERS, (Variable("lulc", INT8, 255, legend="land_use"),), (1000, 1000), time="year"),
        Recipe("ALS_PRODUCTS", "EPSG:25830", _same(products.ALS_STRUCTURE, FLOAT, -9999.0), (1024, 1024)),
        Recipe("ULS_PRODUCTS", "EPSG:32632", _same(products.ULS_BANDS, FLOAT, -9999.0), (1024, 1024)),
    )
}


def alert_layers(cells: DataFrame, code: str = "alert", mask: str = "forest_mask") -> DataFrame:
    """Static layers of a dated alert raster: the mask within its domain, and the month of each alert where the mask is known."""
    domain = V.in_domain(F.col(mask), fill=-9999).cast(INT16)
    rows = cells.withColumn("forest_mask", domain)
    return rows.withColumn("month_index", F.when(F.col("forest_mask") == -9999, -9999).otherwise(V.month_index(F.col(code)))).drop(*({code, mask} - {"forest_mask"}))


def missing_variables(product: str, cube: Cube) -> list[str]:
    """Variables of the recipe that a cube lacks."""
    return sorted({v.name for v in RECIPES[product].variables} - set(cube.variables))

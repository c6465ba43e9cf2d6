"""Many polygons at once: a table of rings becomes spans of cells, which masks and zonal statistics join.

Each edge meets the grid's rows whose centres it passes; the crossings of a row, in order, enclose the spans inside.
The work follows the rows that edges cross and the cells that spans hold, not edges times cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.cube import Cube
from terracell.functions.crs import Transform
from terracell.grid import GridSpec

#: Columns of cells in a block: spans and cells meet by row and block.
BLOCK = 256


def edges(polygons: DataFrame, transform: Transform | None = None, step: float | None = None) -> DataFrame:
    """(polygon_id, xa, ya, xb, yb) of polygons (polygon_id, rings: arrays of rings of struct(x, y)), closed where they aren't.

    transform projects from longitude and latitude. step: longest piece, in degrees, that an edge is cut into
    before, so that it bends as it should. The query fails if a corner is outside of the projection. Rings of less
    than three corners have no edges.
    """
    rings = polygons.select("polygon_id", F.explode("rings").alias("r")).where(F.size("r") > 2)
    following = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", 1, 1))
    pairs = rings.select("polygon_id", F.explode(F.zip_with("r", following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).select("polygon_id", "e.a", "e.b")
    pairs = pairs.select("polygon_id", *[F.col(f"{p}.{c}").cast("double").alias(f"{c}{p}") for p in "ab" for c in "xy"])
    if step is not None:
        n = F.greatest(F.ceil(F.greatest(F.abs(F.col("xb") - F.col("xa")), F.abs(F.col("yb") - F.col("ya"))) / step), F.lit(1))
        cut = pairs.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        at = lambda c, k: F.when(k == F.col("n"), F.col(f"{c}b")).otherwise(F.col(f"{c}a") + (F.col(f"{c}b") - F.col(f"{c}a")) * (k / F.col("n")))
        pairs = cut.select("polygon_id", at("x", F.col("k")).alias("xa"), at("y", F.col("k")).alias("ya"), at("x", F.col("k") + 1).alias("xb"), at("y", F.col("k") + 1).alias("yb"))
    if transform is None:
        return pairs
    (xa, ya), (xb, yb) = (transform.columns(F.col(f"x{p}"), F.col(f"y{p}")) for p in "ab")
    sure = lambda c, n: F.coalesce(c, F.raise_error(F.lit("a polygon's corner is outside of the projection")).cast("double")).alias(n)
    return pairs.select("polygon_id", sure(xa, "xa"), sure(ya, "ya"), sure(xb, "xb"), sure(yb, "yb"))


def _first(low: Column, origin: float, step: float) -> Column:
    """The first index whose centre isn't below low, on an axis of positive step; decided on the centres themselves."""
    k = F.ceil((low - origin) / step - 0.5)
    centre = lambda i: F.lit(origin) + F.lit(step) * (i + 0.5)
    return F.when(centre(k - 1) >= low, k - 1).when(centre(k) < low, k + 1).otherwise(k)


def spans(borders: DataFrame, grid: GridSpec) -> DataFrame:
    """(polygon_id, iy, first, last): runs of cells whose centres are inside by the even-odd rule, within the grid.

    borders: edges(). A ring inside another is a hole. A centre on a left or lower border is inside, as in subset.inside.
    """
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    a, b = (low - grid.y0) / grid.dy - 0.5, (high - grid.y0) / grid.dy - 0.5
    first, last = F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.least(F.ceil(F.greatest(a, b)), F.lit(grid.height - 1))
    rows = borders.withColumns({"_p": first, "_q": last}).where("_p <= _q").withColumn("iy", F.explode(F.sequence("_p", "_q")))
    y = grid.y(F.col("iy"))
    rows = rows.where((y < F.col("ya")) != (y < F.col("yb")))
    rows = rows.select("polygon_id", "iy", (F.col("xa") + (y - F.col("ya")) * ((F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya")))).alias("x"))
    by_row = Window.partitionBy("polygon_id", "iy").orderBy("x")
    runs = rows.select("polygon_id", "iy", "x", F.lead("x").over(by_row).alias("end"), F.row_number().over(by_row).alias("n")).where("n % 2 = 1")
    runs = runs.select("polygon_id", "iy", F.greatest(_first(F.col("x"), grid.x0, grid.dx), F.lit(0)).alias("first"), F.least(_first(F.col("end"), grid.x0, grid.dx) - 1, F.lit(grid.width - 1)).alias("last"))
    return runs.where("first <= last")


def _near(cube: Cube, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cube's rows in the box of all runs, with their block; and runs by block."""
    box = runs.agg(F.min("iy"), F.max("iy"), F.min("first"), F.max("last")).first()
    rows = cube.df.where(F.lit(False)) if box[0] is None else cube.df.where(F.col("iy").between(box[0], box[1]) & F.col("ix").between(box[2], box[3]))
    cut = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))))
    return rows.withColumn("_block", F.floor(F.col("ix") / BLOCK)), cut.withColumnRenamed("iy", "_iy").withColumnRenamed("_block", "_b")


def _meet() -> Column:
    return (F.col("iy") == F.col("_iy")) & (F.col("_block") == F.col("_b")) & F.col("ix").between(F.col("first"), F.col("last"))


def united(runs: DataFrame) -> DataFrame:
    """(iy, first, last): runs of cells apart from each other that hold the cells of runs, whatever polygons these are of.

    Alike starts meet in a maximum before any row is moved, so that no more rows than a grid has cells are ordered by row.
    """
    longest = runs.groupBy("iy", "first").agg(F.max("last").alias("last"))
    by_row = Window.partitionBy("iy").orderBy("first")
    before = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("_new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by_row))
    return marked.groupBy("iy", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def masked(cube: Cube, runs: DataFrame) -> Cube:
    """Cells in any polygon, each once.

    A row meets one run at most; an inner join, unlike a semi-join, stays above an aggregate that makes the cube.
    """
    rows, cut = _near(cube, united(runs))
    return cube.having(rows.join(cut, _meet()).select(*[rows[f"`{c}`"] for c in cube.df.columns]))


def labelled(cube: Cube, runs: DataFrame) -> DataFrame:
    """The cube's rows with the polygon_id of each polygon that holds them, for zonal statistics."""
    rows, cut = _near(cube, runs)
    return rows.join(cut, _meet()).drop("_block", "_iy", "_b", "first", "last")

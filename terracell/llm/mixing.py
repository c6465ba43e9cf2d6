"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.llm.common import carried, n_words, ranked

WEIGHTS = (3, 1, 2)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, n_rows, target): one row for each source of sized (source, size).

    Sources by code point, null last, weigh `weights` in turn. They share percent of all sizes by weight; a
    target stops at `most` times its source's size, and what is over goes to the others by weight until none
    is above. With sources ordered by cap / weight, the level is found where the rest, shared by the weights
    that remain, is within the next cap: one pass over the table of sources, which has a row for a source.
    An empty table gives no rows; sources of size 0 get target 0.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.partitionBy(F.lit(1)).orderBy("_ratio", F.col("source").asc_nulls_last())
    t = (
        totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("_cap", most * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(every) * percent / 100.0)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"])
    )
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("_w")))
    return t.select("source", "source_size", "n_rows", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): a hash of the seed and the source, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(source, F.lit("\u0000null"))), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 42, name: str = "mix") -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target and copies (long).

    Every document of a source expects target / source_size copies. In an order by size, the running sum of
    these plus the source's offset crosses an integer boundary floor(after) - floor(before) times; the
    document is emitted as often. The order goes up through every second size and back down through the
    others, so that what the way up takes too much the way down takes too little, and a source's words miss
    its target by a part of its longest document. Ranks come from ranked(): no source is in one task.
    Null texts have size 0. Rows that repeat are sampled one by one. Sources of size 0 give no copies.
    """
    targets = source_targets(rows, weights, percent, most)
    keyed = ranked(rows, ["source"], ["size", "doc_id"], name)
    keyed = keyed.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.n_rows", "t.target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(each * k + offset(F.col("source"), seed))
    place = F.when(F.col("rank") % 2 == 0, F.expr("rank div 2")).otherwise(F.col("n_rows") - 1 - F.expr("rank div 2"))
    return keyed.withColumn("_place", place).withColumn("copies", (upto(F.col("_place") + 1) - upto(F.col("_place"))).cast("long")).drop("rank", "n_rows", "_place")


def sampled(docs: DataFrame, name: str = "mix", **options) -> DataFrame:
    """docs, each row as often as the mix takes it, with its own columns.

    Decisions are made on narrow rows (a SHA-256 of id, source and text, and the size) and joined back; rows
    alike in doc_id, source and text are one row with the sum of their copies.
    """
    absent = F.lit("-")
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), absent), F.coalesce(F.sha2("text", 256), absent), F.coalesce(F.concat(F.lit("="), "source"), absent)), 256)
    keyed = carried(docs, "doc_id", "source", "text", key.alias("_key"))
    copies = mixed(keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), "_key"), name=name, **options)
    taken = copies.groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    rows = keyed.select("_row", "_key").dropDuplicates(["_key"]).join(taken, "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

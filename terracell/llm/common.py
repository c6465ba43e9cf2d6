"""What the text operators share: shared tables, ranks without a global window, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from terracell.session import importable

#: Words are runs of anything but these ASCII blanks; bytes.split() cuts at exactly the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch. Documents can be long, so batches are kept short.
BATCH_ROWS = 500
#: Least and most bits (as powers of two) of the filters that spare rows; those that pass are joined, so a full
#: filter costs time, not results.
FILTER_BITS = (20, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """The session with short Arrow batches, so that a Python worker holds a few hundred texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return importable(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which all executors see.

    Only where that setting is missing (a local session, as in tests) a folder below the warehouse is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/terracell/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_to(df: DataFrame, path: str) -> DataFrame:
    """df as a written and reread table: its lineage ends there, and what a lost executor held is read again.

    The write's own shuffle files go when it is done, as nothing reads them any more.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """written_to() a fresh folder, which stays."""
    return written_to(df, shared_dir(df.sparkSession, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by shared_dir once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _nullable(schema: StructType) -> StructType:
    return StructType([type(f)(f.name, f.dataType, True, f.metadata) for f in schema.fields])


def carried(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """columns of docs beside a struct _row of all of them: no name that an operator adds can clash with docs' own.

    select("_row.*") gives the rows back as they were.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, rank: str = "rank", total: str | None = None) -> DataFrame:
    """df with the 0-based rank of each row among the rows of the same keys, and in total (if named) how many these are.

    Rows are range-sorted, so that a key with a third of all rows is spread over many partitions. A small
    table of row counts by (key, partition) gives each partition the rank that it starts from; only then each
    part is numbered on its own. Rows are written once, because the partition numbers must not change between
    the two passes. Rows alike in all of keys and order get ranks in any order.
    """
    tagged = written(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id()), name)
    counts = tagged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        tagged.withColumn("_own", own)
        .join(starts, same)
        .withColumn(rank, (F.col("_own") + F.col("_start")).cast("long"))
        .drop("_own", "_start", "_part", "_p", *[f"_k{i}" for i in range(len(keys))])
    )


def running_total(df: DataFrame, order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """df with the sum of value over all rows of a lower order. order: a dense integer, unique by row.

    Two levels: totals of blocks of rows first, then sums inside each block; the only window without a key
    runs over one row for each block.
    """
    blocks = df.groupBy(F.expr(f"`{order}` div {block}").alias("_b")).agg(F.sum(value).alias("_s"))
    blocks = blocks.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_b", F.expr(f"`{order}` div {block}")).withColumn("_in", inner).join(blocks, "_b").withColumn(out, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def bit_filter(df: DataFrame, column: str, n: int) -> tuple[np.ndarray, int]:
    """A map of the low bits that occur in a column of n hashes, about 16 bits a row within FILTER_BITS, and its width.

    The most is 128 MB on the driver and in each worker; beyond some 1e8 rows more rows pass and are joined.
    """
    bits = min(max((16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    block = 1 << 15
    rows = df.groupBy((low / block).cast("long").alias("block")).agg(F.bitmap_construct_agg((low % block).cast("long")).alias("map")).toLocalIterator()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(bytes(r["map"]), np.uint8)[: block // 8]
    return out, bits


def among(filter_: tuple[np.ndarray, int], x: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the filter's column; all that are in it pass."""
    table, bits = filter_
    at = (x & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that links lead to.

    Alternates large-star and small-star steps until no edge changes; every round is two grouped minimums
    and a distinct over the edges, each written before the next one reads it. No round holds a component in
    one place: a node's neighbours meet only in a minimum.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())

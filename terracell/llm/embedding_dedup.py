"""Near-duplicate embeddings by spherical-cap filters: structured random product codes, joined and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import components, written
from terracell.llm.simhash import roots, unite

COSINE = 0.93
#: Filters that a vector exceeds; classes that a filter holds on average; classes of a bucket that are compared in one piece.
FILTERS, BUCKET, TILE = 16, 256, 2048
#: Entries of buckets that a group of the verification holds on average.
ENTRIES = 16384
#: Groups of labels and lengths up to which their sizes are broadcast (a row for each).
SMALL = 100_000


def code_words(n: int, filters: int = FILTERS, bucket: int = BUCKET) -> int:
    """Words of each half's code for n vectors: one for a single bucket; else so many that a filter holds about `bucket` of them."""
    return 1 if n <= bucket else math.ceil(math.sqrt(filters * n / bucket))


@cache
def code(dimensions: int, words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Two code books of random unit vectors, one for each half of a randomly rotated vector, in its coordinates.

    A filter is a pair of code words; its direction is their concatenation. So words * words filters need only
    2 * words stored directions, and a vector's scores for all of them are sums of two short lists.
    """
    rng = np.random.default_rng([seed, dimensions, words])
    turn = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
    half = dimensions // 2
    books = []
    for part in (turn[:, :half], turn[:, half:]):
        c = rng.standard_normal((words, part.shape[1]))
        books.append(part @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T if part.shape[1] else np.zeros((dimensions, words)))
    return books[0], books[1]


def decoded(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], filters: int) -> np.ndarray:
    """For each unit vector the sorted filters that exceed its own limit: the score of the best one but `filters`.

    A limit of its own gives every vector a full list, also one that no direction is near to; with one limit for
    all, such vectors' lists are short, and shorter the more filters there are. The best `filters` sums of two
    falling lists lie among the first `filters` of each, so the list is decoded without visiting the others.
    """
    words = books[0].shape[1]
    top = min(words, filters)
    one, two = units @ books[0], units @ books[1]
    i, j = np.argsort(-one, axis=1)[:, :top], np.argsort(-two, axis=1)[:, :top]
    sums = (np.take_along_axis(one, i, 1)[:, :, None] + np.take_along_axis(two, j, 1)[:, None, :]).reshape(len(units), -1)
    best = np.argsort(-sums, axis=1, kind="stable")[:, :filters]
    return np.sort(np.take_along_axis(i, best // top, 1) * words + np.take_along_axis(j, best % top, 1), axis=1)


def unit_rows(flat: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of length 1, in double precision, from finite vectors that aren't zero."""
    x = flat.reshape(-1, dimensions).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def earlier_filters(lists: list[np.ndarray], bucket: int) -> np.ndarray:
    """Bits of each list's filters below bucket, as rows of 64-bit numbers; a column for each filter that some list has."""
    lengths = [int(np.searchsorted(x, bucket)) for x in lists]
    flat = np.concatenate([x[:n] for x, n in zip(lists, lengths)])
    columns, at = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(lists), -(-len(columns) // 64) * 64), bool)
    bits[np.repeat(np.arange(len(lists)), lengths), at] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def bucket_links(node: np.ndarray, copies: np.ndarray, units: np.ndarray, lists: list[np.ndarray], second: np.ndarray, cosine: float, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of a bucket, or of two of its tiles (second marks the other one's): links to partners,
    counted with copies, for pairs whose first common filter is this bucket, and the least node that they lead to
    here. Filters are looked up for vectors with a partner only."""
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    own = not len(b)
    b = a if own else b
    hits_i, hits_j, step = [], [], max(1, (1 << 20) // len(b))
    for k in range(0, len(a), step):
        i, j = np.nonzero(units[a[k : k + step]] @ units[b].T >= cosine)
        some = node[a[i + k]] < node[b[j]] if own else np.ones(len(i), bool)
        hits_i.append(a[i[some] + k])
        hits_j.append(b[j[some]])
    i, j = np.concatenate(hits_i), np.concatenate(hits_j)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    bits = earlier_filters([lists[k] for k in members.tolist()], bucket)
    links, parent, step = np.zeros(len(members), np.int64), np.arange(len(members)), max(1, (1 << 22) // max(1, bits.shape[1]))
    weight, order = copies[members], np.argsort(node[members])
    place = np.empty_like(order)
    place[order] = np.arange(len(order))  # so that the least place is the least node
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        new = ~(bits[p] & bits[q]).any(1)
        p, q = p[new], q[new]
        links += np.bincount(p, weight[q], len(links)).astype(np.int64) + np.bincount(q, weight[p], len(links)).astype(np.int64)
        unite(parent, place[p], place[q])
    some = np.flatnonzero(links)
    return node[members[some]], links[some], node[members[order[roots(parent, place[some])]]]


def linked(vectors: DataFrame, cosine: float = COSINE, filters: int = FILTERS, bucket: int = BUCKET, tile: int = TILE, seed: int = 42, name: str = "embeddings") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for a row of vectors (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and their lengths agree. Null or zero
    vectors, and those with null or non-finite components, link with nothing and are their own component.
    Equal vectors of a label are one class, whatever their number: each links with every other one. Classes
    are decoded to filters (of a code sized for their label and length, so that buckets stay small at any size),
    joined on (label, length, filter), and verified in double precision. A bucket of more than `tile` classes is
    split into tiles that meet in pairs. A pair is counted in its first common filter only, so nothing is counted
    twice and no pair is ever a row. Pairs without a common filter are missed; see the README for measured recall.
    """
    spark, rows = vectors.sparkSession, vectors.select("vec_id", "embedding", "label")
    valid = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    grouped = rows.where(valid).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = written(grouped.withColumn("size", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), f"{name}-classes")
    sizes = written(classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")), f"{name}-sizes")
    sized = F.broadcast(sizes) if sizes.count() <= SMALL else sizes

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for size, many in sorted({*zip(d.tolist(), (1 << np.ceil(np.log2(n)).astype(np.int64)).tolist())}):
                own = pa.array((d == size) & (1 << np.ceil(np.log2(n)).astype(np.int64) == many))
                units, words = unit_rows(b.column(1).filter(own).flatten().to_numpy(), size), code_words(many, filters, bucket)
                lists = decoded(units, code(size, words, seed), filters)
                flat = pa.ListArray.from_arrays((np.arange(len(lists) + 1) * lists.shape[1]).astype(np.int32), pa.array(lists.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(own), flat], ["node", "filters"])

    decodes = written(classes.join(sized, ["label", "size"]).select("node", "embedding", "size", "n").mapInArrow(decode, "node long, filters array<long>"), f"{name}-decoded")
    keyed = written(classes.select("node", "copies", "label", "size", "embedding").join(decodes, "node"), f"{name}-keyed")
    entries = keyed.select("node", "label", "size", F.explode("filters").alias("filter"))
    counts = written(entries.groupBy("label", "size", "filter").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("n > 1"), f"{name}-buckets")
    bins = max(1, counts.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 1) // ENTRIES + 1
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    spread = entries.join(counts, ["label", "size", "filter"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    spread = spread.select("node", "size", "filter", F.xxhash64("label", "filter", low, high).alias("key"), (F.col("mine") > F.col("other")).alias("second"), "label", low.alias("low"), high.alias("high"))
    carried = spread.join(keyed.select("node", "copies", "embedding", "filters"), "node").withColumn("bin", F.pmod("key", F.lit(bins)))

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in ("label", "filter", "low", "high", "node")]).combine_chunks()
        size = table.column("size")[0].as_py()
        node, copies, bucket_of, low, high = (table.column(k).to_numpy() for k in ("node", "copies", "filter", "low", "high"))
        second, label = table.column("second").to_numpy().astype(bool), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        units = unit_rows(table.column("embedding").combine_chunks().flatten().to_numpy(), size)
        column = table.column("filters").combine_chunks()
        lists = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
        edges = np.flatnonzero((np.diff(bucket_of) != 0) | (np.diff(label) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        found = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(node)]):
            sides = int(second[a:b].sum())
            if b - a > 1 and (low[a] == high[a] or 0 < sides < b - a):
                found.append(bucket_links(node[a:b], copies[a:b], units[a:b], lists[a:b], second[a:b], cosine, int(bucket_of[a])))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, ["node", "links", "root"])

    schema = "node long, links long, root long"
    found = written(carried.repartition(min(bins, 1 << 16), "size", "bin").groupBy("size", "bin").applyInArrow(verify, schema), f"{name}-links")
    stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), name)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.join(links, "node", "left").join(stars.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    result = rooted.join(ids, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.withColumn("_ok", valid)
    good = joined.where("_ok").join(result, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = joined.where(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

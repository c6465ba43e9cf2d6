"""SimHash near-duplicates by a tiled exact comparison of fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from terracell.llm.common import among, bit_filter, carried, components, ranked, written

BITS, RADIUS, SHINGLE, TILE = 64, 4, 4, 32768
#: Beyond this radius nearly all cells of quarter counts are near each other, and tiles are compared as they are.
CELL_RADIUS = 8
#: Buckets of a sketch.
SKETCH = 32
#: Pairs whose exclusive-or is held at a time.
BLOCK = 1 << 21


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; of a text of fewer words, that of all of it; none of a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)


def print_of(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it; no hash gives 0."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """print_of() a text's word shingles."""
    return print_of(shingle_hashes(text, shingle, seed))


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """15 bits of the least hash in each of SKETCH buckets, plus 1; 0 where a bucket is empty. Repeats change nothing."""
    keys = np.sort((hashes % np.uint64(SKETCH)) << np.uint64(58) | hashes >> np.uint64(6))
    bucket = (keys >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.zeros(SKETCH, "<u2")
    out[bucket[first]] = (keys[first] & np.uint64(0x7FFF)) + np.uint64(1)
    return out


def alike(sketch: np.ndarray, others: np.ndarray, similar: float) -> np.ndarray:
    """Which other sketches agree in as many buckets that either fills as sets that similar do, less a wide margin.

    Sets with Jaccard similarity s agree in a share s of the buckets on average, with a deviation of 0.07 or less
    (fewer elements than buckets differ in fewer buckets still); the margin is six of these.
    """
    filled = (others > 0) | (sketch > 0)
    return ((others == sketch) & filled).sum(1) >= (similar - 6 * 0.07) * filled.sum(1)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Signed 64-bit column with the bits of each text's fingerprint; null texts count as empty. Only A-Z are lower-cased."""

    @F.arrow_udf("long")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x or b"", shingle) for x in texts.cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64))

    return sign(text)


def signatures(text: Column, shingle: int) -> Column:
    """struct(bits, sketch) of each text, from one pass over its shingles."""

    @F.arrow_udf("struct<bits:long,sketch:binary>")
    def sign(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(x or b"", shingle) for x in texts.cast(pa.large_binary()).to_pylist()]
        bits = np.array([print_of(h) for h in hashes], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(bits), pa.array([sketch_of(h).tobytes() for h in hashes], pa.binary())], ["bits", "sketch"])

    return sign(text)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def text_keys(text: Column) -> Column:
    """XXH3 of each text's words: texts alike but for blanks and the case of A-Z have one key."""

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([xxhash.xxh3_64_intdigest(b" ".join((x or b"").lower().split())) for x in texts.cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64))

    return key(text)


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def quarters(prints: np.ndarray) -> np.ndarray:
    """Set bits of each 16-bit quarter, as an (n, 4) array."""
    return np.bitwise_count(np.ascontiguousarray(prints).view("<u2").reshape(-1, 4)).astype(np.int16)


def cells(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that groups prints by the counts of their quarters, the groups' counts, and where groups begin (and end)."""
    if radius > CELL_RADIUS:
        return np.arange(len(prints)), np.zeros((1, 4), np.int16), np.array([0, len(prints)])
    counts = quarters(prints)
    key = counts @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order, counts[order[first]], np.append(first, len(prints))


def roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if np.array_equal(up, i):
            return i
        parent[i] = parent[up]
        i = parent[i]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes each i[k] and j[k] share a root, the least of the set."""
    while len(i):
        i, j = roots(parent, i), roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile with itself (b is None) or another, as (print, least print of its set): fewer rows than prints.

    Every print is compared with each whose quarters' counts differ by no more than the radius in total
    (two prints differ in at least as many bits), by exclusive-or and bit count.
    """
    own = b is None
    prints = a if own else np.concatenate([a, b])
    prints = np.unique(prints)
    parent = np.arange(len(prints))
    xa, xb = np.searchsorted(prints, a), np.searchsorted(prints, a if own else b)
    order_a, counts_a, bounds_a = cells(prints[xa], radius)
    xa = xa[order_a]
    if own:
        xb, counts_b, bounds_b = xa, counts_a, bounds_a
    else:
        order_b, counts_b, bounds_b = cells(prints[xb], radius)
        xb = xb[order_b]
    for c in range(len(counts_a)):
        near = np.flatnonzero(np.abs(counts_b - counts_a[c]).sum(1) <= radius)
        if own:
            near = near[near >= c]
        if not len(near):
            continue
        left = xa[bounds_a[c] : bounds_a[c + 1]]
        right = np.concatenate([xb[bounds_b[k] : bounds_b[k + 1]] for k in near.tolist()])
        step = max(1, BLOCK // len(right))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            i, j = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[right][None, :]) <= radius)
            i, j = some[i], right[j]
            unite(parent, i[i != j], j[i != j])
    root = roots(parent, np.arange(len(prints)))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def tile_pairs(prints: DataFrame, radius: int, tile: int, name: str) -> DataFrame:
    """(pair, second, prints): both tiles of each pair of tiles whose population counts are within the radius."""
    spark = prints.sparkSession
    numbered = ranked(prints.select("bits", F.bit_count("bits").alias("pop")), ["pop"], ["bits"], name)
    tiles = written(numbered.groupBy("pop", F.expr(f"int(rank div {tile})").alias("no")).agg(F.collect_list("bits").alias("prints")), f"{name}-tiles")
    of = {r["pop"]: r["n"] for r in tiles.groupBy("pop").agg((F.max("no") + 1).alias("n")).collect()}
    table = F.create_map(*[F.lit(x) for p, n in of.items() for x in (p, n)]) if of else F.create_map(F.lit(-1), F.lit(0))
    partner = F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius))
    spread = tiles.withColumn("_p", partner).withColumn("_n", table[F.col("_p")]).where("_n > 0").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mine, other = F.struct("pop", "no"), F.struct(F.col("_p").alias("pop"), F.col("_t").alias("no"))
    return spread.select(F.to_json(F.array(F.least(mine, other), F.greatest(mine, other))).alias("pair"), (mine > other).alias("second"), "prints")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, name: str = "simhash") -> DataFrame:
    """(a, b): links that connect all distinct prints (bits: long) at radius or fewer differing bits.

    Prints are dealt into tiles of one population count, each of `tile` prints at most. A tile meets those
    tiles only whose count is within the radius; the number of tiles of each of the 65 counts is all that the
    driver sees. A pair of tiles is a task's group of two rows, and returns a spanning forest of its links,
    never the pairs themselves.
    """
    pairs = tile_pairs(prints, radius, tile, name)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        side = [np.array(x, np.int64).view(np.uint64) for x in group.sort_values("second")["prints"]]
        a, b = tile_links(side[0], side[1] if len(side) > 1 else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _dealt(pairs).applyInPandas(compare, "a long, b long")


def _dealt(pairs: DataFrame) -> GroupedData:
    many = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return pairs.repartition(many, "pair").groupBy("pair")


def similar_links(bits: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], radius: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): texts whose prints are within the radius and whose sets' Jaccard similarity is at least `similar`.

    side: only texts of different sides are compared; None: all. Each pair is compared, unless links already
    connect it.
    """
    label, size, out = np.arange(len(bits)), np.array([len(x) for x in sets]), []
    for i in range(len(bits) - 1):
        near = label[i + 1 :] != label[i]
        near &= np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius
        near &= np.minimum(size[i + 1 :], size[i]) >= similar * np.maximum(size[i + 1 :], size[i])
        if side is not None:
            near &= side[i + 1 :] != side[i]
        waiting = np.flatnonzero(near) + i + 1
        while len(waiting):
            j, waiting = int(waiting[0]), waiting[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similar * (size[i] + size[j] - both):
                label[label == label[j]] = label[i]
                out.append((i, j))
                waiting = waiting[label[waiting] != label[i]]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def verified_links(signed: DataFrame, shingle: int, radius: int, similar: float, tile: int, name: str) -> DataFrame:
    """(a, b): keys that connect all texts of signed (key, bits, sketch, text) within the radius and at least `similar` alike.

    First each pair of tiles says which prints have a partner in it. Prints of texts that have nothing in common
    are within a wide radius by chance, ever more often the more there are; so sketches of 64 bytes are compared
    next, and only texts that have a partner in these too are sent, once for each pair of tiles, to where the pair
    is compared again, with Jaccard similarities of word shingles. Distinct texts of one print are a pair of their
    own. Pairs never become rows.
    """

    def involved(group: pd.DataFrame) -> pd.DataFrame:
        side = [np.array(x, np.int64).view(np.uint64) for x in group.sort_values("second")["prints"]]
        a, b = tile_links(side[0], side[1] if len(side) > 1 else None, radius)
        prints = np.unique(np.concatenate([a, b]))
        which = np.isin(prints, side[1]).astype(np.int8) if len(side) > 1 else np.full(len(prints), -1, np.int8)
        return pd.DataFrame({"pair": group["pair"].iloc[0], "bits": prints.view(np.int64), "side": which})

    def sketched(group: pd.DataFrame) -> pd.DataFrame:
        bits, side = group["bits"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy()
        sketches = np.frombuffer(b"".join(group["sketch"]), "<u2").reshape(-1, SKETCH)
        met = np.zeros(len(bits), bool)
        for i in range(len(bits) - 1):
            near = np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius
            if side[0] >= 0:
                near &= side[i + 1 :] != side[i]
            if met[i]:
                near &= ~met[i + 1 :]  # only what isn't known yet
            j = np.flatnonzero(near) + i + 1
            j = j[alike(sketches[i], sketches[j], similar)]
            met[j] = True
            met[i] |= len(j) > 0
        return group.loc[met, ["pair", "bits", "key", "side"]]

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        key, side = group["key"].to_numpy(np.int64), group["side"].to_numpy()
        i, j = similar_links(group["bits"].to_numpy(np.int64).view(np.uint64), None if side[0] < 0 else side, [shingles(x.encode(), shingle) for x in group["text"]], radius, similar)
        return pd.DataFrame({"a": key[i], "b": key[j]})

    nodes = written(signed.groupBy("bits", "key").agg(F.min("sketch").alias("sketch")), f"{name}-nodes")
    near = _dealt(tile_pairs(nodes.select("bits").distinct(), radius, tile, name)).applyInPandas(involved, "pair string, bits long, side int")
    same = nodes.groupBy("bits").count().where("count > 1").select(F.concat(F.lit("="), F.col("bits").cast("string")).alias("pair"), "bits", F.lit(-1).alias("side"))
    asked = _dealt(near.unionByName(same).join(nodes, "bits")).applyInPandas(sketched, "pair string, bits long, key long, side int")
    asked = written(asked, f"{name}-asked")
    keys = asked.select("key").distinct()
    some = signed.sparkSession.sparkContext.broadcast(bit_filter(keys, "key", keys.count()))

    @F.arrow_udf("boolean")
    def waited_for(key: pa.Array) -> pa.Array:
        return pa.array(among(some.value, key.to_numpy(zero_copy_only=False).view(np.uint64)))

    texts = signed.where(waited_for("key")).select("bits", "key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["bits", "key"])
    return _dealt(asked.join(texts, ["bits", "key"])).applyInPandas(verify, "a long, b long")


def clustered(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, name: str = "simhash", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, bits, component_id) and columns named in keep, one row for a document of docs (doc_id, text).

    component_id: the smallest doc_id that links lead to, its own included. Documents with one fingerprint
    are one node, whatever their number; texts without words have fingerprint 0 and link like any other. A
    null doc_id is never a component's smallest unless all of it are null. Repeated rows stay.
    """
    signed = written(docs.select("doc_id", *keep, fingerprints(F.col("text"), shingle).alias("bits")), f"{name}-bits")
    nodes = written(signed.groupBy("bits").agg(F.min("doc_id").alias("least")), f"{name}-nodes")
    stars = components(links(nodes.select("bits"), radius, tile, name), name)
    rooted = nodes.join(stars, nodes["bits"] == stars["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("bits", "component_id")
    return signed.join(classes, "bits").select("doc_id", *keep, "bits", "component_id")


def clustered_similar(docs: DataFrame, similar: float, shingle: int, radius: int, tile: int = TILE, name: str = "simhash", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, root) and columns named in keep, one row for a document of docs (doc_id, text).

    Documents have one root if links between texts lead from one to the other: prints within the radius and
    Jaccard similarity of the word shingles of at least `similar`. Documents of the same words are one node.
    """
    signed = docs.select("doc_id", *keep, "text", signatures(F.col("text"), shingle).alias("_s"), text_keys(F.col("text")).alias("key"))
    signed = written(signed.select("doc_id", *keep, "text", "_s.bits", "_s.sketch", "key"), f"{name}-bits")
    stars = components(verified_links(signed, shingle, radius, similar, tile, name), name)
    rows = signed.select("doc_id", *keep, "key").join(stars, F.col("key") == F.col("node"), "left")
    return rows.select("doc_id", *keep, F.coalesce("root", "key").alias("root"))


def deduplicated(docs: DataFrame, name: str = "simhash", similar: float | None = None, **options) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest doc_id.

    similar: components of clustered_similar(), whose links are verified; None: those of clustered().
    Of rows with that doc_id (or all null ids), the one with the least hash of its text stays, once.
    """
    keyed = carried(docs, "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    slim = keyed.select("doc_id", "text", "_hash")
    found = clustered(slim, name=name, keep=("_hash",), **options) if similar is None else clustered_similar(slim, similar, name=name, keep=("_hash",), **options)
    group = F.col("root") if similar is not None else F.when(F.col("component_id").isNotNull(), F.struct(F.lit(0).alias("k"), F.col("component_id").alias("v"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("bits").alias("v")))
    best = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_hash").alias("h"))).alias("best"))
    best = best.select(F.col("best.n").alias("_n"), F.coalesce("best.d", F.lit(0)).alias("_d"), F.col("best.h").alias("_h")).distinct()
    rows = keyed.select("_row", F.col("doc_id").isNull().alias("_n"), F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("_hash").alias("_h"))
    return rows.join(best, ["_n", "_d", "_h"]).dropDuplicates(["_n", "_d", "_h"]).select("_row.*")

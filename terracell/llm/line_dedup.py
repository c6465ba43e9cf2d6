"""Removal of lines that other documents hold as well, with two Bloom filters in front of the exact comparison.

Each task fills a filter of the lines that it has seen once and one of those seen twice; both are merged block by
block, where a line seen once in each of two tasks becomes one seen twice. Lines of no document but their own
mostly miss the second filter and never leave their task. Only suspects are shuffled, as whole keys: those that
two documents really share get the least doc_id, and the others lose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import dropped, shared_dir, written_to

#: Code points of the shortest key that counts.
LEAST = 10
BLANKS = " \t\n\v\f\r"
#: Bits set for a line, all in one block, and bits of a filter for each line of the table.
PROBES, PER_LINE = 3, 16
#: Least and most bits of a filter, and bits of a block, as powers of two. A filter is 128 MB at most; beyond some 1e8
#: lines it fills up, and ever more lines are compared exactly: results stay.
FILTER_BITS, BLOCK_BITS = (20, 30), 15
_BYTES = 1 << (BLOCK_BITS - 3)


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of all lines of texts (null: one empty line), one text behind the other, and the text that each line is in."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    counts = np.diff(lists.offsets.to_numpy())
    return pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=BLANKS)), np.repeat(np.arange(len(counts)), counts)


def key_of(line: bytes) -> bytes:
    """The same key of one line, in UTF-8."""
    return line.strip(BLANKS.encode()).lower()


def counted_keys(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of at least `least` code points, each once for a text: distinct keys, and for each (text, key) the place of its key, and the text."""
    keys, owner = keys_of(texts)
    long = pc.greater_equal(pc.utf8_length(keys), least)
    coded = keys.filter(long).dictionary_encode()
    at, owner = coded.indices.to_numpy().astype(np.int64), owner[long.to_numpy(zero_copy_only=False)]
    pairs = np.unique(owner * max(len(coded.dictionary), 1) + at)
    return coded.dictionary, pairs % max(len(coded.dictionary), 1), pairs // max(len(coded.dictionary), 1)


def hashes(keys: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys.to_pylist()), np.uint64, len(keys))


class Bloom:
    """A filter of 2 ** bits bits, in blocks that can be merged apart from each other."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def probes(self, h: np.ndarray) -> Iterator[np.ndarray]:
        block = (h >> np.uint64(64 - self.bits + BLOCK_BITS)) << np.uint64(BLOCK_BITS)
        for k in range(PROBES):
            yield (block | (h >> np.uint64(k * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.probes(h):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def add(self, h: np.ndarray) -> None:
        for at in self.probes(h):
            np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def blocks(self) -> np.ndarray:
        return self.data.reshape(-1, _BYTES)


def packed(block: np.ndarray) -> bytes:
    """A block as the places of its bits, or as it is if that is shorter."""
    at = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < _BYTES else block.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == _BYTES:
        return np.frombuffer(raw, np.uint8)
    out = np.zeros(1 << BLOCK_BITS, np.uint8)
    out[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(out, bitorder="little")


def seen_twice(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The filter of keys in two rows of docs (text) or more: all of these are in it, and some others."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for b in batches:
            distinct, at, _ = counted_keys(b.column("text"), least)
            h, n = hashes(distinct), np.bincount(at, minlength=len(distinct))
            twice.add(h[once.has(h) | (n > 1)])
            once.add(h)
        a, b = once.blocks(), twice.blocks()
        some = np.flatnonzero(a.any(axis=1))
        for part in np.array_split(some, max(1, len(some) >> 10)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([packed(a[k]) for k in part], pa.binary()), pa.array([packed(b[k]) for k in part], pa.binary())], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of tasks, in order of blocks, into one of each; holds one at a time."""
        held, once, twice = None, None, None
        done: list[tuple[int, bytes]] = []
        for b in batches:
            for block, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = unpacked(x), unpacked(y)
                if block == held:
                    twice, once = twice | y | once & x, once | x
                else:
                    done += [] if held is None else [(held, twice.tobytes())]
                    held, once, twice = block, x, y
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([v for _, v in done], pa.binary())], ["block", "twice"])
            done = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["block", "twice"])

    parts = docs.mapInArrow(fill, "block long, once binary, twice binary").repartition("block").sortWithinPartitions("block")
    out = Bloom(bits)
    for r in parts.mapInArrow(merge, "block long, twice binary").toLocalIterator():
        out.blocks()[r["block"]] = np.frombuffer(r["twice"], np.uint8)
    return out.data


def filter_bits(lines: int) -> int:
    return min(max((PER_LINE * lines).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def n_lines(text: Column) -> Column:
    """Lines of a text; a null text is one empty line."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, out: str = "lines", name: str = "lines") -> DataFrame:
    """docs whose texts lack the lines that a document of a smaller doc_id holds, and a struct out: n_lines (before), n_dropped.

    A line's key is the line without blanks (ASCII) at both ends, A-Z in lower case. Keys of at least `least` code
    points in two documents or more lose all lines but those of the smallest doc_id that holds them; there all stay.
    Rows with one doc_id are one document; rows without are one, after all others. Null and empty texts are one
    empty line. Other lines, their order and blanks stay; so do other columns, whatever their names (one named like
    out is replaced), and null texts. A text is held whole by its task alone.
    """
    spark, rest = docs.sparkSession, [c for c in docs.columns if c not in (text, out)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("id"))
    bits = filter_bits(rows.agg(F.sum(n_lines(F.col("text")))).first()[0] or 0)
    twice = spark.sparkContext.broadcast(seen_twice(rows.select("text"), least, bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Bloom(bits, twice.value)
        for b in batches:
            distinct, at, owner = counted_keys(b.column("text"), least)
            some = near.has(hashes(distinct))[at] if len(distinct) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner[some])), distinct.take(pa.array(at[some])).cast(pa.string())], ["id", "key"])

    suspects_at, shared_at, gone_at = (shared_dir(spark, f"{name}-{what}") for what in ("suspects", "shared", "gone"))
    suspects = written_to(rows.select("id", "text").mapInArrow(suspected, f"id {rows.schema['id'].dataType.simpleString()}, key string"), suspects_at)
    found = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("unnamed"))
    shared = found.where((F.col("first") < F.col("last")) | F.col("unnamed") & F.col("first").isNotNull()).select("key", "first")
    shared = written_to(shared, shared_at)  # so that the join deals both sides anew, and can split a hot key
    gone = suspects.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id").agg(F.collect_set("key").alias("gone"))
    gone = written_to(gone.select(F.col("id").alias("of"), "gone"), gone_at)
    dropped(spark, suspects_at)
    dropped(spark, shared_at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = b.column("text"), b.column("gone")
            lost = np.zeros(b.num_rows, np.int64)
            fresh = texts
            touched = np.flatnonzero(pc.and_(lists.is_valid(), texts.is_valid()).to_numpy(zero_copy_only=False))
            if len(touched):
                fresh = texts.to_pylist()
                for k in touched.tolist():
                    away, lines = {x.encode() for x in lists[k].as_py()}, fresh[k].encode().split(b"\n")
                    stay = [x for x in lines if key_of(x) not in away]
                    fresh[k], lost[k] = b"\n".join(stay).decode(), len(lines) - len(stay)
                fresh = pa.array(fresh, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_rest"), fresh.cast(pa.string()), b.column("n_lines"), pa.array(lost)], ["_rest", "text", "n_lines", "n_dropped"])

    joined = rows.withColumn("n_lines", n_lines(F.col("text"))).join(gone, F.col("id").eqNullSafe(F.col("of")), "left").select("_rest", "text", "n_lines", "gone")
    done = joined.mapInArrow(cut, f"_rest {rows.schema['_rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long")
    own = {text: F.col("text"), out: F.struct("n_lines", "n_dropped")}
    return done.select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in dict.fromkeys([*docs.columns, out])])


#: The same rows in DuckDB, by exact keys.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.r, k.i, k.line, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id, r
"""

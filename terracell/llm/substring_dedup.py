"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Its fingerprint is the least hash of the GRAM-word runs inside it, so
equal windows have equal fingerprints and neighbouring windows mostly share one: about one word in fifteen
starts a fingerprint. The index keeps these in sorted immutable runs. A new batch's fingerprints are
merge-joined with the runs; those met before, or twice in the batch, are suspects. Windows with a suspect
fingerprint are then verified by 128 bits over all their words (words and pairs of halves are mixed without
any algebraic structure, so no pattern of words collides by rule), counted over all documents, and words that
a repeated window covers go. Runs are compacted once there are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import among, bit_filter, written

WINDOW, GRAM = 35, 8
#: Batches in which a table enters the index, and runs that it keeps before they are merged into one.
BATCHES, FANOUT = 4, 2
#: Bytes of text that are hashed at a time (a longer text is taken alone).
PIECE = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_P, _Q, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Masks that leave the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; works in place."""
    x ^= x >> np.uint64(32)
    x *= _M
    x ^= x >> np.uint64(29)
    x *= _P
    x ^= x >> np.uint64(32)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end], eight bytes at a time; raw goes on for seven bytes behind the last word."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _Q ^ np.uint64(seed))
    eights = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))
    at = np.arange(len(starts))
    for k in range(0, LONG_WORD, 8):
        at = at[lengths[at] > k]
        if not len(at):
            break
        out[at] = mix((out[at] ^ (eights[starts[at] + k] & _MASKS[np.minimum(lengths[at] - k, 8)])) * _Q + np.uint64(k + 1))
    for w in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[w] = xxhash.xxh3_64_intdigest(raw[starts[w] : ends[w]].tobytes(), seed)
    return out


def runs_hashed(x: np.ndarray, width: int, size: int = 1) -> np.ndarray:
    """A hash of each `width` consecutive entries, from two halves that may overlap; x has those of `size` entries, a power of two."""
    while size < width:
        step = min(size, width - size)
        x, size = mix(x[: len(x) - step] * _P + x[step:] * _Q), size + step
    return x


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `width` consecutive entries."""
    size = 1
    while size * 2 <= width:
        x, size = pick(x[:-size], x[size:]), size * 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


class Windows:
    """Words and windows of some texts, which stand one behind the other; all steps run over whole arrays."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        lengths = np.array([len(t or b"") for t in texts], np.int64)
        self.raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n" * 8, np.uint8)
        self.texts = texts
        blank = _BLANK[self.raw]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        self.word_starts, self.word_ends = edges[::2], edges[1::2]
        offsets = np.cumsum(lengths + 1) - (lengths + 1)
        self.begin = np.searchsorted(self.word_starts, offsets)
        self.counts = np.diff(np.append(self.begin, len(self.word_starts)))
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.first = word_hashes(self.raw, self.word_starts, self.word_ends, 1)
        n = len(self.first)
        self.starts = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)

    def keys(self) -> np.ndarray:
        """64 bits over each text."""
        return np.array([xxhash.xxh3_64_intdigest(t or b"") for t in self.texts], np.uint64).view(np.int64)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows' fingerprints, and a list with one entry for each place that is the least of some window."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n, span = len(self.first), self.window - self.gram + 1
        grams = runs_hashed(self.first, self.gram)
        least = sliding(grams, span, np.minimum)
        shown = np.zeros(len(least) + 2 * (span - 1), np.uint64)
        shown[span - 1 + self.starts] = least[self.starts]
        return least[self.starts], grams[(sliding(shown, span, np.maximum)[: len(grams)] == grams) & (grams > 0)]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits over each window's words, as two 64-bit numbers."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        second = word_hashes(self.raw, self.word_starts, self.word_ends, 2)
        return tuple(runs_hashed(h, self.window)[self.starts].view(np.int64) for h in (self.first, second))


def groups(column: pa.Array, least: int = PIECE) -> Iterator[tuple[int, int, list]]:
    """(start, stop, texts): a batch's texts in groups of about `least` bytes."""
    texts = column.cast(pa.large_binary()).to_pylist()
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= least or k + 1 == len(texts):
            yield start, k + 1, texts[start : k + 1]
            start, size = k + 1, 0


def _tally(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each occurs."""
    if not len(columns[0]):
        return list(columns), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([r[1:] != r[:-1] for r in rows], axis=0)))
    first = np.flatnonzero(new)
    return [r[first] for r in rows], np.diff(np.append(first, len(order)))


def fingerprint_counts(docs: DataFrame, window: int = WINDOW, part: str | None = None) -> DataFrame:
    """([part,] print, n): how often each fingerprint starts in docs (text), summed first in each Arrow batch; part: an int column to keep apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in np.unique(parts).tolist():
                for _, _, texts in groups(b.column(0).filter(pa.array(parts == k))):
                    (prints,), n = _tally(Windows(texts, window).fingerprints()[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k)), pa.array(prints.view(np.int64)), pa.array(n)], ["part", "print", "n"])

    own = F.lit(0) if part is None else F.col(part)
    counts = docs.select("text", own.alias("part")).mapInArrow(count, "part long, print long, n long").groupBy("part", "print").agg(F.sum("n").alias("n"))
    return counts.drop("part") if part is None else counts


class FingerprintIndex:
    """Runs of fingerprints, each written once, sorted, and never changed.

    runs: earlier runs' tables, to go on from. Beyond fanout runs, all are merged into one.
    """

    def __init__(self, spark: SparkSession, runs: tuple[DataFrame, ...] = (), fanout: int = FANOUT, window: int = WINDOW):
        self.spark, self.runs, self.fanout, self.window = spark, list(runs), fanout, window

    def add(self, batch: DataFrame, name: str = "run") -> DataFrame:
        """Indexes a batch (text); returns (print): its fingerprints that occur twice in it or in an earlier run."""
        return self.add_counts(fingerprint_counts(batch, self.window), name)

    def add_counts(self, counts: DataFrame, name: str = "run") -> DataFrame:
        """add() of a batch whose fingerprint counts (print, n) are known."""
        run = written(counts.sortWithinPartitions("print"), name)
        suspects = run.where("n > 1").select("print")
        for old in self.runs:
            suspects = suspects.unionByName(run.hint("merge").join(old.select("print"), "print", "left_semi").select("print"))
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            self.compact(name)
        return suspects

    def compact(self, name: str = "run") -> None:
        merged = self.runs[0]
        for r in self.runs[1:]:
            merged = merged.unionByName(r)
        self.runs = [written(merged.groupBy("print").agg(F.sum("n").alias("n")).sortWithinPartitions("print"), f"{name}-compacted")]


def removed(docs: DataFrame, suspects: DataFrame, window: int = WINDOW, name: str = "substring") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for docs (doc_id, text): kept has the words that stay, joined by a space, as binary.

    suspects: (print), as the index gives them; written once here. A window that starts twice or more in docs goes, with every
    word that it covers, all occurrences included; windows are those of the input. Null texts have no words;
    texts shorter than a window lose nothing. A document is found again by its doc_id and 64 bits over its
    text, so rows alike in both share a result, and repeated rows stay repeated.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    suspects = written(suspects.distinct(), f"{name}-suspects")
    near = spark.sparkContext.broadcast(bit_filter(suspects, "print", suspects.count()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in groups(b.column(1)):
                w = Windows(texts, window)
                some = among(near.value, w.fingerprints()[0])
                x, y = w.digests() if some.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                (x, y), n = _tally(x[some[: len(x)]], y[some[: len(y)]])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], ["x", "y", "n"])

    repeated = written(rows.mapInArrow(verify, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").select("x", "y"), f"{name}-repeated")
    twice = spark.sparkContext.broadcast(bit_filter(repeated, "x", repeated.count()))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, texts in groups(b.column(1)):
                w = Windows(texts, window)
                some = among(near.value, w.fingerprints()[0])
                if some.any():
                    ids = np.array([d or 0 for d in b.column(0)[start:stop].to_pylist()], np.int64)
                    x, y = w.digests()
                    some &= among(twice.value, x.view(np.uint64))
                    at = w.starts[some]
                    doc = w.doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(y[some]), pa.array(w.keys()[doc]), pa.array(ids[doc]), pa.array((at - w.begin[doc]).astype(np.int32))], ["x", "y", "k", "d", "at"])

    hits = rows.mapInArrow(locate, "x long, y long, k long, d long, at int").join(repeated.hint("merge"), ["x", "y"]).select("k", "d", "at")
    spans = written(hits.groupBy("k", "d").agg(F.array_sort(F.collect_list("at")).alias("at")), f"{name}-starts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, texts in groups(b.column(1)):
                w, ids = Windows(texts, window), b.column(0)[start:stop]
                words = pa.array([b" ".join((t or b"").split()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(w.keys()), pa.array([d or 0 for d in ids.to_pylist()], pa.int64()), ids, pa.array(w.counts), words], ["k", "d", "doc_id", "n_words", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = [], []
            for words, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if at:
                    words = words.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(at), 1)
                    np.add.at(edge, np.array(at) + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone.append(int(len(words) - stay.sum()))
                    words = b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])
                else:
                    gone.append(0)
                kept.append(words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    texts = rows.mapInArrow(split, "k long, d long, doc_id long, n_words long, words binary")
    return texts.join(spans.hint("merge"), ["k", "d"], "left").select("doc_id", "n_words", "words", "at").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, name: str = "substring") -> DataFrame:
    """removed() over docs, which enter a new index in batches (by a hash of doc_id) one after the other.

    A window in two documents is met when the later batch is joined with the earlier runs, compacted ones
    included, or as a repeat in its own batch; both documents lose it. The texts are fingerprinted in one scan.
    """
    index = FingerprintIndex(docs.sparkSession, window=window)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    counts = written(fingerprint_counts(docs.select("text", part.alias("part")), window, "part"), f"{name}-prints")
    suspects = [index.add_counts(counts.where(F.col("part") == k).select("print", "n"), f"{name}-run{k}") for k in range(batches)]
    every = suspects[0]
    for s in suspects[1:]:
        every = every.unionByName(s)
    return removed(docs, every, window, name)


#: The same rows in DuckDB, from the windows' own words.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i FROM h WHERE t IN (SELECT t FROM h GROUP BY t HAVING count(*) > 1)), range(35) q(k)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""

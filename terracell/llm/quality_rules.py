"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import among, bit_filter, carried
from terracell.llm.quality_classifier import held_out

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks int, n_bad_chunks int, whole_fits boolean"
#: Bins of length for an octave, and of ratios for 1, in which the driver sees fitted ratios.
OCTAVE, STEPS = 8, 256


@dataclass(frozen=True)
class Bands:
    """Limits on bytes / compressed bytes. Short texts compress little and long ones more, so each length has its own.

    whole: (texts of fewer bytes than this, least ratio, greatest ratio), ascending. chunk_*: the same for
    chunks of chunk_bytes; a shorter last chunk is judged only from min_chunk_bytes on. A document fails if
    its own ratio is out of its band, or more than bad_share of its judged chunks are out of theirs. The
    defaults are wide and judge where nothing is known; fitted() gives limits by eighths of an octave. chunks:
    limits on chunks by length like whole; where it is empty, chunk_low and chunk_high hold.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 1.5), (128, 0.75, 2.0), (256, 0.9, 2.4), (512, 1.1, 2.7), (1024, 1.25, 3.0), (2048, 1.35, 3.3), (4096, 1.45, 3.6), (16384, 1.5, 4.0), (float("inf"), 1.55, 4.5),
    )
    chunk_bytes: int = 2048
    min_chunk_bytes: int = 1024
    chunk_low: float = 1.35
    chunk_high: float = 3.6
    chunks: tuple[tuple[float, float, float], ...] = ()
    bad_share: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _table(SYMBOLS)
#: Bytes that begin a code point and aren't blank.
_CHAR = np.array([(b & 0xC0) != 0x80 and b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, where, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def fits(limits: tuple[tuple[float, float, float], ...], size: int, ratio: float) -> bool:
    """Whether a ratio is within the limits for its size."""
    _, low, high = limits[bisect_right(limits, size, key=lambda x: x[0])]
    return low <= ratio <= high


def measured(text: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple:
    """The MEASURES of one text, in that order."""
    words, raw = text.split(), np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ratio = len(text) / len(squeeze.compress(text))
    chunks = bad = 0
    for k in range(0, len(text), bands.chunk_bytes):
        part = text[k : k + bands.chunk_bytes]
        if len(part) >= bands.min_chunk_bytes:
            chunks += 1
            bad += not fits(bands.chunks or ((math.inf, bands.chunk_low, bands.chunk_high),), len(part), len(part) / len(squeeze.compress(part)))
    return (
        len(words), int(np.count_nonzero(_CHAR[raw])), int(np.count_nonzero(_SYMBOL[raw])), len(lines) - len(set(lines)), repeated_words(words),
        len(text), ratio, chunks, bad, fits(bands.whole, len(text), ratio),
    )


def measures(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of MEASURES for each text; a null text counts as empty."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in MEASURES.split(", ")]

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def measure(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        rows = [measured(x or b"", bands, squeeze) for x in texts.cast(pa.large_binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return measure(text)


def _base_failed(words: int, repeats: int, bands: Bands) -> bool:
    return words < bands.min_words or 100 * repeats > bands.max_repeat_percent * words


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """np.quantile of ascending values that come as often as counts say, without repeating them."""
    ends = np.cumsum(counts)
    at = q * (int(ends[-1]) - 1)
    k = math.floor(at)
    a, b = values[np.searchsorted(ends, [k, min(k + 1, int(ends[-1]) - 1)], side="right")]
    return float(a + (b - a) * (at - k))


def limits_of(counts: dict[int, dict[int, int]], tail: float, least: int, beyond: tuple[tuple[float, float, float], ...]) -> tuple[tuple[float, float, float], ...]:
    """Limits by length that leave a share `tail` of the counted ratios out on either side.

    counts: how often each ratio (times STEPS) comes in each bin of length (OCTAVE times its binary logarithm).
    Ratios are taken from a line through the medians of the bins, and each bin borrows what its neighbours
    have around that line until there are `least`; with fewer, limits are wider. beyond: the limits of lengths
    below and above all bins, and of all lengths if no bin has five rows.
    """
    have = {k: (np.array(sorted(c)) / STEPS, np.array([c[r] for r in sorted(c)])) for k, c in counts.items()}
    solid = sorted(k for k, (_, n) in have.items() if n.sum() >= 5)
    if not solid:
        return beyond
    middles = [quantile(*have[k], 0.5) for k in solid]
    first, last = min(have), max(have)
    at = lambda k: float(np.interp(k, solid, middles))
    fitted = []
    for k in range(first, last + 1):
        for reach in range(last - first + 1):
            near = [j for j in range(k - reach, k + reach + 1) if j in have]
            if sum(int(have[j][1].sum()) for j in near) >= least:
                break
        off, times = np.concatenate([have[j][0] - at(j) for j in near]), np.concatenate([have[j][1] for j in near])
        order = np.argsort(off, kind="stable")
        low, high = (quantile(off[order], times[order], q) for q in (tail, 1 - tail))
        few = max(0.0, 1 - int(times.sum()) / least)  # the fewer rows, the less do their extremes say
        fitted.append((2.0 ** ((k + 1) / OCTAVE), at(k) + low - few * (high - low) / 2 - 1 / STEPS, at(k) + high + few * (high - low) / 2 + 1 / STEPS))
    start, end = 2.0 ** (first / OCTAVE), fitted[-1][0]
    below = [x for x in beyond if x[0] < start]
    edge = next(x for x in beyond if x[0] >= start)
    return (*below, (start, *edge[1:]), *fitted, *[x for x in beyond if x[0] > end])


def fitted(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), tail: float = 0.0025, chunk_tail: float = 0.001, least: int = 400) -> Bands:
    """bands with limits by length from the documents (doc_id, text) that labels (doc_id, quality) call clean.

    Measures all documents of quality 1 that aren't held out (see quality_classifier) and pass the base rules.
    A filter of bits spares most of the others; only lengths and ratios are shuffled, to meet the labels, no
    text is. The driver gets counts by bins of length and ratio, a bounded table. Without such rows the bands
    stay as they are.
    """
    clean = F.col("doc_id").isNotNull() & (F.col("quality").cast("int") == 1) & ~held_out(F.col("doc_id"))
    usable = labels.where(clean).select("doc_id").distinct()
    key = F.xxhash64(F.col("doc_id").cast("string"))
    likely = bit_filter(usable.select(key.alias("key")), "key", usable.count())

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            b, out = b.filter(pa.array(among(likely, b["key"].to_numpy().view(np.uint64)))), []
            for row, text in enumerate(b["text"].cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                if _base_failed(len(words), repeated_words(words), bands):
                    continue
                chunks = [text[k : k + bands.chunk_bytes] for k in range(0, len(text), bands.chunk_bytes)]
                for kind, part in [(0, text), *[(1, c) for c in chunks if len(c) >= bands.min_chunk_bytes]]:
                    out.append((row, kind, math.floor(OCTAVE * math.log2(len(part))), round(STEPS * len(part) / len(squeeze.compress(part)))))
            rows, *measured = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), *measured], ["doc_id", "kind", "bin", "ratio"])

    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", key.alias("key"))
    rows = texts.mapInArrow(ratios, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, kind int, bin int, ratio int").join(usable, "doc_id", "left_semi")
    counts: list[dict[int, dict[int, int]]] = [{}, {}]
    for r in rows.groupBy("kind", "bin", "ratio").count().collect():
        counts[r["kind"]].setdefault(r["bin"], {})[r["ratio"]] = r["count"]
    wide = ((math.inf, bands.chunk_low, bands.chunk_high),)
    return replace(bands, whole=limits_of(counts[0], tail, least, bands.whole), chunks=limits_of(counts[1], chunk_tail, least, bands.chunks or wide))


def judged(docs: DataFrame, bands: Bands = Bands(), text: str = "text", out: str = "quality_rules") -> DataFrame:
    """docs with a struct column: MEASURES, base_failed, in_band, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated 3-word
    windows. in_band: the whole text's ratio and its chunks' are within the bands. kept: in_band and not
    base_failed. Null and empty texts fail the base rules; all columns of docs, repeated rows included, stay
    as they are (a column called like out is replaced). One pass without any shuffle.
    """
    m = F.col("_m")
    base = (m["n_words"] < bands.min_words) | (100 * m["n_repeat_words"] > bands.max_repeat_percent * m["n_words"])
    band = m["whole_fits"] & (m["n_bad_chunks"] <= bands.bad_share * m["n_chunks"])
    fields = [m[x.split()[0]].alias(x.split()[0]) for x in MEASURES.split(", ")]
    return docs.withColumn("_m", measures(F.col(text), bands)).withColumn(out, F.struct(*fields, base.alias("base_failed"), band.alias("in_band"), (band & ~base).alias("kept"))).drop("_m")


def filtered(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that judged() keeps, with their own columns."""
    return judged(carried(docs, F.col(text).alias("text")), bands, "text", "_rules").where("_rules.kept").select("_row.*")

"""Quality scores by a Naive Bayes support vector machine.

Indicators of word and word-shape n-grams, hashed into a table of fixed size, are scaled by the log ratio of
their counts in the two classes; a linear hinge-loss model is fitted on them by dual coordinate descent, and
its margins become probabilities by a logistic fit on rows that the model did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Most labelled rows that are learned from (their number is about this if there are more).
SAMPLE = 20_000
MEMO = 400_000
_SHAPE = bytes(65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")


class NGrams:
    """Distinct hashed features of a text: words, pairs of words, and up to three shapes in a row.

    A shape has A, a and 9 for letters and digits and marks as they are, with runs as one. Words are
    remembered with both hashes, up to MEMO of them.
    """

    def __init__(self, bits: int = BITS):
        self.bits, self.index = bits, {}
        self.word, self.shape = np.zeros(MEMO * 2, np.uint64), np.zeros(MEMO * 2, np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > MEMO:
            self.index.clear()
            new = set(words)
        if len(new) > len(self.word):
            self.word, self.shape = np.zeros(2 * len(new), np.uint64), np.zeros(2 * len(new), np.uint64)
        for w in new:
            k = self.index[w] = len(self.index)
            self.word[k] = xxhash.xxh3_64_intdigest(w)
            self.shape[k] = xxhash.xxh3_64_intdigest(_RUN.sub(rb"\1", w.translate(_SHAPE)), 7)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        w, s = self.word[at], self.shape[at]
        p = np.uint64(0x9E3779B97F4A7C15)
        q = s[:-1] * p + s[1:]
        every = np.concatenate([w, w[:-1] * p + w[1:] * np.uint64(3), s, q, q[:-1] * p + s[2:]])
        every = (every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((every >> np.uint64(64 - self.bits)).astype(np.int64))


def log_count_ratios(rows: list[tuple[int, np.ndarray]], size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of class 1's indicators / share of class 0's) for each feature."""
    counts = np.full((2, size), smooth)
    for y, x in rows:
        counts[y, x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def hinge_fit(rows: list[tuple[int, np.ndarray]], r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 42) -> np.ndarray:
    """Weights of the scaled, length-normed indicators, and a bias in the last place, by dual coordinate descent.

    Minimises |w|^2 / 2 + c * sum of hinge losses; classes weigh alike, whatever their numbers.
    """
    w, rng = np.zeros(len(r) + 1), np.random.default_rng(seed)
    y = np.array([1.0 if a else -1.0 for a, _ in rows])
    share = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    top = np.where(y > 0, c * len(y) / (2 * share[0]), c * len(y) / (2 * share[1]))
    x = [_scaled(b, r) for _, b in rows]
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            at, v = rows[k][1], x[k]
            slope = y[k] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[k] - slope / (v @ v + 1.0), 0.0), top[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * y[k] * v
                w[-1] += (new - alpha[k]) * y[k]
                alpha[k] = new
    return w


def _scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[x]
    return v / max(1e-9, float(np.sqrt(v @ v)))


def logistic_fit(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with a little shrinkage; a is at least 0."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - y) * margins).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = p * (1 - p)
        m = np.array([[(h * margins**2).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def model_of(rows: list[tuple[int, int, np.ndarray]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature, squared scales by feature), with bias and the logistic's a, b behind the weights.

    rows: (label, fold, features). Fold 0 calibrates a model of the other folds; the model used is fitted on
    all rows. With one class or none, all scores are that class's share (0.5 without rows).
    """
    size = 1 << bits
    y = np.array([a for a, _, _ in rows], float)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return np.concatenate([np.zeros(size), [0.0, 0.0, np.log(p / (1 - p))]]), np.zeros(size)
    train, test = [(a, x) for a, f, x in rows if f], [(a, x) for a, f, x in rows if not f]
    fit = train if len({a for a, _ in train}) == 2 else [(a, x) for a, _, x in rows]
    held = test if len({a for a, _ in test}) == 2 else fit
    r = log_count_ratios(fit, size)
    w = hinge_fit(fit, r)
    a, b = logistic_fit(np.array([w[x] @ _scaled(x, r) + w[-1] for _, x in held]), np.array([a for a, _ in held], float))
    every = [(a_, x) for a_, _, x in rows]
    r = log_count_ratios(every, size)
    w = hinge_fit(every, r)
    return np.concatenate([w[:-1] * r, [w[-1], a, b]]), r * r


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The model of docs (doc_id, text) and labels (doc_id, label 0 or 1).

    Learns from at most about `sample` label rows, chosen by a hash of doc_id among those that aren't held
    out; these few narrow rows are broadcast, so no text is shuffled to find its label. Their features go to
    one task, which fits. Rows with a null id or another label are left out; a doc_id with several label rows
    counts as often.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(n, 1))) < sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(bits)
        for b in batches:
            xs = [grams.of(t or b"").astype("<i4").tobytes() for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], ["y", "fold", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(y, f, np.frombuffer(x, "<i4")) for y, f, x in zip(*(b.column(k).to_pylist() for k in range(3)))]
        rows.sort(key=lambda row: (row[0], row[1], row[2].tobytes()))
        w, s = model_of(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()]), pa.array([s.astype("<f8").tobytes()])], ["w", "s"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)).cast("int")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", fold.alias("fold"), "text")
    got = labelled.mapInArrow(features, "y int, fold int, x binary").repartition(1).mapInArrow(fit, "w binary, s binary").collect()
    if not got:
        return model_of([], bits)
    return np.frombuffer(got[0]["w"], "<f8"), np.frombuffer(got[0]["s"], "<f8")


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """docs with a score from 0 to 1, higher for likelier label 1, from the whole text alone; null and empty texts get the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** bits numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, squares = shared.value
        bias, a, b = weights[-3:]
        grams = _grams(bits)
        margins = []
        for t in texts.cast(pa.large_binary()).to_pylist():
            x = grams.of(t or b"")
            margins.append(bias + weights[x].sum() / max(1e-9, float(np.sqrt(squares[x].sum()))))
        return pa.array(1 / (1 + np.exp(-np.clip(a * np.array(margins) + b, -30, 30))), pa.float64())

    return docs.withColumn(out, score(F.col(text)))


_GRAMS: dict[int, NGrams] = {}


def _grams(bits: int) -> NGrams:
    """The worker's n-gram hasher; it lives as long as the worker."""
    if bits not in _GRAMS:
        _GRAMS[bits] = NGrams(bits)
    return _GRAMS[bits]

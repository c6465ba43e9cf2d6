"""Personal data in texts with very many matches: the same spans as brute force, in time that grows with the matches."""

import time

import numpy as np
from pyspark.sql import functions as F

from terracell.llm import pii
from test_small_operators import brute_spans, docs


def test_prefixes(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [int(x) for x in rng.integers(-50, 50, n)]) for k, n in enumerate((0, 1, 2, 63, 64, 65, 128, 1000))]
    df = spark.createDataFrame(rows, "k int, v array<int>").select("v", pii.before_each(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), pii.before_each(F.col("v"), pii.larger, F.lit(-99)).alias("m"))
    for r in df.collect():
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] and r["m"] == [max([-99, *r["v"][:k]]) for k in range(len(r["v"]))]


def test_a_contact_list(spark):
    pairs = 5000
    text = "\n".join(f"Ünal {k} call +1 (212) 555-{k % 10000:04d} or mail user{k}@example{k % 7}.org, tel 0{k % 10} 555-{k % 1000:03d}-1234" for k in range(pairs))
    df = docs(spark, [text])
    began = time.time()
    got = pii.found(df.select("doc_id", "text")).first()
    spent = time.time() - began
    assert [tuple(x) for x in got["base_spans"]] == brute_spans(text) and len(got["base_spans"]) == 2 * pairs
    assert spent < 60, spent  # two passes and their compilation; it was some hours when each match copied all before it
    red = pii.redacted(df, pii.Model()).first()["text"]
    want, at = [], 0
    for start, kind, stop in brute_spans(text):
        want += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = stop
    assert red == "".join(want) + text[at:]


def test_what_candidates_touch(spark):
    rng = np.random.default_rng(1)
    bits = ["a@b.co", " at 10.0.0.1", "4111 1111 1111 1111", "+1 212 555 1234", " (212) 555-1234", " x[at]y[dot]org ", "1.2.3.4.5", " ", "-", "\n", "word", "99"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(60)]
    for r in pii.with_spans(docs(spark, texts).select("text")).collect():
        for c in r["_cand"]:
            touched = sum({1 << b["kind"] for b in r["_base"] if b["start"] < c["stop"] and c["start"] < b["stop"]})
            assert c["touched"] == touched
        assert [c["start"] for c in r["_cand"]] == sorted(c["start"] for c in r["_cand"])


def test_only_the_best_of_touching_candidates_stay(spark):
    model = pii.Model({k: [pii.Tree(value=1.0 + n)] for n, k in enumerate(pii.KINDS)}, dict.fromkeys(pii.KINDS, 0.0))
    text = " ".join(f"00{k % 10} 555-{k % 1000:03d}-12{k % 100:02d} 1.2.3.{k % 256}.9 u{k}[at]v" for k in range(800))
    r = pii.found(docs(spark, [text]).select("doc_id", "text"), model).first()
    cand = pii.with_spans(docs(spark, [text]).select("text")).first()["_cand"]
    free = [c for c in cand if not c["touched"]]
    order = lambda c: (c["kind"], -c["start"])
    best = [c for c in free if not any(o["start"] < c["stop"] and c["start"] < o["stop"] and order(o) > order(c) for o in free)]
    added = {(c["start"], c["kind"], c["stop"]) for c in best}
    assert {tuple(x) for x in r["spans"]} == added | {tuple(x) for x in r["base_spans"]} and len(added) > 1000

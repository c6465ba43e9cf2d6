"""Each text operator against brute force on small tables, and its edge cases: nulls, empty texts and tables, repeats, clashing names."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from terracell.llm import chat, embedding_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, tokens
from terracell.llm.common import components, ranked, running_total
from terracell.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def clashing(df):
    """df with columns named like what operators use inside."""
    names = ["_row", "_key", "_hash", "_rules", "spans", "rank", "copies", "bits", "_t", "_copy", "size", "quality_rules"]
    return df.withColumns({n: F.lit(7) for n in names})


# shared helpers


def test_ranks(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", 2), ("a", 1), (None, 4)], "k string, v int")
    got = sorted(((r["k"] or "~", r["v"], r["rank"]) for r in ranked(df, ["k"], ["v"], "t").collect()))
    assert got == [("a", 1, 0), ("a", 1, 1), ("a", 3, 2), ("b", 2, 0), ("~", 4, 0), ("~", 5, 1)]
    assert ranked(df.where("v > 9"), ["k"], ["v"], "t").count() == 0


def test_running_total(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("o"), F.lit(2).alias("v"))
    assert all(r["t"] == r["o"] // 3 * 2 for r in running_total(df, "o", "v", "t", block=32).collect())


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 99), (5, 5), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 101: 99, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# 1


def test_classifier(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "light"], 40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["WIN!!", "###", "$$$", "CLICK", "now"], 40)) for _ in range(60)]
    df = docs(spark, [t for pair in zip(good, bad) for t in pair] + [None, "", "the of", "WIN!! ###"])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)] + [(None, 1), (3, None), (5, 9)], "doc_id long, quality int")
    scored = quality_classifier.scored(clashing(df), quality_classifier.fitted(df, labels))
    score = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(score) == 124 and all(0 <= s <= 1 for s in score.values())
    assert min(score[k] for k in range(0, 120, 2)) > max(score[k] for k in range(1, 120, 2))
    assert score[120] == score[121] and score[122] > score[123]
    none = quality_classifier.fitted(df, labels.where("quality > 9"))
    assert all(r["score"] == pytest.approx(0.5) for r in quality_classifier.scored(df, none).collect())
    assert quality_classifier.scored(df.where("doc_id < 0"), none).count() == 0


def test_held_out_rows_are_not_learned(spark):
    df = spark.range(50).select(quality_classifier.held_out(F.col("id")).alias("h"), "id")
    assert {r["id"]: r["h"] for r in df.collect()} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}


# 2


def brute_rules(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rng = np.random.default_rng(0)
    noise = bytes(rng.integers(33, 127, 9000, dtype=np.uint8)).decode()
    texts = [None, "", " \n\t", prose(1, 200), prose(1, 60) * 30, "a b c " * 100, "é ü x\x1cy # <b>\n# <b>\n\n", " ".join(noise[k : k + 6] for k in range(0, 9000, 6)), prose(2, 3000)]
    got = {r["doc_id"]: r["q"] for r in quality_rules.judged(docs(spark, texts), out="q").collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k])[:5] == brute_rules(t), k
    assert [k for k in got if got[k]["kept"]] == [3, 8]
    assert got[0]["base_failed"] and got[5]["base_failed"] and not got[4]["in_band"] and not got[7]["in_band"]
    kept = quality_rules.filtered(clashing(docs(spark, texts)))
    assert kept.columns == clashing(docs(spark, [])).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 8]
    assert quality_rules.filtered(docs(spark, [])).count() == 0


def test_limits_follow_labelled_texts(spark):
    rng = np.random.default_rng(5)
    clean = [prose(k, int(rng.integers(60, 700))) for k in range(240)]
    fields = lambda k: " ".join(f"{w} #$%" for w in prose(1000 + k, int(rng.integers(100, 350))).split())
    df = docs(spark, clean + [fields(k) for k in range(60)])
    labels = spark.createDataFrame([(k, int(k < 240)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    loose = {r["doc_id"] for r in quality_rules.filtered(df).collect()}
    bands = quality_rules.fitted(df, labels)
    assert bands == quality_rules.fitted(df.repartition(3), labels) and [x[0] for x in bands.whole] == sorted(x[0] for x in bands.whole)
    kept = {r["doc_id"] for r in quality_rules.filtered(df, bands).collect()}
    unseen = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]  # never fitted on
    assert sum(k in loose for k in range(240, 300)) == 60 and sum(k in kept for k in range(240, 300)) <= 6
    assert sum(k in kept for k in unseen if k < 240) >= 0.9 * sum(k < 240 for k in unseen)
    assert quality_rules.fitted(df, labels.where("doc_id < 0")).whole == quality_rules.Bands().whole


def test_limits_come_from_all_labelled_texts(spark, monkeypatch):
    n, seen = 30_000, []
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    df = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", words))
    labels = spark.range(n).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 10 != 3).cast("int").alias("quality"))
    real = quality_rules.limits_of
    monkeypatch.setattr(quality_rules, "limits_of", lambda counts, *more: seen.append(sum(sum(c.values()) for c in counts.values())) or real(counts, *more))
    quality_rules.fitted(df, labels.unionByName(labels))
    assert seen == [sum(k % 10 != 3 and zlib.crc32(str(k).encode()) % 5 != 0 for k in range(n)), 0]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 2000), st.integers(1, 50), min_size=1), st.sampled_from([0.0, 0.001, 0.0025, 0.5, 0.9975, 1.0]))
def test_quantiles_of_counts(counts, q):
    values, times = np.array(sorted(counts)) / 256, np.array([counts[k] for k in sorted(counts)])
    assert quality_rules.quantile(values, times, q) == pytest.approx(np.quantile(np.repeat(values, times), q), abs=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60))
def test_repeats_by_brute_force(t):
    assert quality_rules.repeated_words(t.encode().split()) == brute_rules(t)[4]


# 3


def test_targets_fill_up(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 400), ("d", 0)], "source string, size int")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sized).collect()}
    total, weight, cap = 1510 * 1.5, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 200, "b": 2000, "c": 800, "d": 0, None: 20}
    left, want = dict(weight), {}
    while True:
        level = (total - sum(want.values())) / sum(left.values())
        over = [k for k in left if left[k] * level > cap[k]]
        if not over:
            break
        for k in over:
            want[k] = cap[k]
            left.pop(k)
    want.update({k: w * level for k, w in left.items()})
    assert {k: t for k, (_, t) in got.items()} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(total)


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(k, ["x", "x", "x", "y", None][k % 5], int(rng.integers(0, 50))) for k in range(2000)] + [(1, "x", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, size int")
    got = mixing.mixed(df).collect()
    again = mixing.mixed(df.repartition(3)).collect()
    pick = lambda rs: sorted((r["doc_id"], r["size"], r["copies"]) for r in rs)
    assert len(got) == len(rows) and pick(got) == pick(again) and all(0 <= r["copies"] <= 2 for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in {r["source"]: r["target"] for r in got}.items():
        assert abs(taken[s] - t) <= 60
    assert mixing.mixed(df.where("doc_id < 0")).count() == 0


def test_sampled_documents_keep_their_columns(spark):
    df = clashing(docs(spark, [prose(k, 20) for k in range(40)] + [None, ""]))
    df = df.unionByName(df.where("doc_id = 3"))
    out = mixing.sampled(df)
    n = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == df.columns and set(n) <= set(range(42)) and 50 <= sum(n.values()) <= 68 and max(n.values()) <= 4


# 4


def brute_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k + j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_passages(spark):
    a, b = prose(1, 100), prose(2, 90)
    shared = " ".join(a.split()[20:70])
    texts = [a, None, "", b + " " + shared + "\n" + prose(3, 10), b, prose(4, 34), "x " * 200, prose(5, 36), prose(5, 35), a, shared + " y " + shared]
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id = 7"))
    got = substring_dedup.deduplicated(clashing(df)).collect()
    want = brute_removal([*texts, texts[7]], 35)
    for r in got:
        assert (r["n_words"], r["n_removed"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert len(got) == len(texts) + 1 and substring_dedup.deduplicated(docs(spark, [])).count() == 0


def thue_morse(n, letters):
    return [letters[k.bit_count() % 2] for k in range(n)]


def test_patterns_that_polynomials_confuse_stay(spark):
    """Thue-Morse words and their complements, of letters and of words: equal under any polynomial hash modulo 2**64."""
    tail = prose(6, 34)
    pairs = [("".join(thue_morse(2048, "ab")), "".join(thue_morse(2048, "ba"))), (" ".join(thue_morse(4096, ["no", "yes"])), " ".join(thue_morse(4096, ["yes", "no"])))]
    texts = [f"{w} {tail}" for w in pairs[0]] + [f"{w}  {prose(20 + k, 40)}" for k, w in enumerate(pairs[1])] + [f"{w} x" for w in pairs[0]]
    texts += ["\0 " * 34 + "\0", "\0\0 " * 34 + "\0", "w" * 500_000 + " " + prose(30, 40), "w" * 499_999 + "v " + prose(31, 40)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(docs(spark, texts)).collect()}
    for k, want in enumerate(brute_removal(texts, 35)):
        assert (got[k]["n_words"], got[k]["n_removed"], bytes(got[k]["kept"])) == want, k
    assert got[0]["n_removed"] == got[1]["n_removed"] == 0


def test_index_runs_are_compacted(spark):
    texts = [prose(k % 7, 60) for k in range(14)]
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    new = [index.add(docs(spark, texts[k : k + 2])).distinct().count() for k in range(0, 14, 2)]
    assert new[:3] == [0, 0, 0] and all(new[4:]) and len(index.runs) <= 2
    whole = substring_dedup.FingerprintIndex(spark)
    assert {r[0] for r in whole.add(docs(spark, texts)).collect()} == {r["print"] for r in index.runs[0].unionByName(index.runs[-1]).groupBy("print").agg(F.sum("n").alias("n")).where("n > 1").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6))
def test_equal_windows_have_equal_fingerprints(rows):
    texts = [" ".join(r).encode() for r in rows]
    w = substring_dedup.Windows(texts, window=5, gram=2)
    flat = [x for r in rows for x in r]
    keys = [tuple(flat[k : k + 5]) for k in w.starts]
    x, y = w.digests()
    seen: dict = {}
    for k, p, d in zip(keys, w.fingerprints()[0].tolist(), zip(x.tolist(), y.tolist())):
        assert seen.setdefault(k, (p, d)) == (p, d)
    assert len({d for _, d in seen.values()}) == len(seen)


# 5


def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    base = prose(9, 300)
    near = [" ".join(w if k != j * 37 else "zz" for k, w in enumerate(base.split())) for j in range(4)]
    texts = [base.upper(), *near, None, "", "one two", "one two three four", prose(10, 50), "Ä one", base]
    df = docs(spark, texts)
    got = simhash.clustered(df.unionByName(df.where("doc_id = 9"))).collect()
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["bits"] & (2**64 - 1) == prints[r["doc_id"]] and r["component_id"] == root[r["doc_id"]]
    rows = clashing(df).unionByName(clashing(df).where("doc_id = 9")).unionByName(clashing(df).where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.deduplicated(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == rows.columns
    assert simhash.deduplicated(docs(spark, [])).count() == 0


def test_near_duplicates_are_verified(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " ", "One  two", "one two"]
    for k in range(40):
        w = prose(500 + k, 150).split()
        texts.append(" ".join(w))
        for _ in range(2):  # a few words of each copy are others, so that similarities lie around 0.8
            v = list(w)
            for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                v[at] = "edited"
            texts.append(" ".join(v))
    sets = [set(zip(*[t.lower().split()[k:] for k in range(5)])) or {tuple(t.lower().split())} for t in (x or "" for x in texts)]
    prints = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    alike = [[j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)] for a in sets]
    linked = [[j for j in js if (prints[i] ^ prints[j]).bit_count() <= 14] for i, js in enumerate(alike)]
    assert sum(map(len, linked)) >= 0.9 * sum(map(len, alike))
    root, before = list(range(len(texts))), None
    while root != before:  # least index that links lead to
        root, before = [min(root[j] for j in js) for js in linked], root
    got = simhash.deduplicated(clashing(docs(spark, texts)), similar=0.8, shingle=5, radius=14, tile=16)
    assert got.columns == clashing(docs(spark, [])).columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))
    assert simhash.deduplicated(docs(spark, []), similar=0.8, shingle=5, radius=14).count() == 0
    assert (corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.SIMILAR) == (5, 0.8) and (simhash.SHINGLE, simhash.RADIUS) == (4, 4)


@pytest.mark.parametrize("n, drift, sided", [(0, False, False), (120, True, False), (120, True, True), (120, False, True), (3000, False, False)])
def test_links_of_a_hot_group(n, drift, sided):
    """Chains and thousands of near copies: links connect what all pairs of similar texts connect."""
    rng = np.random.default_rng(n)
    base, sets = rng.integers(0, 2**63, 200, dtype=np.uint64), []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, 200, 6)] = rng.integers(0, 2**63, 6, dtype=np.uint64)
        base = own if drift else base
        sets.append(np.unique(own))
    prints = np.array([simhash.print_of(x) for x in sets], np.uint64)
    side = (np.arange(n) % 2).astype(np.int8) if sided else None
    i, j = simhash.similar_links(prints, side, sets, 14, 0.8)
    assert len(i) <= max(n - 1, 0)
    label = np.arange(n)
    for a, b in zip(i, j):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) and (side is None or side[a] != side[b])
        label[label == label[b]] = label[a]
    for a in range(min(n, 120)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 14)
        near = [b for b in near if (side is None or side[a] != side[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        assert all(label[b] == label[a] for b in near)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 2000), st.floats(0.8, 1.0))
def test_sketches_keep_what_is_similar(seed, n, similar):
    """Sets of any size with the similarity agree enough; sets with nothing in common don't."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
    common = int(np.ceil(similar * n))
    a, b = x[:n], np.concatenate([x[n - common : n], x[n : n + max(0, int(common / similar) - n)]])
    assert simhash.alike(simhash.sketch_of(a), simhash.sketch_of(np.tile(b, 2))[None], 0.8 if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) else 0.0)[0]
    assert not simhash.alike(simhash.sketch_of(a), simhash.sketch_of(x[2 * n :])[None], 0.8)[0]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 6))
def test_tiles_by_brute_force(seed, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)], np.uint64)
    prints = np.unique(base[rng.integers(0, 12, 120)] ^ flips)
    a, b = prints[::2], prints[1::2]
    parent = {int(x): int(x) for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in (*zip(*simhash.tile_links(a, None, radius)), *zip(*simhash.tile_links(b, None, radius)), *zip(*simhash.tile_links(a, b, radius))):
        p, q = find(int(x)), find(int(y))
        parent[max(p, q)] = min(p, q)
    want = np.arange(len(prints))
    for _ in prints:
        for k, x in enumerate(prints):
            near = np.flatnonzero(np.bitwise_count(prints ^ x) <= radius)
            want[near] = want[near].min()
    groups = lambda f: sorted(sorted(int(prints[k]) for k in range(len(prints)) if f(k) == r) for r in {f(k) for k in range(len(prints))})
    assert groups(lambda k: int(want[k])) == groups(lambda k: find(int(prints[k])))


# 6


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 64))
    rows, truth = [], []
    for k in range(400):
        v = centres[k % 12] + 0.12 * rng.standard_normal(64) if k % 3 else rng.standard_normal(64)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2 if k % 50 else None))
    rows += [(500, rows[1][1], 1), (501, rows[1][1], 1), (502, None, 1), (503, [0.0] * 64, 1), (504, [1.0, None], 1), (505, [float("nan")] * 64, 0), (506, [float("inf"), 1.0], 0), (507, [], 1), (508, [1.0, 2.0], 1), (509, [2.0, 4.0], 1), (510, [3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.linked(df, tile=32).collect()}
    assert len(got) == len(rows)
    bad = {502, 503, 504, 505, 506, 507}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, lab in rows if k not in bad and lab is not None}
    lab = {k: x for k, _, x in rows}
    n, root = Counter(), {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and lab[a] == lab[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
                truth.append((a, b))
    found = sum(r["n_links"] for r in got.values()) / 2
    assert len(truth) > 100 and all(got[k]["n_links"] <= n[k] for k in got) and found >= 0.98 * len(truth)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in bad)
    assert np.mean([got[k]["component_id"] == find(k) for k in got]) > 0.98
    assert embedding_dedup.linked(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("n", [1000, 100_000, 1_000_000, 10_000_000])
def test_recall_holds_at_any_size(n):
    """Pairs at the threshold share a filter of the code that n classes get; vectors closer than it share more."""
    rng, words = np.random.default_rng(3), embedding_dedup.code_words(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for d in (64, 384):
        u, w = unit(rng.standard_normal((400, d))), rng.standard_normal((400, d))
        v = 0.93 * u + np.sqrt(1 - 0.93**2) * unit(w - (w * u).sum(1, keepdims=True) * u)
        a, b = (embedding_dedup.decoded(x, embedding_dedup.code(d, words), embedding_dedup.FILTERS) for x in (u, v))
        assert np.mean([bool(set(x) & set(y)) for x, y in zip(a.tolist(), b.tolist())]) >= 0.95, d


def test_filters_are_the_best_ones():
    rng = np.random.default_rng(4)
    u, books = embedding_dedup.unit_rows(rng.standard_normal(20 * 10), 10), embedding_dedup.code(10, 9)
    scores = ((u @ books[0])[:, :, None] + (u @ books[1])[:, None, :]).reshape(20, -1)
    assert embedding_dedup.decoded(u, books, 7).tolist() == np.sort(np.argsort(-scores, axis=1)[:, :7], axis=1).tolist()
    assert embedding_dedup.decoded(u, embedding_dedup.code(10, 1), 7).tolist() == [[0]] * 20


def test_embeddings_of_clashing_names_and_one_hot_group(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + 0.05 * rng.standard_normal(16)).tolist() if k < 150 else rng.standard_normal(16).tolist(), 3) for k in range(220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit(7) for n in ("node", "filter", "filters", "size", "n", "bin", "key", "kept", "links", "_ok")})
    got = {r["vec_id"]: r for r in embedding_dedup.linked(df, bucket=16, tile=20).collect()}
    unit = np.array([v for _, v, _ in rows]) / np.linalg.norm([v for _, v, _ in rows], axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & ~np.eye(220, dtype=bool)
    assert len(got) == 220 and near[:150, :150].sum() > 20000 and all(got[k]["n_links"] == near[k].sum() for k in range(220))
    assert all(got[k]["component_id"] == (0 if k < 150 else k) for k in range(220))


# 7


def test_turn_codes_and_prefixes_are_apart(spark):
    """Separators and NULs in roles and texts, and nulls beside them, make different turns."""
    first = [("a\x01b", "c"), ("a", "b\x01c"), (None, "x"), ("\0", "x"), ("", "x"), ("-", None), (None, None), ("=1:a", "="), ("1", ":a="), (None, "="), ("x", "\0"), ("x", None), ("x", "")]
    turns = [(k, n, *t) for k, x in enumerate(first) for n, t in enumerate([x, ("user", str(k % 2))])]
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).withColumns({n: F.lit(1) for n in ("depth", "prefix", "_keep", "_n", "_digest")})
    got = {r["conv_id"]: r["n_turns"] for r in chat.rendered(df).collect()}
    assert got == dict.fromkeys(range(len(first)), 2)
    kept = chat.maximal(df)
    assert kept.columns == df.columns and kept.count() == 2 * len(first)
    long = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    assert [tuple(r) for r in chat.rendered(long.unionByName(long.where("turn < 2999").withColumn("conv_id", F.lit(2).cast("long")))).select("conv_id", "n_turns").collect()] == [(1, 3000)]


def test_conversations(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (4, 5, "user", "hi"), (4, 6, "assistant", "hello"), (4, 9, "user", "bye"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "hell"), (6, 0, None, None), (7, 0, "user", ""), (8, None, "user", "x"), (8, 0, "user", "y"), (None, 0, "user", "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("depth2", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.rendered(df).collect()}
    assert set(got) == {2, 5, 6, 7, 8, None}
    assert got[2] == (3, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nbye\n") and got[6] == (1, "<||>\n\n") and got[8][1].startswith("<|user|>\nx")
    assert chat.rendered(df.where("conv_id < 0")).count() == 0


# 8 and 10


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


TEXTS = ["", " ", None, "a b", " a  b\n", "don't we'll it's 'tis", "é² x²y 3a b", "w###\nX, y!? <|endoftext|> z", "日本語 テスト", "tab\tx \r\n y", prose(1, 700), prose(2, 2500)]


def test_encoder(plain_ids):
    own = tokens.Encoder(tokenizer_path(), memo=20)
    for t in [*TEXTS, *TEXTS]:
        assert own.ids(t or "") == plain_ids(t).tobytes()
    flat, counts = own.flat(TEXTS, 2)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [[*plain_ids(t).tolist(), 2] for t in TEXTS] and own.flat([], 2)[0].size == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab é'.,\n\t1²_日# \x1c\r ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_on_any_text(t):
    own = tokens.encoder(tokenizer_path())
    assert own.ids(t) == own.plain(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_byte_coding_round_trip(ranks):
    x = np.array(ranks, "<u4")
    assert tokens.unpack_ranks(*tokens.pack_ranks(x), len(x)).tolist() == ranks


def test_token_files(spark, plain_ids, tmp_path):
    df = clashing(docs(spark, TEXTS)).unionByName(clashing(docs(spark, TEXTS)).where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    directory = f"file://{tmp_path}/t"
    tokens.write_token_files(df, directory, tokenizer_path(), 2, tokens_per_file=1500)
    rows = sorted(tokens.read_token_files(spark, directory).collect(), key=lambda r: r["start"])
    assert len(list((tmp_path / "t").glob("*.tok"))) >= 2 and [r["doc_id"] for r in rows] == [None, *range(len(TEXTS))]
    start = 0
    for r, t in zip(rows, [TEXTS[3], *TEXTS]):
        want = np.append(plain_ids(t), 2).astype("<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(want) // 4, want, zlib.crc32(want))
        start += len(want) // 4
    tokens.write_token_files(docs(spark, []), f"{directory}0", tokenizer_path())


def test_cutting():
    got = [x.tolist() for x in packing.cut(np.array([1024, 1, 2500, 2048]), 1024)]
    assert list(zip(*got)) == [(0, 0, 0, 1024), (1, 0, 0, 1), (2, 0, 0, 452), (2, 1, 452, 1024), (2, 2, 1476, 1024), (3, 0, 0, 1024), (3, 1, 1024, 1024)]
    assert all(len(x) == 0 for x in packing.cut(np.zeros(0, np.int64), 1024))


def brute_best_fit(lengths, most):
    """Number of sequences of best fit, one piece after the other, longest first."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else most) - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 1)), max_size=40))
def test_sweep_by_brute_force(events):
    events = sorted(events, key=lambda e: (-e[0], e[1]))
    free, want = [], {}
    for k, (_, kind) in enumerate(events):
        if kind == 0:
            free.append(k)
        elif free:
            want[k] = free.pop()
    piece, place = packing.matched(np.array([e[1] for e in events], np.int64))
    assert dict(zip(piece.tolist(), place.tolist())) == want


def check_packed(rows, most):
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= most
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_pack_like_best_fit(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP", 50)  # many parts, so that pieces and gaps meet across them
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 101, 300), np.minimum(rng.geometric(0.1, 400), 100), rng.choice([34, 51, 49, 33, 3], 300), np.concatenate([np.full(40, 70), rng.integers(1, 4, 600)])][seed].tolist()
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length int")
    rows = packing.packed(df, 100).collect()
    assert Counter((r["doc_id"], r["length"]) for r in rows) == Counter(enumerate(lengths))
    assert check_packed(rows, 100) <= max(brute_best_fit(lengths, 100) * 1.05, sum(lengths) / 100 + 3)


def test_packing(spark, plain_ids):
    df = clashing(docs(spark, TEXTS)).unionByName(clashing(docs(spark, TEXTS)).where("doc_id = 3"))
    got = packing.packed(packing.pieces(df, tokenizer_path())).collect()
    for r in got:
        ids = np.append(plain_ids(TEXTS[r["doc_id"]]), 2).astype("<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    check_packed(got, 1024)
    assert sum(r["length"] for r in got) == sum(len(plain_ids(t)) + 1 for t in [*TEXTS, TEXTS[3]])
    assert packing.packed(packing.pieces(docs(spark, []), tokenizer_path())).count() == 0


# 9

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if ok(kind, m[0]))


PERSONAL = [
    None, "", "a@b.c@d.e x_a@b.co_b@c.org", "1.2.3.4.5 256.1.1.1 001.002.003.255 9.9.9.9.9.9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111-", "+1 (017) 555-7713 +12 345 +++1 23 45 67 89 0 -",
    "ÄÖ🙂 x@y.example.com, 10.0.0.1\n+49 (030) 1234567", "1 " * 3000 + "a" * 5000 + "@" + "9." * 3000, "@ .@. + . - 12345678901234 0000 0000 0000 0000", "a@b.c " * 200,
]


def test_personal_data(spark):
    df = clashing(docs(spark, PERSONAL).unionByName(docs(spark, PERSONAL).where("doc_id = 6")))
    got = pii.found(df.select("doc_id", "text"), pii.Model()).collect()
    assert len(got) == len(PERSONAL) + 1
    for r in got:
        assert [tuple(x) for x in r["base_spans"]] == brute_spans(PERSONAL[r["doc_id"]]) == [tuple(x) for x in r["spans"]], r["doc_id"]
    red = {r["doc_id"]: r for r in pii.redacted(df, pii.Model()).collect()}
    assert pii.redacted(df, pii.Model()).columns == df.columns
    assert red[6]["text"] == "ÄÖ🙂 [EMAIL], [IP]\n[PHONE]" and red[6]["n_chars"] == len(red[6]["text"]) and red[0]["text"] is None
    assert pii.redacted(docs(spark, [])).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 .-+()@ab_\n", max_size=60), min_size=1, max_size=20))
def test_personal_data_on_any_text(spark, texts):
    for r in pii.found(docs(spark, texts).select("doc_id", "text"), pii.Model()).collect():
        assert [tuple(x) for x in r["base_spans"]] == brute_spans(texts[r["doc_id"]])


def test_trees_add_what_looks_like_the_base(spark):
    rng = np.random.default_rng(0)
    number = lambda: f"({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
    texts = [f"please call +1 {number()} soon {k}" for k in range(300)] + [f"order no. {rng.integers(10**15, 10**16)} of lot {k}" for k in range(300)]
    model = pii.fitted(docs(spark, texts))
    assert "phone" in model.thresholds and "email" not in model.thresholds
    asked = ["please call (212) 555-1234 soon", "nothing here", "version 1.2.3 and 12-34"]
    got = {r["doc_id"]: r["spans"] for r in pii.found(docs(spark, asked), model).collect()}
    assert [tuple(x) for x in got[0]] == [(12, 3, 26)] and not got[1] and not got[2]
    row = {"after": 0, "edge": 0, "words": 1, "size": 2, "shape": 2, "check": 1}
    assert all(np.isfinite(t.of(row)) for ts in model.trees.values() for t in ts)


def test_loose_forms_are_added_in_the_texts_that_are_fitted(spark):
    rng = np.random.default_rng(1)
    number = lambda: f"({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
    texts = [f"please call {'+1 ' if k % 2 else ''}{number()} soon {k}" for k in range(200)] + [f"order no. 12 {rng.integers(100, 999)} 555-{rng.integers(1000, 9999)} of lot {k}" for k in range(200)]
    got = {r["doc_id"]: [tuple(x)[1] for x in r["spans"]] for r in pii.found(docs(spark, texts)).collect()}
    assert all(got[k] == [3] for k in range(200)) and not any(got[k] for k in range(200, 400))
    few = [("phone", {"after": 0, "edge": 0, "words": 1, "size": 2, "shape": 2, "check": 1}, 1, k, n) for k, n in ((0, 12), (1, 40))]
    assert "phone" in pii.boosted(few).thresholds and "phone" not in pii.boosted([(*few[0][:4], 2), few[1]]).thresholds

"""Every registered query that has no SQL, over the smallest tables, against brute force; and the classifier's parts."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from terracell.llm import quality_classifier as qc
from terracell.llm.queries import END_ID, ORACLE_SQL, QUERIES, tokenizer_path
from test_small_operators import brute_rules, brute_spans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {k: k + 32 for k in range(65, 91)}


def named(n):
    return next(q for name, q in QUERIES.items() if name.startswith(f"op{n}_"))


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {d: np.append(np.array(t.encode(r["text"] or "", add_special_tokens=False).ids, "<u4"), np.uint32(END_ID)).astype("<u4") for d, r in documents.items()}


def test_each_query_is_tested():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n not in ORACLE_SQL} == {1, 2, 3, 5, 6, 8, 9, 10}


def groups_of(nodes, linked):
    """The smallest node that links lead to, by node."""
    root = {n: n for n in nodes}

    def of(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = of(a), of(b)
        root[max(a, b)] = min(a, b)
    return {n: of(n) for n in nodes}


def test_op1(spark, documents):
    rows = {r["doc_id"]: r for r in named(1)(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert rows.keys() == documents.keys()
    by_text = defaultdict(set)
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        by_text[documents[d]["text"]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    held = [(rows[d]["score"], y) for d, y in labels.items() if d in rows and rows[d]["held_out"] and y in (0, 1)]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert not pairs or np.mean(pairs) >= 0.9


def test_log_count_ratios():
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(2)), np.unique(rng.integers(0, 30, 12))) for _ in range(40)]
    got = qc.log_count_ratios(rows, 32)
    counts = {(y, k): 1 + sum(c == y and k in set(x.tolist()) for c, x in rows) for y in (0, 1) for k in range(32)}
    total = {y: sum(counts[y, k] for k in range(32)) for y in (0, 1)}
    assert got.tolist() == pytest.approx([np.log(counts[1, k] / total[1] * total[0] / counts[0, k]) for k in range(32)])


def test_hinge_loss_is_near_its_least():
    """The loss of dual coordinate descent against plain subgradient descent on the same loss."""
    rng = np.random.default_rng(1)
    rows = [(int(k % 3 == 0), np.unique(np.concatenate([rng.integers(0, 40, 10), rng.integers(0, 12, 3) + (0 if k % 3 else 6)]))) for k in range(90)]
    r = qc.log_count_ratios(rows, 40)
    y = np.array([1.0 if a else -1.0 for a, _ in rows])
    x = np.zeros((len(rows), 41))
    for k, (_, at) in enumerate(rows):
        x[k, at], x[k, 40] = r[at] / np.sqrt((r[at] ** 2).sum()), 1.0
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(41), np.inf
    for step in range(1, 20_001):
        w = w - (w - x.T @ (cost * y * (y * (x @ w) < 1))) / (step + 10)
        best = min(best, loss(w))
    assert loss(qc.hinge_fit(rows, r, epochs=12)) <= 1.02 * best and loss(qc.hinge_fit(rows, r, epochs=300)) <= 1.001 * best


def test_op2(spark, documents):
    rows = named(2)(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n, chars, symbols, lines, repeats = brute_rules(documents[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_op3(spark, documents):
    rows, again = named(3)(spark, SF).collect(), named(3)(spark, SF).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    size = {d: len(WORD.findall(r["text"] or "")) for d, r in documents.items()}
    sums, taken, longest = Counter(), Counter(), Counter()
    for d, r in documents.items():
        sums[r["source"]] += size[d]
        longest[r["source"]] = max(longest[r["source"]], size[d])
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full)
        target = {s: 2.0 * sums[s] if s in full else left * weight[s] / sum(weight[z] for z in order if z not in full) for s in order}
        more = {s for s in order if target[s] > 2 * sums[s] + 1e-9}
        if not more:
            break
        full |= more
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source] and r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1e-6 for s in order)


def test_op5(spark, documents):
    prints = {}
    for d, r in documents.items():
        words = WORD.findall((r["text"] or "").translate(LOW))
        runs = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in runs], np.uint64)
        prints[d] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) if len(h) else 0
    ordered = sorted(prints)
    root = groups_of(ordered, [(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in named(5)(spark, SF).collect()} == {d: (f"{prints[d]:016x}", root[d]) for d in ordered}


def test_op6(spark):
    vectors = {r["vec_id"]: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit = {}
    for v, r in vectors.items():
        x = np.array([np.nan if e is None else e for e in r["embedding"] or []], float)
        if len(x) and np.isfinite(x).all() and x.any() and r["label"] is not None:
            unit[v] = x / np.sqrt(x @ x)
    ordered = sorted(unit)
    linked = [(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if vectors[a]["label"] == vectors[b]["label"] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    n, root = Counter(x for p in linked for x in p), groups_of(vectors, linked)
    rows = named(6)(spark, SF).collect()
    assert {r["vec_id"]: r["kept"] for r in rows} == {r["vec_id"]: r["component_id"] == r["vec_id"] for r in rows} and len(rows) == len(vectors)
    assert all(r["n_links"] <= n[r["vec_id"]] for r in rows) and sum(r["n_links"] for r in rows) >= 0.9 * 2 * len(linked)
    assert sum(r["component_id"] == root[r["vec_id"]] for r in rows) >= 0.9 * len(rows)


def test_op8(spark, ids):
    start, want = 0, {}
    for d in sorted(ids):
        want[d] = (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in named(8)(spark, SF).collect()} == want


def test_op9(spark, documents):
    import hashlib

    kinds = ("email", "ip", "card", "phone")
    rows = named(9)(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = brute_spans(documents[r["doc_id"]]["text"])
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and [r[f"n_{k}"] for k in kinds] == [sum(x[1] == j for x in base) for j in range(4)]
        assert set(listed) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op10(spark, ids):
    rows = named(10)(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and (len(parts) == 1) == (len(ids[d]) <= 1024) and sum(r["length"] for r in parts) == len(ids[d])
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert len(parts) == 1 or all(r["length"] == 1024 for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(len(x) for x in ids.values())
    assert len(by_sequence) <= 1.05 * (-(-total // 1024)) + 3

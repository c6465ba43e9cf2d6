"""Line removal, manifests and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.llm import infill, line_dedup, manifest
from terracell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], DOCS)


def clashing(df):
    return df.withColumns({n: F.lit(7) for n in ("_row", "_rest", "_out", "id", "i", "key", "gone", "of", "lines", "infill", "leaf", "pos", "m", "root", "bucket", "proof", "batch")})


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if n.startswith("op")))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


# 13


def brute_infill(doc_id, text):
    t = text or ""
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(t), form, lo, hi - lo, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def check_infill(df, rows, columns):
    got = infill.transformed(df).withColumn("back", infill.restored(F.col("infill.output"), F.col("infill.form")))
    assert got.columns[:-1] == [*[c for c in columns if c != "infill"], "infill"]
    found = Counter((r["doc_id"], r["text"], *r["infill"], r["back"]) for r in got.collect())
    assert found == Counter((d, t, *brute_infill(d, t), t or "") for d, t, _ in rows)


def test_infill(spark):
    rows = [(None, "without an id", "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (3, "x", "en"), (4, "has <P> in it", "en"), (5, "<M>", "en"), (6, "<P", "en"), (7, "S> <", "en")]
    rows += [(k, "äö🙂\n\r\x00 ́ \\Q'%" * (k % 40), "de") for k in range(10, 200)]
    rows += [(300, "wörd " * 400_000, "en"), (301, "🙂" * 64, "en"), (302, "y" * 128, "en"), (303, "<" * 200, "en")]
    rows += [(12, rows[11][1], "de")] * 3 + [(k, "z" * 65, "en") for k in range(400, 500)]
    check_infill(docs(spark, rows), rows, DOCS.replace(" long", "").replace(" string", "").split(", "))
    df = clashing(docs(spark, rows[:40]))
    check_infill(df, rows[:40], df.columns)
    assert {brute_infill(d, t)[1] for d, t, _ in rows} == {"plain", "psm", "spm"}
    check_infill(docs(spark, []), [], docs(spark, []).columns)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<PSM>aé🙂\n", max_size=150), min_size=1, max_size=30))
def test_infill_of_any_text(spark, texts):
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    check_infill(docs(spark, rows), rows, docs(spark, rows).columns)


def test_infill_forms(spark):
    forms = infill.Forms("[a.*]", "[b'|]", "\\E[c]", plain=0, suffix_first=100, seed="x")
    got = infill.transformed(docs(spark, [(k, "some text", "en") for k in range(50)]), forms=forms)
    rows = got.select("infill.output", infill.restored(F.col("infill.output"), F.col("infill.form"), forms).alias("back")).collect()
    assert {r["back"] for r in rows} == {"some text"}
    assert all(r["output"].startswith("[b'|]") and "[a.*]" in r["output"] and "\\E[c]" in r["output"] for r in rows)


# 12


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({k: k + 32 for k in range(65, 91)})
    order = lambda d: (d is None, d or 0)
    held = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(order(d))
    out = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == order(d)]
        out[d, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return out


def check_lines(df, rows):
    got = line_dedup.deduplicated(df, name="test")
    assert got.columns == list(dict.fromkeys([*df.columns, "lines"]))
    assert Counter((r["doc_id"], r["text"], r["lines"]["n_lines"], r["lines"]["n_dropped"]) for r in got.collect()) == brute_lines(rows)


def test_lines(spark):
    pool = ["A shared line of text", "  a SHARED line of text\t", "short", "0123456789", "012345678", "ÄÖÜ äöü ßßß 🙂🙂", "äöü äöü ßßß 🙂🙂", " wide blanks stay ", "wide blanks stay", "x" * 300_000, "", " ", "\v\f\rcarriage return here\r"]
    rng = np.random.default_rng(3)
    rows = [(int(k), "\n".join(rng.choice(pool, rng.integers(0, 9))), "en") for k in range(60)]
    rows += [(None, "A shared line of text\nonly here, twice\nonly here, twice", None), (None, "only here, twice", None), (None, "0123456789\nwith and without id", "de"), (70, "with and without id", "en")]
    rows += [(80, None, "en"), (81, "", "en"), (82, "\n\n", "en"), (90, "this row is repeated\nthis row is repeated", "en"), (90, "this row is repeated", "en"), (91, "this row is repeated", "en")]
    rows += [(k, "very frequent line\n" * 3 + f"own line of {k}", "en") for k in range(100, 400)]
    for parts in (1, 7):
        check_lines(docs(spark, rows).repartition(parts), rows)
    check_lines(clashing(docs(spark, rows)), rows)
    check_lines(docs(spark, []), [])
    check_lines(docs(spark, [(None, None, None)]), [(None, None, None)])


def test_full_filters_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", (15, 15))
    rng = np.random.default_rng(4)
    rows = [(k, "\n".join(f"number {x} of many lines" for x in rng.integers(0, 60_000, 200)), "en") for k in range(150)]
    check_lines(docs(spark, rows).repartition(5), rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\t\r", max_size=80), min_size=1, max_size=12))
def test_lines_of_any_text(spark, texts):
    rows = [(k // 2, t, "en") for k, t in enumerate(texts)]
    check_lines(docs(spark, rows), rows)


def test_twice_seen_lines_are_in_the_merged_filter(spark):
    lines = [f"this is line {k}" for k in range(4000)]
    rows = [(k, "\n".join(lines[40 * k : 40 * k + 60]), "en") for k in range(100)]
    for bits, parts in ((15, 3), (20, 6)):
        data = line_dedup.seen_twice(docs(spark, rows).repartition(parts).select("text"), 10, bits)
        has = line_dedup.Bloom(bits, data).has(line_dedup.hashes(pa.array(lines)))
        twice = [sum(40 * k <= x < 40 * k + 60 for k in range(100)) > 1 for x in range(4000)]
        assert all(has[np.array(twice)]) and (bits == 15 or has[~np.array(twice)].mean() < 0.05)


def test_blocks_of_filters():
    rng = np.random.default_rng(5)
    for share in (0, 0.001, 0.5, 1):
        block = np.packbits(rng.random(1 << 15) < share, bitorder="little")
        assert np.array_equal(line_dedup.unpacked(line_dedup.packed(block)), block) and len(line_dedup.packed(block)) <= 4096


# 11


def brute_digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, width):
    """(top, a list of (left, right) for each leaf)."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // width * width
            proofs[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + width])))
        at = [p // width for p in at]
        level = [sha("".join(level[k : k + width])) for k in range(0, len(level), width)]
    return level[0], proofs


def brute_manifest(rows, width):
    groups = {}
    for d, t, lang in rows:
        groups.setdefault(lang, []).append((d, brute_digest(d, "s", lang, len(t or ""), t)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([x[1] for x in groups[g]], width)
    root, above = brute_tree([trees[g][0] for g in order], width)
    return Counter((d, leaf, trees[g][0], root, tuple(p + above[k])) for k, g in enumerate(order) for (d, leaf), p in zip(groups[g], trees[g][1], strict=True))


def check_manifest(df, rows, width, height):
    got = manifest.manifest(df, width=width, height=height, also={"again": manifest.digest(*[F.col(c) for c in manifest.COLUMNS])}, name="test")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "again"]
    found = got.withColumn("folds", manifest.folded(F.col("again"), F.col("proof")) == F.col("root")).collect()
    assert all(r["folds"] and r["leaf"] == r["again"] for r in found)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in found) == brute_manifest(rows, width)


@pytest.mark.parametrize("width, height, sizes", [(2, 2, {"en": 37, "de": 4, None: 5, "": 1, "ü": 16}), (8, 4, {"en": 4097, "de": 513, "fr": 1}), (3, 1, {"a": 9, "B": 10, "": 3, "aa": 2}), (8, 4, {None: 1})])
def test_manifest(spark, width, height, sizes):
    rows = [(3 * k % 10007, f"text {k} ÄÖ🙂", lang) for lang, n in sizes.items() for k in range(n)]
    check_manifest(docs(spark, rows), rows, width, height)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None), (None, "", "en"), (None, "", "en"), (5, "same", "en"), (5, "same", "en"), (5, "other", "en"), (-3, "x" * 1_000_000, "en"), (7, "1:a-", "=en"), (7, "-", "-")]
    check_manifest(docs(spark, rows), rows, 2, 2)
    df = clashing(docs(spark, rows))
    got = manifest.manifest(df, width=2, height=2, name="test").collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in got) == brute_manifest(rows, 2)
    assert manifest.manifest(docs(spark, []), name="test").count() == 0


def test_manifest_needs_no_python_worker(spark):
    """Workers' memory beside a full heap stopped the executors of larger tables."""
    got = manifest.manifest(docs(spark, [(k, "x", "en") for k in range(70)]), name="test")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Arrow" not in plan and "Python" not in plan


def test_manifest_tells_changed_rows(spark):
    rows = [(k, f"Text {k}" if k % 3 else f"text {k}", "en" if k % 2 else "de") for k in range(100)]
    low = manifest.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text"))
    got = manifest.manifest(docs(spark, rows), also={"low": low}, name="test")
    for r in got.select("doc_id", (manifest.folded(F.col("low"), F.col("proof")) == F.col("root")).alias("same"), manifest.siblings(F.col("proof")).alias("s"), "proof").collect():
        assert r["same"] == (r["doc_id"] % 3 == 0) and r["s"] == "".join(a + b for a, b in r["proof"])

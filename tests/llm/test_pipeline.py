"""The pipeline's stages against plain versions of what they decide."""

import inspect
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from terracell.llm import pii, quality_rules
from terracell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()} if k < 4 else None
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        seen.append(len(rows))
        if k < 4:
            assert docs.columns == columns, name
        if k < 2:
            assert 0 < len(rows) < len(before) and all(r == before[r["doc_id"]] for r in rows), name
        if k == 2:
            assert len(rows) == len(before) and any("[" in r["text"] and r["text"] != before[r["doc_id"]]["text"] for r in rows)
        if k == 3:
            n = Counter(r["doc_id"] for r in rows)
            assert max(n.values()) <= 2 and all(r == before[r["doc_id"]] for r in rows)
    assert max(sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}) <= 1024
    whole = corpus_pipeline.run(spark, SF)
    pick = lambda rs: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rs)
    assert pick(whole.collect()) == pick(rows)


def test_quality_learns_from_all_labelled_texts(spark, tmp_path, monkeypatch):
    n, seen = 26_000, []
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", F.concat_ws(" ", words))
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    real = quality_rules.limits_of
    monkeypatch.setattr(quality_rules, "limits_of", lambda counts, *more: seen.append(sum(sum(c.values()) for c in counts.values())) or real(counts, *more))
    corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert seen[0] == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(n)) > 20_000


def test_personal_data_learns_and_calibrates_on_all_texts(spark):
    texts = [f"please call +1 (2{k}2) 555-{1234 + k} soon {k}" for k in range(20, 34)] + ["please call (212) 555-1234 soon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert got[len(texts) - 1] == "please call [PHONE] soon"


def test_evidence_of_every_fold_counts_for_thresholds():
    features = {"after": 0, "edge": 0, "words": 1, "size": 2, "shape": 2, "check": 1}
    good = [("phone", features, 1, k, 20) for k in range(4)]
    assert "phone" in pii.cross_boosted(good).thresholds
    for k in range(4):
        model = pii.cross_boosted([*good, ("phone", features, 0, k, 40)])
        assert "phone" in model.trees and "phone" not in model.thresholds
        other = {**features, "words": 0}
        model = pii.cross_boosted([*good, ("phone", other, 0, k, 40), ("phone", other, 0, (k + 1) % 4, 40)])
        score = lambda f: sum(t.of(f) for t in model.trees["phone"])
        assert score(features) >= model.thresholds["phone"] > score(other)

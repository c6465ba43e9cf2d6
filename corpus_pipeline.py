"""The text pipeline: quality rules, near-duplicates, personal data, mixing, packing. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracell.llm import mixing, packing, pii, quality_rules, simhash
from terracell.llm.common import table, tuned, written
from terracell.llm.queries import END_ID, tokenizer_path

#: Near-duplicates: words of a shingle, bits within which texts are compared, and the least Jaccard similarity.
NEAR_SHINGLE, NEAR_RADIUS, SIMILAR = 5, 14, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules keep."""
    tuned(spark)
    return quality_rules.filtered(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of SIMILAR: the one with the smallest doc_id."""
    tuned(spark)
    return simhash.deduplicated(docs, name="pipeline-simhash", similar=SIMILAR, shingle=NEAR_SHINGLE, radius=NEAR_RADIUS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.sampled(docs, name="pipeline-mix")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    tuned(spark)
    return packing.packed(packing.pieces(docs, tokenizer_path(), END_ID), name="pipeline-pack")


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mix", mix), ("pack", pack)]

#: Compression, fingerprints and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, in order, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

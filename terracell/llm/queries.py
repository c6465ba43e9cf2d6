"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import chat, embedding_dedup, infill, line_dedup, manifest, mixing, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, tokens
from terracell.llm.common import n_words, table, tuned

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fitted(docs, table(spark, sf_dir, "labels"))
    rows = quality_classifier.scored(docs, model)
    return rows.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.judged(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")), out="q")
    return rows.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept", "q.ratio")


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = mixing.mixed(docs, name="op3")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op4_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.deduplicated(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), name="op4")
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.clustered(table(tuned(spark), sf_dir, "documents"), name="op5")
    return rows.select("doc_id", simhash.hexadecimal(F.col("bits")).alias("fingerprint"), "component_id")


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"), name="op6")


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op8_ranked_varbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(spark, table(tuned(spark), sf_dir, "documents"), tokenizer_path(), END_ID)


def op9_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return rows.select("doc_id", *[pii.counted(base, k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(tuned(spark), sf_dir, "documents"), tokenizer_path(), END_ID)
    return packing.packed(parts, name="op10").select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op11_merkle_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest, and what its proofs make of a copy of the table in which some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    text, upper = F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)
    columns = [changed if c == "text" else F.col(c) for c in manifest.COLUMNS]
    rows = manifest.manifest(docs, also={"tampered": manifest.digest(*columns)}, name="op11")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), manifest.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), name="op12")
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_duckdb_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.transformed(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"))
    out, form = F.col("infill.output"), F.col("infill.form")
    return rows.select("doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(infill.restored(out, form), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_naive_bayes_svm, op2_compression_bands, op3_systematic_mix, op4_window_index, op5_simhash_tiles,
        op6_cap_filters, op7_snapshot_collapse, op8_ranked_varbyte, op9_candidate_boosting, op10_best_fit,
        op11_merkle_buckets, op12_bloom_lines, op13_duckdb_infill,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_window_index": substring_dedup.ORACLE_SQL, "op7_snapshot_collapse": chat.ORACLE_SQL, "op11_merkle_buckets": manifest.ORACLE_SQL, "op12_bloom_lines": line_dedup.ORACLE_SQL, "op13_duckdb_infill": infill.ORACLE_SQL}

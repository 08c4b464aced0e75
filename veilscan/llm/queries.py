"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import audit, cutting, fingerprints, html_text, infilling, jaccard, lines, mixing, packing, quality, secrets, sql, substrings, toxicity
from veilscan.llm._common import table
from veilscan.sources.tables import spread

SEQUENCE_LENGTH = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path(), SEQUENCE_LENGTH)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.Repeats(window=50).run(spread(table(spark, sf_dir, "documents")))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    return lines.line_rules(spread(table(spark, sf_dir, "documents"))).select(*names)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(mixing.measured(spread(table(spark, sf_dir, "documents"))))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(spread(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.Join(k=4, num=85, den=100).run(spread(table(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")), with_text=False).drop("masked")


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op11_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer_path(), SEQUENCE_LENGTH)


def op12_infilling_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.Infilling().run(spread(table(spark, sf_dir, "documents")), with_text=False)


def op13_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say: each document's size and its source's target."""
    return op4_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can say: the base spans of each document, counted."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"mix_targets": mix_targets, "secret_counts": secret_counts}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)

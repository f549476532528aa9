"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, conversations, decontam, gif_media, html_text, line_dedup, ngram_join, packing, secrets, spelling, suffix_dedup, token_counts, toxicity, warc
from tessella.llm.oracles import ORACLE_SQL


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(common.table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.table(spark, sf_dir, "documents"))


def op3_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.digests(gif_media.store_texts(common.table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(common.table(spark, sf_dir, "pages"), warc.archive_folder(spark))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(common.table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(common.table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(common.table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_secret_scans, op2_ngram_join, op3_media_gif, op4_packing, op5_decontamination, op6_token_counts, op7_toxicity, op8_warc, op9_suffix_dedup, op10_html_text, op11_line_dedup, op12_conversation_repair, op13_spelling_variants)
}
__all__ = ["ORACLE_SQL", "QUERIES"]

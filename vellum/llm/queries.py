"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import alignment, bpe, html_extract, lloyd, mpeg_audio, ngram_join, packing, quality, quality_rules, suffix_dedup, toxicity, url_filter, winnow
from vellum.llm.common import table, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, num=85, den=100)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digest(table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the current policy over the stored ledger."""
    stored = written(quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text")), "ledger")
    return quality_rules.verdicts(stored, quality_rules.POLICIES[quality_rules.CURRENT])


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_media_columns": op6_media_columns,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_byte_level_bpe": op9_byte_level_bpe,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: SQL for those of them that SQL can express.
ORACLES: dict[str, str] = {"op11_quality_rules": quality_rules.SQL, "op13_centroid_clustering": lloyd.SQL}

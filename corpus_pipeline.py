"""From raw documents to packed sequences: STAGES, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``.  All stages but the last return the columns of
``documents``.  Nulls are kept as such where nothing has to be judged: a null text is scored
like an empty one, is nobody's near copy, and is packed as an end of document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from vellum.llm.common import discard, remember, small_batches, table, written

#: Scores that decide, as in the queries of the two classifiers.
QUALITY, TOXIC = quality.THRESHOLD, toxicity.THRESHOLD


def _kept(docs: DataFrame, decision: Callable[[DataFrame], Column]) -> DataFrame:
    """The rows of ``docs`` for which the decision column holds, with the columns of ``docs``."""
    small_batches(docs.sparkSession)
    judged = docs.select(F.struct("*").alias("row"), decision(docs).alias("kept"))
    return judged.where("kept").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return _kept(docs, lambda d: quality.score(model) >= QUALITY)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _kept(docs, lambda d: toxicity.score(d, model) < TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at least 0.8 over five-word shingles join, the one with the least id.

    Documents without words aren't linked, so they stay, as do rows with a null id.  Of rows that share an id and a text
    one stays; rows that share an id and differ in their texts all stay, if their id does.
    """
    linked = ngram_join.link_components(docs.select("doc_id", "text"))
    facts = linked.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("_gone"), (F.count("*") > 1).alias("_many"))
    facts = written(facts.where("_gone OR _many"), "facts")
    left = docs.select(F.struct("*").alias("row"), "doc_id").join(facts, "doc_id", "left").where("NOT coalesce(_gone, false)")
    alone, many = left.where("NOT coalesce(_many, false)"), left.where("_many")
    return alone.select("row.*").unionByName(many.select("row.*").dropDuplicates(["doc_id", "text"]))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that stand elsewhere, too; ``n_chars`` follows.

    A code point that is cut in its middle goes as a whole.  A document of which nothing is left goes.
    """
    spans = suffix_dedup.repeated_spans(docs, "doc_id", "text")

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        remember("suffixes")
        return pd.Series([suffix_dedup.cut_text(t, [(s["from"], s["to"]) for s in x]) if isinstance(t, str) else None for t, x in zip(text, spans, strict=True)])

    joined = suffix_dedup.with_spans(docs, spans)
    cut = joined.withColumn("left", left(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans")).where("left IS NULL OR left <> ''")
    columns = []
    for name in docs.columns:
        value = F.col("row")[name]
        if name == "text":
            value = F.coalesce("left", value)
        elif name == "n_chars":
            value = F.when(F.col("left").isNotNull(), F.length("left").cast("long")).otherwise(value)
        columns.append(value.alias(name))
    return cut.select(columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifiers; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""An index of page texts that a stream builds: each page once, and no batch twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

_KEYS = ["doc_id", "page_no"]
_SCHEMA = "doc_id long, page_no int, text string, words array<string>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_no, text, words, batch) of all pages that are indexed; no rows before the first batch."""
    try:
        return spark.read.schema(_SCHEMA + ", batch long").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _SCHEMA + ", batch long")


def add_batch(pages: DataFrame, batch: int, path: str) -> None:
    """Indexes the pages (doc_id, page_no, text) that no other batch has.

    A batch owns one folder, which it overwrites: when it is run again after a failure it has the same effect as once.  Of rows
    that share a page the one with the least text counts; a null text is empty.
    """
    spark = pages.sparkSession
    text = F.coalesce("text", F.lit(""))
    new = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), text.alias("text")).groupBy(*_KEYS).agg(F.min("text").alias("text"))
    built = read_index(spark, path).where(F.col("batch") != batch).select(*_KEYS)
    new = new.join(built, _KEYS, "left_anti").withColumn("words", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def indexed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream that keeps the index at ``path``; all that is there is taken, then it ends."""
    return stream.writeStream.foreachBatch(lambda pages, batch: add_batch(pages, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found(index: DataFrame, word: Column | str) -> DataFrame:
    """(doc_id, page_no, hits) of pages that hold a word."""
    w = F.lower(F.lit(word) if isinstance(word, str) else word)
    hits = F.size(F.filter("words", lambda x: x == w))
    return index.select(*_KEYS, hits.cast("long").alias("hits")).where("hits > 0")

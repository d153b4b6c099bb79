"""What the operators of this subpackage share: reading tables, written tables, batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.scratch import discard, written  # noqa: F401  (for the operators)

#: Rows in an Arrow batch for whole texts: a batch of long documents stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; all of its columns if none are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker's memory is bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Of this Python worker: the operator that remembers something between batches, and how to forget it.
_REMEMBERS: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Says that ``name`` remembers things in this worker, which serves one operator after the other: those of others go.

    So a worker holds the memo of one operator, and not the sum of all that it has ever worked for.  An operator that remembers nothing
    says so, too: else its workers hold what those before them remembered.
    """
    others = [k for k in _REMEMBERS if k != name]
    for other in others:
        _REMEMBERS.pop(other)()
    if others:
        give_back()
    _REMEMBERS[name] = forget


def give_back() -> None:
    """Gives memory that this worker no longer needs back to the system, where its allocators keep it for themselves."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def texts(batch: pd.Series) -> Iterator[str]:
    """The texts of a batch; a null is an empty text."""
    for x in batch:
        yield x if isinstance(x, str) else ""


def mapped(df: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[str], tuple]) -> DataFrame:
    """``id_col`` and the columns of ``schema``, which ``row`` makes of each text.

    Ids stay in Spark: pandas would make floats of a batch's ids where one is null.
    """
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def rows(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t) for t in texts(batch)], columns=names)

    return df.select(F.col(id_col).alias("_id"), rows(F.col(text_col)).alias("_row")).select(F.col("_id").cast("long").alias(id_col), "_row.*")

"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that were made for applications that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other
    session a folder in its warehouse, which a cluster shares by definition.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.applicationId not in _OWN:
        local = context.master == "local" or context.master.startswith("local[")
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-vellum-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vellum"
    return _OWN[context.applicationId]


#: Written tables that are still there, by application.
_WRITTEN: dict[str, set[str]] = {}


#: While it is on, a query's shuffle files go when the query ends, and not only when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor never makes Spark run the steps
    before it again, and several readers share one computation.  The shuffle
    files of the steps before go at once, as nothing needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def written_large(df: DataFrame, label: str) -> DataFrame:
    """As ``written``, of a table that grows with the input: joins shuffle it and never gather it on the driver.

    Small files may hold many rows, so their size doesn't tell whether they can be broadcast.  Joins of joins over such
    tables need all keys for co-partitioning, which ``tables.by_document`` may have turned off before.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    out = written(df, label)
    large = out.hint("merge")
    large._scratch_path = out._scratch_path
    return large


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession) -> int:
    """Deletes every written table of this application, and says how many: for a session that goes on after the results it wants were collected or written.

    Frames that were made of them can't be read any more.
    """
    paths = sorted(_WRITTEN.get(spark.sparkContext.applicationId, set()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again: all that came of them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)

"""Tables that grow with the input aren't gathered on the driver."""

from pyspark.sql import functions as F

from vellum.operators import trees, validate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_objects_regions_and_trees(spark):
    ids = spark.range(1, 20)
    refs = ids.select(F.col("id").alias("src"), (F.col("id") * 2).alias("dst"), F.lit(0).alias("place"))
    cells = ids.select((F.col("id") % 3).alias("grid"), (F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), F.col("id").alias("delta"))
    docs = ids.select(F.col("id").alias("doc_id"), F.lit(True).alias("marked"), *[F.lit("x").alias(c) for c in ("lang", "title", "xmp_title")], F.lit(True).alias("shows_title"), F.lit(True).alias("has_tree"))
    nodes = ids.select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Table").alias("kind"),
        F.lit("Table").alias("raw"), F.lit(False).alias("unmapped"), *[F.lit("").alias(c) for c in ("alt", "actual")])
    for df in (trees.pruned(ids, refs, ids.where("id = 1"))[1], trees.top_regions(cells), validate.accessible(docs, nodes, docs.select("doc_id"))):
        assert "BroadcastHashJoin" not in _plan(df) and df.count()

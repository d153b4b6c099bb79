"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge to another; the component is its least id.  A written table.

    Labels go to neighbours and then along themselves (a label's own label), so
    a path of n edges takes about log n rounds.  Each round is a written table,
    and the one before it goes; edges, labels and components never meet in one place.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = both.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))).where("src <> dst")
    both = written(both.distinct(), "edges")
    first = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("component"))
    held = written(first, "labels")
    while True:
        labels = held.select("id", "component")
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        moved = written(step.join(jump, "component", "left").select("id", (F.col("old") != F.least("component", "beyond")).alias("moved"), F.least("component", "beyond").alias("component")), "labels")
        discard(held)
        held = moved
        if held.where("moved").isEmpty():
            discard(both)
            out = held.select("id", "component")
            out._scratch_path = held._scratch_path
            return out

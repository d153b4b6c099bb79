"""Trees and graphs: outlines, role maps, reachability, components of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.scratch import discard
from vellum.sources.scratch import written_large as written


def walk(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """Nodes (node_id, parent_id, title) with depth and path from the roots.

    One equi-join for each level, until a level is empty or too deep; a cycle has no root, so it isn't entered.
    """
    kids = nodes.select(F.col("parent_id").alias("_parent"), "node_id", "title")
    level = written(nodes.where("parent_id IS NULL").select("node_id", "title", F.lit(0).alias("depth"), F.col("title").alias("path")), "level")
    out = level
    for d in range(1, depth + 1):
        above = level.select(F.col("node_id").alias("_above"), F.col("path").alias("_path"))
        below = kids.join(above, F.col("_parent") == F.col("_above")).select("node_id", "title", F.lit(d).alias("depth"), F.concat("_path", F.lit("/"), "title").alias("path"))
        level = written(below, "level")
        if level.isEmpty():
            discard(level)
            break
        out = out.unionByName(level)
    return out


def resolve_roles(roles: DataFrame, steps: int = 64) -> DataFrame:
    """(name, target, hops): names mapped on until a name has no map; a cycle is left after ``steps`` hops.

    Each round follows twice as far, so 64 hops take seven joins.
    """
    out = written(roles.select("name", F.col("role").alias("target"), F.lit(1).alias("hops")), "roles")
    reach = 1
    while reach < steps:
        onward = out.select(F.col("name").alias("_n"), F.col("target").alias("_t"), F.col("hops").alias("_h"))
        step = out.join(onward, out["target"] == onward["_n"], "left").select("name", F.coalesce("_t", "target").alias("target"),
            (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        step = written(step, "roles")
        discard(out)
        out, reach = step, reach * 2
    return out


#: Levels of ids that are read one by one before they are put together in one table.
LEVELS = 16


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids that edges (src, dst) lead to from the roots (id), the roots included: level by level, until one is empty, however deep that is.

    Levels are disjoint, so they end with the ids; they are put together now and then, as a plan shouldn't read hundreds of tables.
    """
    front = written(roots.select("id").distinct(), "reached")
    seen, levels = front, [front]
    while True:
        found = edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen.hint("merge"), "id", "left_anti")
        front = written(found, "reached")
        if front.isEmpty():
            discard(front)
            return seen
        seen, levels = seen.unionByName(front), [*levels, front]
        if len(levels) > LEVELS:  # the last level stays, as the next one is found from it
            seen = written(seen, "reached")
            discard(*levels[:-1])
            levels = [seen]


def pruned(objects: DataFrame, references: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects that the roots (id) lead to, with ``number`` from 1 on without gaps in the order of their old ids, and their references (src, dst, place) in new numbers.

    A reference to an object that isn't there is left out, so none dangles.  Numbers are running totals in two steps: no task sees all objects.
    """
    from vellum.operators.organise import running_total

    there, references = objects.select("id").hint("merge"), references.hint("merge")
    alive = written(references.join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi"), "alive")
    kept = objects.join(reachable(alive, roots.join(there, "id", "left_semi")).hint("merge"), "id", "left_semi")
    kept = written(kept, "kept")
    before = running_total(kept.withColumn("_one", F.lit(1)), "id", "_one", "_before")
    numbered = written(kept.join(before, "id").withColumn("number", (F.col("_before") + 1).cast("long")).drop("_before"), "numbered")
    discard(kept)
    new = numbered.select("id", "number")
    ends = alive.join(new.select(F.col("id").alias("src"), F.col("number").alias("_src")), "src").join(new.select(F.col("id").alias("dst"), F.col("number").alias("_dst")), "dst")
    return numbered, ends.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "place")


def top_regions(cells: DataFrame, most: int = 10) -> DataFrame:
    """(grid, rank, left, right, low, high, pixels, delta, mean) of the ``most`` greatest components of each grid's cells (grid, x, y, delta): by cells, then by the sum of their deltas, then by place."""
    labels = grid_labels(cells).select("grid", "x", "y", "label")
    held = cells.groupBy("grid", "x", "y").agg(F.max("delta").alias("delta")).hint("merge").join(labels, ["grid", "x", "y"])
    box = held.groupBy("grid", "label").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("pixels"),
        F.sum("delta").alias("delta"))
    rank = F.row_number().over(Window.partitionBy("grid").orderBy(F.desc("pixels"), F.desc("delta"), "label"))
    return box.withColumn("rank", rank).where(F.col("rank") <= most).select("grid", "rank", "left", "right", "low", "high", "pixels", "delta", (F.col("delta") / F.col("pixels")).alias("mean"))


def grid_components(cells: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Boxes and densities of 4-neighbour components of cells (grid, x, y)."""
    label = grid_labels(cells, rounds)
    box = label.groupBy("grid", "label").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("cells"))
    area = (F.col("right") - F.col("left") + 1) * (F.col("high") - F.col("low") + 1)
    return box.select("grid", "left", "right", "low", "high", "cells", F.round(F.col("cells") / area, 6).alias("density"))


def grid_labels(cells: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(grid, x, y, label): the least place in the component of each cell: labels go to neighbours until none changes."""
    start = written(cells.select("grid", "x", "y").distinct().withColumn("label", F.struct("y", "x")), "labels")
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    label = start
    for _ in range(rounds):
        sent = label.select("grid", "x", "y", "label", moves.alias("m")).select("grid", (F.col("x") + F.col("m.dx")).alias("x"),
            (F.col("y") + F.col("m.dy")).alias("y"), F.col("label").alias("near"))
        step = label.join(sent.groupBy("grid", "x", "y").agg(F.min("near").alias("near")).hint("merge"), ["grid", "x", "y"]).select("grid", "x", "y",
            F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label is the place of a cell, whose own label may be less: a path takes the logarithm of its length in rounds
        onward = step.select("grid", F.struct("y", "x").alias("label"), F.col("label").alias("beyond"))
        new = written(step.join(onward.hint("merge"), ["grid", "label"], "left").select("grid", "x", "y",
            (F.col("old") != F.least("label", "beyond")).alias("moved"), F.least("label", "beyond").alias("label")), "labels")
        discard(label)
        label = new
        if new.where("moved").isEmpty():
            break
    return label

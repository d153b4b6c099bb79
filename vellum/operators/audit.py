"""Rules over documents: structure, headings, tags, signatures, batches, forms, ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of errors by code, and exit codes of a batch (fixed values).
ERROR_KINDS = {"schema": "SCHEMA", "security": "SECURITY", "validation": "VALIDATION", "input": "INPUT"}


def heading_problems(headings: DataFrame, doc: str, order: str) -> DataFrame:
    """Headings (level) that open above level 1 or skip a level."""
    before = F.lag("level").over(Window.partitionBy(doc).orderBy(order))
    problem = F.when(before.isNull() & (F.col("level") != 1), "first").when(F.col("level") > before + 1, "skip")
    return headings.withColumn("problem", problem).where("problem IS NOT NULL")


def with_parent(tags: DataFrame) -> DataFrame:
    """Opening tags (doc_id, ix, tag) with the tag that holds each: the last one before it that is one level higher.

    ``tags`` have ``step``, 1 for an opening and -1 for a closing one.  Tags meet by document and level.
    """
    order = Window.partitionBy("doc_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    opened = tags.withColumn("depth", F.sum("step").over(order)).where("step = 1").select("doc_id", "ix", "tag", "depth")
    above = opened.select("doc_id", F.col("ix").alias("_ix"), F.col("tag").alias("parent"), (F.col("depth") + 1).alias("depth"))
    last = opened.join(above, ["doc_id", "depth"], "left").where("_ix IS NULL OR _ix < ix").groupBy("doc_id", "ix").agg(F.max_by("parent", "_ix").alias("parent"))
    return opened.join(last, ["doc_id", "ix"], "left").select("doc_id", "ix", "tag", "parent")


def stray_items(tags: DataFrame, item: str = "li", holders: tuple[str, ...] = ("ul", "ol")) -> DataFrame:
    """Items whose own parent isn't one of their holders, wherever else on the page there is one."""
    return with_parent(tags).where((F.col("tag") == item) & ~F.coalesce(F.col("parent").isin(*holders), F.lit(False)))


def untagged(runs: DataFrame, by_page: DataFrame, anywhere: DataFrame) -> DataFrame:
    """Text runs whose mark is tagged neither on their page nor for the whole document: two anti-joins."""
    left = runs.join(by_page.select("doc_id", "page_no", "mcid").distinct(), ["doc_id", "page_no", "mcid"], "left_anti")
    return left.join(anywhere.select("doc_id", "mcid").distinct(), ["doc_id", "mcid"], "left_anti")


def byte_range(a: Column, b: Column, c: Column, d: Column, size: Column) -> tuple[Column, Column]:
    """(valid, covers the file) of a signature's two ranges, start and length each."""
    valid = (a >= 0) & (b >= 0) & (c >= 0) & (d >= 0) & (a == 0) & (a + b <= size) & (c + d <= size) & (c >= a + b)
    return valid, valid & (c + d == size)


def signature_error(ranges: Column, size: Column, contents: Column) -> Column:
    """What is wrong with a signature's byte ranges (start and length, twice) in a file of a size; null if nothing is.

    ``contents`` are the places (from, to) of signature values in the file: one of them must be the gap between the
    two ranges.
    """
    v = [F.get(ranges, F.lit(i)) for i in range(4)]
    whole = F.forall(ranges, lambda x: x.isNotNull() & (F.abs(x - F.round(x)) < 1e-7))
    a, b, c, d = (F.round(x).cast("long") for x in v)
    return (
        F.when(F.coalesce(F.size(ranges) != 4, F.lit(True)), "expected exactly four numbers").when(~whole, "an entry is not an integer")
        .when((a < 0) | (b < 0) | (c < 0) | (d < 0), "offsets and lengths must be non-negative").when(a != 0, "first range must start at byte 0")
        .when((b > size) | (c > size) | (d > size - c), "range extends beyond end of file").when(a + b > c, "ranges overlap")
        .when(~F.exists(contents, lambda x: (x["from"] == a + b) & (x["to"] == c)), "the value does not match the gap")
    )


def batch_report(steps: DataFrame, batch: str, order: str, failed: Column, stops: bool = True) -> DataFrame:
    """Steps run and failed of each batch, its status and exit code; after a failure the rest is skipped."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("_bad", failed.cast("int"))
    rows = rows.withColumn("_skip", (F.coalesce(F.sum("_bad").over(w), F.lit(0)) > 0) if stops else F.lit(False))
    out = rows.groupBy(batch).agg(F.count_if(~F.col("_skip")).alias("run"), F.count_if((F.col("_bad") == 1) & ~F.col("_skip")).alias("failed"),
        F.count_if(F.col("_skip")).alias("skipped"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "FAIL").otherwise("PASS")).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


def error_kind(code: Column) -> Column:
    out = F.lit("RUNTIME")
    for k, v in ERROR_KINDS.items():
        out = F.when(F.lower(code) == k, v).otherwise(out)
    return out


def assignment(text: Column) -> tuple[Column, Column]:
    """Name and value of ``name=value``, split at the first sign; null without a name."""
    at = F.instr(text, "=")
    return F.when(at > 1, F.left(text, at - 1)), F.when(at > 1, F.substr(text, at + 1))


def filled(fields: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, value, state, outcome) of fields (kind, read_only, options, value) with new values where they may be set.

    A null value clears; a button's state follows its value and is Off when cleared.  A value for a field that isn't
    there is an error of its own row, so that a caller can refuse the whole.
    """
    v = values.select(F.col(key).alias("_key"), F.col("value").alias("_new"), F.lit(True).alias("_given"))
    joined = fields.join(v, fields[key] == v["_key"], "full")
    listed = F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0
    outcome = (
        F.when(F.col(key).isNull(), "no such field").when(F.col("_given").isNull(), "kept").when(F.col("read_only"), "read-only").when(F.col("kind") == "signature", "refused")
        .when(F.col("_new").isNull(), "cleared").when((F.col("kind") == "choice") & listed & ~F.array_contains("options", F.col("_new")), "not an option").otherwise("set")
    )
    held = joined.withColumn("outcome", outcome)
    value = F.when(F.col("outcome") == "set", F.col("_new")).when(F.col("outcome") != "cleared", F.col("value"))
    state = F.when((F.col("kind") == "button") & F.col("outcome").isin("set", "cleared"), F.coalesce("_new", F.lit("Off")))
    return held.select(F.coalesce(key, "_key").alias(key), value.alias("value"), state.alias("state"), "outcome")


def fill_result(outcomes: DataFrame) -> DataFrame:
    """One row: how many fields were set, and how many errors there are, any of which refuses the whole."""
    return outcomes.agg(F.count_if(F.col("outcome").isin("set", "cleared")).alias("set"), F.count_if(~F.col("outcome").isin("set", "cleared", "kept")).alias("errors"))


#: Tiles along each side of a page, the share of ink that counts, and inked tiles for a verdict (fixed values).
INK_GRID, INK_LEAST, INK_VERDICT = 32, 0.005, 3


def ink_tiles(pages: DataFrame, mine: DataFrame, reference: DataFrame, parts: int = INK_GRID, least: float = INK_LEAST) -> DataFrame:
    """(grid, inked, missing, extra, status) of pages (grid, width, height, status): tiles that the reference inked, and where the images differ.

    ``mine`` and ``reference`` hold inked cells (grid, x, y).  A page that passed and has none of the reference's ink,
    of at least three tiles, misses its content; a page that didn't pass keeps its status.
    """
    size = pages.select("grid", "width", "height", F.greatest(F.lit(1), F.floor(F.col("width") / parts)).alias("tw"),
        F.greatest(F.lit(1), F.floor(F.col("height") / parts)).alias("th"))

    def tiles(df: DataFrame, name: str) -> DataFrame:
        t = df.join(size, "grid").withColumn("tx", F.floor(F.col("x") / F.col("tw"))).withColumn("ty", F.floor(F.col("y") / F.col("th")))
        # tiles at the right and lower edges are smaller
        wide = F.least(F.col("tw"), F.col("width") - F.col("tx") * F.col("tw"))
        high = F.least(F.col("th"), F.col("height") - F.col("ty") * F.col("th"))
        return t.groupBy("grid", "tx", "ty").agg((F.count("*") / F.first(wide * high) >= least).alias(name))

    both = tiles(reference, "want").join(tiles(mine, "have"), ["grid", "tx", "ty"], "full").select("grid",
        F.coalesce("want", F.lit(False)).alias("want"), F.coalesce("have", F.lit(False)).alias("have"))
    out = both.groupBy("grid").agg(F.count_if("want").alias("inked"), F.count_if(F.col("want") & ~F.col("have")).alias("missing"),
        F.count_if(~F.col("want") & F.col("have")).alias("extra"))
    blank = (F.col("status") == "PASS") & (F.col("inked") >= INK_VERDICT) & (F.col("missing") == F.col("inked"))
    return pages.join(out, "grid").select("grid", "inked", "missing", "extra", F.when(blank, "MISSING_CONTENT").otherwise(F.col("status")).alias("status"))


def most_inked(cells: DataFrame, stride: int = 4) -> DataFrame:
    """Of each page the image with most inked cells among every fourth one; the first of equal ones: (page, image, ink)."""
    ink = cells.groupBy("page", "image").agg(F.count_if((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).alias("ink"))
    best = ink.groupBy("page").agg(F.min(F.struct((-F.col("ink")).alias("_i"), "image")).alias("m"))
    return best.select("page", F.col("m.image").alias("image"), (-F.col("m._i")).alias("ink"))

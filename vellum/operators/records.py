"""Smaller operators over records of documents: selection, rules, boxes, names, marks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.scratch import discard, written

#: Pages that a sample takes (fixed values).
SAMPLE = (1, 2, 5, 20)


def manifest_pages(docs: DataFrame, doc: str, count: str, manifest: DataFrame, mode: str) -> DataFrame:
    """(doc, page_number) that a manifest (doc, page_number) names and a document has.

    A document of which only page 0 stands there could not be opened: all of its pages are taken, or the first one if
    ``mode`` isn't "all".  A document that the manifest doesn't name has none.
    """
    named = docs.select(doc, count).join(manifest.select(doc, "page_number").distinct(), doc)
    taken = named.where((F.col("page_number") > 0) & (F.col("page_number") <= F.col(count))).select(doc, "page_number")
    closed = named.where("page_number = 0").join(taken.select(doc).distinct(), doc, "left_anti").select(doc, count)
    return taken.unionByName(selected_pages(closed, doc, count, "all" if mode == "all" else "first"))


def selected_pages(docs: DataFrame, doc: str, count: str, mode: str) -> DataFrame:
    """(doc, page_number) of the first page, of a sample, or of all pages; a document without pages has none."""
    pages = {"first": F.array(F.lit(1)), "sample": F.array(*map(F.lit, SAMPLE)), "all": F.sequence(F.lit(1), F.greatest(F.col(count).cast("int"), F.lit(1)))}[mode]
    return docs.select(doc, count, F.explode(pages).alias("page_number")).where(F.col("page_number") <= F.col(count)).select(doc, "page_number")


def recent(df: DataFrame, key: str, pinned: Column, ts: str, most: int = 20) -> DataFrame:
    """The most recent entries of a list, pinned ones first."""
    return df.groupBy(key).agg(F.max(ts).alias("last"), F.bool_or(pinned).alias("pinned")).orderBy(F.desc("pinned"), F.desc("last"), key).limit(most)


def conformant(results: DataFrame, doc: str) -> DataFrame:
    return results.groupBy(doc).agg((~F.bool_or(F.col("status") == "Fail")).alias("conformant"), F.count_if(F.col("status") == "Fail").alias("failures"))


def mark_depth(marks: DataFrame, doc: str, order: str, step: str) -> DataFrame:
    """Depth of nested marks after each one: a running sum of +1 and -1."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("depth", F.sum(step).over(w))


#: Lengths in points that tell a field from decoration (fixed values).
LINE_LEAST, LINE_THICK, ABOVE, BOX_LEAST, BOX_MOST, ASPECT = 50.0, 2.0, 16.0, 6.0, 24.0, 0.4


def suggested_fields(paths: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind, name, box) of stroked paths that look like fields of a form.

    ``paths`` are single lines (x0, y0, x1, y1) or rectangles (x, y, width, height) under a matrix: a long thin line
    is a text field above it, a small square a checkbox.  Names count in drawing order.
    """
    m, p = F.col("matrix"), F.col("box")

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]

    line = F.col("shape") == "line"
    x0, y0 = point(p[0], p[1])
    x1, y1 = point(F.when(line, p[2]).otherwise(p[0] + p[2]), F.when(line, p[3]).otherwise(p[1] + p[3]))
    drawn = paths.select("*", F.least(x0, x1).alias("left"), F.least(y0, y1).alias("bottom"), F.greatest(x0, x1).alias("right"), F.greatest(y0, y1).alias("top"))
    w, h = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    square = w.between(BOX_LEAST, BOX_MOST) & h.between(BOX_LEAST, BOX_MOST) & (F.abs(w / F.nullif(h, F.lit(0.0)) - 1) <= ASPECT)
    kind = F.when(line & (w >= LINE_LEAST) & (h <= LINE_THICK), "text").when(~line & square, "checkbox")
    found = drawn.withColumn("kind", kind).where("kind IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_no", "kind").orderBy("ix"))
    text = F.col("kind") == "text"
    return found.select(
        "doc_id", "page_no", "kind", F.concat(F.when(text, "Text").otherwise("Checkbox"), n.cast("string")).alias("name"), "left",
            F.when(text, F.col("top") + 1).otherwise(F.col("bottom")).alias("bottom"), "right",
        F.when(text, F.col("top") + 1 + ABOVE).otherwise(F.col("top")).alias("top"),
    )


def fields_of(fields: DataFrame, *kinds: str) -> DataFrame:
    """Fields of some kinds; all of them if none is named."""
    return fields.where(F.col("kind").isin(*kinds)) if kinds else fields


def in_field_order(fields: DataFrame, doc: str) -> DataFrame:
    """Fields with their place: from the top, then from the left, then by name."""
    return fields.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("top"), "left", "field")))


def commands(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows with the command (id, title, cli) that they name, if it is known; the registry is a small table with one row for each id."""
    return rows.join(F.broadcast(registry.withColumnRenamed("id", key)), key, "left").withColumn("known", F.col("title").isNotNull())


def image_facts(pixels: DataFrame, key: str, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(key, pixels, mean_red, mean_green, mean_blue, mean_alpha, dark, transparent, not_white) of pixels (key, x, y, red, green, blue, alpha) in a region (left, top, right, bottom).

    Dark is a luminance under 64, transparent an alpha under 255; white is 250 and more in all colours, and opaque.
    """
    if region:
        left, top, right, bottom = region
        pixels = pixels.where((F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom))
    light = 299 * F.col("red").cast("long") + 587 * F.col("green") + 114 * F.col("blue")  # in thousandths, whole numbers
    white = (F.least("red", "green", "blue") >= 250) & (F.col("alpha") >= 255)
    means = [(F.sum(c) / F.count("*")).alias(f"mean_{c}") for c in ("red", "green", "blue", "alpha")]
    return pixels.groupBy(key).agg(F.count("*").alias("pixels"), *means, F.count_if(light < 64_000).alias("dark"), F.count_if(F.col("alpha") < 255).alias("transparent"), F.count_if(~white).alias("not_white"))


def stamp_position(anchor: Column, width: Column, height: Column, size: Column, margin: float = 36.0) -> tuple[Column, Column]:
    """Where a page number of a width goes, by its anchor (top or bottom, then left, centre or right)."""
    x = F.when(anchor.endswith("left"), margin).when(anchor.endswith("centre"), (width - size) / 2).otherwise(width - margin - size)
    return x, F.when(anchor.startswith("top"), height - margin).otherwise(F.lit(margin))


def merged_counts(df: DataFrame, column: str) -> DataFrame:
    """Maps of counts added up: (key, n)."""
    return df.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def unlinked(widgets: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Fields, and widgets that no field links, with their origin."""
    orphans = widgets.join(fields.select(key), key, "left_anti").select(key, F.lit("widget").alias("origin"))
    return fields.select(key, F.lit("field").alias("origin")).unionByName(orphans)


def resolved(links: DataFrame, names: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of destinations (link, target, array): by name, else by the page that an array names, else by a reference, else as a number.

    Chained left joins on names and on references.
    """
    by_name = names.select(F.col("name").alias("_n"), F.col("page").alias("_np"))
    by_ref = pages.select(F.col("ref").alias("_r"), F.col("page").alias("_rp"))
    asked = links.withColumn("_ref", F.coalesce(F.get("array", F.lit(0)), "target"))
    out = asked.join(by_name, asked["target"] == F.col("_n"), "left").join(by_ref, F.col("_ref") == F.col("_r"), "left")
    return out.select("link", "target", F.coalesce("_np", "_rp", F.expr("try_cast(target AS BIGINT)")).alias("page"))


def destinations(dests: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, page, fit, x, y, zoom) of named destinations (name, ref, fit, params); unknown fits and missing ones are XYZ without numbers."""

    def at(i: int) -> Column:
        return F.get("params", F.lit(i))

    fit = F.col("fit")
    known = F.coalesce(fit.isin("Fit", "FitH", "FitV", "FitB", "FitBH", "FitBV", "FitR", "XYZ"), F.lit(False))
    x = F.when(fit.isin("FitV", "FitBV", "FitR", "XYZ"), at(0))
    y = F.when(fit.isin("FitH", "FitBH"), at(0)).when(fit.isin("FitR", "XYZ"), at(1))
    held = dests.join(pages.withColumnRenamed("ref", "_ref"), dests["ref"] == F.col("_ref"), "left")
    return held.select("name", "page", F.when(known, fit).otherwise("XYZ").alias("fit"), x.alias("x"), y.alias("y"), F.when(fit == "XYZ", at(2)).alias("zoom"))


def element_texts(kids: DataFrame, marked: DataFrame, sep: str = " ", deepest: int = 64) -> DataFrame:
    """(doc_id, element, text) of structure elements: marked content by page and mark, and nested elements, in the order of references.

    ``kids`` are (doc_id, page_no, element, place, mcid, child); each has a mark or a child.  Going down, a piece of
    text keeps its path of places, so one sort of an element's pieces puts them in order.
    """
    own = kids.where("mcid IS NOT NULL").join(marked, ["doc_id", "page_no", "mcid"]).select("doc_id", "element", F.array("place").alias("path"), "text")
    nested = kids.where("child IS NOT NULL").select("doc_id", F.col("element").alias("above"), F.col("place").alias("_place"), F.col("child").alias("element"))
    level = written(own, "pieces")
    tables = [level]
    for _ in range(deepest):
        up = level.join(nested, ["doc_id", "element"]).select("doc_id", F.col("above").alias("element"), F.concat(F.array("_place"), "path").alias("path"), "text")
        level = written(up, "pieces")
        if level.isEmpty():
            discard(level)
            break
        tables.append(level)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return ordered_text(every, ["doc_id", "element"], "path", "text", sep)


def ordered_text(parts: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = " ") -> DataFrame:
    """Parts of each key joined in order; a key's parts are those of one element."""
    held = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return parts.groupBy(*keys).agg(F.concat_ws(sep, held).alias("text"))


def rgb_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return (1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k)


def near_white(r: Column, g: Column, b: Column) -> Column:
    return (r >= 0.95) & (g >= 0.95) & (b >= 0.95)


def before_placeholder(text: Column) -> Column:
    """What stands before the first run of three signs that mark a blank to fill in."""
    return F.rtrim(F.regexp_extract(text, "^(.*?)(?:_{3}|-{3}|$)", 1))


def slashed(path: Column, root: Column) -> Column:
    """A path with plain slashes, relative to a root that it stands below."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith(root), F.substr(p, F.length(root) + 1)).otherwise(p)


def part_name(stem: Column, part: Column, parts: Column) -> Column:
    """The name of a part, with as many digits as the number of parts has."""
    return F.concat(stem, F.lit("_"), F.lpad(part.cast("string"), F.length(parts.cast("string")), "0"), F.lit(".pdf"))


def suggested_name(path: Column, tag: Column | str) -> Column:
    """A path with a tag before its extension."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    stem, extension = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("_"), tag, extension)


def numbered_names(df: DataFrame, path: str, order: str) -> DataFrame:
    """Paths that are taken get a number before their extension, from 2 on."""
    n = F.row_number().over(Window.partitionBy(path).orderBy(order))
    return df.withColumn("_n", n).withColumn(path, F.when(F.col("_n") > 1, suggested_name(F.col(path), F.col("_n").cast("string"))).otherwise(F.col(path))).drop("_n")


def wall_budget(pages: Column, extra: Column, seconds: int, most: int) -> Column:
    return F.least(F.lit(most), (pages * (3 + extra) + 2) * seconds)


#: Statuses that say that a password is missing (fixed values).
LOCKED = ("PASSWORD_REQUIRED", "UNSUPPORTED_ENCRYPTED")


def agreement(status: Column, rendered: Column, oracles: Column) -> Column:
    """State of a page that was scanned, by its status, whether it was rendered, and what other renderers said.

    A renderer that wasn't asked (null), one that refused and one that was OK are three things.
    """
    ok, attempted = F.exists(oracles, lambda o: F.coalesce(o == "OK", F.lit(False))), F.exists(oracles, lambda o: o.isNotNull())
    return (
        F.when(status == "PASS", "PASS").when(status == "PASS_ONE", "ORACLE_SPLIT").when(status.isin("DIFF", "MISSING_CONTENT"), status)
        .when(rendered & ~ok, "OWN_ONLY").when(rendered, "RENDERED").when(status.isin(*LOCKED), "CREDENTIAL_BLOCKED").when(ok, "OWN_SIDE_GAP")
        .when(attempted, "AGREED_REFUSAL").otherwise("UNCORROBORATED")
    )


def triage(status: Column, rendered: Column, oracles: Column, error_type: Column) -> tuple[Column, Column]:
    """Of pages that didn't pass: (part, list): rendered, refused or a gap; and the list of it to look at, else null.

    A page without a status didn't pass either.
    """
    passed = F.coalesce(status == "PASS", F.lit(False))
    ok = F.exists(oracles, lambda o: F.coalesce(o == "OK", F.lit(False)))
    part = F.when(passed, None).when(rendered, "rendered").when(ok, "gap").otherwise("refusal")
    listed = (
        F.when((part == "refusal") & status.isin(*LOCKED), "credential-blocked").when((part == "rendered") & (status == "DIFF"), "disagrees")
        .when((part == "rendered") & (F.length(F.coalesce(error_type, F.lit(""))) > 0), "degraded").when(part == "gap", "not to be pinned")
    )
    return part, listed

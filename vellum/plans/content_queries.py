"""Queries over drawing operators: filters, states, marks, images, structure, obstructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import content as C
from vellum.plans.layout_queries import _areas, _AREAS
from vellum.sources.content import OPERATORS_SQL, operators
from vellum.sources.tables import lines, load


def _ops(spark, sf_dir):
    return operators(load(spark, sf_dir, "documents").select("doc_id", "text"))


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def operator_categories(spark, sf_dir):
    return _count(_ops(spark, sf_dir).select(C.category(F.col("name")).alias("category"), "name"), "category", "name")


def operators_without_category(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    left = _count(C.without_category(ops, "PathPainting", "Color"), "doc_id").withColumn("side", F.lit("left"))
    return left.unionByName(_count(C.of_category(ops, "PathPainting", "Color"), "doc_id").withColumn("side", F.lit("taken")))


def operators_without_area(spark, sf_dir):
    left = C.without_area(_ops(spark, sf_dir), _areas(spark, sf_dir))
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("left").isNull()).alias("without_box"), F.count_if(F.col("name") == "Tj").alias("texts"))


def find_text_operators(spark, sf_dir):
    return _count(C.find_text(_ops(spark, sf_dir), "Tion"), "doc_id", "page_no")


def transform_operators(spark, sf_dir):
    text = F.when(F.col("name") == "Tj", F.replace("arg", F.lit("e"), F.lit("EE"))).otherwise(F.col("arg"))
    moved = C.transformed(_ops(spark, sf_dir), left=F.col("left") + 5, right=F.col("right") + 5, arg=text)
    return moved.groupBy("doc_id").agg(F.sum("left").alias("left_sum"), F.sum("right").alias("right_sum"), F.sum(F.length("arg")).alias("size"), F.count("*").alias("n"))


def graphics_state(spark, sf_dir):
    state = C.with_state(_ops(spark, sf_dir)).where("name IN ('Tj', 'Do', 'f')")
    return state.groupBy("doc_id", "name").agg(*[F.sum(F.col("matrix")[i]).alias(c) for i, c in enumerate("abcdef")])


def marked_content_mcid(spark, sf_dir):
    shown = C.with_state(_ops(spark, sf_dir)).where("name = 'Tj'")
    return shown.groupBy("doc_id").agg(F.count("mark").alias("marked"), F.sum("mark").alias("marks"), F.count_if("artifact").alias("artifacts"),
        F.sum(F.size("marks")).cast("long").alias("around"))


def untagged_text(spark, sf_dir):
    state = C.with_state(_ops(spark, sf_dir))
    line = lines(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id",
        F.floor(F.col("line_no") / 50).cast("int").alias("page_no"), F.col("line_no").alias("mcid"))
    on_page, anywhere = line.where("mcid % 4 <> 1"), line.where("mcid % 8 = 1").select("doc_id", "mcid")
    return _count(C.untagged_runs(state, on_page, anywhere), "doc_id", "page_no")


def image_overlap(spark, sf_dir):
    return _count(C.image_overlaps(C.with_state(_ops(spark, sf_dir)), _areas(spark, sf_dir)), "doc_id", "page_no")


def unused_images(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    pages = ops.select("doc_id", "page_no").distinct()
    declared = pages.withColumn("arg", F.explode(F.array(*[F.lit(f"Im{i}") for i in range(6)])))
    return C.unused_images(declared, ops.where("ix % 3 > 0"))


def redact_structure(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    line = lines(docs).select("doc_id", F.floor(F.col("line_no") / 50).cast("int").alias("page_no"), F.col("line_no").alias("element"),
        F.col("line_no").alias("mcid"), F.col("line").alias("value"))
    elements = line.withColumn("carrier", F.when(F.col("element") % 3 == 0, "ActualText").when(F.col("element") % 3 == 1, "Alt").otherwise("E"))
    removed = line.where("mcid % 10 = 0").select("doc_id", "page_no", F.explode(F.array(F.lit("tion"), F.lit("th"))).alias("term"))
    marks = C.affected_marks(C.with_state(operators(docs)), _areas(spark, sf_dir))
    return _count(C.scrubbed_structure(elements, marks, removed.distinct()), "doc_id", "carrier", "cleared")


def redact_fields(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("widget"))
    kind = F.get(F.array(*map(F.lit, ("text", "button", "choice", "signature", "annotation"))), F.col("widget"))
    left, bottom = 40 * F.col("widget") + F.pmod("doc_id", F.lit(30)), 640 + 25 * F.col("widget")
    w = d.select("doc_id", F.lit(0).alias("page_no"), "widget", kind.alias("kind"), left.alias("left"), bottom.alias("bottom"),
        (left + 50).alias("right"), (bottom + 20).alias("top"))
    return C.scrubbed_widgets(w, _areas(spark, sf_dir)).select("doc_id", "widget", "action")


def obstruction_strip(spark, sf_dir):
    return _count(C.without_obstructions(_ops(spark, sf_dir)), "doc_id", "name")


def hidden_text_state(spark, sf_dir):
    return C.hidden_texts(_ops(spark, sf_dir)).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum("hidden_by").alias("covers"))


QUERIES = {
    f.__name__: f
    for f in (
        operator_categories, operators_without_category, operators_without_area, find_text_operators, transform_operators, graphics_state, marked_content_mcid,
        untagged_text, image_overlap, unused_images, redact_structure, redact_fields, obstruction_strip, hidden_text_state,
    )
}

_KINDS = ", ".join("('" + name.replace("'", "''") + f"', '{kind}')" for kind, names in C.CATEGORIES.items() for name in names.split())
_OPS = f"WITH {OPERATORS_SQL}"
_KIND_OPS = f"{_OPS}, kinds(name, category) AS (VALUES {_KINDS}), o AS (SELECT operators.*, coalesce(category, 'Unknown') AS category FROM operators LEFT JOIN kinds USING (name))"
_MEET = "a.doc_id = o.doc_id AND a.page_no = o.page_no AND l < ar AND r > al AND b < at_y AND t > ab"
_TAKEN = "category IN ('PathPainting', 'Color')"
_IMAGES = "i AS (SELECT doc_id, page_no, line_no, 10 * (line_no % 4) AS l, 795 - 12 * line_no AS b, 10 * (line_no % 4) + 120 AS r, 809 - 12 * line_no AS t FROM lines2)"
_LINES2 = "lines2 AS (SELECT *, CAST(line_no // 50 AS INTEGER) AS page_no FROM lines)"

ORACLES = {
    "operator_categories": _KIND_OPS + " SELECT category, name, count(*) AS n FROM o GROUP BY ALL",
    "operators_without_category": f"{_KIND_OPS} SELECT doc_id, count(*) AS n, CASE WHEN {_TAKEN} THEN 'taken' ELSE 'left' END AS side FROM o GROUP BY ALL",
    "operators_without_area": f"""{_OPS}, {_AREAS} SELECT doc_id, count(*) AS n, count_if(l IS NULL) AS without_box, count_if(name = 'Tj') AS texts FROM operators o
WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE {_MEET}) GROUP BY doc_id""",
    "find_text_operators": _OPS + " SELECT doc_id, page_no, count(*) AS n FROM operators WHERE name = 'Tj' AND contains(lower(arg), 'tion') GROUP BY ALL",
    "transform_operators": _OPS + """ SELECT doc_id, CAST(sum(l + 5) AS DOUBLE) AS left_sum, CAST(sum(r + 5) AS DOUBLE) AS right_sum,
CAST(sum(length(CASE WHEN name = 'Tj' THEN replace(arg, 'e', 'EE') ELSE arg END)) AS BIGINT) AS size, count(*) AS n FROM operators GROUP BY doc_id""",
    "graphics_state": f"""WITH {OPERATORS_SQL}, s AS (SELECT *, name <> 'f' AS inside FROM operators WHERE name IN ('Tj', 'Do', 'f'))
SELECT doc_id, name, CAST(sum(CASE WHEN inside THEN 120 ELSE 1 END) AS DOUBLE) AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, CAST(sum(CASE
WHEN inside THEN 14 ELSE 1 END) AS DOUBLE) AS d,
CAST(sum(CASE WHEN inside THEN 10 * (line_no % 4) ELSE 0 END) AS DOUBLE) AS e, CAST(sum(CASE WHEN inside THEN 795 - 12 * line_no ELSE 0 END) AS DOUBLE) AS f FROM s GROUP BY ALL""",
    "marked_content_mcid": f"""{_OPS} SELECT doc_id, count_if(line_no % 3 <> 2) AS marked, CAST(sum(line_no) FILTER (line_no % 3 <> 2) AS BIGINT) AS marks,
count_if(line_no % 7 = 6) AS artifacts, CAST(count_if(line_no % 3 <> 2) AS BIGINT) AS around FROM operators WHERE name = 'Tj' GROUP BY doc_id""",
    "untagged_text": f"""{_OPS} SELECT doc_id, page_no, count(*) AS n FROM operators WHERE name = 'Tj' AND arg <> '' AND line_no % 7 <> 6
AND NOT (line_no % 3 <> 2 AND (line_no % 4 <> 1 OR line_no % 8 = 1)) GROUP BY ALL""",
    "image_overlap": f"""WITH {OPERATORS_SQL}, {_AREAS}, {_LINES2}, {_IMAGES} SELECT o.doc_id, o.page_no, count(*) AS n FROM i o JOIN areas a ON {_MEET} GROUP BY ALL""",
    "unused_images": f"""{_OPS}, p AS (SELECT DISTINCT doc_id, page_no FROM operators), d AS (SELECT doc_id, page_no, 'Im' || k AS arg FROM p, range(6) x(k))
SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM operators o WHERE o.doc_id = d.doc_id AND o.page_no = d.page_no AND o.name = 'Do' AND o.arg = d.arg AND o.ix % 3 > 0)""",
    "redact_structure": f"""WITH {OPERATORS_SQL}, {_AREAS}, {_LINES2},
m AS (SELECT DISTINCT o.doc_id, o.page_no, o.line_no FROM operators o JOIN areas a ON {_MEET} WHERE name = 'Tj' AND o.line_no % 3 <> 2),
r AS (SELECT DISTINCT doc_id, page_no FROM lines2 WHERE line_no % 10 = 0),
e AS (SELECT x.doc_id, CASE x.line_no % 3 WHEN 0 THEN 'ActualText' WHEN 1 THEN 'Alt' ELSE 'E' END AS carrier,
  CASE WHEN m.line_no IS NOT NULL THEN 'mark' WHEN r.doc_id IS NOT NULL AND contains(x.line, 'tion') THEN 'text' ELSE 'kept' END AS cleared
  FROM lines2 x LEFT JOIN m ON m.doc_id = x.doc_id AND m.page_no = x.page_no AND m.line_no = x.line_no LEFT JOIN r ON r.doc_id = x.doc_id AND r.page_no = x.page_no)
SELECT doc_id, carrier, cleared, count(*) AS n FROM e GROUP BY ALL""",
    "redact_fields": f"""WITH {_AREAS}, o AS (SELECT doc_id, 0 AS page_no, CAST(k AS INTEGER) AS widget, 40 * k + doc_id % 30 AS l, 640 + 25 * k AS b, 40 * k + doc_id % 30 + 50 AS r, 660 + 25 * k AS t FROM documents, range(5) x(k))
SELECT doc_id, widget, CASE widget WHEN 4 THEN 'removed' WHEN 1 THEN 'kept' WHEN 2 THEN 'value and options cleared' ELSE 'value cleared' END AS action
FROM o WHERE EXISTS (SELECT 1 FROM areas a WHERE {_MEET})""",
    "obstruction_strip": _OPS + " SELECT doc_id, name, count(*) AS n FROM operators WHERE NOT (k > 11 AND line_no % 4 < 2) GROUP BY ALL",
    "hidden_text_state": f"""{_OPS}, c AS (SELECT * FROM operators WHERE name = 'f' AND line_no % 4 < 2),
h AS (SELECT o.doc_id, o.page_no, o.ix, min(c.ix) AS cover FROM operators o
JOIN c ON c.doc_id = o.doc_id AND c.page_no = o.page_no AND c.ix > o.ix WHERE o.name = 'Tj'
AND greatest(0, least(o.r, c.r) - greatest(o.l, c.l)) * greatest(0, least(o.t, c.t) - greatest(o.b, c.b)) / greatest(1e-6, (o.r - o.l) * (o.t - o.b)) >= 0.5 GROUP BY ALL)
SELECT doc_id, page_no, count(*) AS n, CAST(sum(cover) AS BIGINT) AS covers FROM h GROUP BY ALL""",
}

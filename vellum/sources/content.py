"""A view of documents as drawing operators, as content streams have them: names, operands, texts, boxes.

Each line of a text is drawn by the operators of ``STEPS``: a tagged mark with an inner one, a saved state with its
matrix, the text, an image, and a rectangle that is filled in one of four greys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.tables import ADVANCE, HEIGHT, LEADING, LINES_SQL, PAGE_LINES, TOP, by_document, lines

#: The operators of one line, in order.
STEPS = ("BDC", "BMC", "q", "cm", "BT", "Tj", "ET", "Do", "Q", "EMC", "EMC", "rg", "re", "f")
#: Numbers that one line's operators may take.
STRIDE = 16
GREYS = (0.0, 0.5, 0.96, 1.0)
BOX = ("left", "bottom", "right", "top")


def operators(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page_no, ix, name, operands, arg, mcid, left, bottom, right, top): boxes are null where an operator draws nothing."""
    line = lines(by_document(docs, id_col, text_col), id_col, text_col)
    n, base = F.col("line_no"), (TOP - LEADING * F.col("line_no")).cast("double")
    x = F.pmod(F.col(id_col), F.lit(60)).cast("double")
    nothing = F.lit(None)
    grey = F.get(F.array(*map(F.lit, GREYS)), F.pmod(n, F.lit(4)))
    matrix = F.array(F.lit(120.0), F.lit(0.0), F.lit(0.0), F.lit(14.0), 10.0 * F.pmod(n, F.lit(4)), base - 5)
    text_box = (F.lit(0.0), base, (ADVANCE * F.length("line")).cast("double"), base + HEIGHT)
    fill_box = (x, base - 2, x + 120, base + 8)

    def step(k: int, name: str) -> Column:
        operands, arg, mcid, box = nothing.cast("array<double>"), nothing.cast("string"), nothing.cast("int"), (nothing.cast("double"),) * 4
        if name == "BDC":
            arg, mcid = F.when(F.pmod(n, F.lit(7)) == 6, "Artifact").otherwise("P"), F.when(F.pmod(n, F.lit(3)) != 2, n)
        elif name == "BMC":
            arg = F.lit("Span")
        elif name == "cm":
            operands = matrix
        elif name == "Tj":
            arg, box = F.col("line"), text_box
        elif name == "Do":
            arg = F.concat(F.lit("Im"), F.pmod(n, F.lit(4)).cast("string"))
        elif name == "rg":
            operands = F.array(grey, grey, grey)
        elif name in ("re", "f"):
            box = fill_box
        named = [c.alias(b) for c, b in zip(box, BOX, strict=True)]
        return F.struct((n * STRIDE + k).cast("int").alias("ix"), F.lit(name).alias("name"), operands.alias("operands"), arg.alias("arg"), mcid.alias("mcid"), *named)

    rows = line.select(id_col, "line_no", F.explode(F.array(*(step(k, name) for k, name in enumerate(STEPS)))).alias("o"))
    return rows.select(id_col, F.floor(n / PAGE_LINES).cast("int").alias("page_no"), "o.*")


_VALUES = ", ".join(f"({k}, '{name}')" for k, name in enumerate(STEPS))
#: The same view as DuckDB SQL, to start a WITH list; boxes are (l, b, r, t).
OPERATORS_SQL = f"""{LINES_SQL}, steps(k, name) AS (VALUES {_VALUES}),
operators AS (
  SELECT doc_id, line_no, CAST(line_no // 50 AS INTEGER) AS page_no, CAST(line_no * 16 + k AS INTEGER) AS ix, k, name,
    CASE k WHEN 0 THEN CASE WHEN line_no % 7 = 6 THEN 'Artifact' ELSE 'P' END WHEN 1 THEN 'Span' WHEN 5 THEN line WHEN 7 THEN 'Im' || (line_no % 4) END AS arg,
    CASE WHEN k = 0 AND line_no % 3 <> 2 THEN line_no END AS mcid,
    CASE WHEN k = 5 THEN 0.0 WHEN k > 11 THEN doc_id % 60 END AS l, CASE WHEN k = 5 THEN 800.0 - 12 * line_no WHEN k > 11 THEN 798.0 - 12 * line_no END AS b,
    CASE WHEN k = 5 THEN 6.0 * length(line) WHEN k > 11 THEN doc_id % 60 + 120 END AS r, CASE WHEN k = 5 THEN 810.0 - 12 * line_no WHEN k > 11 THEN 808.0 - 12 * line_no END AS t
  FROM lines, steps)"""

"""Rows that are made of texts: in how many partitions they stand, and that nothing moves them again."""

from pyspark.sql import functions as F

from vellum.operators import content, layout
from vellum.sources import tables
from vellum.sources.content import operators
from vellum.sources.tables import letters


def _docs(spark):
    return spark.createDataFrame([(i, f"and the {i}\nband") for i in range(40)], "doc_id long, text string")


def _moves(df):
    """What the exchanges of a plan are by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_partitions_grow_with_texts(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 10)
    docs = _docs(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    assert letters(docs).rdd.getNumPartitions() == operators(docs).rdd.getNumPartitions() == -(-size // 10)


def test_joins_by_page_leave_glyphs_where_they_are(spark):
    docs = _docs(spark)
    areas = docs.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("area_id"), *[F.lit(v).alias(c) for c, v in (("left", 0), ("bottom", 0), ("right", 20), ("top", 900))])
    areas = areas.hint("merge")
    for df in (layout.with_areas(letters(docs), areas), layout.without_areas(letters(docs), areas), content.without_area(operators(docs), areas)):
        assert _moves(df) and not any("page_no" in m for m in _moves(df))


def test_texts_left_are_those_of_the_glyphs_left(spark):
    pages = layout.redacted_pages(letters(_docs(spark)), "AND")
    left = layout.without_term(letters(_docs(spark)), "AND").groupBy("doc_id").agg(F.count("*").alias("n"))
    got = {(r.doc_id, r.n, r.text) for r in layout.texts_left(pages).collect()}
    assert got == {(i, len(f" the {i}b"), f" the {i}b") for i in range(40)} and {(d, n) for d, n, _ in got} == {tuple(r) for r in left.collect()}

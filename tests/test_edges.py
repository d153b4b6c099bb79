"""Values that stand exactly at an edge."""

import duckdb
import pytest

from vellum.operators import corpus, records
from vellum.plans import layout_queries


def test_luminance_at_the_edge_of_dark_is_not_dark(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 64, 64, 64, 255), (1, 1, 0, 4, 100, 36, 255), (1, 2, 0, 63, 64, 64, 255)], "k int, x int, y int, red int, green int, blue int, alpha int")
    assert records.image_facts(pixels, "k").first()["dark"] == 1


def test_dark_samples_at_the_edge(spark):
    samples = spark.createDataFrame([(1, 8, 200, 72, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0)], "k int, ar long, ag long, ab long, br long, bg long, bb long")
    assert corpus.difference_metrics(samples, ["k"]).first()["dark_balance"] == 0.5


@pytest.mark.parametrize("name", ["word_space_inference", "space_degenerate"])
def test_spaces_of_lines_of_one_glyph(spark, tmp_path, name):
    texts = ["a\n \nab\n\na b", "é", "\xa0", "", None, "x" * 40 + "\ny"]
    duckdb.from_arrow(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toArrow()).write_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    columns = "doc_id", "line_no", "glyphs", "spaces", "inferred"
    got = sorted(map(str, layout_queries.QUERIES[name](spark, str(tmp_path)).select(*columns).toArrow().to_pylist()))
    found = con.sql(f"SELECT {', '.join(columns)} FROM ({layout_queries.ORACLES[name]})").fetchall()
    assert got == sorted(str(dict(zip(columns, row, strict=True))) for row in found)
    assert sum(row[3] is None for row in found) == 3

"""Readers of manifests, contracts, reports, recognised words and plain text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an expectation list: three that it must have, five that it may.
EXPECTED = ("path", "page_number", "expected_status", "expected_error_contains", "note", "expected_result_status", "expected_result_category", "expected_result_reason")


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated list; comments, blank lines and a header are skipped, missing columns are null."""
    line = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    parts = F.split("value", "\t", -1)
    columns = [F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(EXPECTED)]
    rows = line.select(*columns).where("lower(path) <> 'path'")
    return rows.withColumn("page_number", F.col("page_number").cast("int")).where("path IS NOT NULL AND page_number >= 0 AND expected_status IS NOT NULL")


def _listed(spark: SparkSession, path: str, columns: tuple[str, str]) -> DataFrame:
    """Two columns of a tab-separated list, as they stand; comments, blank lines and a header are skipped, a line with one column is an error."""
    line = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    parts = F.split("value", "\t", -1)
    rows = line.select("value", F.trim(F.get(parts, F.lit(0))).alias(columns[0]), F.get(parts, F.lit(1)).alias(columns[1])).where(f"lower({columns[0]}) <> 'path'")
    wrong = F.col(columns[1]).isNull() | (F.col(columns[0]) == "")
    checked = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("not a path and a value: "), "value"))).otherwise(True).cast("boolean"))
    return checked.select(F.replace(columns[0], F.lit("\\"), F.lit("/")).alias(columns[0]), columns[1])


def page_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number) of the pages that a list names, each once; a number that is none, or below 0, is an error."""
    rows = _listed(spark, path, ("path", "page_number"))
    number = F.trim("page_number").try_cast("int")
    wrong = F.coalesce(number < 0, F.lit(True))
    ok = F.when(wrong, F.raise_error(F.concat(F.lit("not a page number: "), "page_number"))).otherwise(True).cast("boolean")
    return rows.where(ok).select("path", number.alias("page_number")).distinct()


def passwords(spark: SparkSession, path: str) -> DataFrame:
    """(path, password) as they stand, blanks included; a list is one file, and of a path that it names twice the later line counts."""
    numbered = _listed(spark, path, ("path", "password")).withColumn("_line", F.monotonically_increasing_id())
    return numbered.groupBy("path").agg(F.max_by("password", "_line").alias("password"))


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of each contract; a (path, page) that stands there twice is an error."""
    schema = "Path string, Source string, Owner string, RootCause string, ReviewStatus string, Confidence string, Pages map<string, struct<ExpectedRawStatus:string, ReleaseStatus:string, QualityStatus:string, PixelAgreement:string, ReferenceSituation:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    page = rows.select("Path", "Source", "Owner", F.explode("Pages").alias("page", "p")).select(F.col("Path").alias("path"), F.col("page").cast("int").alias("page_number"), "Source", "Owner", "p.*")
    turn = F.row_number().over(Window.partitionBy("path", "page_number").orderBy("Source"))
    checked = page.withColumn("_t", turn)
    return checked.where(F.when(F.col("_t") > 1, F.raise_error(F.concat(F.lit("contract given twice: "), "path"))).otherwise(True).cast("boolean")).drop("_t")


def report_results(spark: SparkSession, path: str, field: str = "results") -> DataFrame:
    """The entries of a JSON report's array; a report without it has none."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("r")).select("r.*") if field in rows.columns else rows.limit(0)


def recognised_words(spark: SparkSession, path: str, dpi: float = 300.0, page_height: float = 792.0) -> DataFrame:
    """Words of a recogniser's table (12 columns, level 5): boxes in points from below, confidence as a share."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(f) >= 12).where(F.get(f, F.lit(0)) == "5").where(F.trim(F.get(f, F.lit(11))) != "")
    n = lambda i: F.get(f, F.lit(i)).cast("double") * 72 / dpi
    return rows.select(F.get(f, F.lit(11)).alias("text"), n(6).alias("left"), (page_height - n(7) - n(9)).alias("bottom"), (n(6) + n(8)).alias("right"),
        (page_height - n(7)).alias("top"), (F.get(f, F.lit(10)).cast("double") / 100).alias("confidence"))


def form_feed_pages(texts: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Text of every page from texts that separate pages by a form feed; pages without text get an empty one.

    ``pages`` holds (id, n_pages).
    """
    parts = texts.select(id_col, F.posexplode(F.split("text", "\f", -1)).alias("page_no", "text"))
    every = pages.where("n_pages > 0").select(id_col, F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)).alias("page_no"))
    return every.join(parts, [id_col, "page_no"], "left").select(id_col, "page_no", F.coalesce("text", F.lit("")).alias("text"))


def first_definitions(objects: DataFrame, key: str = "object_id", section: str = "section") -> DataFrame:
    """Of objects that several sections of a file define, the definition of the first section; null ones stay out of it."""
    values = [c for c in objects.columns if c != key]
    return objects.groupBy(key).agg(F.min_by(F.struct(*values), section).alias("d")).select(key, *[F.col(f"d.{c}").alias(c) for c in values])

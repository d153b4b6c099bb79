"""Tables of a folder, and views that documents are seen through: lines and glyphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The synthetic page layout: advance and height of a glyph, leading, lines on a page, first baseline.
ADVANCE, HEIGHT, LEADING, PAGE_LINES, TOP = 6, 10, 12, 50, 800
#: After so many glyphs a line has a jump of so many points (it breaks words).
RUN, JUMP = 17, 4
#: Characters of text in a partition: a glyph takes some 100 to 200 bytes where it is sorted.
PART = 400_000
#: Pages in an Arrow batch.
PAGES = 500


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the folder; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): a row for each line; a null text has none."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int | None = None) -> DataFrame:
    """Documents placed by their id in as many partitions as their texts need: rows that are made of texts are sorted in memory.

    Joins by (id, page) leave rows that are placed by the id alone where they are, and place the other side so, too: a
    document is no hot key, as all that is made of it stands in one place anyway.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (part or PART))), id_col)


def letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each glyph with its box, from the synthetic layout; empty lines have no glyphs.

    Documents are placed before they become glyphs, so only texts are moved: windows over a document's pages or
    lines find their rows where they are.  The number of partitions is given and grows with the texts, as small texts
    make many glyphs and must not be put together in a few tasks.
    """
    line = lines(by_document(docs, id_col, text_col), id_col, text_col).where(F.length("line") > 0)
    glyph = line.select(id_col, "line_no", F.posexplode(F.split("line", "")).alias("c", "value"))
    left = ADVANCE * F.col("c") + JUMP * F.floor(F.col("c") / RUN)
    bottom = TOP - LEADING * F.col("line_no")
    return glyph.select(
        id_col, "line_no", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page_no"), "c", "value",
        left.cast("int").alias("left"), (left + ADVANCE).cast("int").alias("right"), bottom.cast("int").alias("bottom"), (bottom + HEIGHT).cast("int").alias("top"),
    )


def few_rows(spark: SparkSession) -> None:
    """Arrow batches of at most ``PAGES`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > PAGES:
        spark.conf.set(key, str(PAGES))


def by_page(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """(doc_id, page_no, label): the rows of each page in an array, in the order of the named columns and then of the others.

    Python gets pages as arrays in batches of a bounded number, and returns a value for each: rows stay where they are, and aren't grouped again.
    """
    few_rows(rows.sparkSession)
    names = [*order, *[c for c in rows.columns if c not in order and c not in ("doc_id", "page_no")]]
    return rows.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct(*names))).alias(label))


def is_blank(value: Column) -> Column:
    """White space, as word segmentation sees it."""
    return value.isin(*" \t\n\r\f\x0b\xa0")


#: The same views as DuckDB SQL, to start a WITH list.
LINES_SQL = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
LETTERS_SQL = (
    LINES_SQL
    + """, cells AS (SELECT doc_id, line_no, line, CAST(unnest(range(length(line))) AS INTEGER) AS c FROM lines WHERE length(line) > 0),
letters AS (
  SELECT doc_id, line_no, CAST(line_no // 50 AS INTEGER) AS page_no, c, substr(line, c + 1, 1) AS value, CAST(6 * c + 4 * (c // 17) AS INTEGER) AS left_x,
    CAST(6 * c + 4 * (c // 17) + 6 AS INTEGER) AS right_x, 800 - 12 * line_no AS bottom, 810 - 12 * line_no AS top FROM cells)"""
)

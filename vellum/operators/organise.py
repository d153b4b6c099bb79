"""Pages of documents: numbering, labels, merging, splitting, moving, extracting.

A document's pages are a window; numbers that run over all documents are
running totals in two steps, so no task sees more than a share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Documents in a bucket of a running total.
BUCKET = 1_000


def running_total(df: DataFrame, key: str, amount: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """What stands before each row in ascending order of an integer key: (key, out).

    Totals of buckets of the key come first, in a window over one row for each bucket;
    then rows run within their bucket.
    """
    rows = df.select(key, amount).withColumn("_bucket", F.floor(F.col(key) / bucket))
    totals = rows.groupBy("_bucket").agg(F.sum(amount).alias("_sum")).withColumn("_shelf", F.floor(F.col("_bucket") / bucket))
    shelves = totals.groupBy("_shelf").agg(F.sum("_sum").alias("_all"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelves = shelves.select("_shelf", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_far"))
    near = Window.partitionBy("_shelf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.join(shelves, "_shelf").select("_bucket", (F.coalesce(F.sum("_sum").over(near), F.lit(0)) + F.col("_far")).alias("_start"))
    own = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "_bucket").select(key, (F.coalesce(F.sum(amount).over(own), F.lit(0)) + F.col("_start")).alias(out))


def bates(pages: DataFrame, doc: str, page: str, start: int = 1, digits: int = 6, prefix: str = "", suffix: str = "") -> DataFrame:
    """A number for every page over all documents, by document and page; repeated pages of a document once."""
    pages = pages.select(doc, page).distinct()
    before = running_total(pages.groupBy(doc).agg(F.count("*").alias("_n")), doc, "_n", "_before")
    own = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    n = (own + F.col("_before") + start - 1).cast("long")
    return pages.join(before, doc).select(doc, page, n.alias("number"), T.padded_number(n, digits, prefix, suffix).alias("label"))


def next_number(pages: DataFrame, start: int = 1) -> Column:
    """The number after the last one, as an aggregate; ``start`` where there are no pages."""
    return (F.count("*") + start).alias("next")


def labels(pages: DataFrame, doc: str, page: str, marks: DataFrame) -> DataFrame:
    """Each page with the last mark (first_page, style, prefix, first_value) at or before it.

    An as-of join: marks and pages of a document are in one window, and the last mark is carried on.
    """
    m = marks.select(doc, F.col("first_page").alias(page), F.struct("first_page", "style", "prefix", "first_value").alias("_mark"))
    w = Window.partitionBy(doc).orderBy(page, F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.select(doc, page).withColumn("_mark", F.lit(None).cast(m.schema["_mark"].dataType)).withColumn("_page", F.lit(True))
    both = rows.unionByName(m.withColumn("_page", F.lit(False))).withColumn("_mark", F.last("_mark", True).over(w)).where("_page")
    n = (F.col(page) - F.col("_mark.first_page") + F.col("_mark.first_value")).cast("int")
    value = F.when(F.col("_mark.style") == "roman", T.roman(n)).when(F.col("_mark.style") == "letters", T.alphabetic(n)).otherwise(n.cast("string"))
    return both.select(doc, page, F.when(F.col("_mark").isNull(), (F.col(page) + 1).cast("string")).otherwise(F.concat("_mark.prefix", value)).alias("label"))


def merged(sources: Sequence[DataFrame], doc: str, page: str) -> DataFrame:
    """Pages of several sources in order, numbered anew within each document: (doc, source, page, place)."""
    both = None
    for i, s in enumerate(sources):
        s = s.select(doc, page).withColumn("source", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("source", page)) - 1)


def split_every(pages: DataFrame, page: str, n: int) -> Column:
    """The part that a page goes to; parts have ``n`` pages, the last one what is left."""
    if n <= 0:
        raise ValueError("a part needs one page at least")
    return F.floor(F.col(page) / n).cast("int")


def split_at(page: str, boundaries: Sequence[int], count: Column) -> Column:
    """The part that a page goes to: parts start at 0 and at the boundaries that the document has."""
    part = F.lit(0)
    for b in sorted({b for b in boundaries if b > 0}):
        part = part + ((F.col(page) >= b) & (count > b)).cast("int")
    return part


def split_by_outline(pages: DataFrame, outline: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, part, title, place): parts start where a top title of the document's outline (doc, node, parent, title, page) points to.

    Titles without a page, or with one that the document doesn't have, and nested titles start no part; of titles of one page the first by node names the part.
    Pages before the first title are a part without a title, as is a document without titles.  Pages find the last start before them (an as-of
    join, by a window over the document's pages and starts).
    """
    top = outline.where("parent IS NULL AND page >= 0").groupBy(doc, F.col("page").alias(page)).agg(F.min(F.struct("node", "title")).alias("_top"))
    w = Window.partitionBy(doc).orderBy(page)
    both = pages.select(doc, page).join(top, [doc, page], "left")
    starts = (F.col("_top").isNotNull() | (F.row_number().over(w) == 1)).cast("int")
    both = both.withColumns({"part": (F.sum(starts).over(w) - 1).cast("int"), "title": F.last("_top", ignorenulls=True).over(w)["title"]})
    return both.withColumn("place", F.row_number().over(Window.partitionBy(doc, "part").orderBy(page)) - 1).drop("_top")


def placed(pages: DataFrame, doc: str, page: str, key: Column) -> DataFrame:
    """Pages renumbered by a key, ties by their page."""
    return pages.withColumn("_k", key).withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("_k", page)) - 1).drop("_k")


def removed(pages: DataFrame, doc: str, page: str, gone: Column) -> DataFrame:
    """Pages without some, numbered anew; a document whose pages would all go keeps them."""
    all_gone = F.bool_and(gone).over(Window.partitionBy(doc))
    left = pages.withColumn("_keep", ~gone | all_gone).where("_keep").drop("_keep")
    return placed(left, doc, page, F.col(page))


def moved(pages: DataFrame, doc: str, page: str, start: int, to: int) -> DataFrame:
    """A page taken out and put in again at ``to``; documents without that page or place stay as they are."""
    n = F.count("*").over(Window.partitionBy(doc))
    works = (n > start) & (n > to)
    at = F.col(page).cast("double")
    key = F.when(works & (F.col(page) == start), F.lit(to + (0.5 if to > start else -0.5))).otherwise(at)
    return placed(pages.withColumn("_n", n), doc, page, key).drop("_n")


def shifted(pages: DataFrame, doc: str, page: str, selected: Column, down: bool = False) -> DataFrame:
    """Selected pages moved one place up (or down); a run at that end stays, another one swaps with the page beside it."""
    if down:  # the same, seen from the last page
        back = pages.withColumn("_sel", selected).withColumn(page, -F.col(page))
        turned = shifted(back, doc, page, F.col("_sel")).drop("_sel")
        n = F.count("*").over(Window.partitionBy(doc))
        return turned.withColumns({"place": (n - 1 - F.col("place")).cast("int"), page: -F.col(page)})
    w = Window.partitionBy(doc).orderBy(page)
    flagged = pages.withColumn("_s", selected)
    run = F.sum((~F.col("_s")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    flagged = flagged.withColumn("_run", run)
    size = F.count_if(F.col("_s")).over(Window.partitionBy(doc, "_run"))
    # pages of a run share the number of the unselected page above them
    key = F.when(F.col("_run") == 0, F.col(page)).when(F.col("_s"), F.col(page) - 1).otherwise(F.col(page) + size)
    return placed(flagged.withColumn("_key", key), doc, page, F.col("_key")).drop("_s", "_run", "_key")


def inserted(pages: DataFrame, extra: DataFrame, doc: str, page: str, at: int) -> DataFrame:
    """Pages of ``extra`` put before place ``at`` (at the end of shorter documents), numbered anew."""
    both = pages.select(doc, page, F.lit(0).alias("source"), F.col(page).cast("double").alias("_k"))
    both = both.unionByName(extra.select(doc, page, F.lit(1).alias("source"), F.lit(at - 0.5).alias("_k")))
    w = Window.partitionBy(doc).orderBy("_k", "source", page)
    return both.withColumn("place", F.row_number().over(w) - 1).drop("_k")


def extracted(pages: DataFrame, doc: str, page: str, wanted: Sequence[int]) -> DataFrame:
    """The wanted pages in the order asked for, each once; pages that a document lacks are skipped."""
    order = {p: i for i, p in reversed(list(enumerate(wanted)))}
    key = F.lit(None).cast("int")
    for p, i in order.items():
        key = F.when(F.col(page) == p, i).otherwise(key)
    return placed(pages.withColumn("_want", key).where("_want IS NOT NULL"), doc, page, F.col("_want")).drop("_want")


def chunked(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """Rows dealt to chunks by turns in ascending order of an integer key."""
    ones = df.select(key).distinct().withColumn("_one", F.lit(1))
    return running_total(ones, key, "_one", "place").withColumn("chunk", F.col("place") % chunks)


def shards(df: DataFrame, doc: str, page: str, size: int) -> DataFrame:
    """Parts of at most ``size`` pages of each document: (doc, shard, pages, first, last)."""
    part = df.select(doc, page).distinct().withColumn("shard", F.floor((F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1) / size).cast("int"))
    return part.groupBy(doc, "shard").agg(F.count("*").alias("pages"), F.min(page).alias("first"), F.max(page).alias("last"))


def unique_names(fields: DataFrame, doc: str, name: str, order: str) -> DataFrame:
    """Names of a merged form: of equal ones the later ones get their number."""
    turn = F.row_number().over(Window.partitionBy(doc, name).orderBy(order))
    return fields.withColumn("unique_name", F.when(turn > 1, F.concat(name, F.lit("_"), turn.cast("string"))).otherwise(F.col(name)))


def turned(rotation: Column, by: int) -> Column:
    return F.pmod(rotation + by, F.lit(360))

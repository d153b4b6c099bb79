"""Search in documents: matches, the words that they touch, and counts by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.tables import PAGE_LINES, lines


def substring(docs: DataFrame, needle: str) -> DataFrame:
    """Lines that hold ``needle``, case aside: how often (apart), and the first match in its context."""
    low = F.lower("line")
    hit = lines(docs).where(low.contains(needle.lower()))
    at = F.instr(low, needle.lower())
    return hit.select("doc_id", "line_no", T.count_apart(low, needle.lower()).alias("matches"), T.context(F.col("line"), at, len(needle)).alias("context"))


def overlapping(docs: DataFrame, needle: str) -> DataFrame:
    """Documents by occurrences at every place, case kept."""
    return docs.select("doc_id", T.count_overlapping(F.col("text"), needle).alias("matches")).where("matches > 0")


def whole_word(docs: DataFrame, word: str) -> DataFrame:
    """Documents by words that equal ``word``, case aside; and by tokens between blanks that equal it."""
    low = F.lower("text")
    tokens = F.size(F.filter(F.split(low, T.BLANKS), lambda w: w == word.lower()))
    return docs.select("doc_id", T.count_words(low, word.lower()).alias("words"), tokens.alias("tokens")).where("words > 0")


def regex(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents by matches of a pattern, with the first one; a pattern that is invalid finds nothing."""
    known = T.valid_pattern(pattern)
    if known is None:
        return docs.select("doc_id", F.lit(0).alias("matches"), F.lit("").alias("first")).limit(0)
    return docs.select("doc_id", F.regexp_count("text", F.lit(known)).alias("matches"), F.regexp_extract("text", known, 0).alias("first")).where("matches > 0")


def _holding(docs: DataFrame, needle: str) -> DataFrame:
    """Lines that hold ``needle``, case aside, of documents that do."""
    low = needle.lower()
    return lines(docs.where(F.lower("text").contains(low))).where(F.lower("line").contains(low))


def _pieces(held: DataFrame, parts: Column, gap: int) -> DataFrame:
    """(doc_id, line_no, ix, part, start, last): the parts of lines with their offsets, a running sum of lengths and gaps."""
    one = held.select("doc_id", "line_no", F.size(parts).alias("n"), F.posexplode(parts).alias("ix", "part"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part") + gap).over(before), F.lit(0)).cast("int")
    return one.select("doc_id", "line_no", "ix", "part", start.alias("start"), (F.col("ix") == F.col("n") - 1).alias("last"))


def match_spans(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, line_no, start, end) of matches that don't overlap; 0-based, case aside."""
    parts = F.split(F.lower("line"), T.quoted(needle.lower()), -1)
    found = _pieces(_holding(docs, needle), parts, len(needle)).where("NOT last")
    start = F.col("start") + F.length("part")
    return found.select("doc_id", "line_no", start.alias("start"), (start + len(needle)).alias("end"))


def word_spans(held: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, word) of the runs between single spaces of lines; empty runs are no words."""
    found = _pieces(held, F.split("line", " ", -1), 1).where("part <> ''")
    return found.select("doc_id", "line_no", "start", (F.col("start") + F.length("part")).alias("end"), F.col("part").alias("word"))


def word_bounds(docs: DataFrame, needle: str) -> DataFrame:
    """The first and the last word that each match touches; a match that touches no word is dropped."""
    m, w = match_spans(docs, needle).alias("m"), word_spans(_holding(docs, needle)).alias("w")
    near = m.join(w, (F.col("m.doc_id") == F.col("w.doc_id")) & (F.col("m.line_no") == F.col("w.line_no")) & (F.col("w.start") < F.col("m.end")) & (F.col("w.end") > F.col("m.start")))
    found = near.groupBy("m.doc_id", "m.line_no", F.col("m.start").alias("match_start")).agg(
        F.min_by("w.word", "w.start").alias("first_word"), F.max_by("w.word", "w.start").alias("last_word"), F.min("w.start").alias("left_c"), F.max("w.end").alias("right_c")
    )
    return found


def by_page(docs: DataFrame, needle: str) -> DataFrame:
    """Matches by document and page."""
    found = substring(docs, needle).withColumn("page_no", F.floor(F.col("line_no") / PAGE_LINES).cast("int"))
    return found.groupBy("doc_id", "page_no").agg(F.sum("matches").alias("matches"), F.count("*").alias("lines"))


def with_annotations(docs: DataFrame, notes: DataFrame, needle: str) -> DataFrame:
    """Matches in texts and in annotations (doc_id, note), each with its origin."""
    a = substring(docs, needle).groupBy("doc_id").agg(F.sum("matches").alias("matches")).withColumn("origin", F.lit("text"))
    low = F.lower("note")
    b = notes.where(low.contains(needle.lower())).select("doc_id", T.count_apart(low, needle.lower()).cast("long").alias("matches"), F.lit("annotation").alias("origin"))
    return a.unionByName(b)

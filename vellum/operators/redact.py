"""Redaction of terms in texts and in what travels with them, and checks of what is left."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import content, layout


def carriers(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Terms taken out of ``info``, ``title`` and ``note``.

    Information and annotations that become empty are removed; an outline title says that it was redacted.
    """
    gone = {c: T.without_terms(F.col(c), terms) for c in ("info", "title", "note")}
    return df.select("doc_id", F.nullif(gone["info"], F.lit("")).alias("info"),
        F.when(gone["title"] == "", "[redacted]").otherwise(gone["title"]).alias("title"), F.nullif(gone["note"], F.lit("")).alias("note"))


def counts(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term, matches, documents): one pass over the texts, added up in the tasks."""
    low = F.lower("text")
    per = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_count(low, F.lit(T.quoted(t.lower()))).alias("n")) for t in terms]))
    found = docs.select(per.alias("x")).select("x.term", "x.n")
    return found.groupBy("term").agg(F.sum("n").cast("long").alias("matches"), F.count_if(F.col("n") > 0).alias("documents"))


def multiset_similarity(df: DataFrame, id_col: str, side: str, text: str, split: str | None) -> DataFrame:
    """Jaccard similarity of the two multisets of tokens under each id: sum of the lesser by sum of the greater counts."""
    token = F.explode(F.split(text, split)) if split else F.col(text)
    tokens = df.select(id_col, side, token.alias("token")).where("token <> ''")
    n = tokens.groupBy(id_col, "token").agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    return n.groupBy(id_col).agg(F.round(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), 6).alias("similarity"))


def unseen_words(texts: DataFrame, visible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of ``texts`` that no visible text holds; case and punctuation at the ends aside."""

    def words(df: DataFrame, *keep: str) -> DataFrame:
        one = df.select(*keep, F.explode(F.split("text", T.BLANKS)).alias("word"))
        return one.select(*keep, F.lower(T.trimmed(F.col("word"))).alias("word")).where("word <> ''")

    counted = words(texts, *keys).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return counted.join(words(visible).distinct(), "word", "left_anti").select(*keys, "word", "n")


def scrub_metadata(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns emptied."""
    return df.select(*[F.lit(None).cast(t).alias(c) if c in columns else F.col(c) for c, t in df.dtypes])


def distinct_terms(terms: DataFrame, column: str = "term", least: int = 3) -> DataFrame:
    """Terms of a length, distinct but for case; of equal ones the least stays."""
    return terms.where(F.length(column) >= least).groupBy(F.lower(column).alias("_key")).agg(F.min(column).alias(column)).select(column)


def area_report(letters: DataFrame, ops: DataFrame, areas: DataFrame, strategy: str = "any") -> DataFrame:
    """(doc_id, kind, n): what redacting areas takes out of documents: glyphs by a strategy, and images that areas touch."""
    glyphs = layout.with_areas(letters, areas).where(layout.removed_by(strategy)).select("doc_id", "page_no", "line_no", "c").distinct()
    images = content.image_overlaps(content.with_state(ops), areas).select("doc_id", "page_no", "ix").distinct()
    kinds = [rows.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(kind).alias("kind"), "n") for rows, kind in ((glyphs, "letters"), (images, "images"))]
    return kinds[0].unionByName(kinds[1])


class Redaction:
    """Redactions of glyphs and operators, gathered by chained calls and carried out in their order by ``apply``.

    Nothing is computed before: each step is a part of the plan.
    """

    def __init__(self, letters: DataFrame, ops: DataFrame) -> None:
        self._letters, self._ops, self._steps = letters, ops, []

    def _then(self, letters=lambda x: x, ops=lambda x: x) -> Redaction:
        self._steps.append((letters, ops))
        return self

    def area(self, areas: DataFrame, strategy: str = "any") -> Redaction:
        """Glyphs of areas by a strategy, and drawn operators, but for texts, that areas touch."""

        def letters(x: DataFrame) -> DataFrame:
            return layout.without_areas(x, areas, strategy)

        def ops(x: DataFrame) -> DataFrame:
            shown = content.category(F.col("name")) == "TextShowing"
            return x.where(shown).unionByName(content.without_area(x.where(~shown), areas))

        return self._then(letters, ops)

    def text(self, term: str, strategy: str = "any") -> Redaction:
        return self._then(lambda x: layout.without_term(x, term, strategy))

    def letters(self, which: Column) -> Redaction:
        """Glyphs for which a condition holds."""
        return self._then(lambda x: x.where(~F.coalesce(which, F.lit(False))))

    def all_text(self) -> Redaction:
        return self._then(lambda x: x.limit(0), lambda x: content.without_category(x, "TextShowing"))

    def category(self, *kinds: str) -> Redaction:
        return self._then(ops=lambda x: content.without_category(x, *kinds))

    def apply(self) -> tuple[DataFrame, DataFrame]:
        """The glyphs and the operators that are left."""
        letters, ops = self._letters, self._ops
        for on_letters, on_ops in self._steps:
            letters, ops = on_letters(letters), on_ops(ops)
        return letters, ops


class RedactedDocuments(NamedTuple):
    """What is left of documents: glyphs, operators, carriers (doc_id, carrier, place, text, and ``cut``, whether a term was taken out); and what was done: (doc_id, matches, operators, carriers).

    ``pages`` are the pages that the glyphs are from, as in ``layout.redacted_pages``.
    """

    pages: DataFrame
    letters: DataFrame
    ops: DataFrame
    carriers: DataFrame
    report: DataFrame


#: What stands where a carrier of a kind loses all of its text; other kinds go.
PLACEHOLDER = {"outline": "[redacted]"}
#: Letters of a term from which it is taken out of what travels with a document.
LEAST_SCRUBBED = 3


def redact_document(letters: DataFrame, ops: DataFrame, carriers: DataFrame, term: str, strategy: str = "any", case_sensitive: bool = False, hidden_layers: bool = True, scrub: bool = True, anew: bool = True) -> RedactedDocuments:
    """A term taken out of documents in one act: of their pages, of the operators that show it, and of all that travels with them.

    Glyphs go as in ``layout.redacted``; operators whose text holds the term go with hidden layers included; ``carriers`` are rows of any kind (info, packet,
    outline, annotation): their texts lose the term, also where no page has it.  A carrier that becomes empty goes, but for an outline title, which says that
    it was redacted.  Terms of under three letters are taken out of pages alone, as they'd spoil other texts.  An empty term changes nothing.
    What a removal brings together is taken out of pages, too, but not without ``anew``, and not of carriers.
    """
    pages = layout.redacted_pages(letters, term, strategy, case_sensitive=case_sensitive, hidden_layers=hidden_layers, anew=anew)
    marked = layout.spread(pages, letters, "gone", "matches")
    left_ops, kept, beside = redact_beside_pages(ops, carriers, term, case_sensitive, hidden_layers, scrub)
    found = pages.select("doc_id", F.col("matches")[0].alias("matches")).groupBy("doc_id").agg(F.sum("matches").alias("matches"))
    done = found.select("doc_id", "matches", F.lit(0).alias("operators"), F.lit(0).alias("carriers")).unionByName(beside.select("doc_id", F.lit(0).alias("matches"), "operators", "carriers"))
    report = done.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("matches", "operators", "carriers")])
    return RedactedDocuments(pages, marked.where("NOT gone").drop("gone", "matches"), left_ops, kept, report)


def redact_beside_pages(ops: DataFrame, carriers: DataFrame, term: str, case_sensitive: bool = False, hidden_layers: bool = True, scrub: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The operators and carriers that ``redact_document`` leaves, and (doc_id, operators, carriers), how many lost the term."""
    shown = content.find_text(ops, term, not case_sensitive) if hidden_layers else ops.limit(0)
    left_ops = ops.join(shown.select("doc_id", "ix"), ["doc_id", "ix"], "left_anti")
    cut = T.without_terms(F.col("text"), [term], not case_sensitive)
    hit = F.coalesce(F.regexp_count("text", F.lit(("" if case_sensitive else "(?iu)") + T.quoted(term))) > 0, F.lit(False)) if term else F.lit(False)
    scrubs = hit & F.lit(scrub and len(term) >= LEAST_SCRUBBED)
    instead = F.coalesce(*[F.when(F.col("carrier") == k, v) for k, v in PLACEHOLDER.items()])
    judged = carriers.withColumn("_hit", scrubs).withColumn("text", F.when(F.col("_hit"), F.coalesce(F.nullif(cut, F.lit("")), instead)).otherwise(F.col("text")))
    kept = judged.where("NOT (_hit AND text IS NULL)").withColumnRenamed("_hit", "cut")
    done = [
        shown.groupBy("doc_id").agg(F.count("*").alias("operators")).select("doc_id", "operators", F.lit(0).alias("carriers")),
        judged.groupBy("doc_id").agg(F.count_if("_hit").alias("carriers")).select("doc_id", F.lit(0).alias("operators"), "carriers"),
    ]
    report = done[0].unionByName(done[1]).groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("operators", "carriers")])
    return left_ops, kept, report


#: Characters that a term has to have to be looked for in a copy.
LEAST_PREVIEW = 3


def safe_copy(docs: DataFrame, previews: DataFrame, hidden: DataFrame, images: DataFrame, checks: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """What can be said of redacted copies (doc_id, text, skipped, info, xmp, attachments): a row for each.

    ``previews`` are terms that were redacted (doc_id, term); ``hidden`` and ``images`` are findings of the audits
    (doc_id, n).  A check that is off, or has nothing to look at, is NotChecked; one that finds something warns.
    """
    text = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    term = F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))
    asked = previews.select("doc_id", term.alias("term")).where("term <> ''").distinct().groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    held = docs.select("doc_id", "skipped", "info", "xmp", "attachments", text.alias("text")).join(asked, "doc_id", "left")
    held = held.join(hidden.withColumnRenamed("n", "hidden"), "doc_id", "left").join(images.withColumnRenamed("n", "images"), "doc_id", "left")
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    checked = F.filter(terms, lambda t: F.length(t) >= LEAST_PREVIEW)
    left = F.size(F.filter(checked, lambda t: F.contains("text", t)))

    def state(on: Column, found: Column) -> Column:
        return F.when(~on, "NotChecked").when(found > 0, "Warning").otherwise("Verified")

    n_hidden, n_images = F.coalesce("hidden", F.lit(0)), F.coalesce("images", F.lit(0))
    content_state = state(F.lit(checks[0]) & (F.size(checked) > 0), left)
    hidden_state, image_state = state(F.lit(checks[1]), n_hidden), state(F.lit(checks[2]) & (F.size(terms) > 0), n_images)
    warnings = (F.col("skipped") > 0).cast("int") + sum(((s == "Warning").cast("int") for s in (content_state, hidden_state, image_state)), F.lit(0))
    return held.select(
        "doc_id", F.size(terms).alias("previews"), F.size(checked).alias("checked"), left.alias("remaining"),
            (F.size(terms) - F.size(checked)).alias("short"), content_state.alias("content"),
        hidden_state.alias("hidden_text"), image_state.alias("raster"), F.col("info").alias("info_scrubbed"), F.col("xmp").alias("had_xmp"),
            F.col("attachments").alias("attachments"), warnings.alias("warnings"),
    )

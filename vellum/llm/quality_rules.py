"""Rule bitmask ledger: every quality rule is evaluated once, policies are masks over its bits.

``ledger`` measures each text and evaluates all rules once: a row holds the measurements and ``fail_bits``,
an integer whose bit n is set where rule n of ``RULES`` fails.  A policy is a version and the rules that it enforces, so
``apply_policy`` is one bitwise AND for each row of a stored ledger, however many policies there are.  ``ablations`` counts, for each
rule of a policy, what it rejects, what it rejects alone (what leaving it out would bring back), and ``changes``
what another version would decide otherwise; both add up equal bit patterns first, of which there are at most 2 to the
number of rules, so no group is large.

All of it is built-in column functions; a document is judged within its row, so nothing is shuffled.
Repeated words are found in two steps: hashes of the five-word windows tell texts without any repeated
window (equal windows have equal hashes, so none is missed); for the others the windows themselves are sorted with their
places, and the places of those that have an equal neighbour are added up.

A null or empty text, or one of white space, has no words: all measurements are 0 and it fails ``few_words``.  A null id, and ids
that rows share, are kept as they are, one row for each; an empty table gives an empty one; further columns of any name are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, as a set of characters and as a regular expression.
SPACE = " \t\n\x0b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words in a window.
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")

#: (name, SQL condition under which a text fails), in the order of their bits; new rules are put at the end, so that stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = [name for name, _ in RULES]
        return reduce(lambda m, r: m | 1 << order.index(r), self.rules, 0)


BASE = Policy("1-base", ("few_words", "repeated_words"))
POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        BASE,
        Policy("2-surface", (*BASE.rules, "symbols", "repeated_lines")),
        Policy("3-full", tuple(name for name, _ in RULES)),
    )
}
#: The version that decides in production.
CURRENT = "3-full"


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def _windows(words: Column, value) -> Column:
    """``value`` of each window of words and its place, for texts of at least a window."""
    n = F.size(words) - (WINDOW - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: value(F.slice(words, i, F.lit(WINDOW)), i)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of each text, all of them long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.split(F.btrim(text, F.lit(SPACE)), _GAP).alias("split"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    # splitting an empty string gives one empty word
    df = df.select("id", "text", "lines", F.when(F.get("split", F.lit(0)) == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.col("split")).alias("words"))
    words, lines = F.col("words"), F.col("lines")
    df = df.select("id", "text", "lines", "words", _windows(words, lambda w, i: F.xxhash64(w)).alias("hashes"))
    doubtful = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.select(
        "id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _count(F.col("text"), "[A-Z]+").alias("n_capitals"),
        _count(F.col("text"), "!").alias("n_exclamations"),
        F.when(doubtful, F.sort_array(_windows(words, lambda w, i: F.struct(F.xxhash64(w).alias("hash"), F.concat_ws(" ", w).alias("window"), i.alias("at"))))).alias("sorted"),
    )
    s = F.col("sorted")
    equal = lambda x, j: F.coalesce(F.get(s, j)["window"] == x["window"], F.lit(False))
    repeated = F.filter(s, lambda x, j: equal(x, j - 1) | equal(x, j + 1))
    df = df.withColumn("places", F.sort_array(F.transform(repeated, lambda x: x["at"])))
    # a window covers its words up to the next repeated one; least() passes over the null after the last
    covered = F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(F.col("id").alias(id_col), *[F.coalesce(total, F.lit(0).cast("long")).alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the measurements and ``fail_bits`` of each text: what is stored, and what policies are applied to."""
    bits = [F.when(F.expr(fails), F.lit(1 << n)).otherwise(0).cast("long") for n, (_, fails) in enumerate(RULES)]
    return measures(docs, id_col, text_col).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def enforced(policy: Policy) -> Column:
    """The bits of the rules of ``policy`` that a row of a ledger fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))


def rule_names(bits: Column) -> Column:
    """The names of the rules whose bits are set, in order."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << n).cast("long")) != 0, F.lit(name)) for n, (name, _) in enumerate(RULES)]), lambda x: x.isNotNull())


def apply_policy(stored: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy``, ``kept`` and ``sole_rule``: the one rule without which a rejected row would be kept, else null."""
    bits = enforced(policy)
    return stored.withColumns(
        {"policy": F.lit(policy.version), "kept": bits == 0, "sole_rule": F.when(F.bit_count(bits) == 1, F.get(rule_names(bits), F.lit(0)))}
    )


def _patterns(stored: DataFrame) -> DataFrame:
    """Rows and words of each pattern of bits."""
    return stored.groupBy("fail_bits").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))


def ablations(stored: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, that fail it alone, and the words of those; all of the rows ``kept`` under it and without it."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << n).cast("long").alias("bit")) for n, (name, _) in enumerate(RULES) if name in policy.rules])
    bits = enforced(policy)
    each = _patterns(stored).select("docs", "words", bits.alias("bits"), F.explode(rules).alias("r"))
    fails, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    kept = F.col("bits") == 0
    n = lambda when, what="docs": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        n(fails).alias("failed"), n(alone).alias("failed_alone"), n(alone, "words").alias("words_alone"), n(kept).alias("kept"), n(kept | alone).alias("kept_without")
    )


def changes(stored: DataFrame, before: Policy, after: Policy) -> DataFrame:
    """Documents by what two policies decide: ``kept_before``, ``kept_after``, ``docs``, ``words``, and ``any_bits``, ``all_bits`` of the rules that they fail."""
    return (
        _patterns(stored)
        .groupBy((enforced(before) == 0).alias("kept_before"), (enforced(after) == 0).alias("kept_after"))
        .agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"))
    )


def verdicts(stored: DataFrame, policy: Policy, id_col: str = "doc_id") -> DataFrame:
    """The measurements, ``base_failed`` (by the first policy), ``kept``, and what ``policy`` found in a stored ledger."""
    return apply_policy(stored, policy).select(id_col, *MEASURES, "fail_bits", (enforced(BASE) != 0).alias("base_failed"), "policy", "kept", "sole_rule")


_CASES = "\n".join(f"         + CASE WHEN {fails} THEN {1 << n} ELSE 0 END" for n, (_, fails) in enumerate(RULES))
_SOLE = " ".join(f"WHEN fail_bits = {1 << n} THEN '{name}'" for n, (name, _) in enumerate(RULES))

#: The rows of the query under the policy that enforces every rule.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i AS pos, array_to_string(words[i:i + 4], ' ') AS w FROM split, unnest(generate_series(1, len(words) - 4)) AS s(i)),
repeated AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least(5, coalesce(next_pos - pos, 5))) AS n FROM (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS next_pos FROM repeated) GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations
  FROM split LEFT JOIN covered c USING (r)),
bits AS (SELECT *, CAST(0
{_CASES} AS BIGINT) AS fail_bits FROM measured)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, '{CURRENT}' AS policy, fail_bits = 0 AS kept,
       CASE {_SOLE} END AS sole_rule
FROM bits
"""

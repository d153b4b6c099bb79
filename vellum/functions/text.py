"""Text: folding, normal forms, search, similarity, redaction, labels."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space that typographic normalisation joins.
BLANKS = r"[ \t\n\r\f\x0b ]+"
#: Punctuation that is trimmed from words (fixed values).
EDGE_PUNCTUATION = ".,:;!?\"'()[]"


def quoted(literal: str) -> str:
    """A literal as a regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def typographic(text: Column) -> Column:
    """Curly apostrophes and long dashes as plain ones, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "’‘ʼ′–—−", "''''---"), BLANKS, " "))


def count_apart(text: Column, needle: str) -> Column:
    """Occurrences that don't overlap, from the left; none of an empty needle."""
    if not needle:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def count_overlapping(text: Column, needle: str) -> Column:
    """Occurrences at every place."""
    return F.regexp_count(text, F.lit(f"(?={quoted(needle)})")) if needle else F.lit(0)


def count_words(text: Column, word: str) -> Column:
    """Words (runs of letters, digits and low lines) that equal ``word``."""
    return F.size(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w == word))


def context(text: Column, at: Column, size: Column | int, around: int = 30) -> Column:
    """What stands around a match at 1-based ``at``, with dots where it is cut."""
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at - 1 + size + around)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))


def valid_pattern(pattern: str) -> str | None:
    """The pattern, or None for one that can't be compiled: such a search finds nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def alnum(text: Column) -> Column:
    """ASCII letters and digits, in small letters."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


#: The alphabet of ``alnum``; a pair of its signs is a bit of a set of 36 times 36.
_SIGNS = b"0123456789abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(DoubleType())
def pair_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the sets of neighbouring signs of two ``alnum`` texts; 1 if neither has a pair, null beside a null.

    A set is a bitmap of fixed size, so a text of any length costs one pass.
    """
    place = np.zeros(256, np.int16)
    place[list(_SIGNS)] = np.arange(len(_SIGNS))

    def pairs(text: str) -> np.ndarray:
        at = place[np.frombuffer(text.encode(), np.uint8)]
        out = np.zeros(len(_SIGNS) ** 2, bool)
        out[at[:-1] * len(_SIGNS) + at[1:]] = True
        return out

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = pairs(x), pairs(y)
        either = int((p | q).sum())
        return int((p & q).sum()) / either if either else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


def letters_and_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def coverage(own: Column, oracle: Column) -> Column:
    """Letters and digits of one text for each of the other; 1 if that has none."""
    return F.when(letters_and_digits(oracle) == 0, 1.0).otherwise(letters_and_digits(own) / letters_and_digits(oracle))


def tier(oracle: Column, size: Column, worse: Column) -> Column:
    """Trust in an extraction, by the worse of coverage and similarity; short texts are fine."""
    return F.when(oracle.isNull(), "Unverified").when(size < 32, "Ok").when(worse < 0.5, "Severe").when(worse < 0.9, "Degraded").otherwise("Ok")


#: From best to worst (fixed order).
TIERS = ("Ok", "Unverified", "Degraded", "Severe")


def tier_rank(name: Column) -> Column:
    out = F.lit(-1)
    for i, t in enumerate(TIERS):
        out = F.when(name == t, i).otherwise(out)
    return out


def trimmed(word: Column) -> Column:
    """A word without punctuation at its ends."""
    return F.btrim(word, F.lit(EDGE_PUNCTUATION))


def dehyphenated(text: Column) -> Column:
    """Joins words that were split at the end of a line: a letter, a hyphen, and a small letter on the next line."""
    return F.regexp_replace(text, r"(?<=\p{L})-\n(?=\p{Ll})", "")


def list_marker(line: Column) -> Column:
    """The bullet, number or letter that opens a list item; empty if none does."""
    return F.regexp_extract(line, r"^ *([•·‣◦*⁃∙\-–—]|[0-9]{1,3}[.)]|\p{L}[.)])(?: |$)", 1)


def collapsed_message(message: Column, width: int = 66) -> Column:
    """Numbers as N, cut to a width, so that like messages are equal."""
    return F.left(F.regexp_replace(message, "[0-9]+", "N"), F.lit(width))


#: Strong right-to-left letters: Hebrew to Arabic Extended but for digits, and presentation forms (fixed ranges).
_RTL = "\u0590-\u065f\u066a-\u06ef\u06fa-\u08ff\ufb1d-\ufdff\ufe70-\ufeff"


def has_rtl(text: Column) -> Column:
    """Whether a strong right-to-left letter occurs."""
    return text.rlike(f"[{_RTL}]")


_IS_RTL = re.compile(f"[{_RTL}]")


def _bidi_class(c: str) -> str:
    """R, digit (D), neutral (N: blanks, punctuation, symbols) or other (O)."""
    if c in "0123456789" or "\u0660" <= c <= "\u0669" or "\u06f0" <= c <= "\u06f9":
        return "D"
    if _IS_RTL.match(c):
        return "R"
    return "N" if c.isspace() or unicodedata.category(c)[0] in "PS" else "O"


#: What keeps its order in a run that turns: a number, with single separators between its digits, and a letter with its marks.
_ISLAND = re.compile("\\d+(?:[.,:/+-]\\d+)*|.[\u0300-\u036f\u0591-\u05bd\u05bf\u05c1-\u05c2\u05c4-\u05c5\u05c7\u0610-\u061a\u064b-\u065f\u0670]*", re.S)


def logical_order(text: str | None) -> str | None:
    """A line that is known to be in the order in which it was painted, with its right-to-left runs turned to the order in which they are read.

    Plain texts are in that order already; where it isn't known, glyphs tell (``operators.bidi``).

    A run goes from one strong letter to another with neutral signs between.  Where nothing on the line is strong the
    other way, numbers belong to runs, too, and keep their own order.
    """
    if not text or not _IS_RTL.search(text):
        return text
    kinds = "".join(map(_bidi_class, text))
    members = "R" if "O" in kinds else "RD"
    out = list(text)
    for run in re.finditer(f"[{members}](?:[{members}N]*[{members}])?", kinds):
        start, end = run.span()
        if "R" in run.group():
            out[start:end] = "".join(reversed(_ISLAND.findall(text[start:end])))
    return "".join(out)


def folded_letters(values: list[str | None]) -> list[str]:
    """Each letter folded by itself; one that opens with a combining mark joins the last letter that isn't empty."""
    out: list[str] = []
    last = -1
    for v in values:
        f = fold_for_matching(v or "") or ""
        if f and last >= 0 and unicodedata.category(f[0])[0] == "M":
            out[last] = fold_for_matching(out[last] + f) or ""
            f = ""
        elif f:
            last = len(out)
        out.append(f)
    return out


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most ``width`` signs, filled word by word; breaks of the text stay and a longer word has a line of its own.

    Nothing is wrapped for a width of 0 or less.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)

    def fill(line: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("at"))

        def add(state: Column, word: Column) -> Column:
            longer = F.concat(state["at"], F.lit(" "), word)
            grown = F.struct(state["done"].alias("done"), F.when(state["at"] == "", word).otherwise(longer).alias("at"))
            ended = F.struct(F.array_append(state["done"], state["at"]).alias("done"), word.alias("at"))
            return F.when((state["at"] != "") & (F.length(longer) > width), ended).otherwise(grown)

        whole = F.aggregate(F.split(line, " ", -1), start, add, lambda s: F.when(s["at"] == "", s["done"]).otherwise(F.array_append(s["done"], s["at"])))
        return F.when(line == "", F.array(F.lit(""))).otherwise(whole)

    return F.flatten(F.transform(lines, fill)) if width > 0 else lines


def without_terms(text: Column, terms: Sequence[str], ignore_case: bool = True) -> Column:
    """The text without the terms, removed one after the other, then trimmed.

    A later term may hit what an earlier removal has brought together.
    """
    out = text
    for t in terms:
        if t:
            out = F.regexp_replace(out, ("(?iu)" if ignore_case else "") + quoted(t), "")
    return F.btrim(out, F.lit(" \t\n\r"))


def remaining(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of the terms that are left, case aside."""
    out = F.lit(0)
    for t in terms:
        out = out + F.regexp_count(text, F.lit("(?iu)" + quoted(t)))
    return out


def padded_number(n: Column, digits: int, prefix: str = "", suffix: str = "") -> Column:
    """A number with leading zeros; one with more digits is never cut."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.length(s), F.lit(digits)), "0"), F.lit(suffix))


#: Roman numerals, greatest first (fixed values).
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    """A positive number as a small Roman numeral."""
    parts, rest = [], n.cast("int")
    for value, sign in _ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*parts)


def alphabetic(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: digits from 1 to 26 (up to four of them)."""
    out, rest = F.lit(""), n.cast("int")
    for _ in range(4):
        out = F.when(rest > 0, F.concat(F.char((F.lit(65) + (rest - 1) % 26).cast("int")), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26).cast("int")).otherwise(rest)
    return out


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7f]")


#: Marks that folding drops, and letters whose compatibility forms it replaces one by one (fixed ranges).
_DROPPED = re.compile("[­​‌‍﻿֑-ׇֽֿׁׂًׅׄ-ٰٟ]")
_FOLDED = re.compile("[ﬀ-ﬆﭐ-﷿ﹰ-ﻼ！-～￠-￦]")


def fold_for_matching(text: str | None) -> str | None:
    """Presentation forms and wide letters as plain ones, marks dropped, composed, hard spaces as spaces."""
    if text is None or text.isascii():
        return text
    text = _FOLDED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _DROPPED.sub("", unicodedata.normalize("NFC", text)).replace(" ", " ")
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def _fold_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(fold_for_matching, na_action="ignore")


def folded(text: Column) -> Column:
    """``fold_for_matching`` of a column; Python sees only texts beyond ASCII."""
    return F.when(is_ascii(text) | text.isNull(), text).otherwise(_fold_batches(F.when(~is_ascii(text), text)))


def token_lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def sequence_agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens in common order for each of the longer text; 1 if both are empty, 0 if one is."""

    def one(x: str | None, y: str | None) -> float:
        p, q = (x or "").split(), (y or "").split()
        return token_lcs(p, q) / max(len(p), len(q)) if p and q else float(not p and not q)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

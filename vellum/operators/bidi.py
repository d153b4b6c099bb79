"""Right-to-left runs of glyphs in the order in which they are read, by where the glyphs stand.

Glyphs come in the order of their stream.  A run of right-to-left letters whose x ascends was painted from its end: it is turned; one whose x
descends is in order, and stays.  Pages are arrays of their glyphs, which go to Python in Arrow batches; there whole runs of pages are gone through at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import _IS_RTL

#: Points that glyphs of a line may differ in height from their neighbour.
SAME_LINE = 5.0
_DIGIT = "0-9٠-٩۰-۹"
_SEPARATOR = "[.,:/+\\-]"


_SINGLE = re.compile(_SEPARATOR)
_DIGITS, _MARKS, _NEUTRAL = re.compile(f"[{_DIGIT}]+"), regex.compile(r"\p{M}+"), regex.compile(r"[ \t\n\x0b\f\r\p{Z}\p{P}\p{S}]+")
#: Glyphs of pages that are gone through together, or those of one page.
TOGETHER = 200_000


def kind(value: str | None) -> str:
    """R (any right-to-left letter), D (digits), M (marks), N (blanks, punctuation, symbols), else O."""
    if value is None:
        return "O"
    if _MARKS.fullmatch(value):
        return "M"
    if _IS_RTL.search(value):
        return "R"
    return "D" if _DIGITS.fullmatch(value) else "N" if _NEUTRAL.fullmatch(value) else "O"


def _places(names: list[str | None], code: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin among the glyphs of pages of the given sizes, and each glyph's place when all are read; the value of a glyph is ``names[code]``."""
    n = len(code)
    at, starts = np.arange(n), np.zeros(n + 1, bool)
    starts[np.cumsum(sizes) - sizes] = True
    starts = starts[:n]
    starts[1:] |= np.abs(y[1:] - y[:-1]) > SAME_LINE
    k = np.array([kind(v) for v in names], "U1")[code]
    sep = np.array([v is not None and bool(_SINGLE.fullmatch(v)) for v in names], bool)[code]
    right, digit, mark = k == "R", k == "D", k == "M"
    line = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    digits = ~np.logical_or.reduceat(k == "O", first)[line]
    member = right | digits & digit

    def before(flag: np.ndarray, by: int) -> np.ndarray:
        """The flag of the glyph so many places before (behind, if negative) on the line."""
        out = np.zeros(n, bool)
        if by > 0:
            out[by:] = flag[:-by] & (line[by:] == line[:-by])
        else:
            out[:by] = flag[-by:] & (line[:by] == line[-by:])
        return out

    # marks that follow the last member belong to it
    number = digit & (before(digit, 1) | before(sep, 1) & before(digit, 2)) | sep & before(digit, 1) & before(digit, -1)
    glued = mark | digits & number
    breaks = starts | ~member & (k != "N") & ~mark
    run, run_at = np.cumsum(breaks) - 1, np.flatnonzero(breaks)
    low = np.minimum.reduceat(np.where(member, at, n), run_at)
    high = np.maximum.reduceat(np.where(member, at, -1), run_at)
    turned = np.logical_or.reduceat(right, run_at) & (high > low)
    turned &= x[np.maximum(high, 0)] > x[np.minimum(low, n - 1)]
    base = np.maximum.accumulate(np.where(~glued, at, -1))
    base = np.where(base >= first[line], base, -1)
    turns = turned[run] & (low[run] <= base) & (base <= high[run])
    block_at = np.flatnonzero(breaks | ~glued)
    block = np.cumsum(breaks | ~glued) - 1
    last = np.append(block_at[1:], n) - 1
    t0 = np.minimum.reduceat(np.where(turns, at, n), run_at)
    t1 = np.maximum.reduceat(np.where(turns, at, -1), run_at)
    return first, np.where(turns, t0[run] + t1[run] - last[block] + at - block_at[block], at)


def _runs(values: pa.Array, x: pa.Array, y: pa.Array) -> Iterator[tuple]:
    """(names, code, where pages end, where lines begin, places) of runs of pages."""
    sizes = values.value_lengths().to_numpy()
    coded = values.flatten().dictionary_encode(null_encoding="encode")
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    xs, ys = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
    ends = np.cumsum(sizes)
    page = done = 0
    while page < len(sizes):
        stop = max(page + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
        part = slice(done, int(ends[stop - 1]))
        yield names, code[part], ends[page:stop] - done, *_places(names, code[part], xs[part], ys[part], sizes[page:stop])
        page, done = stop, part.stop


def lines_of_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text): lines as ``reading_order`` has them, of pages with arrays of ``values``, ``x`` and ``y`` of their glyphs in the order of their stream."""

    @F.arrow_udf("array<string>")
    def read(values: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for names, code, ends, first, places in _runs(values, x, y):
            order = np.empty(len(code), np.int64)
            order[places] = code
            shown = [v or "" for v in names]
            flat = [shown[c] for c in order.tolist()]
            edges = [*first.tolist(), len(flat)]
            texts = ["".join(flat[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            cuts = [0, *np.searchsorted(first, ends, "left").tolist()]
            out += [texts[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.array(out, pa.list_(pa.string()))

    doubles = [F.col(c).cast("array<double>") for c in ("x", "y")]
    return pages.where(F.size("values") > 0).select(*keys, F.posexplode(read("values", *doubles)).alias("line", "text"))


def reading_order(glyphs: DataFrame, keys: list[str], order: str = "ix", value: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """The glyphs with ``line`` and ``read``, their place in it when read; ``keys`` are those of a page, whose lines are bounded.

    A line goes on while a glyph is within ``SAME_LINE`` of the one before it.  A run goes from one right-to-left letter to another with only neutral
    glyphs between; where nothing else on the line is strong, numbers belong to runs.  In a run that turns, a number (digits with single separators between them)
    and a letter with its marks keep their own order.  A null value is a strong glyph of the other direction.
    """

    @F.arrow_udf("array<struct<line:int,read:int>>")
    def placed(values: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for _, code, ends, first, places in _runs(values, x, y):
            line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
            read = (places - first[line] + 1).tolist()
            start = 0
            for end in ends.tolist():
                out.append([{"line": k, "read": r} for k, r in zip((line[start:end] - line[start]).tolist(), read[start:end], strict=True)])
                start = end
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("read", pa.int32())])))

    held = glyphs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*glyphs.columns).alias("_g")))).alias("_page"))
    of = lambda c: F.transform("_page", lambda g: g["_g"][c])
    each = held.select("_page", F.explode(F.arrays_zip("_page", placed(of(value), of(x).cast("array<double>"), of(y).cast("array<double>")).alias("_at"))).alias("_e"))
    return each.select(F.col("_e")["_page"]["_g"].alias("_g"), F.col("_e")["_at"].alias("_at")).select("_g.*", "_at.line", "_at.read")


def lines_read(glyphs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, line, text) of glyphs in ``reading_order``."""
    held = F.transform(F.sort_array(F.collect_list(F.struct("read", value))), lambda g: g[value])
    return glyphs.groupBy(*keys, "line").agg(F.array_join(held, "").alias("text"))

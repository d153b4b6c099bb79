"""Codes of mixed length: byte strings cut by codespace ranges, and looked up in ranges of a character map.

A character map is a resource of a font, and small: its codespaces and ranges are parameters, checked against a bound.  Strings are cut and
looked up in Arrow batches, whole strings of any length at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that a map may hold: two-byte codes make no more.
MOST = 65_536
#: What a code without a character becomes.
UNKNOWN = "�"


@dataclass
class CharacterMap:
    """``codespaces`` are (low, high) byte strings of one length each; ``ranges`` are (first, last, text): texts count up with their codes in the last code point.

    Ranges are of codes of ``len(first)`` bytes; where ranges overlap the later one counts, as in the source of a map.  Without codespaces, codes have two bytes.
    """

    codespaces: Sequence[tuple[bytes, bytes]]
    ranges: Sequence[tuple[bytes, bytes, str]]
    _tables: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if len(self.ranges) > MOST:
            raise ValueError(f"more than {MOST} ranges")
        if any(len(a) != len(b) or not a for a, b in self.codespaces) or any(len(a) != len(b) or not a for a, b, _ in self.ranges):
            raise ValueError("both ends of a range have as many bytes")
        self.spaces = sorted(self.codespaces or [(b"\0\0", b"\xff\xff")], key=lambda s: (-len(s[0]), s[0]))

    def _steps(self, raw: bytes) -> np.ndarray:
        """Bytes of the code that starts at each place: of the longest codespace that holds each of its bytes, else of one that holds its first, else one."""
        b = np.frombuffer(raw, np.uint8)
        n = len(b)
        out = np.zeros(n, np.int64)
        for low, high in self.spaces:
            at = np.flatnonzero((b >= low[0]) & (b <= high[0]) & (out == 0))
            at = at[at + len(low) <= n]
            for j in range(1, len(low)):
                x = b[at + j]
                at = at[(x >= low[j]) & (x <= high[j])]
            out[at] = len(low)
        for low, high in self.spaces:
            at = np.flatnonzero((out == 0) & (b >= low[0]) & (b <= high[0]))
            out[at] = np.minimum(len(low), n - at)
        out[out == 0] = 1
        return out

    def _starts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the codes of a byte string start, and their bytes."""
        steps = self._steps(raw)
        if (steps == 1).all():
            return np.arange(len(raw)), steps
        hop, starts, at, n = steps.tolist(), [], 0, len(raw)
        while at < n:
            starts.append(at)
            at += hop[at]
        found = np.array(starts, np.int64)
        return found, steps[found]

    def cut(self, raw: bytes) -> list[bytes]:
        """The codes of a byte string; together they are all of it."""
        return [raw[a : a + n] for a, n in zip(*(x.tolist() for x in self._starts(raw)), strict=True)]

    def _sorted(self, size: int) -> tuple[np.ndarray, np.ndarray, dict[int, str], np.ndarray, np.ndarray]:
        """Ranges of codes of a length, disjoint and by their first code: first and last, texts before the last code point by range, the code that this point is of, and the point."""
        if size not in self._tables:
            flat: list[list] = []
            for first, last, text in ((int.from_bytes(a), int.from_bytes(b), t) for a, b, t in self.ranges if len(a) == size):
                keep = []
                for f, e, t, base in flat:
                    if e < first or f > last:
                        keep.append([f, e, t, base])
                        continue
                    if f < first:
                        keep.append([f, first - 1, t, base])
                    if e > last:
                        keep.append([last + 1, e, t, base])
                flat = [*keep, [first, last, text, first]]
            flat.sort()
            first, last, base, end = (np.array(x, np.int64) for x in ([f[0] for f in flat], [f[1] for f in flat], [f[3] for f in flat], [ord(f[2][-1]) for f in flat]))
            self._tables[size] = first, last, {i: f[2][:-1] for i, f in enumerate(flat) if len(f[2]) > 1}, base, end
        return self._tables[size]

    def decode(self, raw: bytes) -> tuple[str, int, int]:
        """The text of a byte string, its number of codes, and how many of them have no character."""
        starts, sizes = self._starts(raw)
        b = np.frombuffer(raw, np.uint8)
        points, before = np.full(len(starts), ord(UNKNOWN), np.int64), {}
        for size in np.flatnonzero(np.bincount(sizes)).tolist():
            first, last, texts, base, end = self._sorted(size)
            if not len(first):
                continue
            at = np.flatnonzero(sizes == size)
            value = np.zeros(len(at), np.int64)
            for j in range(size):
                value = value << 8 | b[starts[at] + j]
            k = np.searchsorted(first, value, "right") - 1
            found = (k >= 0) & (value <= last[k])
            at, value, k = at[found], value[found], k[found]
            point = end[k] + value - base[k]
            valid = (point < 0x110000) & ~((point >= 0xD800) & (point < 0xE000))
            at, k = at[valid], k[valid]
            points[at] = point[valid]
            if texts:  # texts before the last code point, where ranges have them
                before |= {i: texts[r] for i, r in zip(at.tolist(), k.tolist(), strict=True) if r in texts}
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        unknown = text.count(UNKNOWN)
        if before:
            unknown -= sum(text[i] == UNKNOWN for i in before)
            text = "".join([before.get(i, "") + c for i, c in enumerate(text)])
        return text, len(starts), unknown


def decoded(raw: Column, cmap: CharacterMap) -> Column:
    """(text, codes, unknown) of byte strings; a null is null."""

    @F.pandas_udf("text string, codes long, unknown long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [cmap.decode(bytes(x)) if x is not None else (None, None, None) for x in b]
            yield pd.DataFrame(rows, columns=["text", "codes", "unknown"]).astype({"codes": "Int64", "unknown": "Int64"})

    return run(raw)

"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton (pyahocorasick
works on str) finds all vocabulary entries in a piece in one pass.  From the
longest entry at each place the encoder goes forward, and backtracks to the
next shorter entry whenever two neighbours aren't compatible, that is, when
BPE would not leave them side by side.  A sequence whose neighbours are all
compatible *is* the BPE encoding, so the merges are reproduced exactly.
Compatibility is memoised per pair, and each place is given up at most once,
hence linear time, even for a piece of a million equal letters.

Nulls and empty texts have no ids.  Rows are independent of each other: repeated
rows, ids and null ids are kept as they are, an empty table gives an empty one,
and further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from vellum.llm.common import mapped, remember

#: White space as Unicode defines it (the property White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Splits a text where every piece of the usual patterns ends: a run of other
#: characters with at most one space before it, or white space alone.
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Chunks, and pairs, that a worker remembers (together some 200 MB at most).
MEMO = 500_000


class BpeCodec:
    """One vocabulary with its automaton and its memos; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Chunks may be cut off and remembered only where the pattern can't look across them.
        self.chunked = "(?!\\S)" in pattern and " ?\\p{L}+" in pattern
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """BPE by its definition: join the pair of least rank, under ``below``, until none is left (short pieces only)."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int]:
        """The two entries whose merge makes ``token``; itself twice for a single byte."""
        known = self.split.get(token)
        if known is None:
            b = self.token[token]
            if len(b) == 1:
                known = token, token
            else:
                known = tuple(self.merged(b, below=token))
                if len(known) != 2:
                    raise ValueError(f"entry {token} of the vocabulary can't be reached by merges")
            self.split[token] = known
            self.joined[known] = token
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side.

        Undoes merges at the seam, latest first, and looks for a merge across
        the seam that would have come before the one undone.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        limit = 1 << 60  # merges of this rank and above haven't happened yet where we stand
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < limit and self.parts(across) == (a, b):
                return False
            left, right = self.parts(a), self.parts(b)
            if left[0] == a and right[0] == b and left[1] == a and right[1] == b:
                return True
            # the later merge is undone first; a merge across of equal rank to the left one comes after it
            if a > b:
                if left[1] == a:
                    return True
                limit, a = a, left[1]
            else:
                if right[0] == b:
                    return True
                limit, b = b + 1, right[0]

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of ``token``; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            b = self.token[token]
            known = self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [(0, -1)] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > longest[start][0]:
                longest[start] = (size, token)
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        while True:
            while True:
                end = at + len(self.token[token])
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at][1]
                    break
                token = self.next_shorter(token)
                if token < 0:
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(self.token[token])
                    # the token that led here is tried again; its end is closed now

    def encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for m in self.pattern.findall(chunk):
            ids += self.encode_piece(m.encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            return self.encode_chunk(text)
        memo, out = self.memo, []
        for chunk in _CHUNK.findall(text):
            ids = memo.get(chunk)
            if ids is None:
                ids = self.encode_chunk(chunk)
                if len(chunk) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> BpeCodec:
    """The codec of a rank file; a Python worker reads the file once."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return BpeCodec(ranks, pattern)


def bpe_encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (the ids as little-endian unsigned 32-bit integers) for every row."""
    return mapped(df, id_col, text_col, "ids binary", lambda t: (codec(vocabulary, pattern).encode(t),))


def bpe_digest(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns counts and digests of both."""

    def row(text: str) -> tuple[int, str, str]:
        remember("chunks", codec.cache_clear)
        c = codec(vocabulary, pattern)
        ids = c.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return mapped(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)

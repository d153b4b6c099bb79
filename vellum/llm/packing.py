"""Packing by minimum bin slack.

Texts are tokenised and cut into pieces of at most ``capacity`` ids.  The
number of pieces of each length is all that the packing needs: while pieces
remain, the longest length opens a window and a bitset subset-sum dynamic
program over the remaining multiset of lengths finds the sum closest to what is
left of the window; backtracking through the bitsets gives how many pieces of
each length make that sum.  The same window is then repeated as often as the
counts allow.  At most ``capacity`` lengths exist, so the plan is small whatever
the size of the corpus, and a few thousand rounds of the program end it.

Pieces find their place in the plan by their rank among the pieces of equal
length: ranks are taken in salted groups whose offsets are a running sum, so no
length, however common, meets in one task.

A null or an empty text is the end-of-document id alone.  Repeated rows, and
rows whose id is null or that of another row, are packed as rows of their own; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import give_back, remember, small_batches, texts, written

CAPACITY = 2048
#: Words whose ids a worker remembers, those that it keeps once a task has learnt fewer than so many, and those that are learnt at once.
MEMO, KEPT, RUN = 700_000, 100_000, 5_000
_GAP = re.compile("[ \n]+")


class WordIds:
    """Ids of a tokenizer that drops white space and marks the end of each word.

    A new word of letters alone is one piece to the tokenizer, whose last id is
    one that ends words; so the new words of a batch are encoded as one text and
    told apart by those ids.  Any other run of characters is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in names.items() if t.endswith(suffix)]] = True
        self.memo: dict[str, bytes] = {"": b""}
        self.learnt = 0

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words to the memo."""
        memo, plain, other = self.memo, [], []
        for w in words:
            core = w.rstrip(".,!?;:")
            if core.isalpha() and (core.isascii() or core.lower().isalpha() and unicodedata.is_normalized("NFC", core)):
                plain.append(core)
                if core != w:
                    other.append(w[len(core) :])
            else:
                other.append(w)
        plain = [w for w in dict.fromkeys(plain) if w not in memo]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(plain):
            raw, start = ids.tobytes(), 0
            for w, stop in zip(plain, (stops * 4).tolist(), strict=True):
                memo[w], start = raw[start:stop], stop
        else:  # a tokenizer that marks ends in some other way
            other += plain
        other = [w for w in dict.fromkeys(other) if w not in memo]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()
        for w in words:
            if w not in memo:
                core = w.rstrip(".,!?;:")
                memo[w] = memo[core] + memo[w[len(core) :]]

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = b""
        split = [_GAP.split(t) for t in batch]
        new = list(set().union(*split).difference(memo))
        self.learnt += len(new)
        for x in range(0, len(new), RUN):
            self._learn(new[x : x + RUN])
        for words in split:
            yield b"".join(map(memo.__getitem__, words))
        for w in new:
            if len(w) > 64:
                memo.pop(w, None)

    def rest(self) -> None:
        """After a task: where tasks learn little, what others left behind is hardly needed, and goes."""
        if self.learnt < KEPT < len(self.memo):
            self.memo = dict(islice(self.memo.items(), len(self.memo) - KEPT // 2, None)) | {"": b""}
            give_back()
        self.learnt = 0


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts every text into pieces of ``capacity`` ids and a rest."""
    end = np.array([end_id], "<u4").tobytes()
    small_batches(df.sparkSession)

    @F.pandas_udf("doc_tokens long, pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remember("words", word_ids.cache_clear)
        words = word_ids(tokenizer)
        for batch in batches:
            out = []
            for ids in words.encode(list(texts(batch))):
                ids += end
                n = len(ids) // 4
                out.append((n, [(s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for s in range(0, n, capacity)]))
            yield pd.DataFrame(out, columns=["doc_tokens", "pieces"])
        words.rest()

    # ids stay in Spark: pandas would make floats of a batch's ids where one is null
    rows = df.select(F.col(id_col).alias("_id"), cut(F.col(text_col)).alias("_cut")).select(F.col("_id").cast("long").alias(id_col), "_cut.doc_tokens", F.explode("_cut.pieces").alias("_piece"))
    return rows.select(id_col, "_piece.*", "doc_tokens")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how many of each, whose sum is the largest that fits into ``room``.

    Bit s of a bitset tells that sum s can be made.  Copies of a length are
    added in powers of two, so that a count costs its logarithm.
    """
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + copies
            total -= length * copies
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths with their counts) for each kind of window; uses every piece once."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[x] // n for x, n in window.items())
        for x, n in window.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((times, window))
    return out


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = df.sparkSession
    cut = written(pieces(df, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    # a group holds some 100,000 pieces at most of one length, however many there are
    groups = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), cut.count() // 100_000)
    salt = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(groups)).alias("_salt")
    sized = cut.select("*", salt)
    in_group = sized.groupBy("length", "_salt").count()
    # at most `capacity` rows come to the driver: the number of pieces of each length
    counts = {r.length: r.n for r in in_group.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_group.select("length", "_salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_below"))
    order = Window.partitionBy("length", "_salt").orderBy(id_col, "start", "ids_crc32", "doc_tokens")
    ranked = sized.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + F.col("_below")).alias("_rank"))

    # for each length: where the ranks of each window kind start, and what a rank means there
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, window in plan(counts, capacity):
        at = 0
        for length in sorted(window, reverse=True):
            start = used.get(length, 0)
            slots.setdefault(length, []).append((start, first, at, window[length]))
            used[length] = start + times * window[length]
            at += length * window[length]
        first += times
    table = {k: np.array(v, np.int64) for k, v in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length).tolist():
            rows, t = np.flatnonzero(length == size), table[size]
            start, first, at, each = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1].T
            turn, nth = np.divmod(rank[rows] - start, each)
            sequence[rows], offset[rows] = first + turn, at + nth * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "_place.*")

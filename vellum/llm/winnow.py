"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in every window of w hashes the
least one is chosen, the rightmost of equal ones; each chosen hash is kept once
with its position.  Two texts that share a run of ``w + k - 1`` code points
share a chosen hash (the match guarantee), and the positions say where.

A fingerprint is the Base64 of (hash, position) pairs of unsigned 32-bit
little-endian integers.  A text shorter than k is one gram; a null or an empty
text has the empty fingerprint.  Likeness is the Jaccard similarity of the two
sets of hashes: 1 for two empty ones, 0 for an empty one and another.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, mapped, small_batches, written

#: Code points in a gram (a power of two) and hashes in a window: runs of 31 are found.
GRAM, WINDOW = 16, 16
#: Runs of documents, for each partition of a shuffle.
RUNS = 8
_BASE = 0x9E3779B97F4A7C15


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The chosen (hash, position) pairs, by position: an array of n x 2 unsigned 32-bit integers."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(h)
    if not n:
        return np.zeros((0, 2), np.uint32)
    base = pow(_BASE, min(1, n), 1 << 64)
    width = 1
    with np.errstate(over="ignore"):
        if n < gram:
            h = np.array([sum(int(x) * pow(_BASE, i, 1 << 64) for i, x in enumerate(h)) & (1 << 64) - 1], np.uint64)
        else:
            while width < gram:  # a hash of 2k code points from two of k
                h = h[:-width] * np.uint64(base) + h[width:]
                base = base * base & (1 << 64) - 1
                width *= 2
        h = h ^ h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ h >> np.uint64(32)
    # one key orders by hash, then from the right
    key = (h & np.uint64(0xFFFFFFFF)) << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)
    span = min(window, len(key))
    least, width = key, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - width :][: len(key) - span + 1])
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return np.stack(((least >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.uint32)), 1)


def fingerprint(chosen: np.ndarray) -> str:
    return base64.b64encode(chosen.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """``a`` and ``b`` are sets of hashes (sorted, distinct)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``id_col``, ``hashes`` and ``positions`` for every row; further columns are ignored."""

    def row(text: str) -> tuple:
        chosen = winnow(text, gram, window).astype(np.int64)
        return chosen[:, 0], chosen[:, 1]

    return mapped(df, id_col, text_col, "hashes array<bigint>, positions array<bigint>", row)


def _starts(rows: DataFrame, runs: int) -> list[tuple[int, int]]:
    """(id, h) of the rows that open some ``runs`` runs of about equal size, in order: no more than runs and partitions."""
    n = rows.count()
    every = max(1, -(-n // runs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for batch in batches:
            yield batch.iloc[np.flatnonzero((at + np.arange(len(batch))) % every == 0)]
            at += len(batch)

    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    return sorted({(r[0], r[1]) for r in ordered.mapInPandas(run, "_id long, _h long").collect()})


def in_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _h, _run, _tail): rows dealt to runs in the order of (id, h), h a hash of the text, so that each row has its successor in its run.

    The row that opens a run is dealt to the run before it, too, as its last row (``_tail``), and the very
    first one to the last run: after the last document comes the first.  Rows arrive sorted.  All ids are whole numbers
    throughout.  Rows without an id aren't among them.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL").withColumn("_h", F.xxhash64("_text"))
    slim = written(docs.select("_id", "_h"), "order")
    starts = _starts(slim, RUNS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids, marks = np.array([i for i, _ in starts], np.int64), [h for _, h in starts]
    discard(slim)

    @F.pandas_udf("array<struct<run:bigint,tail:boolean>>")
    def places(i: pd.Series, h: pd.Series) -> pd.Series:
        i, h = i.to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        out = []
        for a, b, mark in zip(low.tolist(), high.tolist(), h.tolist(), strict=True):
            opens = False
            if a < b:  # a row that shares its id with one that opens a run
                at = bisect.bisect_left(marks, mark, a, b)
                opens = at < b and marks[at] == mark
                b = at + opens
            place = [(b - 1, False)]
            if opens:
                place.append(((b - 2) % len(marks), True))
            out.append(place)
        return pd.Series(out)

    dealt = docs.withColumn("_place", F.explode(places("_id", "_h")))
    dealt = dealt.select("_id", "_text", "_h", F.col("_place.run").alias("_run"), F.col("_place.tail").alias("_tail"))
    return dealt.repartition("_run").sortWithinPartitions("_run", "_tail", "_id", "_h")


def edited_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, and compares both with the next document.

    The edited text has its last quarter replaced by the beginning of the next
    document, in ascending order of ids; rows that share an id come in the order
    of a hash of their texts, and rows with equal ids and texts follow each
    other.  A document that is alone is its own next, and so is each row
    without an id, as it has no place in the order.
    """
    small_batches(df.sparkSession)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(text: str, mine: np.ndarray, after: str, theirs: np.ndarray) -> tuple:
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        changed = winnow(edited)
        own = np.unique(mine[:, 0])
        return len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(mine), fingerprint(changed), likeness(own, np.unique(changed[:, 0])), likeness(own, np.unique(theirs[:, 0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for i, text, r, tail in zip(*(batch[c] for c in ("_id", "_text", "_run", "_tail")), strict=True):
                if tail and held is None:
                    continue  # a further copy of the row that opens the next run
                text = text if isinstance(text, str) else ""
                chosen = winnow(text)
                if held is not None and held[3] == r:
                    out.append((held[0], *row(held[1], held[2], text, chosen)))
                held = None if tail else (i, text, chosen, r)
            yield pd.DataFrame(out, columns=["_id", *names])

    def lone(text: str) -> tuple:
        chosen = winnow(text)
        return row(text, chosen, text, chosen)

    placed = in_runs(df, id_col, text_col).mapInPandas(run, f"_id long, {schema}")
    nameless = mapped(df.where(F.col(id_col).isNull()), id_col, text_col, schema, lone)
    return placed.withColumnRenamed("_id", id_col).unionByName(nameless)

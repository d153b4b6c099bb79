"""Suffix-array dedup: induced sorting of suffixes with their common prefixes.

Removes each byte that lies in a string of ``LENGTH`` bytes which also starts
anywhere else.  A suffix array over a whole corpus would be many times the
corpus, so Spark first deals suffixes to shards and keeps those that can match:

1. In each window of ``LENGTH`` bytes the least hash of its ``GRAM``-byte grams
   (the rightmost of equal ones) is the window's anchor.  Equal windows have
   equal anchors at equal places, so windows with one anchor, a run of starts
   called a stretch, form a shard with all others of the same anchor hash.
   Anchors that stand in the corpus once are dropped.
2. Stretches of equal bytes are one for the sorting, and all of their windows
   are repeated.  Those that a text holds several times are one row from the
   start, so a passage that fills a text over and over costs it a row.  Shards with more than ``MANY`` different stretches are split by
   the bytes that all windows of a class of starts have in common; while such a
   part has more than ``MANY`` different pieces, its class is halved, down to one
   start, where equal windows are one key and are only counted.
3. In each shard the suffixes at the anchors are sorted, with the common prefix
   of neighbours.  From the order of the suffixes at one place the order of
   those a byte earlier is *induced*: stable by their first byte, and the common
   prefix of new neighbours is one more than the least in between.  A suffix
   that can't reach ``LENGTH`` any more leaves.  Wherever a common prefix
   reaches ``LENGTH``, the window is repeated.

Spark's shuffles sort the shards' tuples on disk, so a shard set may be far
larger than memory; a task holds one block of shards at a time, and no shard
that is sorted has more than ``MANY`` pieces.

Rows are known by their text, that is by a 64-bit and a 32-bit hash of it, so
rows with equal texts lose the same bytes whatever their ids are, and ids may be
null, repeated or as great as 64 bits go; they never pass through Python.

A null text is an empty one; a text of fewer than ``LENGTH`` bytes loses
nothing; of two equal longer texts nothing is left of either.  An empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, remember, small_batches, texts, written

LENGTH, GRAM = 200, 32
#: Bytes that are looked at together; longer texts are gone through in overlapping parts.
PART = 1 << 20
#: Different stretches from which a shard is split; stretches in a block that is sorted together.
MANY, BLOCK = 1_000, 20_000
_PIECE = "key long, h long, sum long, at long, first int, last int, tag long, low int, high int, bytes binary"
_PIECES = [c.split()[0] for c in _PIECE.split(", ")]
_PLACES = (1 << 20) - 1
_BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, those of its inverse, and a random number for each byte."""
    with np.errstate(over="ignore"):
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = (np.concatenate(([np.uint64(1)], np.full(PART, np.uint64(b)).cumprod(dtype=np.uint64))) for b in (_BASE, inverse))
    return up, down, np.random.default_rng(10).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def stretches(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the bytes, place) of each stretch.

    A place packs the anchor's position and how far before it the stretch's
    first and last window start: position * 65536 + first * 256 + last.
    """
    out = []
    up, down, numbers = _powers()
    with np.errstate(over="ignore"):
        for x in range(0, max(0, len(raw) - LENGTH + 1), PART - LENGTH + 1):
            b = np.frombuffer(raw, np.uint8, min(PART, len(raw) - x), x)
            n = len(b)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(numbers[b] * up[:n], out=total[1:])
            h = _mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
            key = (h & ~np.uint64(_PLACES)) | (np.uint64(_PLACES) - np.arange(len(h), dtype=np.uint64))
            span, width, least = LENGTH - GRAM + 1, 1, key
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = span - width
            least = np.minimum(least[: n - LENGTH + 1], least[rest : rest + n - LENGTH + 1])
            first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            last = np.concatenate((first[1:], [len(least)])) - 1
            anchor = _PLACES - (least[first] & np.uint64(_PLACES)).astype(np.int64)
            before, after = anchor - first, anchor - last
            content = _mix((total[last + LENGTH] - total[first]) * down[first] + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64))
            out.append(((least[first] >> np.uint64(20)).astype(np.int64), content.astype(np.int64), (anchor + x) * 65536 + before * 256 + after))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def induce(keys: list, data: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which windows are repeated: a row for each stretch, a column for each distance from start to anchor.

    ``data`` are the bytes of stretches, ``keys`` their shards, ``first`` and
    ``last`` how far before the anchor their windows start.
    """
    n = len(data)
    found = np.zeros((n, LENGTH - GRAM + 1), bool)
    far = first.tolist()
    right = [d[f:] for d, f in zip(data, far, strict=True)]
    order = np.array(sorted(range(n), key=lambda i: (keys[i], right[i])), np.int64)
    group = np.zeros(n, np.int64)
    group[order] = np.cumsum([0, *(keys[a] != keys[b] for a, b in zip(order[1:], order, strict=False))])
    # the common prefix of neighbours at the anchors
    size = np.array([len(r) for r in right], np.int64)
    table = np.frombuffer(b"".join([right[i].ljust(LENGTH, b"\0") for i in order.tolist()]), np.uint8).reshape(n, LENGTH)
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = table[1:] != table[:-1]
        at = np.where(differ.any(1), differ.argmax(1), LENGTH)
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], np.minimum(at, np.minimum(size[order[1:]], size[order[:-1]])), 0)
    buffer = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data], np.int64)
    anchor = np.cumsum(sizes) - sizes + first
    for o in range(LENGTH - GRAM + 1):
        most = np.maximum(common, np.append(common[1:], 0))
        found[order[most >= LENGTH], o] = True
        left = first[order] - o
        stay = np.flatnonzero((left > 0) & (most + left >= LENGTH))
        if not len(stay):
            break
        members = order[stay]
        letter = group[members] * 256 + buffer[anchor[members] - o - 1]
        turn = np.argsort(letter, kind="stable")
        letter, place = letter[turn], stay[turn]
        low = np.zeros(len(turn), np.int64)
        joined = np.flatnonzero(letter[1:] == letter[:-1])
        if len(joined):
            ranges = np.stack((place[joined] + 1, place[joined + 1] + 1), 1).ravel()
            low[joined + 1] = np.minimum.reduceat(np.append(common, 0), ranges)[::2] + 1
        order, common = order[place], low
    return found & (np.arange(found.shape[1]) >= last[:, None])


def _classes() -> list[tuple[int, int]]:
    """Classes of distances: 0, 1, 2 to 3, 4 to 7 and so on."""
    out, low = [(0, 0)], 1
    while low <= LENGTH - GRAM:
        out.append((low, min(2 * low - 1, LENGTH - GRAM)))
        low *= 2
    return out


def _removed(n: int, spans: list) -> np.ndarray:
    """The bytes that spans of (from, to) cover."""
    edge = np.zeros(n + 1, np.int64)
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return edge[:-1].cumsum() > 0


def _cut(raw: bytes, spans: list) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs of them, what is left)."""
    if not spans:
        return 0, 0, raw
    gone = _removed(len(raw), spans)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of its bytes; code points that a span cuts go as a whole."""
    raw = text.encode()
    gone = _removed(len(raw), spans)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    return "".join(raw[a:b].decode(errors="ignore") for a, b in edge.reshape(-1, 2).tolist())


def text_key(text_col: str) -> list[Column]:
    """(h, sum): what rows are known by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.crc32(F.encode(text, "UTF-8")).alias("sum")]


def _anchored(docs: DataFrame) -> DataFrame:
    """(anchor, content, h, sum, id, place, more) of all stretches of all texts; ``more``: further places of the same one in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("suffixes")
        for batch in batches:
            parts, more, sizes = [], [], []
            for t in batch.column("text").to_pylist():
                anchor, content, place = stretches(t.encode())
                _, first, of = np.unique(anchor * 31 ^ content, return_index=True, return_inverse=True)
                sizes.append(len(first))
                more += [None] * len(first)
                if len(first) < len(anchor):
                    again = np.ones(len(anchor), bool)
                    again[first] = False
                    for k, p in zip(of[again].tolist(), place[again].tolist(), strict=True):
                        k += len(more) - len(first)
                        more[k] = more[k] or []
                        more[k].append(p)
                parts.append((anchor[first], content[first], place[first]))
            columns = {name: pa.array(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64)) for k, name in enumerate(("anchor", "content", "place"))}
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns |= {c: batch.column(c).take(rows) for c in ("h", "sum", "id")}
            columns["more"] = pa.array(more, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in names})

    names = ["anchor", "content", "h", "sum", "id", "place", "more"]
    return docs.select("id", "h", "sum", "text").mapInArrow(run, "anchor long, content long, h long, sum long, id long, place long, more array<long>")


def _span(place: Column) -> Column:
    """The bytes of a stretch, as (from, to)."""
    anchor, first, last = F.shiftright(place, 16), F.shiftright(place, 8).bitwiseAND(255), place.bitwiseAND(255)
    return F.struct((anchor - first).alias("from"), (anchor - last + LENGTH).alias("to"))


def _spans() -> Column:
    """The bytes of a stretch at all of its places."""
    return F.transform(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<bigint>"))), _span)


def _piece(key: int, part: int, h: int, s: int, a: int, first: int, last: int, low: int, high: int, own: bytes) -> tuple | None:
    """The piece of a stretch with the bytes ``own`` whose windows start ``low`` to ``high`` before the anchor, keyed by what all of these share."""
    o1, o2 = max(low, last), min(high, first)
    if o1 > o2:
        return None
    shared, mine = own[first - low : first - high + LENGTH], own[first - o2 : first - o1 + LENGTH]
    sub = xxhash.xxh3_64_intdigest(shared, seed=(key << 4 | part) & (1 << 64) - 1)
    tag = xxhash.xxh3_64_intdigest(mine, seed=o1 << 8 | o2)
    return sub - (1 << 63), h, s, a, o2, o1, (tag >> 1) + 1, low, high, mine


def _members(touched: DataFrame, split: bool) -> DataFrame:
    """Stretches with their bytes: those of shards that stay whole, or those of large shards, split by classes of distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remember("suffixes")
        for batch in batches:
            out = []
            for h, s, text, look in zip(*(batch[c] for c in ("h", "sum", "text", "look")), strict=True):
                raw = text.encode()
                for x in look:
                    key, place = x["anchor"], x["place"]
                    a, first, last = place >> 16, place >> 8 & 255, place & 255
                    own = raw[a - first : a - last + LENGTH]
                    if not split:
                        out.append((key, h, s, a, first, last, 0, 0, LENGTH - GRAM, own))
                        continue
                    parts = (_piece(key, j, h, s, a, first, last, low, high, own) for j, (low, high) in enumerate(_classes()))
                    out += [p for p in parts if p]
            yield pd.DataFrame(out, columns=_PIECES)

    mine = F.filter("look", lambda x: (x["many"] > MANY) == split).alias("look")
    return touched.select("h", "sum", "text", mine).where("size(look) > 0").mapInPandas(run, _PIECE)


def _halved(pieces: DataFrame) -> DataFrame:
    """The pieces of either half of each piece's class of distances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remember("suffixes")
        for batch in batches:
            out = []
            for key, h, s, a, first, last, low, high, own in zip(*(batch[c] for c in _PIECES if c != "tag"), strict=True):
                middle = (low + high) // 2
                parts = (_piece(key, j, h, s, a, first, last, x, y, bytes(own)) for j, (x, y) in enumerate(((low, middle), (middle + 1, high))))
                out += [p for p in parts if p]
            yield pd.DataFrame(out, columns=_PIECES)

    return pieces.select(_PIECES).mapInPandas(run, _PIECE)


def _parted(pieces: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pieces to sort, in shards of at most ``MANY``; (h, sum, from, to) of equal pieces; the written tables of the former.

    Equal pieces are one for the sorting, and all of their windows are repeated.
    A shard that is too large is split again; a class of one distance has only
    equal pieces in a shard, so this ends.
    """
    sortable, equal, tables = [], [], []
    while True:
        pieces = written(pieces, "members")
        one = F.min_by(F.struct(*(c for c in _PIECES if c not in ("key", "tag"))), F.struct("h", "sum", "at")).alias("one")
        grouped = written(pieces.groupBy("key", "tag").agg(F.count("*").alias("copies"), one), "pieces")
        again = pieces.join(grouped.where("copies > 1").select("key", "tag"), ["key", "tag"])
        equal.append(written(again.select("h", "sum", (F.col("at") - F.col("first")).alias("from"), (F.col("at") - F.col("last") + LENGTH).alias("to")), "equal"))
        discard(pieces)
        sizes = written(grouped.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "parts")
        tables += [grouped, sizes]
        kinds = grouped.join(sizes, "key").select("many", "key", "tag", "one.*")
        sortable.append(kinds.where(F.col("many") <= MANY).select(_PIECES))
        if sizes.where(F.col("many") > MANY).isEmpty():
            return reduce(DataFrame.unionByName, sortable), reduce(DataFrame.unionByName, equal), tables
        pieces = _halved(kinds.where(F.col("many") > MANY))


def _sorted_shards(members: DataFrame) -> DataFrame:
    """(h, sum, from, to) of repeated strings, from the induced order in each shard."""

    def block(held: pd.DataFrame) -> pd.DataFrame:
        first, last = held["first"].to_numpy(np.int64), held["last"].to_numpy(np.int64)
        found = induce(held["key"].tolist(), [bytes(b) for b in held["bytes"]], first, last)
        step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(step == 1)
        high = np.nonzero(step == -1)[1] - 1  # both in order of rows, so they pair up
        at = held["at"].to_numpy(np.int64)[row]
        return pd.DataFrame({"h": held["h"].to_numpy()[row], "sum": held["sum"].to_numpy()[row], "from": at - high, "to": at - low + LENGTH})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remember("suffixes")
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK:
                whole = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iloc[-1], "left"))  # the last shard may go on
                if cut:
                    yield block(whole.iloc[:cut].reset_index(drop=True))
                held = [whole.iloc[cut:].reset_index(drop=True)]
                rows = len(held[0])
        if rows:
            yield block(pd.concat(held, ignore_index=True))

    dealt = members.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "h", "sum", "at", "first", "last", "bytes").mapInPandas(run, "h long, sum long, from long, to long")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, sum, spans): for every text that loses bytes, by its ``text_key``, the spans of them; a written table."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", *text_key("text"))
    anchored = _anchored(docs)
    times = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    often = anchored.groupBy("anchor").agg(F.sum(times).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    often = written(often.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")), "anchors")
    kept = written(anchored.join(often, "anchor"), "stretches")
    # where all stretches of an anchor are equal, all are repeated and nothing has to be sorted
    mixed = kept.where("NOT alike")
    kinds = mixed.groupBy("anchor", "content").agg(F.sum(times).alias("copies"), F.min(F.struct("h", "sum", "id", "place")).alias("one"))
    kinds = written(kinds, "kinds")
    many = written(kinds.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), "shards")
    copied = mixed.join(kinds.where("copies > 1").select("anchor", "content"), ["anchor", "content"])
    known = copied.select("h", "sum", _spans().alias("spans")).unionByName(kept.where("alike").select("h", "sum", _spans().alias("spans")))
    # a set, as copies of a text have the same spans: no more of them than the text is long
    known = written(known.groupBy("h", "sum").agg(F.flatten(F.collect_set("spans")).alias("spans")), "known")
    look = kinds.join(many, "anchor").select("one.id", "one.h", "one.sum", F.struct("anchor", "one.place", "many").alias("look"))
    look = written(look.groupBy("id", "h", "sum").agg(F.collect_list("look").alias("look")), "look")
    discard(often, kept, kinds, many)

    touched = docs.join(look, docs["id"].eqNullSafe(look["id"]) & (docs["h"] == look["h"]) & (docs["sum"] == look["sum"])).select(docs["h"], docs["sum"], "text", "look")
    whole = _members(touched, False)
    split, again, tables = _parted(_members(touched, True))
    found = written(_sorted_shards(whole.unionByName(split)).unionByName(again), "found")
    discard(look, *tables)
    every = known.unionByName(found.select("h", "sum", F.array(F.struct("from", "to")).alias("spans")))
    out = written(every.groupBy("h", "sum").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(known, found)
    return out


def with_spans(df: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, spans): every row of ``df`` as a struct, whatever its columns are called, and what ``repeated_spans`` found for its text, else null."""
    rows = df.select(F.struct("*").alias("row"), *text_key(text_col))
    return rows.join(spans, ["h", "sum"], "left").select("row", "spans")


def repeated_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How much every text loses, and the SHA-256 of what is left of its bytes."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        remember("suffixes")
        out = []
        for t, x in zip(text, spans, strict=True):
            if not isinstance(t, str):
                out.append((0, 0, None))
                continue
            removed, runs, left = _cut(t.encode(), [(s["from"], s["to"]) for s in x])
            out.append((removed, runs, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs, repeated_spans(docs, "id")).select("row.id", "row.text", "spans")
    whole = F.col("spans").isNull()
    done = rows.select("id", "text", whole.alias("whole"), cut(F.when(~whole, F.col("text")), "spans").alias("cut"))
    digest = F.when(F.col("whole"), F.sha2(F.encode("text", "UTF-8"), 256)).otherwise(F.col("cut.kept_sha256"))
    return done.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", digest.alias("kept_sha256"))

"""Cross-tokenizer alignment by a dictionary of groups.

Each text is encoded by two tokenizers, A and B; the places where a token of both ends cut it into groups, each a run of A ids and a run
of B ids over the same bytes.  Groups repeat a lot, and their bytes follow from their ids, so they are interned: a task numbers the distinct groups of
each chunk of documents, and only these dictionaries are shuffled, with frequencies that are added up before.  Links (pairs of an A
and a B token whose bytes overlap) are expanded once for each distinct group of the corpus and multiplied by its frequency (or by the documents that hold
it); what they add up to is joined back by group key, and then to each chunk's own numbers, so a document is never a row for each of its groups.

Texts are encoded by segments, cut where a space follows what is neither white space nor U+2581: there both tokenizers start anew
(A's pieces hold no space but at their start, and no piece of B holds U+2581 behind another character, which is looked up; else texts are encoded whole).  A
text with a segment whose bytes don't come back is encoded whole.

A null or empty text, and one whose tokens' bytes of A or B aren't ``" " + text``, has no tokens: zeros and an empty hash.  Null and shared ids
are kept, one row each; repeated texts count as often as they occur; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import give_back, remember, small_batches, written

#: Segments that a worker remembers, those that it keeps once a task has learnt fewer than so many, and the longest of them.
MEMO, KEPT, MEMO_CHARS = 500_000, 100_000, 64
#: Characters of texts that are split together, and segments that are encoded together: both take many times their size.
SPLIT, LOT = 500_000, 10_000
#: Characters in a chunk of documents with a dictionary of its own (a longer text is a chunk).
CHUNK = 4_000_000
#: Groups whose text is longer than this are known by its hash.
KEY = 64

_CUT = re.compile("(?<=[^\\s▁])(?= )")
_ODD = re.compile("[\\s▁] | $")


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and what this worker remembers of segments."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        byte = _byte_level()
        tokens = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in tokens.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = [len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]
        self.b_len = [len(x) for x in self.b_bytes]
        self.names = [str(i) for i in range(max(len(self.a_len), len(self.b_len)))]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memo: dict[str, bytes | None] = {}
        self.learnt = 0

    def split(self, text: str) -> list[str]:
        """``" " + text`` as segments, each of which starts with a space."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        if not _ODD.search(whole):
            return [" " + x for x in text.split(" ")]
        parts = _CUT.split(whole)
        if len(parts) > 1 and parts[-1].isspace():  # white space at the end stays with what it follows
            parts[-2:] = [parts[-2] + parts[-1]]
        return parts

    def _name(self, ids: list[int]) -> str:
        return self.names[ids[0]] if len(ids) == 1 else ",".join([self.names[x] for x in ids])

    def groups(self, a: list[int], b: list[int]) -> str:
        """The groups of ids over the same bytes as ``a1,a2|b1``, joined by semicolons."""
        if len(a) == 1 or len(b) == 1:
            return f"{self._name(a)}|{self._name(b)}"
        out, i, j, from_i, from_j, ahead = [], 0, 0, 0, 0, 0
        a_len, b_len = self.a_len, self.b_len
        for x in a:
            ahead += a_len[x]
            i += 1
            while ahead > 0:
                ahead -= b_len[b[j]]
                j += 1
            if not ahead:
                out.append(f"{self._name(a[from_i:i])}|{self._name(b[from_j:j])}")
                from_i, from_j = i, j
        return ";".join(out)

    def learn(self, segments: list[str]) -> list[bytes | None]:
        """The groups of segments; None where the bytes of A's or B's tokens aren't the segment's."""
        out: list[bytes | None] = []
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for at in range(0, len(segments), LOT):
            lot = segments[at : at + LOT]
            for s, e, b in zip(lot, self.a.encode_batch_fast(lot, add_special_tokens=False), self.b.encode([s[1:] for s in lot], num_threads=1), strict=True):
                a, raw = e.ids, s.encode()
                whole = b"".join(map(b_of, b)) == raw and b"".join(map(a_of, a)) == raw
                out.append(self.groups(a, b).encode() if whole else None)
        return out

    def texts(self, batch: list[str | None]) -> Iterator[list[bytes]]:
        """The groups of each text by segments, as the memo holds them; none of a text without tokens."""
        for start, stop in _chunks(batch, SPLIT):
            yield from self._texts(batch[start:stop])

    def _texts(self, batch: list[str | None]) -> Iterator[list[bytes]]:
        if len(self.memo) > MEMO:  # the older half goes
            self._keep(MEMO // 2)
        memo = self.memo
        split = [self.split(t) if t else [] for t in batch]
        new = list(set().union(*split).difference(memo))
        self.learnt += len(new)
        memo.update(zip(new, self.learn(new), strict=True))
        for t, parts in zip(batch, split, strict=True):
            found = [memo[s] for s in parts]
            if None in found:
                whole = self.learn([" " + t])[0] if len(parts) > 1 else None
                found = [whole] if whole else []
            yield found
        for s in new:
            if len(s) > MEMO_CHARS:
                del memo[s]

    def _keep(self, most: int) -> None:
        """Only the segments that came last are remembered."""
        self.memo = dict(islice(self.memo.items(), max(0, len(self.memo) - most), None))

    def rest(self) -> None:
        """After a task: where tasks learn little, what others left behind is hardly needed, and goes."""
        if self.learnt < KEPT < len(self.memo):
            self._keep(KEPT // 2)
            give_back()
        self.learnt = 0

    def forget(self) -> None:
        self.memo = {}


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def pairs(a: list[int], b: list[int], a_len: list[int], b_len: list[int]) -> Counter[tuple[int, int]]:
    """How often each A id overlaps each B id in a group, whose tokens have the given numbers of bytes."""
    out: Counter[tuple[int, int]] = Counter()
    i, j, rest_a, rest_b = 0, 0, a_len[0], b_len[0]
    while True:
        out[a[i], b[j]] += 1
        step = min(rest_a, rest_b)
        rest_a, rest_b = rest_a - step, rest_b - step
        i, j = i + (not rest_a), j + (not rest_b)
        if i == len(a) or j == len(b):
            return out
        rest_a, rest_b = rest_a or a_len[i], rest_b or b_len[j]


_SCHEMA = "chunk long, is_doc boolean, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers array<int>, counts array<int>, number int, key string, ids string, freq long, docs long"
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}
_FIELDS = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in _SCHEMA.split(", ")])


def _chunks(texts: list[str | None], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` characters (``CHUNK``, if not given), or of one text."""
    most = most or CHUNK
    start, size = 0, 0
    for n, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, n
            start, size = n, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def interned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of two kinds of rows: documents with the numbers of their groups, and each chunk's dictionary."""
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        remember("alignment", both.forget)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _chunks(texts):
                numbers, counts, hashes, number, within = [], [], [], {}, {}
                for found in both.texts(texts[start:stop]):
                    own: dict[int, int] = {}
                    for s, times in Counter(found).items():
                        if (places := within.get(s)) is None:
                            places = within[s] = [number.setdefault(g, len(number)) for g in s.split(b";")]
                        for x in places:
                            own[x] = own.get(x, 0) + times
                    numbers.append(np.fromiter(own.keys(), np.int32, len(own)))
                    counts.append(np.fromiter(own.values(), np.int32, len(own)))
                    hashes.append(hashlib.sha256(b";".join(found)).hexdigest() if found else "")
                groups = [g.decode() for g in number]
                n, m = stop - start, len(number)
                # ids of each group, occurrences of each document and of the chunk
                ids_a = np.fromiter((g.partition("|")[0].count(",") + 1 for g in groups), np.int64, m)
                ids_b = np.fromiter((g.partition("|")[2].count(",") + 1 for g in groups), np.int64, m)
                flat, times = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
                of = np.repeat(np.arange(n), [len(x) for x in numbers])
                n_a, n_b, total = (_added(of, times * x, n) for x in (ids_a[flat], ids_b[flat], 1))
                known = {"chunk": [chunk] * n, "is_doc": [True] * n, "id": ids.slice(start, n), "numbers": pa.array(numbers, _FIELDS.field("numbers").type), "counts": pa.array(counts, _FIELDS.field("counts").type)}
                # no two tokens of a group end together but the last, so a group of m and n ids has m + n - 1 links
                yield _batch(n, known | {"n_a": n_a, "n_b": n_b, "n_groups": total, "n_links": n_a + n_b - total, "groups_sha256": hashes})
                if m:
                    keys = [g if len(g) <= KEY else hashlib.sha256(g.encode()).hexdigest() for g in groups]
                    yield _batch(m, {"chunk": [chunk] * m, "is_doc": [False] * m, "number": np.arange(m, dtype=np.int32), "key": keys, "ids": [g if len(g) > KEY else None for g in groups], "freq": _added(flat, times, m), "docs": np.bincount(flat, minlength=m)})
                chunk += 1
        both.rest()

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(run, _SCHEMA), "groups")


def _batch(n: int, known: dict) -> pa.RecordBatch:
    columns = [known[f.name] if isinstance(known.get(f.name), pa.Array) else pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in _FIELDS]
    return pa.RecordBatch.from_arrays(columns, schema=_FIELDS)


def expanded(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The links of each distinct group of the corpus: ``key``, ``a``, ``b``, how often a group holds the link, and the group's ``freq`` and ``docs``."""
    distinct = groups.where("NOT is_doc").groupBy("key").agg(F.first("ids").alias("ids"), F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        schema = pa.schema([("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("freq", pa.int64()), ("docs", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                a, b = ([int(x) for x in side.split(",")] for side in (r["ids"] or r["key"]).split("|"))
                links = pairs(a, b, [len(both.a_bytes[x]) for x in a], [len(both.b_bytes[x]) for x in b])
                out += [(r["key"], x, y, n, r["freq"], r["docs"]) for (x, y), n in links.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return distinct.mapInArrow(run, "key string, a int, b int, n long, freq long, docs long")


def pair_counts(links: DataFrame, weight: str = "freq") -> DataFrame:
    """``count`` of each pair of ids over the corpus, and ``top``, the highest of its B id.

    ``weight`` is ``freq`` (each link counts) or ``docs`` (each link counts once for a document and distinct group).
    """
    counted = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col(weight)).alias("count"))
    return counted.join(counted.groupBy("b").agg(F.max("count").alias("top")), "b").select("a", "b", "count", "top")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: tokens, groups and links, those that are their B id's most common, and the sum of the links' counts."""
    groups = interned(df, a_path, b_path, id_col, text_col)
    links = written(expanded(groups, a_path, b_path), "links")
    counted = links.join(pair_counts(links), ["a", "b"])
    of_group = counted.groupBy("key").agg(F.sum(F.when(F.col("count") == F.col("top"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    known = groups.where("NOT is_doc").select("chunk", "number", "key").join(of_group, "key").select(F.col("chunk").alias("of_chunk"), "number", "n_best", "count_sum")
    docs = groups.where("is_doc").select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "counts")

    def gather(docs: pa.Table, known: pa.Table) -> pa.Table:
        """The documents of a chunk with the sums over their groups."""
        size = known.num_rows
        best, total = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        number = known["number"].to_numpy()
        best[number], total[number] = known["n_best"].to_numpy(), known["count_sum"].to_numpy()
        lengths = docs["numbers"].combine_chunks().value_lengths().to_numpy()
        flat = lambda c: docs[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(docs.num_rows), lengths)
        times, number = flat("counts").astype(np.int64), flat("numbers")
        sums = [pa.array(_added(of, times * each[number], docs.num_rows)) for each in (best, total)]
        return docs.drop_columns(["chunk", "numbers", "counts"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1])

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = docs.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(gather, schema)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

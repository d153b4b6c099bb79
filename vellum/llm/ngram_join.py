"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes.  Each
shingle flips one bit of a wide parity sketch, so the sketches of two sets
differ in at most as many places as the sets: their Hamming distance bounds the
symmetric difference from below.  Two sets that are similar enough differ in at
most D shingles, where D follows from the sizes, so of D + 1 pieces of the
sketch one is equal at least.  Pieces are wide and nearly empty and are kept as
the XOR of 64-bit hashes of their set bits.  Sizes are dealt to bands; a band
sets D and the number of pieces, and a set that may be similar to one of the
next band stands in both.

Pieces with few shingles would be shared by chance.  So there are D + 1 + E
pieces and a set leaves out its E weakest: equal pieces have equal strength, at
least E + 1 are equal, hence the strongest of these is left out by neither.  No
link is lost.

Equal sets are one node, named by a hash of the set, before anything is joined.
In each group of equal pieces all nodes are compared with the least and the
greatest one, which are random members; the true links among these are joined
to components.  Groups that still hold more than one component are searched in
full.  Of those with few nodes, pairs whose sizes and folded sketches allow a
link are verified, each once.  Greater ones are searched in blocks that hold the
sets: a pair is passed over once its components are one, so a block puts out a
spanning forest and never its pairs.  No link between components is missed.
``link_pairs`` searches in the same way to list every link.

A null text, or one without words, has no shingles and no links; a text with
fewer words than a shingle is one shingle.  Rows that share an id are nodes of
their own, where their sets differ, and count as linked.  Rows with a null id
are kept, each by itself, with a null component.  Ids are never floats, so all
64-bit ids come back as they are.  An empty table gives an empty one; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from vellum.llm.common import discard, remember, small_batches, texts, written
from vellum.llm.components import components

#: Words in a shingle, and the least similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Width of a band of sizes; extra pieces, as a share.
RATIO, EXTRA = 1.6, 0.25
#: Groups of up to so many nodes are searched by pairs, greater ones in blocks.
FEW = 32
#: Nodes, and shingles, that a block of a searched group holds at most (but for a single greater set).
BLOCK, SHINGLES = 4096, 2_000_000
#: Candidates of one node whose sets are compared together.
CHUNK = 64
#: Words that a worker remembers.
MEMO = 500_000


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ h >> np.uint64(29)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words ``[^\\x20\\x09-\\x0D]+``, A-Z in small letters."""
    parts = text.encode().lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_hashes) > MEMO:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, n)
    width = min(words, n)
    with np.errstate(over="ignore"):
        s = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            s = s * np.uint64(0x5851F42D4C957F2D) + h[j : n - width + 1 + j]
    return np.unique(_mixed(s, 1))


def most_different(top: int, num: int, den: int) -> int:
    """How many shingles may differ between similar sets of at most ``top`` shingles."""
    return 2 * top * (den - num) // (den + num)


@lru_cache(maxsize=8)
def band_starts(num: int, den: int) -> np.ndarray:
    """The least size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * max(RATIO, 1.1 * den / num))))
    return np.array(out, np.int64)


def bands_of(n: int, num: int, den: int) -> list[int]:
    """A size's own band, and those above it that hold sizes which may be similar."""
    starts = band_starts(num, den)
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = [own]
    while num * int(starts[out[-1] + 1]) <= den * n:
        out.append(out[-1] + 1)
    return out


def piece_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the pieces of a set, over its bands."""
    out, starts = [], band_starts(num, den)
    for band in bands_of(len(s), num, den):
        need = most_different(int(starts[band + 1]) - 1, num, den) + 1
        pieces = need + (int(EXTRA * need) + 1 if need > 1 else 0)
        h = _mixed(s, band + 100)
        at = (h >> np.uint64(20)) % np.uint64(pieces)
        order = np.argsort(at.astype(np.uint16 if pieces < 65536 else np.uint32), kind="stable")
        at = at[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        value = np.zeros(pieces, np.uint64)
        value[at[first]] = np.bitwise_xor.reduceat(_mixed(s, 2)[order], first)
        if pieces > need:
            strength = np.bincount(at, minlength=pieces) * pieces + np.arange(pieces)
            kept = np.argpartition(strength, pieces - need)[pieces - need :]
        else:
            kept = np.arange(pieces)
        with np.errstate(over="ignore"):
            place = (kept.astype(np.uint64) << np.uint64(8)) + np.uint64(band)
        out.append(_mixed(value[kept] ^ _mixed(place, 3), 4))
    return np.concatenate(out).astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """A dense parity sketch: a power of two of bits, about one for each shingle, 64 at least."""
    bits = max(64, 1 << max(0, int(len(s)) - 1).bit_length())
    flips = np.bincount((_mixed(s, 5) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded_distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches; the longer one is folded by XOR to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), 0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, h, n, node, keys, sketch) of docs (id, h, text): node is a hash of the set, null for an empty one."""

    @F.pandas_udf("n long, node long, keys array<long>, sketch binary")
    def facts(batch: pd.Series) -> pd.DataFrame:
        remember("shingles", _hashes.clear)
        out = []
        for t in texts(batch):
            s = shingles(t, words)
            if len(s):
                with np.errstate(over="ignore"):
                    node = _mixed(np.array([np.bitwise_xor.reduce(_mixed(s, 6)) + _mixed(s, 7).sum(dtype=np.uint64) * np.uint64(3) + np.uint64(len(s))]), 8)
                out.append((len(s), int(node.astype(np.int64)[0]), piece_keys(s, num, den), sketch(s)))
            else:
                out.append((0, None, [], b""))
        return pd.DataFrame(out, columns=["n", "node", "keys", "sketch"]).astype({"node": "Int64"})

    return docs.select("id", "h", facts("text").alias("s")).select("id", "h", "s.*")


def _near(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and folded sketches allow a link."""

    @F.pandas_udf(BooleanType())
    def allowed(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([folded_distance(p, q) <= (i + j) * (den - num) // (den + num) for i, j, p, q in zip(n, m, x, y, strict=True)], dtype=bool)

    x = facts.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ax"))
    y = facts.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bx"))
    sized = pairs.join(x, "a").join(y, "b").where(F.least("an", "bn") * den >= F.greatest("an", "bn") * num)
    return sized.where(allowed("an", "bn", "ax", "bx")).select("a", "b")


def _verified(pairs: DataFrame, held: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts, in ``held`` by node, are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        remember("shingles", _hashes.clear)

        def set_of(node: int, text: str) -> np.ndarray:
            s = memo.get(node)
            if s is None:
                s = memo[node] = shingles(text or "", words)
            return s

        for batch in batches:
            good = []
            for a, b, ta, tb in zip(*(batch[c] for c in ("a", "b", "ta", "tb")), strict=True):
                if len(memo) > 200:
                    memo.clear()
                good.append(similar(set_of(a, ta), set_of(b, tb), num, den))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    joined = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return written(joined.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), "links")


def _shared(index: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another row has, too.  Counts are combined in the tasks, and a hot key's rows can be split."""
    often = written(index.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "keys")
    out = written(index.join(often, "key"), "shared")
    discard(often)
    return out


class _Block:
    """Nodes of two blocks (or one) of a group: sizes, folded sketches and sets, compared without a pair ever leaving."""

    def __init__(self, rows: dict[str, np.ndarray], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.node, self.label, self.size = rows["node"], rows["component"].copy(), rows["n"]
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        low, high = rows["low"][0], rows["high"][0]
        self.one = bool(low == high)
        self.first = np.flatnonzero(rows["block"] == low)
        self.second = self.first if self.one else np.flatnonzero(rows["block"] == high)
        width = min(map(len, rows["sketch"]))
        self.folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), 0) for x in rows["sketch"]]).view(np.uint64)

    def candidates(self, i: int, apart: bool) -> np.ndarray:
        """Nodes that sizes and sketches allow to be like node i, nearest first; ``apart``: of other components."""
        m, n = self.second, self.size
        fits = m[(np.minimum(n[m], n[i]) * self.den >= np.maximum(n[m], n[i]) * self.num) & ((m > i) if self.one else True) & (self.node[m] != self.node[i])]
        if apart:
            fits = fits[self.label[fits] != self.label[i]]
        away = np.bitwise_count(self.folded[fits] ^ self.folded[i]).sum(1, dtype=np.int64)
        good = away <= (n[fits] + n[i]) * (self.den - self.num) // (self.den + self.num)
        return fits[good][np.argsort(away[good], kind="stable")]

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others' sets are similar to that of node i."""
        own, sets = self.sets[i], [self.sets[j] for j in others]
        every = np.concatenate(sets)
        at = np.searchsorted(own, every)
        at[at == len(own)] = 0
        both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))
        return self.den * both >= self.num * (self.size[i] + self.size[others] - both)

    def forest(self) -> list[tuple[int, int]]:
        """Links that join components, as few as join all that any link joins."""
        out = []
        for i in self.first.tolist():
            left = self.candidates(i, True)
            while len(left):
                chunk, left = left[:CHUNK], left[CHUNK:]
                for j in chunk[self.like(i, chunk)].tolist():
                    a, b = self.label[i], self.label[j]
                    if a != b:
                        out.append((int(a), int(b)))
                        self.label[self.label == b] = a
                left = left[self.label[left] != self.label[i]]
        return out

    def links(self) -> list[tuple[int, int]]:
        """Every link, the lesser node first."""
        out = []
        for i in self.first.tolist():
            left = self.candidates(i, False)
            for x in range(0, len(left), CHUNK):
                chunk = left[x : x + CHUNK]
                out += [(int(min(self.node[i], b)), int(max(self.node[i], b))) for b in self.node[chunk[self.like(i, chunk)]]]
        return out


def _searched(groups: DataFrame, tested: DataFrame | None, facts: DataFrame, held: DataFrame, words: int, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b) of groups (key, node, component): links between components, or every link, but for pairs that were tested.

    Groups of the same nodes are searched once.  A great group is dealt to blocks by its number of nodes and of
    shingles, and each two blocks meet in one place.
    """
    sized = groups.join(facts.select("node", "n"), "node")
    facts_of = sized.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    facts_of = facts_of.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / SHINGLES))
    kept = written(facts_of.select("key", "size", blocks.alias("blocks")), "groups")
    rows = sized.join(kept, "key")

    few = rows.where(F.col("size") <= FEW)
    x, y = (few.select("key", *[F.col(c).alias(side + c) for c in ("node", "component", "n")]) for side in "xy")
    fits = (F.col("xnode") < F.col("ynode")) & (F.least("xn", "yn") * den >= F.greatest("xn", "yn") * num)
    if forest:
        fits = fits & (F.col("xcomponent") != F.col("ycomponent"))
    pairs = x.join(y, "key").where(fits).select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    near = _verified(_near(pairs, facts, num, den), held, words, num, den)

    many = rows.where(F.col("size") > FEW)

    @F.pandas_udf("binary")
    def hashes(batch: pd.Series) -> pd.Series:
        remember("shingles", _hashes.clear)
        return pd.Series([shingles(t, words).tobytes() for t in texts(batch)])

    wanted = many.select("node").distinct()
    sets = held.join(wanted, "node", "left_semi").select("node", hashes("text").alias("hashes")).join(facts.select("node", "sketch"), "node")
    sets = written(sets, "hashes")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    dealt = many.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).join(sets, "node")
    names = ["key", "low", "high", "block", "node", "component", "n", "sketch", "hashes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_rows: list[dict[str, np.ndarray]] = []  # of the group that may go on in the next batch

        def found(parts: list[dict[str, np.ndarray]]) -> list[tuple[int, int]]:
            rows = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in names}
            if len(rows["node"]) < 2:
                return []
            b = _Block(rows, num, den)
            return b.forest() if forest else b.links()

        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch[c].to_numpy() for c in names}
            place = np.stack([columns[c] for c in ("key", "low", "high")], 1)
            cuts = (np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist()
            if kept_rows and any(kept_rows[-1][c][-1] != columns[c][0] for c in ("key", "low", "high")):
                cuts = [0, *cuts]
            out, start = [], 0
            for cut in cuts:
                out += found([*kept_rows, *([{c: v[start:cut] for c, v in columns.items()}] if cut > start else [])])
                kept_rows, start = [], cut
            kept_rows.append({c: v[start:] for c, v in columns.items()})
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if kept_rows:
            yield pd.DataFrame(found(kept_rows), columns=["a", "b"], dtype="int64")

    placed = dealt.select(names).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    far = placed.mapInPandas(run, "a long, b long")
    out = written(near.unionByName(far).distinct(), "found")
    discard(kept, sets, near)
    return out


def _prepared(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, ...]:
    """Written tables: rows (id, n, node), shared (key, node), facts (node, n, sketch) and texts (node, text) of nodes with a shared key."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sets = written(_sets(docs, words, num, den), "sets")
    rows = written(sets.select("id", "n", "node"), "rows")
    full = sets.where("n > 0 AND id IS NOT NULL")
    # one row stands for a node
    chosen = full.groupBy("node").agg(F.min(F.struct("id", "h")).alias("one")).select("node", "one.*")
    single = written(full.join(chosen, ["node", "id", "h"], "left_semi"), "nodes")
    discard(sets)
    shared = _shared(single.select("node", F.explode("keys").alias("key")).select("key", "node"))
    facts = single.select("node", "id", "h", "n", "sketch").join(shared.select("node").distinct(), "node", "left_semi")
    facts = written(facts.dropDuplicates(["node"]), "facts")
    discard(single)
    # texts that may have to be verified, moved once; sorted, whatever the sizes, so that the plan is the same at every size
    held = docs.join(facts.select("node", "id", "h").hint("merge"), ["id", "h"]).dropDuplicates(["id", "h"])
    return rows, shared, facts, written(held.select("node", "text"), "texts")


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the least id that links reach) for every row."""
    rows, shared, facts, held = _prepared(df, id_col, text_col, words, num, den)
    hubs = shared.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = shared.join(hubs, "key").select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    pairs = written(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    links = _verified(_near(pairs, facts, num, den), held, words, num, den)
    found = components(links)

    # groups that hold nodes of several components still are searched in full
    placed = written(shared.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    is_open = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    is_open = written(is_open, "open")
    more = _searched(placed.join(is_open, "key").distinct(), pairs, facts, held, words, num, den, True)
    # rows of one id are linked, whatever their sets
    named = rows.where("n > 0 AND id IS NOT NULL")
    clash = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    ties = written(named.join(clash, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "ties")
    if not (more.isEmpty() and ties.isEmpty()):
        discard(found)
        found = components(links.unionByName(more).unionByName(ties))
    discard(shared, pairs, facts, held, links, placed, is_open, more, ties)

    nodes = named.groupBy("node").agg(F.min("id").alias("least")).join(found.withColumnRenamed("id", "node"), "node", "left")
    nodes = nodes.select("node", "least", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    names = written(nodes.join(least, "component").select("node", "component_id"), "names")
    discard(found)
    linked = named.join(names, "node").select("id", "n", "component_id")
    alone = rows.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def link_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who has which set.

    The pairs are (a, b) of class ids with a < b; members are ``id_col``, ``n_shingles`` and ``class_id``, the
    least id with the same set.  Members of a class are linked with each other; copies aren't expanded into pairs.
    The pairs grow with the links themselves, so with the square of a group of differing near copies.
    """
    rows, shared, facts, held = _prepared(df, id_col, text_col, words, num, den)
    found = _searched(shared.withColumn("component", F.col("node")).distinct(), None, facts, held, words, num, den, False)
    named = rows.where("n > 0 AND id IS NOT NULL")
    ids = written(named.groupBy("node").agg(F.min("id").alias("class_id")), "classes")
    discard(shared, facts, held)
    a, b = (ids.select(F.col("node").alias(x), F.col("class_id").alias(f"{x}_id")) for x in "ab")
    pairs = found.join(a, "a").join(b, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    members = named.join(ids, "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id")
    return pairs, members

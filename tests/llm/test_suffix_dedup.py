"""Repeated strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from vellum.llm import suffix_dedup as S
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """{id: (bytes, removed, runs, digest)}"""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[x : x + 200] for _, r in raws for x in range(len(r) - 199))
    out = {}
    for i, r in raws:
        gone = bytearray(len(r))
        for x in range(len(r) - 199):
            if seen[r[x : x + 200]] > 1:
                gone[x : x + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())
    return out


def got_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_small_documents(spark):
    docs = table(spark, SMALL, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(w[1] for w in want.values())
    assert got_of(S.repeated_digest(docs)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    assert got_of(S.repeated_digest(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.repeated_digest(no_docs).count() == 0


def planted(rng, groups):
    make = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passages = [make(n) for n in (150, 199, 200, 201, 260, 900)]
    rows = []
    for _ in range(groups):
        text = make(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2) if rng.random() < 0.5 else 0
            text += p[a:] + make(rng.randint(0, 300))
        rows.append((len(rows), text))
    near = list(make(3000))
    for _ in range(6):
        for _ in range(4):
            near[rng.randrange(len(near))] = rng.choice("xyz")
        rows.append((len(rows), "".join(near)))
    rows += [(len(rows), rows[0][1] * 2), (len(rows) + 1, "ab" * 300), (len(rows) + 2, "word " * 100)]
    return rows


def test_planted_passages(spark):
    rows = planted(random.Random(4), 40)
    assert got_of(S.repeated_digest(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_shards_are_split_and_long_texts_parted(spark, monkeypatch):
    for name, value in (("MANY", 3), ("BLOCK", 50), ("PART", 700)):
        monkeypatch.setattr(S, name, value)
    S._powers.cache_clear()
    rows = planted(random.Random(5), 60)
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(S)  # so that tasks see the small parameters
    try:
        assert got_of(S.repeated_digest(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(S)
        S._powers.cache_clear()


def test_no_sorted_shard_is_larger_than_its_bound(spark, monkeypatch):
    """A passage shorter than a window in every document: its edges give a different piece for each document."""
    monkeypatch.setattr(S, "MANY", 20)
    rng, sizes, sort = random.Random(8), [], S._sorted_shards
    make = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    short, long = make(170), make(420)
    rows = [(i, make(rng.randint(150, 300)) + (short if i % 2 else long) + make(rng.randint(150, 300))) for i in range(160)]

    def measured(members):
        sizes.append(max((r["count"] for r in members.groupBy("key").count().collect()), default=0))
        return sort(members)

    monkeypatch.setattr(S, "_sorted_shards", measured)
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(S)
    try:
        assert got_of(S.repeated_digest(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(S)
    assert 1 < sizes[0] <= 20


def test_stretches_cover_every_window_once():
    rng = random.Random(6)
    raw = bytes(rng.choices(b"abc ", k=5000)) + b"z" * 500
    starts = []
    for p in S.stretches(raw)[2].tolist():
        starts += range((p >> 16) - (p >> 8 & 255), (p >> 16) - (p & 255) + 1)
    assert starts == list(range(len(raw) - 199))


def test_induced_order_finds_exactly_the_equal_windows():
    rng = random.Random(7)
    core = bytes(rng.choices(b"ab", k=32))
    keys, data, first, last = [], [], [], []
    for k in range(60):
        f = rng.randint(0, 168)
        la = rng.randint(0, f)
        left, right = bytes(rng.choices(b"ab", k=f)), bytes(rng.choices(b"ab", k=200 - la - 32))
        if k % 2 and data:
            left, right = (b"ab" * 100)[:f], (b"ba" * 100)[: 200 - la - 32]
        keys.append(k % 3)
        data.append(left[::-1] + core + right)
        first.append(f)
        last.append(la)
    found = S.induce(keys, data, np.array(first), np.array(last))
    seen = Counter((keys[i], o, data[i][first[i] - o : first[i] - o + 200]) for i in range(60) for o in range(last[i], first[i] + 1))
    for i in range(60):
        for o in range(found.shape[1]):
            real = last[i] <= o <= first[i] and seen[keys[i], o, data[i][first[i] - o : first[i] - o + 200]] > 1
            assert found[i, o] == real


def test_null_shared_and_great_ids(spark):
    """Rows of one id and different texts, null ids with equal texts, ids above 2**53, and a text that is one passage over and over."""
    rng, great = random.Random(11), 1 << 60
    a, b = ("".join(rng.choices("abcdefg ", k=900)) for _ in "ab")
    own = ["".join(rng.choices("hijkl", k=150)) for _ in range(9)]
    line = "".join(rng.choices("mnop", k=230)) + "\n"
    texts = [a, b, own[0] + a[100:400], own[1] + b[:250] + own[2], own[3], own[3], None, "", line * 40, own[4] + line * 3, own[5] + own[6]]
    ids = [5, 5, None, None, None, None, great + 1, great + 7, great + 9, None, great + 11]
    docs = spark.createDataFrame(list(zip(ids, texts, range(11), strict=True)), "doc_id long, text string, _id long")
    want = brute(list(enumerate(texts)))
    got = S.repeated_digest(docs).collect()
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))
    assert rows == sorted((ids[k] is None, ids[k] or 0, *w) for k, w in want.items())
    assert {r.doc_id: r.n_removed for r in got}[great + 9] == 40 * 231


def test_memos_of_other_operators_go():
    from vellum.llm import common

    gone = []
    common.remember("shingles", lambda: gone.append("shingles"))
    common.remember("suffixes")
    common.remember("suffixes")
    assert gone == ["shingles"] and list(common._REMEMBERS) == ["suffixes"]

"""The parity-sketch join against brute force."""

import random

import numpy as np
import pytest

from vellum.llm import ngram_join as J
from vellum.llm.common import table
from vellum.llm.components import components

SMALL = "/root/testdata/sf0.001"


def brute(rows, words, num, den, pairs=None):
    """{id: (set size, component)} by comparing all pairs; linked ids are added to ``pairs``."""
    sets = {}
    for i, t in rows:
        parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        parts = [p for p in __import__("re").split("[\x20\x09-\x0d]+", parts) if p]
        sets[i] = {tuple(parts[k : k + words]) for k in range(len(parts) - words + 1)} if len(parts) >= words else {tuple(parts)} if parts else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                if pairs is not None:
                    pairs.add((i, j))
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def got_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100)])
def test_small_documents(spark, words, num, den):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got_of(J.link_components(docs, words=words, num=num, den=den)) == brute(rows, words, num, den)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got_of(J.link_components(odd_docs)) == brute(rows, 5, 80, 100)
    assert J.link_components(no_docs).count() == 0


def edited(rng, words, rate):
    return [rng.choice(words) + str(rng.randint(0, 99)) if rng.random() < rate else w for w in words]


def test_planted_groups_near_the_threshold(spark):
    rng, rows = random.Random(8), []
    for g in range(12):
        base = ["".join(rng.choices("abcdef", k=4)) for _ in range(rng.choice([3, 8, 20, 60, 200, 500]))]
        for _ in range(12):
            rows.append((len(rows) * 3, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04])))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80, 100)
    assert len({c for _, c in want.values()}) < len(rows)
    assert got_of(J.link_components(docs)) == want


def test_chain_and_large_group(spark, monkeypatch):
    """A chain whose ends aren't alike, and a group in which few are like the first one; small blocks."""
    monkeypatch.setattr(J, "FEW", 4)
    monkeypatch.setattr(J, "BLOCK", 20)
    monkeypatch.setattr(J, "CHUNK", 7)
    rng, rows = random.Random(9), []
    chain = [f"w{i}" for i in range(100)]
    for k in range(40):
        rows.append((k, " ".join(chain)))
        at = rng.randrange(len(chain))
        chain[at] = f"c{k}"
    base = [f"b{i}" for i in range(120)]
    for k in range(150):
        rows.append((1000 + k, " ".join(edited(rng, base, 0.03))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(J.link_components(docs)) == brute(rows, 5, 80, 100)


def test_similar_sets_share_a_piece():
    rng = np.random.default_rng(1)
    for num, den in ((80, 100), (85, 100)):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = np.concatenate((a[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)))
            a, b = np.unique(a), np.unique(b)
            if J.similar(a, b, num, den):
                assert set(J.piece_keys(a, num, den)) & set(J.piece_keys(b, num, den))
                assert J.folded_distance(J.sketch(a), J.sketch(b)) <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) * (den - num) // (den + num)


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_every_link_of_different_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "FEW", 4)
    monkeypatch.setattr(J, "BLOCK", 20)
    rng, base = random.Random(12), [f"b{i}" for i in range(90)]
    rows = [(3 * k, " ".join(edited(rng, base, 0.02))) for k in range(80)] + [(1000, "no words like these at all"), (1001, None)]
    rows += [(2000 + k, rows[k][1]) for k in range(10)]
    want: set = set()
    sizes = brute(rows, 5, 80, 100, want)
    pairs, members = J.link_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = {r.doc_id: r.class_id for r in members.collect()}
    assert {i: (sizes[i][0]) for i in classes} == {r.doc_id: r.n_shingles for r in members.collect()} and 1001 not in classes
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {tuple(sorted((classes[a], classes[b]))) for a, b in want if classes[a] != classes[b]}
    assert pairs.count() == len(got) > 100


def test_shared_null_and_great_ids(spark):
    """Rows of one id hold different texts, ids are above 2**53, and null ids stand beside them."""
    a, b = ("".join(f"{c}{i} " for i in range(30)) for c in "ab")
    great = 1 << 60
    rows = [(5, a), (5, b), (7, a + "x"), (9, b + "y"), (great + 1, "c d e f g h"), (None, "c d e f g h"), (great + 7, "c d e f g h"), (None, a), (great + 9, None), (-3, "z"), (-3, "z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(False, 5, 26, 5), (False, 5, 26, 5), (False, 7, 27, 5), (False, 9, 27, 5), (False, great + 1, 2, great + 1), (False, great + 7, 2, great + 1), (False, great + 9, 0, great + 9), (False, -3, 1, -3), (False, -3, 1, -3), (True, 0, 2, None), (True, 0, 26, None)])


def test_a_hot_group_of_near_copies_puts_out_a_forest(spark):
    """Hundreds of differing near copies: what the search of open groups puts out doesn't grow with its pairs."""
    rng, base = random.Random(13), [f"b{i}" for i in range(100)]
    rows = [(k, " ".join(edited(rng, base, 0.025))) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, searched = [], J._searched

    def measured(*args):
        out = searched(*args)
        sizes.append(out.count())
        return out

    J._searched = measured
    try:
        assert got_of(J.link_components(docs)) == brute(rows, 5, 80, 100)
    finally:
        J._searched = searched
    assert sizes[0] <= 5 * 700 < 700 * 699 / 2 / 10

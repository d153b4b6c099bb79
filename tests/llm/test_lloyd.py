"""Plain Lloyd against a version in Python's integers, and its odd rows."""

import hashlib
import math
import random

from vellum.llm import lloyd
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**50 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((apart(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    of = {n: sum(d for _, m, d in found if m == n) for n in range(len(cents))}
    fits = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    some = any(fits(d) is None for *_, d in found)
    gone = {n for _, n, d in found if fits(d) is None}
    return sorted(((i, n, fits(d), None if n in gone else fits(of[n]), None if some else fits(sum(of.values())), sha[n]) for i, n, d in found), key=str)


def got(df):
    return sorted((tuple(r) for r in lloyd.clusters(df).collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, id int, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def test_given_table(spark):
    df = table(spark, SMALL, "embeddings")
    assert got(df.repartition(5)) == plain([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    same = vec()
    rows = [(i, vec()) for i in range(60)] + [((1 << 62) + i, same) for i in range(200)] + [(7, vec()), (7, same), (None, vec()), (None, same)]
    rows += [(900, None), (901, []), (902, vec()[:63]), (903, [*vec(), 0.0]), (904, [None, *vec()[1:]]), (905, [math.nan, *vec()[1:]]), (906, [math.inf, *vec()[1:]])]
    assert got(frame(spark, rows).repartition(3)) == plain(rows)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert got(frame(spark, rows)) == plain(rows)
    assert len({r[1] for r in plain(rows)}) == 2


def test_few_and_no_rows(spark):
    rows = [(3, [0.5] * 64), (4, [-0.25] * 64)]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, [])) == [] and got(frame(spark, [(1, [1.0])])) == []


def test_great_components(spark):
    rows = [(i, [x * (1 + i)] * 64) for i, x in enumerate([1e30, -1e30, 3e38, 0.1, 5e5, -7e5, 1e12, 2.5, 1e300, 77.7])]
    assert got(frame(spark, rows)) == plain(rows)


def test_digits():
    for n in (0, 1, -1, 1 << 40, -(1 << 40), (1 << 40) - 1, 3**200, -(3**200)):
        assert sum(d << 40 * i for i, d in enumerate(lloyd.digits(n))) == n and all(abs(d) <= 1 << 40 for d in lloyd.digits(n))

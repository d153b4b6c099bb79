"""Plain Lloyd over integer vectors.

A vector is kept if it has exactly ``dims`` components, none null or non-finite; each component x becomes the integer
floor(1024 * x).  The first centroids are the kept vectors of least hash, in hash order.  Each round broadcasts the
centroids (``k`` x ``dims`` integers), and ``mapInPandas`` computes integer squared differences to each centroid in NumPy,
takes the lowest index of the least, and puts out the integer sums and counts of its partition, at most one row for each
centroid and component; a groupBy adds those up.  So a round moves a few hundred rows for each partition, whatever a cluster's size, and
only sums of clusters reach the driver.  Nothing is kept between rounds but the centroids: a lost task reads its part of the table again.

All arithmetic is exact: a batch with components beyond 2**26 is computed with Python's integers, and sums are split into digits
of base 2**40, so that no total overflows.  A squared distance or an inertia beyond a 64-bit integer is null.

Ties go to the smaller cluster; equal hashes (rows that share an id) are ordered by their vectors; a null id hashes last.  Fewer kept
vectors than ``k`` give as many centroids; none gives an empty result.  Rows with a null vector, another number of components or a
null, NaN or infinite one are left out; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components up to this are computed in 64-bit integers: (2 * 2**26)**2 * 64 fits.
_SMALL = 1 << 26
#: Sums are moved as digits of this base.
_DIGIT = 40
_LONG = (1 << 63) - 1


def _floor(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def integers(vectors: pd.Series, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch are kept, and their integer components: 64-bit ones if they are small, else Python's."""
    kept = np.array([v is not None and len(v) == dims for v in vectors], bool)
    if not kept.any():
        return kept, np.zeros((0, dims), np.int64)
    # a null component is a NaN here
    x = np.array([np.asarray(v, np.float64) for v, k in zip(vectors, kept, strict=True) if k]).reshape(-1, dims)
    whole = np.isfinite(x).all(axis=1)
    kept[np.flatnonzero(kept)[~whole]] = False
    x = x[whole]
    if not len(x) or np.abs(x).max() < _SMALL // scale:
        return kept, np.floor(x * scale).astype(np.int64)
    return kept, np.array([[_floor(c, scale) for c in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lowest index of the nearest centroid of each vector, and its squared distance."""
    if x.dtype != object and all(abs(c) <= _SMALL for row in centroids for c in row):
        c = np.array(centroids, np.int64)
    else:
        x, c = x.astype(object), np.array(centroids, object)
    apart = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    which = apart.argmin(axis=1)
    return which, apart[np.arange(len(x)), which]


def digits(total: int) -> list[int]:
    """A total as digits of base 2**40, the lowest first; the last one carries the sign."""
    out = []
    while not -(1 << _DIGIT) < total < 1 << _DIGIT:
        out.append(total & (1 << _DIGIT) - 1)
        total >>= _DIGIT
    return [*out, total]


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Ids as text, as pandas would make floats of them where one is null."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))


def _first(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The kept vectors of least hash: each partition puts out its ``k`` least, the driver gets ``k`` rows."""

    def least(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            kept, x = integers(b["vector"], dims, scale)
            ids = b["id"].to_numpy()[kept]
            held += [(h := None if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), h is None, v) for i, v in zip(ids, x.tolist(), strict=True)]
            held = sorted(held, key=lambda h: (h[1], h[0] or "", h[2]))[:k]
        yield pd.DataFrame({"hash": [h[0] for h in held], "vector": [" ".join(map(str, h[2])) for h in held]}, dtype=object)

    found = rows.mapInPandas(least, "hash string, vector string").select("hash", F.split("vector", " ").alias("vector"))
    ordered = found.orderBy(F.col("hash").asc_nulls_last(), F.col("vector").cast("array<double>"), "vector").limit(k)
    return [[int(c) for c in r.vector] for r in ordered.collect()]


def _round(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """The centroids after one round."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(held.value)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            _, x = integers(b["vector"], dims, scale)
            if len(x):
                which, _ = nearest(x, held.value)
                for c in np.unique(which).tolist():
                    total[c] += x[which == c].sum(axis=0).astype(object)
                count += np.bincount(which, minlength=k)
        out = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        out += [(c, d, n, v) for c in range(k) if count[c] for d in range(dims) for n, v in enumerate(digits(int(total[c, d])))]
        yield pd.DataFrame(out, columns=["cluster", "dim", "digit", "total"], dtype=np.int64)

    merged = rows.mapInPandas(sums, "cluster int, dim int, digit int, total long").groupBy("cluster", "dim", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got: dict[tuple[int, int], int] = {}
    for r in merged.collect():
        got[r.cluster, r.dim] = got.get((r.cluster, r.dim), 0) + (int(r.total) << _DIGIT * r.digit)
    held.unpersist()
    return [[got[c, d] // got[c, -1] for d in range(dims)] if (c, -1) in got else row for c, row in enumerate(centroids)]


def fit(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    rows = _rows(df, id_col, vec_col)
    centroids = _first(rows, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        after = _round(rows, centroids, dims, scale)
        if after == centroids:  # no further round changes anything
            break
        centroids = after
    return centroids


def assign(df: DataFrame, centroids: list[list[int]], dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The id of each kept vector, its ``cluster`` and squared ``distance`` (null beyond a long)."""
    rows = _rows(df, id_col, vec_col)
    held = df.sparkSession.sparkContext.broadcast(centroids)

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept, x = integers(b["vector"], dims, scale)
            which, apart = nearest(x, held.value) if len(x) and held.value else (np.zeros(0, int), np.zeros(0, int))
            yield pd.DataFrame({"id": b["id"].to_numpy()[kept][: len(which)], "cluster": which, "distance": pd.array([int(a) if a <= _LONG else None for a in apart], "Int64")})

    return rows.mapInPandas(each, "id string, cluster int, distance long").select(F.col("id").cast("long").alias(id_col), "cluster", "distance")


def clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each kept vector with its cluster, distance, the inertia of its cluster and of all, and the hash of its centroid."""
    spark = df.sparkSession
    centroids = fit(df, k, rounds, seed, dims, scale, id_col, vec_col)
    placed = assign(df, centroids, dims, scale, id_col, vec_col)
    # a null distance makes its inertia null: it isn't known
    inertia = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    of = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(inertia.alias("inertia")).collect()}
    fits = lambda n: None if n is None or n > _LONG else int(n)
    whole = None if None in of.values() else sum(map(int, of.values()))
    facts = [(c, fits(of[c]), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(of)]
    # one row for each of k clusters
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The rows of the query in SQL: components as rows, one assignment and one update for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INT) AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c.c, CAST({apart} AS BIGINT) AS d FROM kept k, c{n} c) GROUP BY r)")
        if n < rounds:
            # floor of a sum over a count, for sums of either sign
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts = f"SELECT a.c, i, sum(k.v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} a JOIN kept k USING (r), generate_series(1, {dims}) AS g(i) GROUP BY a.c, i"
            steps.append(f"m{n} AS MATERIALIZED (SELECT c, list({floor} ORDER BY i) AS v FROM ({parts}) GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (c))")
    last = f"""SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} c ON c.c = a.c"""
    return "WITH " + ",\n".join(steps) + "\n" + last


#: The rows of the query, for vectors whose distances fit a long.
SQL = _sql()

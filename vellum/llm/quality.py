"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by minimising
the non-negative unbiased risk estimate (Kiryo et al., 2017).  The class prior
is estimated from held-back halves: the least ratio of unlabelled to positive
mass above a threshold bounds the share of positives among unlabelled text.
Labelled rows of both classes in the training folds then set the scale of the
scores (Platt scaling), so that they are probabilities.

Features are shares of neighbouring character classes, repetition of words and
lines, word shapes and compressibility; all come from the text alone.  Labelled
rows are a bounded sample (``LABELLED`` of each label, by a hash of the id).
Unlabelled text counts as a whole: its rows are added up in cells (rows on the
same sides of ten random planes), which stand for them in the risk with their numbers, means and
spreads are those of all rows, and the prior comes from a histogram of all
scores.  Every text is scored.

A null text is an empty one, and is scored like one.  Rows with the same text
have the same score; a table without positives gives every text the score 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, remember, small_batches, texts, written

#: Labelled rows of each label that the fit may use at most.
LABELLED = 8_000
#: Rows without a label are summed up in cells, two to the power of this many for each half of them, and their scores in this many bins.
PLANES, BINS = 10, 2048
HIDDEN, ROUNDS, BATCH, RATE, SEED = 16, 60, 128, 0.01, 20
#: Fits whose mean is the model.
FITS = 5
THRESHOLD = 0.3

#: Character classes of bytes: small and capital letters, digits, spaces, line ends, stops, commas, calls, quotes, signs, bars, beyond ASCII.
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "\"'()[]-")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[ord("|"), ord("<"), ord(">"), ord("=")]] = 10
_CLASS[128:] = 11
_KINDS = 12
N_FEATURES = _KINDS * _KINDS + 12


def features(text: str) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    raw = text.encode()
    n = len(raw)
    if n < 2:
        return out
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kinds[:-1] * np.uint8(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS)
    out[: _KINDS * _KINDS] = np.sqrt(pairs / (n - 1))
    words, lines = text.split(), text.split("\n")
    w = len(words)
    k = _KINDS * _KINDS
    if w:
        lengths = np.fromiter(map(len, words), np.int64, w)
        same = sum(map(str.__eq__, words, words[1:]))
        marks = sum(not x.isalnum() for x in words)
        out[k : k + 8] = (
            np.sqrt(same / w), np.sqrt(len(set(words)) / w), lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100,
            np.sqrt(sum(map(str.isupper, words)) / w), np.sqrt(sum(map(str.istitle, words)) / w), np.sqrt(marks / w),
        )
    out[k + 8 : k + 12] = len(zlib.compress(raw, 1)) / n, 1 - len(set(lines)) / len(lines), np.log1p(n) / 10, np.log1p(n / len(lines)) / 10
    return out


@dataclass
class Model:
    """A network with one hidden layer over standardised features, and the scale of its output."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x).astype(np.float64) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Cells:
    """Rows without a label, summed up: by cell their number and the mean of their features; over all rows, mean and spread."""

    count: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    centre: np.ndarray

    @property
    def rows(self) -> float:
        return float(self.count.sum())


def cells_of(count: np.ndarray, total: np.ndarray, squares: np.ndarray) -> Cells:
    """Cells from counts, sums by cell, and the sum of squares over all rows."""
    n = max(float(count.sum()), 1.0)
    centre = total.sum(0) / n
    return Cells(count, total / np.maximum(count, 1)[:, None], np.sqrt(np.maximum(squares / n - centre**2, 0)), centre)


def rows_as_cells(x: np.ndarray) -> Cells:
    """Each row a cell of its own: for few rows."""
    return Cells(np.ones(len(x)), x.astype(np.float64), x.std(0), x.mean(0))


def fit_nnpu(positive: np.ndarray, unlabelled: Cells | np.ndarray, prior: float, seed: int = SEED, rounds: int = ROUNDS) -> Model:
    """Minimises  prior R+(positive) + max(0, R-(unlabelled) - prior R-(positive))  with the sigmoid loss; a cell weighs as its rows."""
    u = unlabelled if isinstance(unlabelled, Cells) else rows_as_cells(unlabelled)
    rng = np.random.default_rng(seed)
    # of positives and unlabelled rows together
    n_p, n_u = len(positive), u.rows
    mean = (positive.sum(0) + n_u * u.centre) / (n_p + n_u)
    second_moment = ((positive.astype(np.float64) ** 2).sum(0) + n_u * (u.spread**2 + u.centre**2)) / (n_p + n_u)
    spread = np.sqrt(np.maximum(second_moment - mean**2, 0)) + 1e-3
    d = positive.shape[1]
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    full = np.flatnonzero(u.count)
    xp, xu, weight = (positive - mean) / spread, (u.mean[full] - mean) / spread, u.count[full] / max(n_u, 1)
    turns = max(1, max(len(xp), len(xu)) // BATCH, min(8, len(xp), len(xu)))
    for _ in range(rounds):
        for a, b in zip(np.array_split(rng.permutation(len(xp)), turns), np.array_split(rng.permutation(len(xu)), turns), strict=True):
            if not len(a) or not len(b):
                continue
            x = np.concatenate((xp[a], xu[b]))
            h = np.tanh(x @ p[0] + p[1])
            g = h @ p[2] + p[3]
            s = _sigmoid(g)  # the loss as a negative; 1 - s as a positive
            slope = s * (1 - s)
            n, w = len(a), weight[b] / weight[b].sum()
            negative_risk = s[n:] @ w - prior * s[:n].mean()
            grad = np.zeros_like(g)
            if negative_risk >= 0:
                grad[:n] = -2 * prior * slope[:n] / n
                grad[n:] = slope[n:] * w
            else:  # the estimate is below zero, that is, overfitted: step back from it
                grad[:n] = prior * slope[:n] / n
                grad[n:] = -slope[n:] * w
            back = np.outer(grad, p[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ grad + 1e-4 * p[2], grad.sum(keepdims=True)]
            step += 1
            for i, v in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * v
                second[i] = 0.999 * second[i] + 0.001 * v * v
                p[i] = p[i] - RATE * (1 - 0.95 * step / (rounds * turns + 1)) * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, p[0], p[1], p[2], float(p[3][0]), prior=prior)


def fit_mean(positive: np.ndarray, unlabelled: Cells | np.ndarray, prior: float, fits: int = FITS) -> Model:
    """The mean of several fits from different starts, as one network."""
    ms = [fit_nnpu(positive, unlabelled, prior, SEED + i) for i in range(fits)]
    return Model(ms[0].mean, ms[0].spread, np.concatenate([m.w1 for m in ms], axis=1), np.concatenate([m.b1 for m in ms]), np.concatenate([m.w2 for m in ms]) / fits, sum(m.b2 for m in ms) / fits, prior=prior)


def prior_of(positive: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> float:
    """The share of positives among rows whose scores are counted by bin, from scores of positives that the scorer hasn't seen."""
    n = counts.sum()
    if not len(positive) or not n:
        return 0.5
    above = counts[::-1].cumsum()[::-1]  # rows in this bin or a higher one
    cuts = np.clip(np.searchsorted(edges, np.quantile(positive, np.linspace(0, 0.9, 46)), "left"), 0, len(counts) - 1)
    scores = np.searchsorted(edges, positive, "right")
    ratio = [(above[c] / n + 1 / np.sqrt(n)) / max(np.mean(scores >= c), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> float:
    """The share of positives among the unlabelled, from scores on halves that the scorer hasn't seen."""
    m = fit_nnpu(positive[::2], unlabelled[::2], 0.5, seed, max(5, ROUNDS // 4))
    p, u = m.raw(positive[1::2]), m.raw(unlabelled[1::2])
    edges = bins(p)
    return prior_of(p, edges, np.bincount(np.searchsorted(edges, u, "right"), minlength=len(edges) + 1))


def bins(scores: np.ndarray) -> np.ndarray:
    """Edges of bins that scores fall into, fine where positives are."""
    return np.unique(np.quantile(scores, np.linspace(0, 1, BINS))) if len(scores) else np.zeros(1)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt scaling on labelled rows, with its smoothed targets; without both classes the output stays as it is."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return model
    g, t = model.raw(x).astype(np.float64), np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method with a little damping
        s = _sigmoid(a * g + b)
        r, w = s - t, np.maximum(s * (1 - s), 1e-9)
        hess = np.array([[(w * g * g).sum() + 1e-3, (w * g).sum()], [(w * g).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(r * g).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        size = min(1.0, 2.0 / max(2.0, float(np.abs(move).max())))
        a, b = a - size * move[0], b - size * move[1]
    model.slope, model.shift = float(a), float(b)
    return model


def _in_fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def held_out(id_col: str = "doc_id", folds: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(_in_fold(id_col, folds) == rest, F.lit(False))


def gather(docs: DataFrame, labels: DataFrame, label: str, features_of: Callable[[str], np.ndarray], width: int, folds: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of bounded samples of the training folds.

    At most ``most`` rows of each label are picked by a hash of the id; only their ids (a few tens of
    thousands) are broadcast, and only their features reach the driver.
    """
    small_batches(docs.sparkSession)
    ids = labels.where(~held_out(id_col, folds, rest)).where(F.col(label).isNotNull()).select(id_col, F.col(label).cast("int").alias("_y"))
    order = F.xxhash64(id_col, F.lit(SEED))
    picked = [ids.where(F.col("_y") == v).groupBy(id_col).agg(F.max("_y").alias("_y")).orderBy(order, id_col).limit(most) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1])

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("_y", id_col, _packed(features_of)(text_col).alias("_x")).collect()
    rows.sort(key=lambda r: (r[1], r[2]))
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.float32).reshape(-1, width)
    return x, np.array([r[0] for r in rows], np.int64)


def _packed(features_of: Callable[[str], np.ndarray]) -> Callable[[str], Column]:
    """Features of a text column as bytes."""

    @F.pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return pd.Series([features_of(t).astype(np.float32).tobytes() for t in texts(batch)])

    return packed


def _free(docs: DataFrame, labels: DataFrame, folds: int, rest: int, id_col: str, text_col: str) -> DataFrame:
    """(half, x) of all documents of the training folds without a label, halved by a hash of the id: features, as texts would be far more to move."""
    small_batches(docs.sparkSession)
    asked = docs.where(F.col(id_col).isNotNull()).where(~held_out(id_col, folds, rest)).select(id_col, _packed(features)(text_col).alias("x"))
    free = asked.join(labels.select(id_col).distinct(), id_col, "left_anti")
    return free.select(F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(2)).cast("int").alias("half"), "x")


def _matrix(batch: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, batch)), np.float32).reshape(-1, width)


def summed(free: DataFrame, centre: np.ndarray, scale: np.ndarray, planes: int = PLANES) -> tuple[Cells, Cells]:
    """All rows of (half, x) as cells: those on the same sides of ``planes`` random planes are one.

    A task adds its rows up, so no more than its cells are shuffled; the driver gets two tables of 2 to the power of ``planes`` rows.
    """
    small_batches(free.sparkSession)
    turn = np.random.default_rng(SEED).normal(0, 1, (len(centre), planes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            x = _matrix(b["x"], len(centre)).astype(np.float64)
            cell = ((x - centre) / scale @ turn > 0) @ (1 << np.arange(planes))
            half = b["half"].to_numpy()
            for h in (0, 1):
                for c in np.unique(cell[half == h]).tolist():
                    rows = x[(half == h) & (cell == c)]
                    at = held.setdefault((h, c), [0, np.zeros(x.shape[1])])
                    at[0] += len(rows)
                    at[1] += rows.sum(0)
                squares = held.setdefault((h, -1), [0, np.zeros(x.shape[1])])
                squares[1] += (x[half == h] ** 2).sum(0)
        yield pd.DataFrame([(h, c, n, v.tolist()) for (h, c), (n, v) in held.items()], columns=["half", "cell", "n", "total"])

    parts = free.mapInPandas(run, "half int, cell int, n long, total array<double>")
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(len(centre))])
    rows = parts.groupBy("half", "cell").agg(F.sum("n").alias("n"), total.alias("total")).collect()
    out = []
    for h in (0, 1):
        count, sums, squares = np.zeros(1 << planes), np.zeros((1 << planes, len(centre))), np.zeros(len(centre))
        for r in rows:
            if r.half == h and r.cell >= 0:
                count[r.cell], sums[r.cell] = r.n, r.total
            elif r.half == h:
                squares = np.array(r.total)
        out.append(cells_of(count, sums, squares))
    return out[0], out[1]


def score_counts(free: DataFrame, model: Model, edges: np.ndarray) -> np.ndarray:
    """How many rows of (half, x) have scores in each bin, counted in the tasks first."""
    small_batches(free.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            if len(b):
                scores = model.raw(_matrix(b["x"], len(model.mean)))
                counts += np.bincount(np.searchsorted(edges, scores, "right"), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bin": at.astype(np.int32), "n": counts[at]})

    out = np.zeros(len(edges) + 1, np.int64)
    for r in free.mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits prior, network and scale; None where there are no positives or nothing is unlabelled.

    Labelled rows are a bounded sample; of unlabelled ones all count: their means, spreads and risk through cells, and the prior through the
    scores of one half under a model of the other.
    """
    x, y = gather(docs, labels, label, features, N_FEATURES, folds, rest, LABELLED, id_col, text_col)
    positive = x[y == 1]
    if not len(positive):
        return None
    free = written(_free(docs, labels, folds, rest, id_col, text_col), "features")
    seen, unseen = summed(free, x.mean(0).astype(np.float64), x.std(0) + 1e-3)
    if seen.rows and unseen.rows:
        half = fit_nnpu(positive[::2], seen, 0.5, SEED, max(5, ROUNDS // 4))
        scores = half.raw(positive[1::2])
        edges = bins(scores)
        prior = prior_of(scores, edges, score_counts(free.where("half = 1"), half, edges))
        n = seen.count + unseen.count
        rows = max(seen.rows + unseen.rows, 1)
        centre = (seen.rows * seen.centre + unseen.rows * unseen.centre) / rows
        moment = (seen.rows * (seen.spread**2 + seen.centre**2) + unseen.rows * (unseen.spread**2 + unseen.centre**2)) / rows
        mean = (seen.mean * seen.count[:, None] + unseen.mean * unseen.count[:, None]) / np.maximum(n, 1)[:, None]
        unlabelled: Cells | np.ndarray = Cells(n, mean, np.sqrt(np.maximum(moment - centre**2, 0)), centre)
    else:
        # where (nearly) every row has a label, labelled rows of both classes stand for unlabelled text
        prior, unlabelled = estimate_prior(positive, x), x
    discard(free)
    return calibrate(fit_mean(positive, unlabelled, prior), x[y >= 0], y[y >= 0])


def score(model: Model | None, text_col: str = "text") -> Column:
    """The probability that a text's label is 1, as a column."""

    @F.pandas_udf("double")
    def scores(batch: pd.Series) -> pd.Series:
        remember("quality")
        if model is None:
            return pd.Series(np.full(len(batch), 0.5))
        return pd.Series(model.probability(np.stack([features(t) for t in texts(batch)])) if len(batch) else np.zeros(0))

    return scores(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` for every document; further columns are left out."""
    docs = docs.select(id_col, text_col)
    model = train(docs, labels.select(id_col, "quality"), id_col=id_col, text_col=text_col)
    out = docs.select(id_col, held_out(id_col).alias("held_out"), score(model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

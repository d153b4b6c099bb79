"""Toxicity by a lexicon, Levenshtein automata and context windows.

The lexicon is learnt: words, and beginnings of words, that labelled toxic
texts hold far more often than labelled clean ones.  Every form in a text is
run through a Levenshtein automaton that is intersected with the lexicon's
trie, so misspelled terms count, unless clean texts hold the very form.  A
window of words around each hit is scored for quotation against abuse: marks of
quotation on both sides, and neighbouring words that came with hits in clean or
in toxic texts.  A logistic regression over the sums of a text's hits gives its
score.

The fit takes a bounded sample of labelled rows (``LABELLED`` of each label, by
a hash of the id), in which equal texts of a label count once; counts of forms
are added up by Spark, and the sample alone bounds the lexicon.  Every text is scored
whole.  A null text is an empty one and scores like a text without hits; equal
texts have equal scores; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import discard, remember, small_batches, texts, written
from vellum.llm.quality import SEED, held_out

#: Labelled rows of each label that the fit may use at most.
LABELLED = 12_000
#: Toxic texts that hold a candidate at least.
LEAST = 3
#: Letters of a term from which it is matched with one error, and with two.
FUZZY_FROM, TWICE_FROM = 5, 8
#: Lengths of beginnings that may be terms.
STEMS = (4, 5, 6, 7)
#: Words on either side of a hit that are its context.
WINDOW = 5
THRESHOLD = 0.7
#: Forms that a worker remembers.
MEMO = 400_000

_OPEN, _CLOSE = "\"'«„“‘‹‚”(", "\"'»”“’›‘)"
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
#: What may stand around a word.
_MARKS = ".,;:!?()[]{}\"'«»„“”‘’-–—%&*$#|"
_PART = re.compile(r"[^\W_]+")
#: Signs that are written for letters (fixed values).
_LOOKS = str.maketrans("0134578@$!|", "oieastbasii")
_SIGN = re.compile(r"[0134578@$!|]")


def forms(chunk: str) -> list[str]:
    """What a run of non-blank characters may stand for: itself without outer marks, and its parts."""
    core = _EDGE.sub("", chunk)
    if not core:
        return []
    parts = _PART.findall(core)
    return parts if parts == [core] else [core, *parts]


def disguised(chunk: str) -> list[str]:
    """What is meant by a run in which signs stand for letters, or marks between single letters: words of letters alone."""
    out = []
    bare = chunk.strip(".,;:?()[]{}\"'«»„“”‘’")
    if not bare.isalpha() and any(map(str.isalpha, bare)) and _SIGN.search(bare):
        word = bare.rstrip("!").translate(_LOOKS)
        if word.isalpha():
            out.append(word)
    parts = _PART.findall(chunk)
    if len(parts) > 2 and all(len(x) == 1 for x in parts):
        out.append("".join(parts).translate(_LOOKS))
    return [w for w in out if w.isalpha() and len(w) >= 3]


class Levenshtein:
    """A Levenshtein automaton of one or two errors, of which two swapped neighbours are one, as a parametric automaton.

    States are sets of (characters of the word read, errors, whether the first of two swapped letters was just read), normalised to the
    least place; the next state depends on which of the next characters of the
    word equal the letter read, so transitions are shared by all words.
    """

    _moves: dict = {}

    def __init__(self, word: str, errors: int = 1) -> None:
        self.word, self.errors = word, errors

    def start(self) -> tuple[int, frozenset]:
        return 0, frozenset({(0, 0, False)})

    def step(self, state: tuple[int, frozenset], letter: str) -> tuple[int, frozenset] | None:
        base, places = state
        near = tuple(c == letter for c in self.word[base : base + 3 * self.errors + 2])
        key = (places, near, self.errors)
        if key not in self._moves:
            out = set()
            for i, e, swapped in places:
                if swapped:
                    if i < len(near) and near[i]:
                        out.add((i + 2, e, False))
                    continue
                for skip in range(self.errors - e + 1):  # letters of the word are missing
                    if i + skip < len(near) and near[i + skip]:
                        out.add((i + skip + 1, e + skip, False))
                if e < self.errors:
                    out.add((i, e + 1, False))  # the letter is one too many
                    if i < len(near):
                        out.add((i + 1, e + 1, False))  # another letter stands here
                    if i + 1 < len(near) and near[i + 1]:
                        out.add((i, e + 1, True))
            out = {(i, e, t) for i, e, t in out if t or not any(f < e and abs(i - j) <= e - f for j, f, u in out if not u)}
            low = min((i for i, _, _ in out), default=0)
            self._moves[key] = (low, frozenset((i - low, e, t) for i, e, t in out)) if out else None
        move = self._moves[key]
        return None if move is None else (base + move[0], move[1])

    def accepts(self, state: tuple[int, frozenset]) -> bool:
        base, places = state
        return any(not t and len(self.word) - base - i <= self.errors - e for i, e, t in places)


def _tries(pairs: Iterator[tuple[str, str]]) -> dict[str, dict]:
    """By key, the trie of the terms that have it."""
    out: dict[str, dict] = {}
    for key, term in pairs:
        node = out.setdefault(key, {})
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return out


class Lexicon:
    """Terms with weights in tries.  A term that ends in ``*`` stands for all words that begin with it.

    An error or two leave a part of a term as it is, and tries are kept by that part, so a form meets the terms only that it shares one with.  One error
    leaves the first or the last letters (two; three of terms of seven letters and more), two leave the first three, the last three, or those between, at most one
    place from their own.
    """

    def __init__(self, terms: dict[str, float], exempt: frozenset[str] = frozenset()) -> None:
        self.terms, self.exempt = terms, exempt
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.stem_lengths = sorted({len(s) for s in self.stems})
        fuzzy = [t for t in self.words if len(t) >= FUZZY_FROM]
        short, long, twice = [t for t in fuzzy if len(t) < 7], [t for t in fuzzy if len(t) >= 7], [t for t in fuzzy if len(t) >= TWICE_FROM]
        self.head2, self.tail2 = _tries((t[:2], t) for t in short), _tries((t[-2:], t) for t in short)
        self.head3, self.tail3 = _tries((t[:3], t) for t in long), _tries((t[-3:], t) for t in long)
        self.twice_head, self.twice_tail = _tries((t[:3], t) for t in twice), _tries((t[-3:], t) for t in twice)
        # of terms of eight letters only two stand between
        self.middle2, self.middle3 = _tries((t[3:5], t) for t in twice if len(t) == 8), _tries((t[3:6], t) for t in twice if len(t) > 8)
        self.longest = max(map(len, fuzzy), default=0)

    def _walk(self, tries: list[dict | None], form: str, errors: int) -> str | None:
        """The least term that the automaton of ``form`` accepts, by going through it and the tries at once."""
        automaton, found = Levenshtein(form, errors), []
        stack = [(trie, automaton.start()) for trie in tries if trie]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if not c:
                    if automaton.accepts(state):
                        found.append(below)
                elif (after := automaton.step(state, c)) is not None:
                    stack.append((below, after))
        return min(found, default=None)

    def nearest(self, form: str) -> str | None:
        """The term nearest to ``form``: at one error, else, of long terms, at two; least in order of ties."""
        n = len(form)
        if not FUZZY_FROM - 1 <= n <= self.longest + 2:
            return None
        head, tail = form[:3], form[-3:]
        tries = [self.head3.get(head), self.tail3.get(tail)]
        if n <= 7:
            tries += [self.head2.get(form[:2]), self.tail2.get(form[-2:])]
        near = self._walk(tries, form, 1) if any(tries) else None
        if near is None and n >= TWICE_FROM - 2:
            tries = [self.twice_head.get(head), self.twice_tail.get(tail), self.middle3.get(form[2:5]), self.middle3.get(form[3:6]), self.middle3.get(form[4:7])]
            # two swapped letters of which one stands in the middle
            tries += [self.middle3.get(form[2:3] + form[4:6]), self.middle3.get(form[2:4] + form[5:6]), self.middle3.get(form[3:5] + form[6:7]), self.middle3.get(form[4:6] + form[7:8]), self.middle3.get(form[2:7:2])]
            if n <= 10:
                tries += [self.middle2.get(form[2:4]), self.middle2.get(form[3:5]), self.middle2.get(form[4:6])]
                tries += [self.middle2.get(form[2:3] + form[4:5]), self.middle2.get(form[3:4] + form[5:6]), self.middle2.get(form[4:5] + form[6:7]), self.middle2.get(form[2:6:3])]
            if any(tries):
                near = self._walk(tries, form, 2)
        return near

    def match(self, form: str) -> tuple[str, float, bool] | None:
        """(term, weight, whether it is misspelled) of a form in small letters."""
        w = self.words.get(form)
        if w is not None:
            return form, w, False
        for n in self.stem_lengths:
            w = self.stems.get(form[:n])
            if w is not None and form not in self.exempt:
                return form[:n] + "*", w, False
        if form in self.exempt:
            return None
        near = self.nearest(form)
        return None if near is None else (near, self.words[near], True)


def fold(text: str) -> str:
    """Small letters; compatibility forms (wide letters, for one) as plain ones where a text isn't ASCII."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


@dataclass
class Hit:
    term: str
    form: str
    weight: float
    fuzzy: bool
    marked: bool
    around: list[str]


class Finder:
    """Finds hits; remembers what each run of characters stands for."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.clean: set[str] = set()
        self.hits: dict[str, tuple] = {}

    def look(self, chunk: str) -> tuple | None:
        core = chunk.strip(_MARKS)
        if core.isalpha():
            m = self.lexicon.match(core)
            return (*m, core) if m else None
        best = None
        for form in forms(chunk):
            m = self.lexicon.match(form)
            if m and (best is None or (m[2], -m[1]) < (best[2], -best[1])):
                best = (*m, form)
        if best is None:
            for form in disguised(chunk):
                m = self.lexicon.match(form)
                if m and form not in self.lexicon.exempt and (best is None or -m[1] < -best[1]):
                    best = (m[0], m[1], True, form)
        return best

    def find(self, text: str) -> tuple[int, list[Hit]]:
        """The number of words, and the hits in order."""
        if len(self.clean) > MEMO:
            self.clean.clear()
        if len(self.hits) > MEMO:
            self.hits.clear()
        chunks = fold(text).split()
        for c in set(chunks) - self.clean:
            if c not in self.hits:
                m = None if c.strip(_MARKS) in self.clean else self.look(c)
                if m is None:
                    self.clean.add(c)
                else:
                    self.hits[c] = m
        out = []
        if not self.hits.keys().isdisjoint(chunks):
            for j, c in enumerate(chunks):
                m = self.hits.get(c)
                if m is not None:
                    before, after = chunks[max(0, j - WINDOW) : j], chunks[j + 1 : j + 1 + WINDOW]
                    opened = c[0] in _OPEN or any(x[0] in _OPEN for x in before)
                    closed = c[-1] in _CLOSE or c.rstrip(".,;:!?")[-1:] in _CLOSE or any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in after)
                    around = [_EDGE.sub("", x) for two in zip_longest(reversed(before), after) for x in two if x]  # the nearest first
                    out.append(Hit(m[0], m[3], m[1], m[2], opened and closed, around))
        return len(chunks), out


#: Weights of the gate before anything is learnt: bias, marks on both sides, what the words around tell.
GATE = (-3.0, 4.5, 1.0)


@dataclass
class Context:
    """What tells quotation from abuse: words that came with hits in clean texts (above 0) or in toxic ones, and the weights of the gate."""

    words: dict[str, float] = field(default_factory=dict)
    gate: tuple[float, float, float] = GATE


@dataclass
class Model:
    """The lexicon, the words of contexts, and the weights of the regression."""

    lexicon: Lexicon
    context: Context = field(default_factory=lambda: Context())
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = -40.0


N_FEATURES = 6


def signs(hit: Hit, context: Context) -> tuple[float, float, float]:
    """What the gate looks at: 1, whether marks stand on both sides, and what the words around tell, of which near ones count more."""
    told = sum(context.words.get(w, 0.0) / (1 + d // 4) for d, w in enumerate(hit.around))
    return 1.0, float(hit.marked), max(-3.0, min(3.0, told))


def quotation(hit: Hit, context: Context) -> float:
    """The probability that a hit is quoted rather than meant: 0 to 1."""
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, sum(g * x for g, x in zip(context.gate, signs(hit, context), strict=True))))))


def fit_gate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 2.0) -> tuple[float, float, float]:
    """The gate from hits in clean (1) and toxic (0) texts: a logistic regression that is pulled to ``GATE``, which stays where hits tell nothing.

    Marks and words that speak for quotation never speak against it.
    """
    b = np.array(GATE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        grad = x.T @ (weight * (p - y)) + pull * (b - np.array(GATE))
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + pull * np.eye(3)
        move = np.linalg.solve(hess, grad)
        b = b - move * min(1.0, 2.0 / max(2.0, float(np.abs(move).max())))
    return float(b[0]), max(float(b[1]), 1.0), max(float(b[2]), 0.0)


def features(words: int, hits: list[Hit], context: Context) -> np.ndarray:
    abuse = fuzzy = quoted = best = 0.0
    for h in hits:
        q = quotation(h, context)
        if h.fuzzy:
            fuzzy += h.weight * (1 - q)
        else:
            abuse += h.weight * (1 - q)
        quoted += h.weight * q
        best = max(best, h.weight * (1 - q) * (0.5 if h.fuzzy else 1.0))
    return np.array([math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted), best, math.log1p(100 * (abuse + fuzzy) / max(words, 20)), float(abuse > 0)])


def _sample(docs: DataFrame, labels: DataFrame, folds: int, rest: int, id_col: str, text_col: str) -> DataFrame:
    """(y, text) of at most ``LABELLED`` training rows of each label, broadcast by their ids."""
    order = F.xxhash64(id_col, F.lit(SEED))
    ids = labels.where(~held_out(id_col, folds, rest)).where(F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("_y"))
    picked = [ids.where(F.col("_y") == v).orderBy(order, id_col).limit(LABELLED) for v in (0, 1)]
    return docs.select(id_col, text_col).join(F.broadcast(picked[0].unionByName(picked[1])), id_col).select("_y", F.col(text_col).alias("_t"))


def _log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def _counted(sample: DataFrame, counter, schema: str = "word string, toxic long, clean long") -> DataFrame:
    """Texts of either label that hold each word of ``words_of(text)``; added up in the tasks first.

    A task makes its ``words_of`` once, by ``counter()``, so that it may remember forms.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = counter()
        for batch in batches:
            counts = (Counter(), Counter())
            for y, t in zip(batch.iloc[:, 0], texts(batch.iloc[:, 1]), strict=True):
                counts[y].update(words_of(t))
            yield pd.DataFrame([(w, counts[1][w], counts[0][w]) for w in counts[0].keys() | counts[1].keys()], columns=["word", "toxic", "clean"])

    return sample.mapInPandas(run, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms_of(text: str) -> set[str]:
    """The distinct forms of a text with their beginnings."""
    words = {f for c in set(fold(text).split()) for f in forms(c) if len(f) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _covering(found: dict[str, tuple[int, float]], held: list[set[str]], n_toxic: int) -> list[str]:
    """Candidates that are common, or that explain toxic texts which those before them don't.

    Copies of one toxic text make all of its words look toxic; such words explain nothing anew.
    """
    where: dict[str, list[int]] = {}
    for i, h in enumerate(held):
        for word in h & found.keys():
            where.setdefault(word, []).append(i)
    out, is_open = [], np.ones(len(held), bool)
    common, fresh = max(5, 0.04 * n_toxic), max(2, min(LEAST, 0.003 * n_toxic))
    for word, (n, _) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        at = where.get(word, [])
        if n >= common or is_open[at].sum() >= fresh:
            out.append(word)
            is_open[at] = False
    return out


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Words and beginnings whose log odds stand out; a beginning only where it says more than one word."""
    counts = _counted(sample, lambda: _terms_of)
    odds = _log_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    # no more candidates than the bounded sample holds
    rows = counts.where(F.col("toxic") >= LEAST).withColumn("w", odds).where("w > 2.5").select("word", "toxic", "w").collect()
    found = {r.word: (r.toxic, r.w) for r in rows}
    names = sorted(found)
    number = sample.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    @F.pandas_udf("array<int>")
    def holds(batch: pd.Series) -> pd.Series:
        return pd.Series([sorted(number.value[w] for w in _terms_of(t) if w in number.value) for t in texts(batch)])

    # of the bounded sample of toxic texts, the candidates that each one holds
    held = [{names[i] for i in r.h} for r in sample.where("_y = 1").select(holds("_t").alias("h")).collect()]
    return Lexicon(choose_terms(found, held, n_toxic))


def choose_terms(found: dict[str, tuple[int, float]], held: list[set[str]], n_toxic: int) -> dict[str, float]:
    """The terms of the lexicon with their weights, from candidates (texts that hold them, log odds).

    The whole words of a beginning are terms, too, so that they are found with an error.
    """
    whole_words, found = {w: v for w, (_, v) in found.items() if not w.endswith("*")}, {w: found[w] for w in _covering(found, held, n_toxic)}
    terms: dict[str, float] = {}
    for word, (n, w) in sorted(found.items(), key=lambda x: (len(x[0].rstrip("*")), x[0])):
        stem = word.rstrip("*")
        if any(stem[:k] + "*" in terms for k in STEMS if k < len(stem)):
            continue  # a shorter beginning has it
        if word.endswith("*"):
            whole = max((m for o, (m, _) in found.items() if not o.endswith("*") and o.startswith(stem)), default=0)
            longer = max((v for o, (m, v) in found.items() if o.endswith("*") and len(o) > len(word) and o.startswith(stem) and m >= 0.9 * n), default=-math.inf)
            if whole >= 0.8 * n or longer > w + 0.7:
                continue  # it is that word, or that longer beginning, that counts
        terms[word] = w
    stems = {t[:-1] for t in terms if t.endswith("*")}
    return terms | {o: v for o, v in whole_words.items() if any(o[:k] in stems for k in STEMS if k < len(o))}


def learn_context(sample: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> Context:
    """Words around hits, and the gate.

    A word tells something only if it stands around hits of clean texts twice as often as it stands in clean texts at all: what is common everywhere, as
    articles are, says nothing about quotation.  Each text's hits weigh as one in the gate.
    """

    def near_hits():
        finder = Finder(lexicon)
        return lambda text: {w for h in finder.find(text)[1] for w in h.around if w and not lexicon.match(w)} | ({""} if finder.find(text)[1] else set())

    near = {r.word: (r.toxic, r.clean) for r in _counted(sample, near_hits).where("clean >= 3 OR word = ''").collect()}
    hit_toxic, hit_clean = near.pop("", (0, 0))
    known = frozenset(near)
    plain = {r.word: r.clean for r in _counted(sample, lambda: lambda text: known.intersection(_EDGE.sub("", c) for c in set(fold(text).split()))).collect()} if known else {}
    words = {}
    for w, (toxic, clean) in sorted(near.items()):
        told = math.log((clean + 0.5) / (hit_clean + 1)) - math.log((toxic + 0.5) / (hit_toxic + 1))
        if clean / max(hit_clean, 1) >= 2 * plain.get(w, 0) / n_clean and abs(told) > 1:
            words[w] = max(-2.0, min(2.0, told))
    context = Context(words)

    @F.pandas_udf("array<array<double>>")
    def seen(batch: pd.Series) -> pd.Series:
        finder = Finder(lexicon)
        return pd.Series([[list(signs(h, context)) for h in finder.find(t)[1]] for t in texts(batch)])

    # a text's hits of equal signs are counted in its task; the sample bounds the texts, three signs the rows of each
    hits = sample.select("_y", F.explode(seen("_t")).alias("x"), F.xxhash64("_t").alias("h")).groupBy("_y", "x", "h").agg(F.count("*").alias("n"))
    hits = hits.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("h"))).groupBy("_y", "x").agg(F.sum("n").alias("n"))
    rows = sorted((r._y, list(r.x), r.n) for r in hits.collect())
    if rows and hit_clean:
        context.gate = fit_gate(np.array([x for _, x, _ in rows]), np.array([1.0 - y for y, _, _ in rows]), np.array([n for *_, n in rows]))
    return context


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learns the lexicon, exemptions, contexts and weights; None without labels of both kinds."""
    small_batches(docs.sparkSession)
    # copies of a text would make its chance words look toxic
    sample = written(_sample(docs, labels, folds, rest, id_col, text_col).dropDuplicates(["_y", "_t"]), "sample")
    n = {r[0]: r[1] for r in sample.groupBy("_y").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    lexicon = learn_lexicon(sample, n_toxic, n_clean)

    def soft_forms():
        """Forms that match only by an error or by their beginning."""
        finder = Finder(lexicon)
        return lambda text: {h.form for h in finder.find(text)[1] if h.form not in lexicon.words}

    odds = _log_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    own = _counted(sample, soft_forms).where("clean > 0").where(odds < 1.5)
    exempt = own.select("word").collect()
    lexicon = Lexicon(lexicon.terms, frozenset(r.word for r in exempt))

    context = learn_context(sample, lexicon, n_toxic, n_clean)

    @F.pandas_udf("array<double>")
    def vector(batch: pd.Series) -> pd.Series:
        finder = Finder(lexicon)
        return pd.Series([features(*finder.find(t), context).tolist() for t in texts(batch)])

    rows = sample.select("_y", vector("_t").alias("x")).collect()
    discard(sample)
    x, y = np.array([r.x for r in rows]), np.array([r._y for r in rows], float)
    weights, bias = _logistic(x, y)
    return Model(lexicon, context, weights, bias)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; hits never speak against toxicity, and quoted ones never for it."""
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    a = np.column_stack((x, np.ones(len(x))))
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    free = np.ones(a.shape[1], bool)
    b = np.zeros(a.shape[1])
    for _ in range(x.shape[1] + 1):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
            grad = a.T @ (p - y) + penalty @ b
            hess = (a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + penalty
            move = np.zeros_like(b)
            move[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            b = b - move * min(1.0, 4.0 / max(4.0, float(np.abs(move).max())))
            if np.abs(move).max() < 1e-8:
                break
        quoted = np.arange(len(b) - 1) == 2
        wrong = np.where(quoted, b[:-1] > 0, b[:-1] < 0)
        if not wrong.any():
            break
        free[:-1] &= ~wrong
        b[:-1][wrong] = 0
    return b[:-1], float(b[-1])


#: The model that a worker scored with last, and its finder.
_LAST: list[tuple[Model, Finder]] = []


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """The probability that a text is toxic, as a column."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batch: pd.Series) -> pd.Series:
        m = held.value
        if m is None:
            return pd.Series(np.zeros(len(batch)))
        remember("forms", _LAST.clear)
        if not _LAST or _LAST[0][0] is not m:  # the model is held, so no other one can take its place in memory
            _LAST[:] = [(m, Finder(m.lexicon))]
        finder = _LAST[0][1]
        return pd.Series([1 / (1 + math.exp(-min(40.0, max(-40.0, float(features(*finder.find(t), m.context) @ m.weights) + m.bias)))) for t in texts(batch)])

    return scores(F.col(text_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` for every document; further columns are left out."""
    docs = docs.select(id_col, text_col)
    model = train(docs, labels.select(id_col, "toxic"), id_col=id_col, text_col=text_col)
    out = docs.select(id_col, held_out(id_col, 3, 1).alias("held_out"), score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

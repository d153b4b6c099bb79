"""URL filters: rules first, then a ratio of character language models.

Two variable-order Markov models over characters, one of accepted and one of
rejected URLs, are counted in one Spark job.  All counts are kept, as a table
that grows with the corpus; orders are interpolated by Witten-Bell smoothing,
an order at a time, by joins of distinct grams, so no key of a join is hot.
Differences of grams that make up a share ``COMMON`` of what has to be scored
(``1 / COMMON`` at most) are broadcast to the URLs; rarer ones are joined.

The score of a URL is the difference of its two log-likelihoods divided by its
length.  The threshold is calibrated on a fifth of the labelled URLs, which the
models don't count: it is the one with the least mean error of both classes,
found in a histogram that Spark aggregates.

A null URL, or one without ``://``, has an empty host and an empty path; an
empty or null URL scores 0.  Without URLs of both classes every score is 0, the
threshold 0, and a URL is allowed.  Repeated URLs count as often as they stand
there; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import written

#: Verdict and rule, that is, host and path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Characters in the longest context.
ORDER = 4
#: Grams with this share of all positions to score are broadcast, the others joined.
COMMON = 1 / 65536
#: Symbols: printable ASCII, anything else, and the end.
ALPHABET = 97
#: Bins of the calibration histogram, over scores from -SPAN to SPAN.
BINS, SPAN = 800, 4.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits host and path, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: str | None) -> str:
    """What the models see: lower case, anything but printable ASCII as one symbol, an end."""
    return "".join(c if " " <= c <= "~" else "\x7f" for c in (url or "").lower()) + "\0"


class Markov:
    """One smoothed variable-order model in memory: gram (context and next symbol) to count."""

    def __init__(self, grams: dict[str, int], contexts: dict[str, tuple[int, int]], order: int) -> None:
        self.grams, self.contexts, self.order = grams, contexts, order

    def probability(self, context: str, symbol: str) -> float:
        lower = 1 / ALPHABET if not context else self.probability(context[1:], symbol)
        n, kinds = self.contexts.get(context, (0, 0))
        if not n:
            return lower
        return (self.grams.get(context + symbol, 0) + kinds * lower) / (n + kinds)

    def log(self, context: str, symbol: str) -> float:
        return math.log(self.probability(context, symbol))


class Ratio:
    """Both models; ``score`` remembers the differences of single grams."""

    def __init__(self, accepted: Markov, rejected: Markov, order: int) -> None:
        self.accepted, self.rejected, self.order, self.memo = accepted, rejected, order, {}

    def score(self, url: str | None) -> float:
        if not url:
            return 0.0
        s, total, memo = symbols(url), 0.0, self.memo
        for i in range(len(s)):
            gram = s[max(0, i - self.order) : i + 1]
            x = memo.get(gram)
            if x is None:
                if len(memo) >= 500_000:
                    memo.clear()
                x = memo[gram] = self.accepted.log(gram[:-1], gram[-1]) - self.rejected.log(gram[:-1], gram[-1])
            total += x
        return total / len(s)


def count_grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``accepted``, ``gram``, ``n`` over (url, accepted) rows; added up in the tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for url, good in zip(batch["url"], batch["accepted"], strict=True):
                s = symbols(url)
                counts.update((good, s[max(0, i - k) : i + 1]) for k in range(order + 1) for i in range(k, len(s)))
            yield pd.DataFrame([(g, gram, n) for (g, gram), n in counts.items()], columns=["accepted", "gram", "n"])

    grams = labelled.select("url", "accepted").mapInPandas(run, "accepted boolean, gram string, n long")
    return grams.groupBy("accepted", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, order: int = ORDER) -> Ratio | None:
    """Both models in the driver's memory, for small tables; None unless both classes have rows."""
    rows = count_grams(labelled, order).collect()
    if {r.accepted for r in rows} != {True, False}:
        return None
    models = []
    for good in (True, False):
        grams = {r.gram: r.n for r in rows if r.accepted == good}
        contexts: dict[str, tuple[int, int]] = {}
        for gram, n in grams.items():
            m, kinds = contexts.get(gram[:-1], (0, 0))
            contexts[gram[:-1]] = m + n, kinds + 1
        models.append(Markov(grams, contexts, order))
    return Ratio(*models, order)


def _all_counts(urls: DataFrame, order: int) -> DataFrame:
    """Every gram of every URL: ``yes`` and ``no``, its counts in the models' URLs (``accepted`` true, false), and ``uses``, the positions it scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for url, good in zip(batch["url"], batch["accepted"], strict=True):
                s = symbols(url)
                for i in range(len(s)):
                    for k in range(min(i, order) + 1):
                        row = counts.setdefault(s[i - k : i + 1], [0, 0, 0])
                        if good is not None:
                            row[0 if good else 1] += 1
                    row[2] += 1  # of the longest context
            yield pd.DataFrame([(g, *n) for g, n in counts.items()], columns=["gram", "yes", "no", "uses"])

    grams = urls.select("url", "accepted").mapInPandas(run, "gram string, yes long, no long, uses long")
    return grams.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("yes", "no", "uses")))


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``uses`` and ``x``, the difference of its log-probabilities in both models, for all grams of ``_all_counts``."""
    counts = counts.withColumn("length", F.length("gram"))
    out, lower = [], None
    for k in range(1, order + 2):
        mine = counts.where(F.col("length") == k).withColumn("context", F.expr(f"left(gram, {k - 1})"))
        sums = [F.sum(c).alias(f"{c}_n") for c in ("yes", "no")] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("yes", "no")]
        joined = mine.join(mine.groupBy("context").agg(*sums), "context")
        if lower is None:
            joined = joined.withColumns({f"{c}_lower": F.lit(1 / ALPHABET) for c in ("yes", "no")})
        else:
            joined = joined.withColumn("rest", F.expr(f"right(gram, {k - 1})")).join(lower, "rest")
        for c in ("yes", "no"):
            n, kinds, low = F.col(f"{c}_n"), F.col(f"{c}_kinds"), F.col(f"{c}_lower")
            joined = joined.withColumn(f"{c}_p", F.when(n > 0, (F.col(c) + kinds * low) / (n + kinds)).otherwise(low))
        level = written(joined.select("gram", "uses", "yes_p", "no_p"), "grams")
        out.append(level)
        lower = level.select(F.col("gram").alias("rest"), F.col("yes_p").alias("yes_lower"), F.col("no_p").alias("no_lower"))
    return reduce(DataFrame.unionByName, out).where("uses > 0").select("gram", "uses", (F.log("yes_p") - F.log("no_p")).alias("x"))


def with_scores(urls: DataFrame, scores: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` (row, url and others) with ``score``, from the scores of all grams."""
    scores = written(scores, "scores")
    total = scores.agg(F.sum("uses")).first()[0] or 0
    common = {r.gram: r.x for r in scores.where(F.col("uses") >= max(1.0, total * COMMON)).select("gram", "x").collect()}
    held = urls.sparkSession.sparkContext.broadcast(common)

    @F.pandas_udf("struct<size:int,known:double,rare:array<string>>")
    def parts(batch: pd.Series) -> pd.DataFrame:
        rows, known = [], held.value
        for url in batch:
            s = symbols(url)
            grams = [s[max(0, i - order) : i + 1] for i in range(len(s))]
            found = [known.get(g) for g in grams]
            rows.append((len(s), math.fsum(x for x in found if x is not None), [g for g, x in zip(grams, found, strict=True) if x is None]))
        return pd.DataFrame(rows, columns=["size", "known", "rare"])

    parted = written(urls.withColumn("_part", parts("url")), "urls")
    rare = parted.select("row", F.explode("_part.rare").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
    rare = rare.join(scores.select("gram", "x"), "gram")
    # in one order, so that sums don't depend on how rows arrive
    rare = rare.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("gram", (F.col("x") * F.col("times")).alias("x")))).alias("xs"))
    rare = rare.select("row", F.aggregate("xs", F.lit(0.0), lambda a, b: a + b["x"]).alias("_more"))
    score = F.when(F.coalesce(F.col("url"), F.lit("")) == "", 0.0).otherwise((F.col("_part.known") + F.coalesce("_more", F.lit(0.0))) / F.col("_part.size"))
    return parted.join(rare, "row", "left").withColumn("score", score).drop("_part", "_more")


def calibrate(labelled: DataFrame) -> float:
    """The threshold with the least mean of both error rates over (accepted, score) rows; of a tie the middle one."""
    bin_of = F.floor((F.greatest(F.least(F.col("score"), F.lit(SPAN - 1e-9)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * BINS)
    counts = {(r.accepted, r.bin): r["count"] for r in labelled.select("accepted", bin_of.alias("bin")).groupBy("accepted", "bin").count().collect()}
    n = {g: sum(v for (good, _), v in counts.items() if good == g) for g in (True, False)}
    if not n[True] or not n[False]:
        return 0.0
    wrong, errors = n[False] / n[False], []
    for b in range(BINS + 1):  # the threshold is the lower edge of bin b
        errors.append(wrong)
        wrong += counts.get((True, b), 0) / n[True] - counts.get((False, b), 0) / n[False]
    best = [b for b, e in enumerate(errors) if e <= min(errors) + 1e-12]
    return -SPAN + 2 * SPAN * best[len(best) // 2] / BINS


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Judges every URL: the longest fitting rule's verdict, else the models'.

    The URLs that a rule judges are the models' accepted and rejected ones.
    """
    urls = df.select(F.col(id_col), F.col(url_col).alias("url"))
    urls = urls.select(id_col, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("_rule.verdict") == "allow"
    fold = F.pmod(F.crc32(F.col("url")), F.lit(5))
    # rows get a number that stays, since a URL may stand in many rows
    urls = written(urls.withColumn("accepted", F.when(fold != 0, allowed)).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = {r.accepted for r in urls.where("accepted IS NOT NULL").select("accepted").distinct().collect()}
    if len(classes) == 2:
        scored = written(with_scores(urls, gram_scores(written(_all_counts(urls, ORDER), "counts"))), "scored")
        threshold = calibrate(scored.where((fold == 0) & F.col("_rule").isNotNull()).select(allowed.alias("accepted"), "score"))
    else:
        scored, threshold = urls.withColumn("score", F.lit(0.0)), 0.0
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")

"""Corpus analytics: histograms, percentiles, gates, joins of scans with what is expected of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(value: Column | str) -> Column:
    """Money and milliseconds as decimals, so that sums don't depend on their order."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,4)")


#: Buckets for each doubling of a value, where percentiles are searched.
FINE = 64


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Keys with the least value at or above each share of a group's values, exact, by name; groups of nulls alone have no row.

    Equal values are counted first.  Counts are added up by buckets of values, whose running totals (some thousand
    rows for a group) tell the bucket of each share; only that bucket's values are then looked at one by one.  So no
    task holds a group.
    """
    keys = list(keys)
    v = F.col("_v").cast("double")
    bucket = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * FINE)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", bucket)
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bucket.withColumn("_end", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("share")) for n, p in shares.items()]))
    wanted = ends.withColumn("_q", asked).withColumn("_rank", F.col("_q.share") * F.col("_all"))
    wanted = wanted.where((F.col("_end") >= F.col("_rank")) & ((F.col("_end") - F.col("_n") < F.col("_rank")) | ((F.col("_rank") <= 0) & (F.col("_end") == F.col("_n")))))
    wanted = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_wb"), F.col("_q.name").alias("_name"), "_rank",
        (F.col("_end") - F.col("_n")).alias("_before"))
    on = counts["_b"] == wanted["_wb"]
    for k in keys:
        on = on & counts[k].eqNullSafe(wanted[f"_k_{k}"])
    within = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.join(wanted, on).withColumn("_end", F.sum("_n").over(within) + F.col("_before")).where(F.col("_end") >= F.col("_rank"))
    return at.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])


def upper_median(value: str) -> Column:
    """The element in the middle, the greater one of two; 0 of none."""
    held = F.sort_array(F.collect_list(value))
    return F.coalesce(F.get(held, F.floor(F.size(held) / 2).cast("int")), F.lit(0))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def hotspots(df: DataFrame, phase: str, ms: str, top: int = 0) -> DataFrame:
    """Per phase: count, total, mean, median, 95th percentile, greatest, and share of the total; ``top <= 0`` is all."""
    out = df.groupBy(phase).agg(F.count("*").alias("n"), F.sum(exact(ms)).alias("_total"), F.max(ms).alias("most"))
    out = out.join(percentiles(df, [phase], ms, {"p50": 0.5, "p95": 0.95}), phase, "left")
    # the window runs over one row for each phase
    out = out.withColumn("share", F.round(F.col("_total").cast("double") / F.sum("_total").over(Window.partitionBy(F.lit(1))).cast("double"), 6))
    out = out.select(phase, "n", F.col("_total").cast("double").alias("total"), F.round(F.col("_total").cast("double") / F.col("n"), 4).alias("mean"),
        "p50", "p95", "most", "share")
    return out.orderBy(F.desc("total"), phase).limit(top) if top > 0 else out


#: Renderers with the phases that a time of theirs belongs to: drawn, read from a cache, and as drawn when it was cached.
RENDERERS = ("own", "r1", "r2", "r3", "r4", "r5")
OVERHEAD = "compare-classify-and-overhead"


def render_phases(df: DataFrame, renderers: Sequence[str] = RENDERERS) -> DataFrame:
    """(phase, ms) of scan entries: for each renderer its time (``_ms``), cold or from the cache (``_hit``), the time
    when it was cached (``_cached_ms``), and what of ``elapsed_ms`` is left, not less than 0."""
    rows, measured = [], F.lit(0)
    for r in renderers:
        ms, hit = F.col(f"{r}_ms"), F.coalesce(F.col(f"{r}_hit"), F.lit(False))
        rows.append(F.struct(F.when(hit, f"{r}-cache-read").otherwise(f"{r}-render").alias("phase"), ms.alias("ms")))
        rows.append(F.struct(F.lit(f"{r}-cached-original").alias("phase"), F.col(f"{r}_cached_ms").alias("ms")))
        measured = measured + F.coalesce(ms, F.lit(0))
    rows.append(F.struct(F.lit(OVERHEAD).alias("phase"), F.greatest(F.lit(0), F.col("elapsed_ms") - measured).alias("ms")))
    # greatest() passes over nulls, so a page without a time of its own is asked for
    long = df.select("elapsed_ms", F.explode(F.array(*[F.struct(x["phase"].alias("phase"),
        x["ms"].cast("long").alias("ms")) for x in rows])).alias("x")).select("elapsed_ms", "x.*")
    return long.where(F.col("ms").isNotNull() & ~((F.col("phase") == OVERHEAD) & F.col("elapsed_ms").isNull())).select("phase", "ms")


def cache_counts(df: DataFrame, renderers: Sequence[str] = RENDERERS) -> DataFrame:
    """(renderer, state, n): hits, misses, and times without a word about the cache, which is a third thing."""
    rows = [F.struct(F.lit(r).alias("renderer"), F.col(f"{r}_ms").alias("ms"), F.col(f"{r}_hit").alias("hit")) for r in renderers]
    long = df.select(F.explode(F.array(*rows)).alias("x")).where("x.ms IS NOT NULL")
    state = F.when(F.col("x.hit").isNull(), "uncached").when(F.col("x.hit"), "hit").otherwise("miss")
    return long.groupBy(F.col("x.renderer").alias("renderer"), state.alias("state")).agg(F.count("*").alias("n"))


def count_maps(df: DataFrame, maps: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(map, key, n) of several count maps in one pass, each given as (which rows, key)."""
    found = F.array(*[F.struct(F.lit(name).alias("map"), rows.alias("on"), key.cast("string").alias("key")) for name, (rows, key) in maps.items()])
    return df.select(F.explode(found).alias("x")).where("x.on").groupBy("x.map", "x.key").agg(F.count("*").alias("n"))


def named(value: Column, blank: str) -> Column:
    """A value, or ``blank`` for null and white space."""
    return F.when(F.length(F.trim(F.coalesce(value, F.lit("")))) > 0, value).otherwise(F.lit(blank))


#: Workloads by what their phases begin with, and by phases (fixed values; the first that fits counts).
WORKLOADS = (
    ("gui.document-open.", "gui.document-open"), ("gui.input.", "gui.input"), ("gui.render.", "gui.render"), ("gui.search.", "gui.search"), ("gui.annotation.", "gui.annotation"),
    ("gui.form.", "gui.form"), ("gui.page-organization.", "gui.page-organization"), ("gui.redaction.", "gui.redaction"), ("gui.save.", "gui.save"), ("gui.close.", "gui.close"),
    ("gui.thumbnail.", "gui.thumbnail"), ("own-render", "renderer.page-render"), ("reference-", "reference.external-render"),
)
WORKLOAD_OF = {
    "viewer-render-and-capture": "gui.display-render-capture", "image-source-diff": "gui.display-render-capture", "dimension-check": "gui.display-render-capture",
    "semantic-status-policy": "gui.display-render-capture", OVERHEAD: "corpus.compare-classify",
}


def workload(phase: Column) -> Column:
    """The workload of a phase, by its beginning, else by its name; "unknown" if none fits."""
    by_name = F.create_map(*[F.lit(x) for kv in WORKLOAD_OF.items() for x in kv])
    out = F.coalesce(F.try_element_at(by_name, phase), F.lit("unknown"))
    for prefix, name in reversed(WORKLOADS):
        out = F.when(phase.startswith(prefix), name).otherwise(out)
    return out


def compared_keys(budgets: DataFrame, measured: DataFrame, step: str, key: str) -> DataFrame:
    """(step, compared, missing): keys of budgets that were measured, and those that weren't, in order."""
    seen = measured.select(step, key).distinct().withColumn("_seen", F.lit(True))
    held = budgets.select(step, key).distinct().join(seen, [step, key], "left")
    missing = F.sort_array(F.collect_list(F.when(F.col("_seen").isNull(), F.col(key).cast("string"))))
    return held.groupBy(step).agg(F.count("_seen").alias("compared"), F.concat_ws(",", missing).alias("missing"))


def gated(rows: DataFrame, group: Sequence[str], ratio: str, key: str) -> DataFrame:
    """Groups with their worst ratio and the key that contributes it; the first of equal ones."""
    worst = F.min(F.struct((-F.col(ratio)).alias("r"), key))
    out = rows.where(F.col(ratio).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), worst.alias("m"))
    return out.select(*group, "n", (-F.col("m.r")).alias("worst"), F.col(f"m.{key}").alias("contributor"))


def difference_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of samples (ar, ag, ab, br, bg, bb; 0 to 255): mean steps of luminance and chroma of those that differ, and how even dark ones are.

    The balance is the lesser count of dark samples for the greater one; 1 if neither image has any.
    """

    def y(s: str) -> Column:  # in thousandths, and chroma in millionths: whole numbers, so a sample at an edge is on its right side
        return 299 * F.col(f"{s}r").cast("long") + 587 * F.col(f"{s}g") + 114 * F.col(f"{s}b")

    def chroma(s: str) -> tuple[Column, Column]:
        r, g, b = (F.col(f"{s}{c}").cast("long") for c in "rgb")
        return -168736 * r - 331264 * g + 500000 * b, 500000 * r - 418688 * g - 81312 * b

    def rounded(x: Column) -> Column:
        return F.round(F.coalesce(x, F.lit(0.0)) * 10_000, 0) / 10_000

    (ab, ar), (bb, br) = chroma("a"), chroma("b")
    differs = (F.col("ar") != F.col("br")) | (F.col("ag") != F.col("bg")) | (F.col("ab") != F.col("bb"))
    rows = df.select(*keys, differs.alias("differs"), F.abs(y("a") - y("b")).alias("y"), ((F.abs(ab - bb) + F.abs(ar - br)) / 1e6 / 2).alias("c"),
        (y("a") < 128_000).alias("da"), (y("b") < 128_000).alias("db"))
    out = rows.groupBy(*keys).agg(
        F.count_if("differs").alias("differing"), F.sum(F.when(F.col("differs"), F.col("y"))).alias("y"), F.avg(F.when(F.col("differs"), F.col("c"))).alias("c"),
        F.count_if("da").alias("da"), F.count_if("db").alias("db"),
    )
    balance = F.when(F.greatest("da", "db") == 0, 1.0).otherwise(F.least("da", "db") / F.nullif(F.greatest("da", "db"), F.lit(0)))
    return out.select(*keys, "differing", rounded(F.col("y") / F.nullif(1000 * F.col("differing"), F.lit(0))).alias("luminance"),
        rounded(F.col("c")).alias("chroma"), F.round(balance, 6).alias("dark_balance"))


def unpivoted(df: DataFrame, id_col: str, timers: Sequence[str]) -> DataFrame:
    """(id, timer, ms) rows of timer columns; null timers have no row."""
    return df.unpivot(id_col, list(timers), "timer", "ms").where("ms IS NOT NULL")


def first_per_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def least_of_runs(df: DataFrame, keys: Sequence[str], ms: str, failed: Column) -> DataFrame:
    """The least time over runs that didn't fail, with counts of both; null where all failed."""
    return df.groupBy(*keys).agg(F.min(F.when(~failed, F.col(ms))).alias("least"), F.count_if(~failed).alias("runs"), F.count_if(failed).alias("failures"))


def budget_gate(least: DataFrame, budget: DataFrame, keys: Sequence[str], warn: float, fail: float, floor_ms: float) -> DataFrame:
    """Times against budgets: a ratio counts only where the difference exceeds a floor."""
    both = least.join(budget, list(keys))
    ratio = F.col("least") / F.col("budget")
    beyond = F.col("least") - F.col("budget") > floor_ms
    verdict = F.when(F.col("least").isNull(), "SKIP").when((ratio > fail) & beyond, "FAIL").when((ratio > warn) & beyond, "WARN").otherwise("PASS")
    return both.select(*keys, "least", "budget", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def triage_clusters(df: DataFrame, keys: Sequence[str], ref: Column, pdf: str, most: int = 12) -> DataFrame:
    """Groups with counts, distinct files and their first references.

    A group may hold a great part of all rows, so only ``most`` references are kept from the start:
    ranks are taken in salted parts first.
    """
    salted = df.select(*keys, ref.alias("_ref"), F.col(pdf).alias("_pdf")).withColumn("_salt", F.pmod(F.xxhash64("_ref"), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_ref")
    firsts = salted.withColumn("_turn", F.row_number().over(part)).where(F.col("_turn") <= most)
    refs = firsts.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_ref")), 1, most).alias("refs"))
    sizes = salted.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("_pdf").alias("files"))
    return sizes.join(refs, list(keys)).select(*keys, "n", "files", F.concat_ws(",", "refs").alias("refs"))


def lookup_with_fallback(df: DataFrame, expected: DataFrame, path: str, prefix: str, value: str) -> DataFrame:
    """A row's expectation by its path, else by the path with the prefix, else without it.

    Three equi-joins; a join on alternatives would compare all pairs.
    """

    def named(name: str) -> DataFrame:
        return expected.select(F.col(path).alias(f"_{name}"), F.col(value).alias(f"_{name}_value"))

    bare = F.when(F.col(path).startswith(prefix), F.substr(F.col(path), F.lit(len(prefix) + 1)))
    out = df.withColumn("_b", F.concat(F.lit(prefix), F.col(path))).withColumn("_c", bare)
    for key, name in ((path, "x"), ("_b", "y"), ("_c", "z")):
        out = out.join(named(name), out[key] == F.col(f"_{name}"), "left")
    return out.select(*df.columns, F.coalesce("_x_value", "_y_value", "_z_value").alias(value))


def contract_pages(df: DataFrame, contracts: DataFrame, path: str, page: str, prefix: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Columns replaced by those of a page's contract where it says something, with ``contract_status`` (APPLIED or MISSING).

    A contract is found by path and page; a path without a folder also with ``prefix`` before it, and a path that has the prefix also without it.  Backslashes
    are slashes.  With ``strict``, columns of a page without a contract are NEEDS_REVIEW.  Three equi-joins on small keys: a contract's columns travel as one struct.
    """
    asked = df.withColumn("_p", F.replace(F.col(path), F.lit("\\"), F.lit("/")))
    asked = asked.withColumn("_longer", F.when(~F.contains("_p", F.lit("/")), F.concat(F.lit(prefix), "_p"))).withColumn("_shorter", F.when(F.startswith("_p", F.lit(prefix)), F.substr("_p", F.lit(len(prefix) + 1))))
    over = contracts.select(F.col(path).alias("_k"), F.col(page).alias("_n"), F.struct(*columns).alias("_c"))
    for key, name in (("_p", "_0"), ("_longer", "_1"), ("_shorter", "_2")):
        side = over.select(F.col("_k").alias(f"_k{name}"), F.col("_n").alias(f"_n{name}"), F.col("_c").alias(name))
        asked = asked.join(side, (asked[key] == side[f"_k{name}"]) & (asked[page] == side[f"_n{name}"]), "left").drop(f"_k{name}", f"_n{name}")
    asked = asked.withColumn("_c", F.coalesce("_0", "_1", "_2"))
    missing = F.col("_c").isNull()
    said = {c: F.when(missing & F.lit(strict), "NEEDS_REVIEW").otherwise(F.coalesce(F.nullif(F.trim(F.col(f"_c.{c}")), F.lit("")), c)) for c in columns}
    return asked.select(*[said[c].alias(c) if c in said else F.col(c) for c in df.columns], F.when(missing, "MISSING").otherwise("APPLIED").alias("contract_status"))


def cover_with(df: DataFrame, overlay: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by those of an overlay where it says something (not null, not blank)."""
    over = overlay.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(over, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), c).alias(c) if c in columns else F.col(c) for c in df.columns])


def worst_first(df: DataFrame, rank: Column, keys: Sequence[str], most: int = 50) -> DataFrame:
    """The first rows by rank and keys; Spark takes ``most`` in each task, then of those."""
    return df.orderBy(rank, *keys).limit(most)


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row for each key, the least by the order; partial results in each task."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *columns)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])


def within_budget(df: DataFrame, group: str, size: str, recency: Sequence[str], cap: float, newest_first: bool = True) -> DataFrame:
    """What a cache keeps: the most recent entries of each group whose running size stays within the cap."""
    order = [F.desc(c) if newest_first else F.asc(c) for c in recency]
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(exact(size)).over(w)).withColumn("kept", F.col("running") <= cap).withColumn("running", F.col("running").cast("double"))


def latest_wins(df: DataFrame, group: str, ts: str, order: str, wait_ms: int) -> DataFrame:
    """Events that no newer one of their group follows within the wait: what a debounced handler acts on."""
    following = F.lead(ts).over(Window.partitionBy(group).orderBy(ts, order))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > wait_ms * 1000)).drop("_gap")


def against_prior(df: DataFrame, keys: Sequence[str], order: Sequence[str], ms: str) -> DataFrame:
    """Each run with the run before it and the growth; the first has none."""
    prior = F.lag(ms).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("prior", prior).withColumn("growth", F.round(F.when(F.col("prior") > 0, F.col(ms) / F.col("prior") - 1), 6))


def pairwise(df: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """Mean and greatest absolute difference of each pair of a group's vectors, in order of items."""
    a, b = (df.select(group, F.col(item).alias(f"{s}_item"), F.col(vector).alias(f"{s}_vector")) for s in "ab")
    both = a.join(b, group).where("a_item < b_item")
    d = F.zip_with("a_vector", "b_vector", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    both = both.select(group, "a_item", "b_item", d.alias("d"))
    mean = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x) / F.size("d")
    return both.select(group, "a_item", "b_item", F.round(mean, 6).alias("mae"), F.round(F.array_max("d"), 6).alias("most"))


def centre_rank(pairs: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """Items by their mean difference from the others of the group; rank 1 plus the number of better ones."""
    one = pairs.select(group, F.explode(F.array(F.struct(F.col(a).alias("item"), score), F.struct(F.col(b).alias("item"), score))).alias("x")).select(group, "x.item", f"x.{score}")
    mean = one.groupBy(group, "item").agg(F.round(F.sum(F.col(score).cast("decimal(20,6)")).cast("double") / F.count("*"), 8).alias("centre"))
    return mean.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy("centre")))


def vote(compared: Column, agreeing: Column) -> Column:
    """PASS for a majority of at least two comparisons, PASS_ONE for any agreement, else DIFF."""
    return F.when((compared >= 2) & (2 * agreeing > compared), "PASS").when(agreeing > 0, "PASS_ONE").otherwise("DIFF")


def ssim(x: str, y: str, n: str = "n") -> Mapping[str, Column]:
    """Aggregates of global structural similarity over samples of 0 to 255 (constants of the definition)."""
    c1, c2 = 6.5025, 58.5225
    mx, my, vx, vy, cov = F.avg(x), F.avg(y), F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    value = F.when(F.count("*") > 1, (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).otherwise(F.lit(1.0))
    return {n: F.count("*"), "ssim": F.round(value, 4)}

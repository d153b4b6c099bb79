"""Corpus analytics over events, line items, orders, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import classify as C
from vellum.operators import corpus as O
from vellum.sources.tables import load

#: Line items stand for page scans: OR and OA passed, FR is a difference, the rest are failures.
_RESULT_SQL = "CASE WHEN l_linestatus || l_returnflag IN ('OR', 'OA') THEN 'PASS' WHEN l_linestatus || l_returnflag = 'FR' THEN 'DIFF' ELSE 'FAIL' END"
_D = "CAST({0} AS DECIMAL(20,4))"


def _scan(spark, sf_dir):
    status = F.concat("l_linestatus", "l_returnflag")
    return load(spark, sf_dir, "lineitem").withColumn("status", F.when(status.isin("OR", "OA"), "PASS").when(status == "FR", "DIFF").otherwise("FAIL"))


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events")


def status_counts(spark, sf_dir):
    return O.histogram(_scan(spark, sf_dir), "l_linestatus", "l_returnflag")


def scan_summary(spark, sf_dir):
    s = _scan(spark, sf_dir)
    return s.agg(F.count("*").alias("pages"), F.countDistinct("l_orderkey").alias("files"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "DIFF").alias("different"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.max("l_discount").alias("most_diff"))


def expectation_join(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "pdf/").otherwise(""), F.col("doc_id").cast("string")).alias("path"))
    e = load(spark, sf_dir, "labels").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "pdf/").otherwise(""),
        F.col("doc_id").cast("string")).alias("path"), F.when(F.col("toxic") == 1, "DIFF").when(F.col("quality") == 0, "*").otherwise("PASS").alias("expected"))
    out = O.lookup_with_fallback(d, e, "path", "pdf/", "expected")
    actual = F.when(F.col("doc_id") % 5 == 0, "DIFF").otherwise("PASS")
    result = F.when(F.col("expected").isNull(), "UNEXPECTED").when((F.col("expected") == "*") | (F.col("expected") == actual), "PASS").otherwise("MISMATCH")
    return out.select("doc_id", "path", "expected", result.alias("result"))


def contract_overlay(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    over = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "junk").otherwise(" ").alias("lang"), F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return O.cover_with(d, over, "doc_id", ["lang", "source"])


def phase_hotspots(spark, sf_dir):
    return O.hotspots(_events(spark, sf_dir), "event_type", "value")


def percentile_gate(spark, sf_dir):
    e = _events(spark, sf_dir)
    g = e.groupBy("event_type").agg(F.max("value").alias("most")).join(O.percentiles(e, ["event_type"], "value", {"p95": 0.95}), "event_type")
    return g.select("event_type", "p95", "most", ((F.col("p95") <= 150) & (F.col("most") <= 450)).alias("ok"))


def corpus_hotspots_unpivot(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem")
    timers = s.select("l_orderkey", (F.col("l_tax") * 100).alias("parse"), (F.col("l_discount") * 100).alias("text"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("render"))
    rest = F.greatest(F.lit(0.0), F.lit(40.0) - F.col("parse") - F.col("text") - F.coalesce("render", F.lit(0.0)))
    long = O.unpivoted(timers.withColumn("overhead", rest), "l_orderkey", ["parse", "text", "render", "overhead"])
    return long.groupBy("timer").agg(F.count("*").alias("n"), F.sum(F.round("ms", 2).cast("decimal(20,2)")).cast("double").alias("total"), F.max(F.round("ms", 2)).alias("most"))


def workflow_summary(spark, sf_dir):
    e = _events(spark, sf_dir)
    bad = F.get_json_object("props", "$.k").cast("int") >= 90
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(bad).alias("errors"),
        F.sum(O.exact("value")).cast("double").alias("total"))
    return out.join(O.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")


def first_per_group(spark, sf_dir):
    return O.first_per_group(_events(spark, sf_dir), "user_id", "value", "event_id")


def min_of_n(spark, sf_dir):
    return O.least_of_runs(_events(spark, sf_dir), ["user_id", "event_type"], "value", F.get_json_object("props", "$.k").cast("int") >= 90)


def budget_gate(spark, sf_dir):
    e = _events(spark, sf_dir)
    budget = O.percentiles(e, ["event_type"], "value", {"budget": 0.02})
    return O.budget_gate(min_of_n(spark, sf_dir), budget, ["event_type"], 1.25, 2.0, 0.5).select("event_type", "least", "budget", "ratio",
        "verdict").groupBy("event_type", "verdict").agg(F.count("*").alias("n"), F.max("ratio").alias("worst"))


def triage_clusters(spark, sf_dir):
    s = _scan(spark, sf_dir).where("status <> 'PASS'")
    ref = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("#"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return O.triage_clusters(s, ["l_linestatus", "l_returnflag", "l_linenumber"], ref, "l_orderkey")


def _vectors(spark, sf_dir):
    # a group is a page that several renderers drew: five vectors for each
    return load(spark, sf_dir, "embeddings").withColumn("page", F.floor(F.col("vec_id") / 5).cast("long"))


def pairwise_disagreement(spark, sf_dir):
    p = O.pairwise(_vectors(spark, sf_dir), "page", "vec_id", "embedding")
    return p.groupBy("page").agg(F.count("*").alias("pairs"), F.count_if(F.col("mae") > 0.15).alias("disagreeing"), F.max("most").alias("most"))


def centre_rank(spark, sf_dir):
    return O.centre_rank(O.pairwise(_vectors(spark, sf_dir), "page", "vec_id", "embedding"), "page", "a_item", "b_item", "mae")


def majority_vote(spark, sf_dir):
    d = pairwise_disagreement(spark, sf_dir)
    return d.select("page", O.vote(F.col("pairs"), F.col("pairs") - F.col("disagreeing")).alias("vote"))


def _samples(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    pair = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")).join(v, "vec_id")
    z = pair.select("vec_id", F.explode(F.arrays_zip("embedding", "other")).alias("z"))
    byte = lambda c: F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), c.cast("double"))) + 0.5) * 255)
    return z.select("vec_id", byte(F.col("z.embedding")).alias("x"), byte(F.col("z.other")).alias("y"))


def image_metrics(spark, sf_dir):
    d = F.abs(F.col("x") - F.col("y"))
    return _samples(spark, sf_dir).groupBy("vec_id").agg(F.round(F.count_if(d > 16) / F.count("*"), 6).alias("diff_fraction"),
        F.round(F.avg(d), 4).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 4).alias("rmse"), F.max(d).alias("most"))


def ssim_global(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("vec_id").agg(*[c.alias(k) for k, c in O.ssim("x", "y").items()])


def top_nonpass(spark, sf_dir):
    s = _scan(spark, sf_dir).where("status <> 'PASS'")
    rank = F.when(F.col("status") == "FAIL", 0).otherwise(1)
    return O.worst_first(s.select("l_orderkey", "l_linenumber", "status", "l_partkey", "l_suppkey"), rank, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def best_reference(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem")
    order = [F.col("l_discount").isNull(), F.col("l_discount").alias("_d"), F.col("l_tax").alias("_t")]
    return O.best_by(s, ["l_orderkey"], order, ["l_linenumber", "l_suppkey"])


def lru_eviction(spark, sf_dir):
    e = O.within_budget(_events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), "user_id", "value", ["ts", "event_id"], 400)
    return e.select("event_id", "user_id", F.round("running", 2).alias("running"), "kept")


def cache_trim(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type <> 'signup'").select("event_id", "user_id", "ts", "value")
    total = e.groupBy("user_id").agg(F.sum(O.exact("value")).alias("total"))
    run = O.within_budget(e, "user_id", "value", ["ts", "event_id"], 0, newest_first=False).join(total, "user_id")
    # the oldest go until what is left fits: an entry goes if what stood before it was too much
    gone = F.col("total").cast("double") - F.col("running") + F.col("value") > 300
    return run.groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(gone).alias("deleted"))


def debounce_latest(spark, sf_dir):
    return O.latest_wins(_events(spark, sf_dir), "user_id", "ts", "event_id", 150).select("event_id", "user_id")


def prior_run_growth(spark, sf_dir):
    e = O.against_prior(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return e.select("event_id", "prior", "growth")


#: Columns of scan entries, in SQL that Spark and DuckDB read alike; lines of orders stand for pages of files.
_STATUSES = ("PASS", "PASS_ONE", "DIFF", "MISSING_CONTENT", "ALL_ORACLES_REFUSED", "MALFORMED_PDF", "PASSWORD_REQUIRED", "RESOURCE_LIMIT", "TIMEOUT",
    "RECOVERED_MALFORMED_CONTENT", "PASS_ONE", "PASS")
_STATUS = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STATUSES)) + " END"
_ENTRY = {
    "status": _STATUS, "path": "l_orderkey", "page": "l_linenumber", "result": "CASE l_suppkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' END",
    "best": "concat('r', l_partkey % 3)", "agreeing": "l_suppkey % 3", "compared": "CASE WHEN l_partkey % 5 < 4 THEN l_partkey % 5 END",
        "pairs": "CASE WHEN l_orderkey % 5 < 4 THEN l_orderkey % 5 END",
    "disagreeing": "CASE WHEN l_suppkey % 7 < 6 THEN l_suppkey % 4 END", "rank": "l_suppkey % 5",
        "release": "CASE l_orderkey % 6 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'OK' END",
    "rendered": "l_suppkey % 3 > 0", "error_type": "CASE l_partkey % 7 WHEN 0 THEN 'recovered' WHEN 1 THEN '' END",
        "expectation": "CASE l_partkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END",
    "known": "l_partkey % 4 > 0", "primary": "CASE l_suppkey % 5 WHEN 0 THEN ' ' ELSE concat('r', l_suppkey % 3) END",
    "review": "CASE l_orderkey % 5 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'GENERATED' WHEN 2 THEN 'NEEDS_REVIEW' END",
        "root_cause": "CASE WHEN l_partkey % 11 = 0 THEN 'FULL_CORPUS_BASELINE' ELSE 'FONT' END",
    "reason": "CASE l_suppkey % 6 WHEN 0 THEN 'Auto-Classified' WHEN 1 THEN ' ' WHEN 2 THEN 'looks right' END",
        "notes": "CASE l_orderkey % 7 WHEN 0 THEN 'seen' WHEN 1 THEN 'promote to a reviewed contract' END",
    "target_reason": "CASE WHEN l_partkey % 13 = 0 THEN 'the Baseline' END", "has_target": "l_partkey % 3 > 0",
        "impact": "CASE l_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN ' ' END",
    "category": "CASE l_suppkey % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'none' END",
}
_ORACLES = [f"CASE (l_partkey + {i} * l_suppkey) % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'REFUSED' END" for i in range(1, 4)]
_TIMES = {"elapsed_ms": "CASE WHEN l_partkey % 9 > 0 THEN l_suppkey % 300 END"}
for _i, _r in enumerate(O.RENDERERS):
    _TIMES |= {
        f"{_r}_ms": f"CASE WHEN (l_partkey + {_i}) % 4 > 0 THEN (l_suppkey + {_i} * l_partkey) % 90 END",
            f"{_r}_cached_ms": f"CASE WHEN (l_suppkey + {_i}) % 3 = 0 THEN l_partkey % 70 END",
        f"{_r}_hit": f"CASE (l_orderkey + {_i}) % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    }


def _entries(spark, sf_dir, columns=None):
    columns = _ENTRY if columns is None else columns
    out = load(spark, sf_dir, "lineitem").select("*", F.array(*[F.expr(o) for o in _ORACLES]).alias("oracles"))
    return out.select("oracles", *[F.expr(sql).alias(name) for name, sql in columns.items()])


def _column_map(names):
    return {n: F.col(n) for n in names}


def visual_diff_category(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem")
    m = _column_map(_VISUAL_INPUTS)
    d = s.select(*[F.expr(sql).cast("double").alias(n) for n, sql in _VISUAL_INPUTS.items()])
    d = d.select("*", C.visual_difference(m).alias("kind"))
    return d.select("kind", C.impact(F.col("kind"), F.col("diff"), F.col("mae")).alias("impact")).groupBy("kind", "impact").agg(F.count("*").alias("n"))


_VISUAL_INPUTS = {
    "diff": "(l_partkey % 20) * 0.01", "mae": "l_suppkey % 30", "luminance": "(l_partkey + l_suppkey) % 40", "chroma": "l_orderkey % 25",
        "region": "l_partkey % 300", "region_width": "l_suppkey % 40",
    "region_height": "l_linenumber", "region_density": "(l_orderkey % 10) * 0.1", "dark_balance": "(l_suppkey % 5) * 0.25",
        "pixels": "CASE WHEN l_linenumber % 2 = 0 THEN 9000 ELSE 20000 END",
}


def failure_class(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem")
    d = s.select(*[F.expr(sql).alias(n) for n, sql in _FAILURE_INPUTS.items()])
    messages, kinds = F.array("message", F.coalesce("cause", F.lit(""))), F.array("error", F.coalesce("cause_kind", F.lit("")))
    return d.select("phase", C.failure(F.col("phase"), F.col("error"), messages, kinds, F.col("stack")).alias("class")).groupBy("phase", "class").agg(F.count("*").alias("n"))


_ERRORS = ("geometry", "limit", "encryption", "data", "parse", "overflow", "format", "unsupported", "io")
_FAILURE_INPUTS = {
    "phase": "CASE WHEN l_linenumber % 2 = 0 THEN 'open' ELSE 'render' END",
        "error": "CASE l_partkey % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ERRORS)) + " END",
    "message": "CASE l_suppkey % 5 WHEN 0 THEN 'Password verification failed' WHEN 1 THEN 'bad ZLIB header' WHEN 2 THEN 'unsupported filter X' "
        "WHEN 3 THEN 'requiring a non-empty user password' ELSE 'failed' END",
    "cause": "CASE l_orderkey % 4 WHEN 0 THEN 'compressed data' WHEN 1 THEN 'no such filter' END",
        "cause_kind": "CASE l_orderkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'unsupported' END",
    "stack": "CASE l_suppkey % 11 WHEN 0 THEN 'at X.Filters.Y' WHEN 1 THEN 'at StreamDecompressor' ELSE 'at Z' END",
}


def quality_ladders(spark, sf_dir):
    e = _entries(spark, sf_dir)
    m = _column_map(_ENTRY)
    out = C.quality_ladders(m, m, strict=True)
    proposed = F.when(F.col("rank") == 0, "MATCHES_NONE").when(F.col("rank") == 1, "MATCHES_SOME").otherwise("MATCHES_ALL_REQUIRED")
    out["settled"] = C.settled_agreement(F.col("status"), proposed, out["pixel_agreement"])
    return e.select(*[c.alias(n) for n, c in out.items()]).groupBy(*out).agg(F.count("*").alias("n"))


def triage_partition(spark, sf_dir):
    from vellum.operators.records import triage

    part, listed = triage(F.col("status"), F.col("rendered"), F.col("oracles"), F.col("error_type"))
    return _entries(spark, sf_dir).select(part.alias("part"), listed.alias("list"), "status").where("part IS NOT NULL").groupBy("part", "list",
        "status").agg(F.count("*").alias("n"))


def scan_maps(spark, sf_dir):
    e = _entries(spark, sf_dir)
    every, bad = F.lit(True), F.coalesce(F.col("status") != "PASS", F.lit(True))
    passing = F.when(F.col("status").isin("PASS", "PASS_ONE"), "PASS").otherwise(F.col("status"))
    result = F.when(F.coalesce(F.col("result"), F.lit("UNKNOWN")) == "UNKNOWN", passing).otherwise(F.col("result"))
    return O.count_maps(e, {
        "status": (every, F.col("status")), "result": (every, result), "category": (every, O.named(F.col("category"), "unclassified")),
            "impact": (bad, O.named(F.col("impact"), "unclassified")),
        "visual": (bad, O.named(F.col("category"), "unclassified")), "disagreement": (every, C.disagreement_bucket(F.col("pairs"), F.col("disagreeing"))),
    })


def scan_counts(spark, sf_dir):
    bad = F.col("status") != "PASS"
    return _entries(spark, sf_dir).agg(
        F.count_if(bad).alias("nonpass"), F.count_if(F.col("expectation") == "PASS").alias("expected_pass"), F.count_if(F.col("expectation") == "FAIL").alias("expected_fail"),
        F.count_if(F.col("status") == "DIFF").alias("true_diff"), F.count_if(F.col("status") == "PASS_ONE").alias("pass_one"),
    )


def render_hotspots(spark, sf_dir):
    phases = O.render_phases(_entries(spark, sf_dir, _TIMES))
    return O.hotspots(phases, "phase", "ms").withColumn("workload", O.workload(F.regexp_replace("phase", "^r[0-9]-", "reference-")))


def render_cache_counts(spark, sf_dir):
    return O.cache_counts(_entries(spark, sf_dir, _TIMES))


def review_clusters(spark, sf_dir):
    e = _entries(spark, sf_dir).where("status = 'PASS_ONE'")
    m = _column_map(_ENTRY)
    ladders = C.quality_ladders(m, m)
    ref = F.concat(F.lpad(F.col("path").cast("string"), 10, "0"), F.lit("#"), F.lpad(F.col("page").cast("string"), 2, "0"))
    rows = e.select(
        ladders["review"].alias("review"), "root_cause", ladders["target_basis"].alias("target_basis"),
            O.named(F.col("primary"), "none").alias("target"), ladders["references"].alias("references"),
        O.named(F.col("impact"), "none").alias("impact"), O.named(F.col("category"), "none").alias("category"), "best",
            F.when(F.col("known"), "known").otherwise("missing").alias("contract"), ref.alias("ref"), "path",
    )
    return O.triage_clusters(rows, [c for c in rows.columns if c not in ("ref", "path")], F.col("ref"), "path")


def budget_keys(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("pdf"), "l_partkey")
    return O.compared_keys(s.where("pdf % 3 > 0"), s.where("l_partkey % 7 > 0"), "step", "pdf")


def worst_contributor(spark, sf_dir):
    e = _events(spark, sf_dir)
    budget = O.percentiles(e, ["event_type"], "value", {"budget": 0.02})
    gate = O.budget_gate(min_of_n(spark, sf_dir), budget, ["event_type"], 1.25, 2.0, 0.5)
    users = min_of_n(spark, sf_dir).join(budget, "event_type").select("event_type", "user_id", F.round(F.col("least") / F.col("budget"), 6).alias("ratio"))
    return O.gated(users, ["event_type"], "ratio", "user_id").join(gate.groupBy("event_type").agg(F.count_if(F.col("verdict") == "FAIL").alias("failed")), "event_type")


def colour_metrics(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    pair = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")).join(v, "vec_id")
    byte = lambda c: F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), c.cast("double"))) + 0.5) * 255)
    places = F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)
    z = pair.select("vec_id", "embedding", "other", F.explode(places).alias("i"))
    rows = z.select("vec_id", *[byte(F.get(side, (3 * F.col("i") + k).cast("int"))).alias(f"{s}{c}") for s, side in (("a", "embedding"), ("b",
        "other")) for k, c in enumerate("rgb")])
    return O.difference_metrics(rows, ["vec_id"])


def responsiveness_rollup(spark, sf_dir):
    p = O.percentiles(_events(spark, sf_dir), ["user_id", "event_type"], "value", {"p90": 0.9})
    return p.groupBy("user_id").agg(F.when(F.bool_or(F.col("p90") > 200), "Fail").when(F.bool_or(F.col("p90") > 120),
        "Warn").otherwise("Pass").alias("status"), F.max("p90").alias("worst"))


QUERIES = {f.__name__: f for f in (scan_maps, scan_counts, render_hotspots, render_cache_counts, review_clusters, budget_keys, worst_contributor,
    colour_metrics, status_counts, scan_summary, expectation_join, contract_overlay, phase_hotspots, percentile_gate, corpus_hotspots_unpivot,
        workflow_summary, first_per_group, min_of_n, budget_gate, triage_clusters, pairwise_disagreement, centre_rank, majority_vote, image_metrics,
            ssim_global, top_nonpass, best_reference, lru_eviction, cache_trim, debounce_latest, prior_run_growth, visual_diff_category,
                failure_class, quality_ladders, triage_partition, responsiveness_rollup)}

_BAD = "CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90"
_MIN = f"SELECT user_id, event_type, min(value) FILTER (NOT ({_BAD})) AS least, count_if(NOT ({_BAD})) AS runs, count_if({_BAD}) AS failures FROM events GROUP BY ALL"
_PAIRS = """WITH v AS (SELECT vec_id // 5 AS page, vec_id, embedding FROM embeddings),
d AS (SELECT a.page, a.vec_id AS i, b.vec_id AS j, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))) AS d FROM v a JOIN v b ON a.page = b.page AND a.vec_id < b.vec_id),
p AS (SELECT page, i, j, round(list_reduce(d, lambda x, y: x + y) / len(d), 6) AS mae, round(list_max(d), 6) AS most FROM d)"""
_BYTE = "CAST(floor((greatest(-0.5, least(0.5, CAST({0} AS DOUBLE))) + 0.5) * 255) AS BIGINT)"
_SAMPLES = f"""WITH z AS (SELECT b.vec_id, unnest(list_zip(b.embedding, a.embedding)) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {_BYTE.format('z[1]')} AS x, {_BYTE.format('z[2]')} AS y FROM z)"""


def _select(columns: dict[str, str], source: str = "lineitem") -> str:
    return "SELECT " + ", ".join(f'{sql} AS "{n}"' for n, sql in columns.items()) + f" FROM {source}"


_VISUAL = """CASE WHEN diff = 0 THEN 'none' WHEN diff <= 0.002 AND mae <= 2 THEN 'minor-noise-or-antialiasing' WHEN luminance <= 18 AND mae <= 24 THEN 'color-tone-or-texture'
WHEN mae <= 12 AND chroma >= 12 AND dark_balance >= 0.75 THEN 'color-tone-or-texture'
WHEN share >= 0.01 AND (region_density < 0.3 OR aspect >= 8) AND dark_balance >= 0.75 AND mae <= 20 THEN 'localized-linework-or-texture'
WHEN share >= 0.01 AND region_density >= 0.6 AND chroma >= 12 AND diff <= 0.35 THEN 'localized-color-or-image-content'
WHEN share >= 0.01 AND region_density < 0.5 AND mae >= 8 THEN CASE
WHEN pixels <= 10000 AND region < 100 AND dark_balance >= 0.5 THEN 'small-text-antialiasing' ELSE 'localized-text-or-geometry' END
WHEN pixels <= 10000 AND region < 100 AND diff >= 0.005 AND dark_balance >= 0.5 THEN 'small-text-antialiasing' WHEN share >= 0.01 AND mae >= 12 THEN 'localized-content-or-geometry'
WHEN diff >= 0.08 AND mae >= 12 THEN 'structural-or-missing-content-candidate' ELSE 'mixed' END"""
_IMPACT = """CASE WHEN kind = 'none' THEN 'none' WHEN kind IN ('minor-noise-or-antialiasing', 'small-text-antialiasing') THEN 'low'
WHEN kind = 'color-tone-or-texture' AND mae <= 16 THEN 'low'
WHEN kind IN ('color-tone-or-texture', 'localized-color-or-image-content', 'localized-linework-or-texture') THEN 'medium'
WHEN kind = 'structural-or-missing-content-candidate' THEN 'high'
WHEN kind IN ('localized-text-or-geometry', 'localized-content-or-geometry') THEN CASE WHEN diff >= 0.03 THEN 'high' ELSE 'medium' END
WHEN diff <= 0.01 AND mae <= 5 THEN 'low' WHEN diff >= 0.08 AND mae >= 16 THEN 'high' ELSE 'medium' END"""
_LOCKED_SQL = "regexp_matches(said, 'password verification failed|requires a non-empty user password|requiring a non-empty user password')"
_FAILURE = f"""CASE WHEN error = 'geometry' THEN 'INVALID_PAGE_GEOMETRY' WHEN error = 'limit' THEN 'RESOURCE_LIMIT'
WHEN phase = 'open' THEN CASE WHEN error = 'encryption' THEN CASE WHEN {_LOCKED_SQL} THEN 'PASSWORD_REQUIRED' ELSE 'UNSUPPORTED_ENCRYPTED' END
  WHEN error = 'data' AND regexp_matches(said, 'compression|compressed|deflate|zlib|unsupported filter|unsupported stream') THEN 'UNSUPPORTED_COMPRESSION' WHEN error IN ('data', 'parse', 'overflow', 'format') THEN 'MALFORMED_PDF' ELSE 'PARSE_ERROR' END
WHEN error IN ('parse', 'data') OR coalesce(cause_kind, '') IN ('parse', 'data') OR (error = 'unsupported' AND contains(lower(message), 'filter')) OR (coalesce(cause_kind, '') = 'unsupported' AND contains(lower(cause), 'filter'))
  OR contains(stack, 'StreamDecompressor') OR contains(stack, '.Filters.') THEN 'DECODE_ERROR' ELSE 'RENDER_ERROR' END"""
_RANK = {k: f"coalesce({k}, 0)" for k in ("agreeing", "compared", "pairs", "disagreeing", "rank")}
_OUTLIER = f"""(status = 'PASS_ONE' AND {_RANK['compared']} >= 3 AND (({_RANK['agreeing']} = 1 AND {_RANK['pairs']} > 0 AND {_RANK['disagreeing']} = 0) OR ({_RANK['agreeing']} <= 1 AND {_RANK['rank']} >= 3)))"""
_DEGENERATE = "'MALFORMED_PDF', 'EMPTY_DOC', 'PASSWORD_REQUIRED', 'INVALID_PAGE_GEOMETRY'"


def _ladders(strict: bool) -> str:
    unknown = "WHEN NOT known THEN 'NEEDS_REVIEW'" if strict else ""
    return f"""q AS (SELECT *, CASE {unknown} WHEN status = 'PASS' THEN 'PIXEL_EXACT' WHEN status = 'PASS_ONE' THEN 'MATCHES_ACCEPTED_REFERENCE'
WHEN status = 'ALL_ORACLES_REFUSED' THEN 'REFERENCE_REFUSAL_ACCEPTED'
  WHEN status IN ('RECOVERED_MALFORMED_CONTENT', 'RESOURCE_LIMIT', {_DEGENERATE}) THEN 'NON_RENDERABLE_ACCEPTED' WHEN status = 'DIFF' THEN 'FAIL'
WHEN result = 'PASS' THEN 'GOOD_ENOUGH' ELSE 'FAIL' END AS quality FROM e),
l AS (SELECT *, CASE WHEN status = 'PASS' THEN 'MATCHES_ALL_REQUIRED' WHEN status = 'PASS_ONE' THEN CASE
WHEN trim("primary") <> '' AND best = "primary" THEN 'MATCHES_TARGET' WHEN agreeing = 1 THEN 'MATCHES_ONE_REFERENCE' ELSE 'MATCHES_SOME' END
  WHEN status = 'DIFF' THEN 'MATCHES_NONE' ELSE 'NOT_COMPARABLE' END AS pixel_agreement,
  CASE WHEN status = 'ALL_ORACLES_REFUSED' THEN 'REFS_REFUSE' WHEN {_RANK['compared']} = 0 THEN 'REFS_INCOMPLETE'
WHEN disagreeing > 0 THEN 'REFS_DISAGREE' ELSE 'REFS_AGREE' END AS "references",
  CASE WHEN status IN ({_DEGENERATE}) THEN 'MALFORMED_INPUT_POLICY' WHEN status IN ('RESOURCE_LIMIT', 'TIMEOUT') THEN 'RESOURCE_POLICY'
WHEN status = 'ALL_ORACLES_REFUSED' THEN 'QUALITY_STANDARD' WHEN status = 'PASS_ONE' THEN 'REFERENCE_DISAGREEMENT' ELSE 'REFERENCE_CONSENSUS' END AS target_basis,
  CASE status WHEN 'DIFF' THEN 'P1' WHEN 'PASS_ONE' THEN 'P2' ELSE 'NONE' END AS priority, CASE WHEN status = 'PASS' THEN 'HIGH'
WHEN status = 'PASS_ONE' AND {_RANK['compared']} < 3 THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN status <> 'PASS_ONE' THEN 'NOT_APPLICABLE' WHEN release IN ('BLOCKED', 'FAIL') OR quality = 'FAIL' THEN 'REJECTED'
WHEN NOT known THEN 'UNREVIEWED' WHEN review = 'REVIEWED' THEN 'ACCEPTED' WHEN review IN ('GENERATED', 'NEEDS_REVIEW') THEN 'UNREVIEWED'
    WHEN root_cause = 'FULL_CORPUS_BASELINE' OR regexp_matches(lower(concat_ws(' | ', reason, notes, target_reason)), 'baseline|auto-classified|promote to a reviewed contract') THEN 'UNREVIEWED' WHEN {_OUTLIER} OR NOT has_target THEN 'UNREVIEWED'
    WHEN trim(coalesce(reason, '')) = '' AND trim(coalesce(notes, '')) = '' THEN 'UNREVIEWED' ELSE 'ACCEPTED' END AS review_status, {_OUTLIER} AS outlier FROM q)"""


_ORACLE_LIST = "[" + ", ".join(_ORACLES) + "]"
_ENTRIES = "e AS (" + _select(_ENTRY).replace("SELECT ", f"SELECT {_ORACLE_LIST} AS oracles, ", 1) + ")"
_PASSING = "CASE WHEN status IN ('PASS', 'PASS_ONE') THEN 'PASS' ELSE status END"
_PHASES = "t AS (" + _select(_TIMES) + "), p AS (" + " UNION ALL ".join(
    [f"SELECT CASE WHEN {r}_hit THEN '{r}-cache-read' ELSE '{r}-render' END AS phase, {r}_ms AS ms FROM t UNION ALL "
        f"SELECT '{r}-cached-original', {r}_cached_ms FROM t" for r in O.RENDERERS]
    + [f"SELECT '{O.OVERHEAD}', CASE WHEN elapsed_ms IS NOT NULL THEN greatest(0, elapsed_ms - (" + " + ".join(f"coalesce({r}_ms, 0)" for r in O.RENDERERS) + ")) END FROM t"]
) + "), h AS (SELECT * FROM p WHERE ms IS NOT NULL)"
_WORKLOAD = f"CASE WHEN starts_with(phase, 'own-render') THEN 'renderer.page-render' WHEN regexp_matches(phase, '^r[0-9]-') THEN 'reference.external-render' WHEN phase = '{O.OVERHEAD}' THEN 'corpus.compare-classify' ELSE 'unknown' END"
_RGB = [f"CAST(floor((greatest(-0.5, least(0.5, CAST({s}[3 * i + {k + 1}] AS DOUBLE))) + 0.5) * 255) AS BIGINT) AS {t}{c}" for t,
    s in (("a", "mine"), ("b", "other")) for k, c in enumerate("rgb")]

ORACLES = {
    "status_counts": "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
    "scan_summary": f"SELECT count(*) AS pages, count(DISTINCT l_orderkey) AS files, count_if(s = 'PASS') AS passed, count_if(s = 'DIFF') AS different, count_if(s = 'FAIL') AS failed, max(l_discount) AS most_diff FROM (SELECT *, {_RESULT_SQL} AS s FROM lineitem)",
    "expectation_join": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf/' ELSE '' END || doc_id AS path FROM documents),
e AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'pdf/' ELSE '' END || doc_id AS path, CASE WHEN toxic = 1 THEN 'DIFF' WHEN quality = 0 THEN '*' ELSE 'PASS' END AS expected FROM labels),
j AS (SELECT d.*, coalesce((SELECT expected FROM e WHERE e.path = d.path), (SELECT expected FROM e WHERE e.path = 'pdf/' || d.path), (SELECT expected
FROM e WHERE d.path = 'pdf/' || e.path)) AS expected FROM d)
SELECT doc_id, path, expected, CASE WHEN expected IS NULL THEN 'UNEXPECTED' WHEN expected = '*' OR expected = CASE WHEN doc_id % 5 = 0 THEN 'DIFF'
ELSE 'PASS' END THEN 'PASS' ELSE 'MISMATCH' END AS result FROM j""",
    "contract_overlay": "SELECT doc_id, CASE WHEN quality = 0 THEN 'junk' ELSE lang END AS lang, CASE WHEN toxic = 1 THEN 'toxic' "
        "ELSE source END AS source FROM documents LEFT JOIN labels USING (doc_id)",
    "phase_hotspots": f"SELECT event_type, count(*) AS n, CAST(sum({_D.format('value')}) AS DOUBLE) AS total, round(CAST(sum({_D.format('value')}) AS DOUBLE) / count(*), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(CAST(sum({_D.format('value')}) AS DOUBLE) / CAST(sum(sum({_D.format('value')})) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type",
    "percentile_gate": "SELECT event_type, quantile_disc(value, 0.95) AS p95, max(value) AS most, quantile_disc(value, 0.95) <= 150 AND max(value) <= 450 AS ok FROM events GROUP BY event_type",
    "corpus_hotspots_unpivot": """WITH t AS (SELECT l_tax * 100 AS parse, l_discount * 100 AS text, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS render FROM lineitem),
o AS (SELECT *, greatest(0.0, 40.0 - parse - text - coalesce(render, 0.0)) AS overhead FROM t)
SELECT timer, count(*) AS n, CAST(sum(CAST(round(ms, 2) AS DECIMAL(20,2))) AS DOUBLE) AS total, max(round(ms, 2)) AS most
FROM (UNPIVOT o ON parse, text, render, overhead INTO NAME timer VALUE ms) GROUP BY timer""",
    "workflow_summary": f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count_if({_BAD}) AS errors, CAST(sum({_D.format('value')}) AS DOUBLE) AS total, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "first_per_group": "SELECT user_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id",
    "min_of_n": _MIN,
    "budget_gate": f"WITH m AS ({_MIN}), b AS (SELECT event_type, quantile_disc(value, 0.02) AS budget FROM events GROUP BY 1), "
        f"v AS (SELECT event_type, least / budget AS ratio, CASE WHEN least IS NULL THEN 'SKIP' "
            f"WHEN least / budget > 2.0 AND least - budget > 0.5 THEN 'FAIL' WHEN least / budget > 1.25 AND least - budget > 0.5 THEN 'WARN' "
                f"ELSE 'PASS' END AS verdict FROM m JOIN b USING (event_type)) SELECT event_type, verdict, count(*) AS n, max(round(ratio, 6)) AS worst FROM v GROUP BY ALL",
    "triage_clusters": f"WITH s AS (SELECT *, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '#' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS ref "
        f"FROM lineitem WHERE {_RESULT_SQL} <> 'PASS') "
            f"SELECT l_linestatus, l_returnflag, l_linenumber, count(*) AS n, count(DISTINCT l_orderkey) AS files, array_to_string((list(ref "
                f"ORDER BY ref))[1:12], ',') AS refs FROM s GROUP BY ALL",
    "pairwise_disagreement": _PAIRS + " SELECT page, count(*) AS pairs, count_if(mae > 0.15) AS disagreeing, max(most) AS most FROM p GROUP BY page",
    "centre_rank": _PAIRS + ", o AS (SELECT page, i AS item, mae FROM p UNION ALL SELECT page, j, mae FROM p), "
        "c AS (SELECT page, item, round(CAST(sum(CAST(mae AS DECIMAL(20,6))) AS DOUBLE) / count(*), 8) AS centre FROM o GROUP BY ALL) "
            "SELECT *, CAST(rank() OVER (PARTITION BY page ORDER BY centre) AS INTEGER) AS rank FROM c",
    "majority_vote": _PAIRS + ", g AS (SELECT page, count(*) AS c, count_if(mae <= 0.15) AS a FROM p GROUP BY page) SELECT page, CASE "
        "WHEN c >= 2 AND 2 * a > c THEN 'PASS' WHEN a > 0 THEN 'PASS_ONE' ELSE 'DIFF' END AS vote FROM g",
    "image_metrics": _SAMPLES + " "
        "SELECT vec_id, round(count_if(abs(x - y) > 16) / count(*), 6) AS diff_fraction, round(avg(abs(x - y)), 4) AS mae, round(sqrt(avg((x - y) * (x - y))), 4) AS rmse, max(abs(x - y)) AS most FROM s GROUP BY vec_id",
    "ssim_global": _SAMPLES + " SELECT vec_id, count(*) AS n, round(CASE "
        "WHEN count(*) > 1 THEN (2 * avg(x) * avg(y) + 6.5025) * (2 * covar_samp(x, y) + 58.5225) / ((avg(x) * avg(x) + avg(y) * avg(y) + 6.5025) * (var_samp(x) + var_samp(y) + 58.5225)) ELSE 1.0 END, 4) AS ssim FROM s GROUP BY vec_id",
    "top_nonpass": f"SELECT l_orderkey, l_linenumber, s AS status, l_partkey, l_suppkey FROM (SELECT *, {_RESULT_SQL} AS s FROM lineitem) "
        f"WHERE s <> 'PASS' ORDER BY CASE WHEN s = 'FAIL' THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50",
    "best_reference": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey "
        "ORDER BY l_discount NULLS LAST, l_tax, l_linenumber, l_suppkey) = 1",
    "lru_eviction": f"SELECT event_id, user_id, round(CAST(r AS DOUBLE), 2) AS running, r <= 400 AS kept "
        f"FROM (SELECT *, sum({_D.format('value')}) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS r FROM events)",
    "cache_trim": f"SELECT user_id, count(*) AS entries, count_if(CAST(total AS DOUBLE) - CAST(r AS DOUBLE) + value > 300) AS deleted "
        f"FROM (SELECT user_id, value, sum({_D.format('value')}) OVER (PARTITION BY user_id) AS total, sum({_D.format('value')}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events WHERE event_type <> 'signup') GROUP BY user_id",
    "debounce_latest": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) "
        "WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 150000",
    "prior_run_growth": "SELECT event_id, prior, CASE WHEN prior > 0 THEN round(value / prior - 1, 6) END AS growth "
        "FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior FROM events)",
    "visual_diff_category": f"""WITH v AS ({_select({n: f"CAST({x} AS DOUBLE)" for n, x in _VISUAL_INPUTS.items()})}), w AS (SELECT *, region / pixels AS share,
CASE WHEN least(region_width, region_height) = 0 THEN 0 ELSE greatest(region_width, region_height) / least(region_width, region_height) END AS aspect
FROM v), k AS (SELECT *, {_VISUAL} AS kind FROM w)
SELECT kind, {_IMPACT} AS impact, count(*) AS n FROM k GROUP BY ALL""",
    "failure_class": f"""WITH f AS ({_select(_FAILURE_INPUTS)}), g AS (SELECT *, lower(concat_ws(chr(10), message, cause)) AS said FROM f)
SELECT phase, {_FAILURE} AS class, count(*) AS n FROM g GROUP BY ALL""",
    "quality_ladders": f"""WITH {_ENTRIES}, {_ladders(True)}, p AS (SELECT *, CASE rank WHEN 0 THEN 'MATCHES_NONE' WHEN 1 THEN 'MATCHES_SOME'
ELSE 'MATCHES_ALL_REQUIRED' END AS proposed FROM l)
SELECT quality, pixel_agreement, "references", target_basis, priority, confidence, review_status AS review, outlier,
CASE WHEN status = 'PASS_ONE' AND proposed = 'MATCHES_NONE' THEN pixel_agreement WHEN status = 'PASS' AND proposed <> 'MATCHES_ALL_REQUIRED' THEN 'MATCHES_ALL_REQUIRED'
WHEN status = 'DIFF' AND proposed NOT IN ('MATCHES_NONE', 'NOT_COMPARABLE') THEN 'MATCHES_NONE' ELSE proposed END AS settled, count(*) AS n FROM p GROUP BY ALL""",
    "triage_partition": f"""WITH {_ENTRIES}, t AS (SELECT *, CASE WHEN rendered THEN 'rendered' WHEN list_contains(oracles, 'OK') THEN 'gap'
ELSE 'refusal' END AS part FROM e WHERE status <> 'PASS')
SELECT part, CASE WHEN part = 'refusal' AND status IN ('PASSWORD_REQUIRED', 'UNSUPPORTED_ENCRYPTED') THEN 'credential-blocked'
WHEN part = 'rendered' AND status = 'DIFF' THEN 'disagrees'
WHEN part = 'rendered' AND error_type <> '' THEN 'degraded' WHEN part = 'gap' THEN 'not to be pinned' END AS list, status, count(*) AS n FROM t GROUP BY ALL""",
    "scan_maps": f"""WITH {_ENTRIES}, m AS (SELECT 'status' AS map, status AS key FROM e UNION ALL SELECT 'result', CASE
WHEN coalesce(result, 'UNKNOWN') = 'UNKNOWN' THEN {_PASSING} ELSE result END FROM e
UNION ALL SELECT 'category', coalesce(nullif(trim(category), ''), 'unclassified') FROM e UNION ALL
SELECT 'impact', coalesce(nullif(trim(impact), ''), 'unclassified') FROM e WHERE status <> 'PASS'
UNION ALL SELECT 'visual', coalesce(nullif(trim(category), ''), 'unclassified') FROM e WHERE status <> 'PASS'
UNION ALL SELECT 'disagreement', CASE WHEN pairs IS NULL OR pairs <= 0 OR disagreeing IS NULL THEN 'unmeasured' WHEN disagreeing <= 0 THEN 'none'
WHEN disagreeing >= pairs THEN 'all' ELSE 'some' END FROM e)
SELECT map, key, count(*) AS n FROM m GROUP BY ALL""",
    "scan_counts": f"""WITH {_ENTRIES} SELECT count_if(status <> 'PASS') AS nonpass, count_if(expectation = 'PASS') AS expected_pass, count_if(expectation = 'FAIL') AS expected_fail, count_if(status = 'DIFF') AS true_diff,
count_if(status = 'PASS_ONE') AS pass_one FROM e""",
    "render_hotspots": f"""WITH {_PHASES} SELECT phase, count(*) AS n, CAST(sum(ms) AS DOUBLE) AS total, round(CAST(sum(ms) AS DOUBLE) / count(*), 4) AS mean, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS most,
round(CAST(sum(ms) AS DOUBLE) / sum(sum(ms)) OVER (), 6) AS share, {_WORKLOAD} AS workload FROM h GROUP BY phase""",
    "render_cache_counts": "WITH t AS (" + _select(_TIMES) + "), c AS (" + " "
        "UNION ALL ".join(f"SELECT '{r}' AS renderer, {r}_ms AS ms, {r}_hit AS hit FROM t" for r in O.RENDERERS) + ") SELECT renderer, CASE "
            "WHEN hit IS NULL THEN 'uncached' WHEN hit THEN 'hit' ELSE 'miss' END AS state, count(*) AS n FROM c WHERE ms IS NOT NULL GROUP BY ALL",
    "review_clusters": f"""WITH {_ENTRIES}, {_ladders(False)}, r AS (SELECT *, lpad(CAST(path AS VARCHAR), 10, '0') || '#' || lpad(CAST(page AS VARCHAR), 2, '0') AS ref FROM l WHERE status = 'PASS_ONE')
SELECT review_status AS review, root_cause, target_basis, coalesce(nullif(trim("primary"), ''), 'none') AS target, "references", coalesce(nullif(trim(impact), ''), 'none') AS impact, coalesce(category, 'none') AS category, best,
CASE WHEN known THEN 'known' ELSE 'missing' END AS contract, count(*) AS n, count(DISTINCT path) AS files, array_to_string((list(ref ORDER BY ref))[1:12], ',') AS refs FROM r GROUP BY ALL""",
    "budget_keys": """WITH b AS (SELECT DISTINCT l_linenumber AS step, l_suppkey AS pdf FROM lineitem WHERE l_suppkey % 3 > 0),
m AS (SELECT DISTINCT l_linenumber AS step, l_suppkey AS pdf FROM lineitem WHERE l_partkey % 7 > 0)
SELECT b.step, count(m.pdf) AS compared, coalesce(string_agg(CAST(b.pdf AS VARCHAR), ',' ORDER BY CAST(b.pdf AS VARCHAR)) FILTER (m.pdf IS NULL), '') AS missing FROM b LEFT JOIN m USING (step, pdf) GROUP BY b.step""",
    "worst_contributor": f"""WITH m AS ({_MIN}), b AS (SELECT event_type, quantile_disc(value, 0.02) AS budget FROM events GROUP BY 1),
v AS (SELECT event_type, user_id, round(least / budget, 6) AS ratio, least / budget > 2.0 AND least - budget > 0.5 AS bad FROM m JOIN b USING (event_type))
SELECT event_type, count(ratio) AS n, max(ratio) AS worst, arg_min(user_id, (-ratio, user_id)) FILTER (ratio IS NOT NULL) AS contributor, count_if(bad) AS failed FROM v GROUP BY event_type""",
    "colour_metrics": f"""WITH v AS (SELECT b.vec_id, b.embedding AS mine, a.embedding AS other, unnest(range(len(b.embedding) // 3)) AS i
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {', '.join(_RGB)} FROM v),
d AS (SELECT *, ar <> br OR ag <> bg OR ab <> bb AS differs, 0.299 * ar + 0.587 * ag + 0.114 * ab AS ya, 0.299 * br + 0.587 * bg + 0.114 * bb AS yb,
(abs((-0.168736 * ar - 0.331264 * ag + 0.5 * ab) - (-0.168736 * br - 0.331264 * bg + 0.5 * bb)) + abs((0.5 * ar - 0.418688 * ag - 0.081312 * ab) - (0.5 * br - 0.418688 * bg - 0.081312 * bb))) / 2 AS c FROM s),
g AS (SELECT vec_id, count_if(differs) AS differing, avg(abs(ya - yb)) FILTER (differs) AS y, avg(c) FILTER (differs) AS c, count_if(ya < 128) AS da, count_if(yb < 128) AS db FROM d GROUP BY vec_id)
SELECT vec_id, differing, round(CAST(coalesce(y, 0) AS DOUBLE), 4) AS luminance, round(CAST(coalesce(c, 0) AS DOUBLE), 4) AS chroma, round(CASE
WHEN greatest(da, db) = 0 THEN 1.0 ELSE least(da, db) / greatest(da, db) END, 6) AS dark_balance FROM g""",
    "responsiveness_rollup": "WITH p AS (SELECT user_id, event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY ALL) SELECT user_id, CASE "
        "WHEN bool_or(p90 > 200) THEN 'Fail' WHEN bool_or(p90 > 120) THEN 'Warn' ELSE 'Pass' END AS status, max(p90) AS worst FROM p GROUP BY user_id",
}

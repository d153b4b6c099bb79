"""Rows with known answers, most of them on either side of a bound."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions import classify as C
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import audit, corpus, layout, organise, redact, search, trees
from vellum.sources import readers, sinks
from vellum.streaming import debounce


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n,digits,want", [(1, 6, "000001"), (1, 4, "0001"), (1, 8, "00000001"), (999, 6, "000999"), (1234567, 6, "1234567")])
def test_numbers_are_padded_and_never_cut(spark, n, digits, want):
    assert one(spark, T.padded_number(F.lit(n), digits)) == want


@pytest.mark.parametrize("n,want", [(1, "A"), (26, "Z"), (27, "AA"), (28, "AB"), (52, "AZ"), (53, "BA"), (703, "AAA")])
def test_alphabetic_labels(spark, n, want):
    assert one(spark, T.alphabetic(F.lit(n))) == want


@pytest.mark.parametrize("n,want", [(1, "i"), (4, "iv"), (9, "ix"), (14, "xiv"), (1999, "mcmxcix")])
def test_roman_labels(spark, n, want):
    assert one(spark, T.roman(F.lit(n))) == want


def test_overlapping_and_apart(spark):
    assert one(spark, T.count_overlapping(F.lit("aaaa"), "aa")) == 3
    assert one(spark, T.count_apart(F.lit("aaaa"), "aa")) == 2
    assert one(spark, T.count_apart(F.lit("aaaa"), "")) == 0
    assert one(spark, T.count_overlapping(F.lit("a.b"), ".")) == 1


def test_fold_for_matching(spark):
    rows = [("ﬁn ｗｉｄｅ", "fin wide"), ("é", "é"), ("so­ft​", "soft"), ("a b", "a b"), ("plain", "plain"), (None, None), ("ﻻ", "لا")]
    df = spark.createDataFrame(rows, "a string, want string").select(T.folded(F.col("a")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_tiers(spark):
    tier = lambda o, n, w: one(spark, T.tier(F.lit(o).cast("string"), F.lit(n), F.lit(w)))
    assert (tier(None, 99, 0.0), tier("x", 31, 0.0), tier("x", 32, 0.49), tier("x", 32, 0.5), tier("x", 32, 0.9)) == ("Unverified", "Ok", "Severe", "Degraded", "Ok")
    worst = lambda *ts: spark.createDataFrame([(t,) for t in ts], "t string").select(F.max_by("t", T.tier_rank(F.col("t")))).first()[0]
    assert worst("Ok", "Unverified") == "Unverified" and worst("Severe", "Unverified") == "Severe"


def test_sequence_agreement():
    a, b = "quick the fox brown over jumps lazy the dog".split(), "the quick brown fox jumps over the lazy dog".split()
    assert T.token_lcs(a, b) / 9 < 0.75
    assert T.token_lcs(list("abcbdab"), list("bdcaba")) == 4 and T.token_lcs([], ["a"]) == 0


def test_context_has_dots_only_where_cut(spark):
    text = "x" * 40 + "HIT" + "y" * 5
    assert one(spark, T.context(F.lit(text), F.lit(41), 3)) == "..." + "x" * 30 + "HIT" + "y" * 5


def test_dehyphenated_and_markers(spark):
    assert one(spark, T.dehyphenated(F.lit("a-\nb-\nc D-\nE 1-\nx"))) == "abc D-\nE 1-\nx"
    assert [one(spark, T.list_marker(F.lit(x))) for x in ("• a", " 12) b", "a. c", "1234. d", "ab. e", "-")] == ["•", "12)", "a.", "", "", "-"]


def test_terms_go_in_order(spark):
    assert one(spark, T.without_terms(F.lit("xabcy "), ["b", "ac"])) == "xy"
    assert one(spark, T.without_terms(F.lit("A.b"), ["."])) == "Ab"


def test_search_of_nothing_and_of_bad_patterns(spark):
    docs = spark.createDataFrame([(1, "the the"), (2, None)], "doc_id long, text string")
    assert search.regex(docs, "(").count() == 0
    assert [(r.words, r.tokens) for r in search.whole_word(docs, "the").collect()] == [(2, 2)]


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    assert one(spark, G.overlaps(box(0, 0, 10, 10), box(10, 0, 20, 10))) is False
    assert one(spark, G.holds(box(0, 0, 10, 10), box(0, 0, 10, 10))) is True
    assert one(spark, G.has_point(box(0, 0, 10, 10), F.lit(10), F.lit(0))) is True
    assert one(spark, G.covered(box(0, 0, 10, 10), box(5, 0, 15, 10))) == 0.5


@pytest.mark.parametrize("ix,right,want", [(5, 60, 1), (1, 60, 0), (5, 49, 0)])
def test_hidden_text(spark, ix, right, want):
    """Hidden by a cover after it; not by one before it, nor by less than half."""
    text = spark.createDataFrame([(1, 0, 3, 0.0, 0.0, 100.0, 10.0)], "doc_id long, page_no int, ix int, left double, bottom double, right double, top double")
    cover = spark.createDataFrame([(1, 0, ix, 0.0, 0.0, float(right), 10.0)], text.schema)
    assert layout.hidden_by_later(text, cover).count() == want


def test_splits_refuse_no_pages(spark):
    with pytest.raises(ValueError):
        organise.split_every(None, "turn", 0)


def test_moves(spark):
    pages = spark.createDataFrame([(1, i) for i in range(4)], "d long, p long")
    order = lambda df: [r.p for r in sorted(df.collect(), key=lambda r: r.place)]
    assert order(organise.moved(pages, "d", "p", 0, 3)) == [1, 2, 3, 0]
    assert order(organise.moved(pages, "d", "p", 3, 0)) == [3, 0, 1, 2]
    assert order(organise.moved(pages, "d", "p", 9, 0)) == [0, 1, 2, 3]
    assert order(organise.removed(pages, "d", "p", F.lit(True))) == [0, 1, 2, 3]
    assert order(organise.shifted(pages, "d", "p", F.col("p").isin(0, 2, 3))) == [0, 2, 3, 1]


def test_running_totals_over_buckets(spark):
    df = spark.range(0, 500, 3).selectExpr("id AS k", "id % 5 AS n")
    got = {r.k: r.t for r in organise.running_total(df, "k", "n", "t", 4).collect()}
    total = 0
    for k in range(0, 500, 3):
        assert got[k] == total
        total += k % 5


def test_percentiles_and_medians(spark):
    df = spark.range(1, 5).selectExpr("CAST(id AS DOUBLE) AS v")
    r = df.agg(corpus.upper_median("v").alias("m")).first()
    p = corpus.percentiles(df.withColumn("k", F.lit(1)), ["k"], "v", {"p": 0.95, "least": 0.0, "half": 0.5}).first()
    assert (p.p, p.least, p.half, r.m) == (4, 1, 2, 3)
    assert df.where("false").agg(corpus.upper_median("v").alias("m")).first().m == 0


def test_votes(spark):
    vote = lambda c, a: one(spark, corpus.vote(F.lit(c), F.lit(a)))
    assert (vote(3, 2), vote(2, 1), vote(1, 1), vote(3, 0)) == ("PASS", "PASS_ONE", "PASS_ONE", "DIFF")


def test_lookup_adds_and_strips_the_prefix(spark):
    d = spark.createDataFrame([("a",), ("pdf/b",), ("c",), ("d",)], "path string")
    e = spark.createDataFrame([("pdf/a", "1"), ("b", "2"), ("c", "3"), ("pdf/c", "4")], "path string, expected string")
    got = {r.path: r.expected for r in corpus.lookup_with_fallback(d, e, "path", "pdf/", "expected").collect()}
    assert got == {"a": "1", "pdf/b": "2", "c": "3", "d": None}


def test_debounce_bounds(spark):
    rows = [(1, 1, "2024-01-01 00:00:00.000"), (1, 2, "2024-01-01 00:00:00.150"), (1, 3, "2024-01-01 00:00:00.301")]
    df = spark.createDataFrame(rows, "g long, o long, s string").select("g", "o", F.to_timestamp_ntz("s").alias("ts"))
    assert sorted(r.o for r in corpus.latest_wins(df, "g", "ts", "o", 150).collect()) == [2, 3]


def test_links(spark):
    kinds = [one(spark, C.link_kind(F.lit(u))) for u in ("HTTPS://a", "mailto:x", "#p", " ", "javascript:x", "file:///a", "no scheme")]
    assert kinds == ["external", "external", "internal", None, "dangerous", "dangerous", "dangerous"]


def test_batches_stop_at_the_first_failure(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "b long, i long, bad boolean")
    got = {r.b: (r.run, r.failed, r.skipped, r.status, r.exit_code) for r in audit.batch_report(df, "b", "i", F.col("bad")).collect()}
    assert got == {1: (2, 1, 1, "FAIL", 1), 2: (1, 0, 0, "PASS", 0)}
    assert one(spark, audit.error_kind(F.lit("Security"))) == "SECURITY"
    assert one(spark, audit.assignment(F.lit("a=b=c"))[1]) == "b=c" and one(spark, audit.assignment(F.lit("=x"))[0]) is None


def test_roles_with_a_cycle_end(spark):
    roles = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, role string")
    got = {r.name: r.target for r in trees.resolve_roles(roles).collect()}
    assert (got["a"], got["b"]) == ("c", "c") and got["x"] in "xy"


def test_reachable_and_grid(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 10)], "src long, dst long")
    assert sorted(r.id for r in trees.reachable(edges, spark.createDataFrame([(1,)], "id long")).collect()) == [1, 2, 3]
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 3, 3)], "grid long, x int, y int")
    got = sorted((r.left, r.right, r.cells, r.density) for r in trees.grid_components(cells).collect())
    assert got == [(0, 1, 3, 0.75), (3, 3, 1, 1.0)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# note\npath\tpage_number\texpected_status\na.pdf\t1\tPASS\tboom\n\nb.pdf\t-1\tPASS\nc.pdf\t0\t*\n")
    got = [(r.path, r.page_number, r.expected_error_contains) for r in readers.expectations(spark, str(tmp_path / "e.tsv")).collect()]
    assert sorted(got) == [("a.pdf", 1, "boom"), ("c.pdf", 0, None)]
    texts = spark.createDataFrame([(1, "a\fb")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, n_pages int")
    assert sorted((r.doc_id, r.page_no, r.text) for r in readers.form_feed_pages(texts, pages).collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (2, 0, "")]
    df = spark.createDataFrame([Row(a='x"y,z', b=1.5)])
    sinks.csv(df, str(tmp_path / "out"))
    assert '"x""y,z",1.5' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.csv(df, str(tmp_path / "out"))
    assert sinks.markdown(df).startswith("| a | b |")


def test_redaction_of_carriers(spark):
    df = spark.createDataFrame([(1, "Secret", "secret", "a secret")], "doc_id long, info string, title string, note string")
    assert tuple(redact.carriers(df, ["secret"]).first()) == (1, None, "[redacted]", "a")


def test_streaming_debounce_and_state(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00.000", 1.0), (1, 2, "2024-01-01 00:00:00.100", 2.0), (1, 3, "2024-01-01 00:00:05", 3.0), (2, 4, "2024-01-01 01:00:00", 4.0)]
    df = spark.createDataFrame(rows, "g long, o long, s string, v double").select("g", "o", F.to_timestamp("s").alias("ts"), "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("debounced", debounce.debounced(stream, "g", "ts", "o", 150, "1 second")), ("grown", debounce.growth(stream, "g", "o", "v"))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.o, r.merged) for r in spark.table("debounced").collect()) == [(2, 2), (3, 1)]
    assert sorted((r.o, r.prior) for r in spark.table("grown").collect() if r.prior is not None) == [(2, 1.0), (3, 2.0)]

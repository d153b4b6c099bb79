"""Smaller queries over records: selection, rules, marks, names, destinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import organise as P
from vellum.operators import records as R
from vellum.plans.corpus_queries import _ENTRIES
from vellum.sources.tables import LINES_SQL, load

def page_selection(spark, sf_dir):
    n = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return R.selected_pages(n, "conv_id", "n", "sample").withColumn("mode",
        F.lit("sample")).unionByName(R.selected_pages(n, "conv_id", "n", "all").withColumn("mode", F.lit("all")))


def recent_files(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return R.recent(e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", F.col("user_id") % 10 == 0, "us").select("user_id", "pinned")


def manifest_selection(spark, sf_dir):
    n = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    named = n.select("conv_id", F.explode(F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(0))).when(F.col("conv_id") % 3 == 1, F.array(F.lit(0),
        F.lit(2), F.lit(99)))).alias("page_number"))
    return R.manifest_pages(n, "conv_id", "n", named, "all").withColumn("mode",
        F.lit("all")).unionByName(R.manifest_pages(n, "conv_id", "n", named, "first").withColumn("mode", F.lit("first")))


def marked_content_depth(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"),
        F.posexplode(F.regexp_extract_all("html", F.lit("<(/?)(?:ul|li|article|nav|body)[ >]"), 0)).alias("ix", "tag"))
    m = R.mark_depth(p.withColumn("step", F.when(F.col("tag").startswith("</"), -1).otherwise(1)), "doc_id", "ix", "step")
    return m.groupBy("doc_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "ix").alias("left_open"))


def _paths(spark, sf_dir):
    """Strokes of pages: a line or a rectangle for each line of an order, under the matrix of its place."""
    q, t = F.col("l_partkey") % 90, F.col("l_suppkey") % 30
    box = F.array(t.cast("double"), q.cast("double"), (q - 10).cast("double"), (t - 4).cast("double"))
    scale = F.when(F.col("l_linenumber") % 4 == 0, 2.0).otherwise(1.0)
    matrix = F.array(scale, F.lit(0.0), F.lit(0.0), scale, F.lit(5.0), (10 * F.col("l_linenumber")).cast("double"))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ix"),
        F.when(F.col("l_linenumber") % 2 == 1, "line").otherwise("rect").alias("shape"), box.alias("box"), matrix.alias("matrix"),
    )


def form_autodetect(spark, sf_dir):
    return R.suggested_fields(_paths(spark, sf_dir))


def bates_position(spark, sf_dir):
    anchors = ["topleft", "topcentre", "topright", "bottomleft", "bottomcentre", "bottomright"]
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, anchors)),
        (F.col("o_orderkey") % 6).cast("int")).alias("anchor"), (F.col("o_custkey") % 100 + 20).cast("double").alias("size"))
    x, y = R.stamp_position(F.col("anchor"), F.lit(612.0), F.lit(792.0), F.col("size"))
    return o.select("o_orderkey", x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment_count_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return R.merged_counts(maps, "m")


def orphan_widgets(spark, sf_dir):
    return R.unlinked(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id"),
        "doc_id").groupBy("origin").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def destination_resolve(spark, sf_dir):
    key = F.col("s_suppkey") % 4
    target = F.when(key == 0, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).when(key == 1,
        F.concat(F.lit("ref"), F.col("s_nationkey").cast("string"))).when(key == 2, F.col("s_nationkey").cast("string"))
    array = F.when(key == 3, F.array(F.concat(F.lit("ref"), (F.col("s_nationkey") % 30).cast("string")), F.lit("Fit")))
    links = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("link"), target.alias("target"), array.alias("array"))
    n = load(spark, sf_dir, "nation")
    return R.resolved(links, n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1000).cast("long").alias("page")),
        n.select(F.concat(F.lit("ref"), F.col("n_nationkey").cast("string")).alias("ref"), (F.col("n_nationkey") + 2000).cast("long").alias("page")))


def named_destinations(spark, sf_dir):
    fits = F.get(F.array(*map(F.lit, ("Fit", "FitH", "FitV", "FitB", "FitBH", "FitBV", "FitR", "XYZ", "Odd"))), (F.col("s_suppkey") % 9).cast("int"))
    params = F.slice(F.array(F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double"), F.lit(1.5)), 1, (F.col("s_suppkey") % 4).cast("int"))
    d = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"),
        F.concat(F.lit("ref"), F.col("s_nationkey").cast("string")).alias("ref"), F.when(F.col("s_suppkey") % 10 > 0, fits).alias("fit"), params.alias("params"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("ref"), F.col("n_nationkey").cast("string")).alias("ref"),
        (F.col("n_nationkey") + 2000).cast("long").alias("page")).where("page % 5 > 0")
    return R.destinations(d, n)


def structure_text(spark, sf_dir):
    """Each page's lines are marked content; five lines form an element, whose references run backwards, below one for the page."""
    from vellum.sources.tables import lines

    line = lines(load(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("page_no", F.floor(F.col("line_no") / 50).cast("int"))
    marked = line.select("doc_id", "page_no", F.col("line_no").alias("mcid"), F.col("line").alias("text"))
    group = F.floor(F.col("line_no") / 5).cast("int")
    kids = line.select("doc_id", "page_no", F.concat(F.lit("g"), group.cast("string")).alias("element"), (-F.col("line_no")).alias("place"),
        F.col("line_no").alias("mcid"), F.lit(None).cast("string").alias("child"))
    tops = line.select("doc_id", "page_no", F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("element"), group.alias("place"),
        F.lit(None).cast("int").alias("mcid"), F.concat(F.lit("g"), group.cast("string")).alias("child"))
    out = R.element_texts(kids.unionByName(tops.distinct()), marked, "|")
    return out.where("element LIKE 'p%'").select("doc_id", "element", F.md5("text").alias("digest"), F.length("text").alias("size"))


def xref_first_wins(spark, sf_dir):
    from vellum.sources.readers import first_definitions

    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object_id"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 100_000_000 + F.col("l_partkey")).alias("section"), "l_partkey")
    return first_definitions(s)


def near_white_fill(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem")
    white = R.near_white(*R.rgb_of_cmyk(F.col("l_tax"), F.col("l_discount"), F.lit(0.0), F.lit(0.0)))
    return s.groupBy("l_tax", "l_discount").agg(F.count_if(white).alias("white"), F.count("*").alias("n"))


def placeholder_strip(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return b.select("item_id", "line_no", R.before_placeholder(F.regexp_replace("line", " th", " ____")).alias("text"))


def path_normalise(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    p = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "root\\dir\\").otherwise("other/"), "s_name")
    return s.select("s_suppkey", R.slashed(p, F.lit("root/")).alias("path"))


def split_names(spark, sf_dir):
    p = load(spark, sf_dir, "conversations")
    n = p.groupBy("conv_id").agg(F.count("*").alias("n"))
    return p.join(n, "conv_id").select("conv_id", "turn", R.part_name(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn") + 1, F.col("n")).alias("name"))


def wall_budgets(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.select("l_orderkey", R.wall_budget(F.col("n"), F.col("l_orderkey") % 3, 20, 400).cast("long").alias("seconds"))


def agreement_class(spark, sf_dir):
    from vellum.plans.corpus_queries import _entries

    state = R.agreement(F.col("status"), F.col("rendered"), F.col("oracles"))
    return _entries(spark, sf_dir).select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def link_targets(spark, sf_dir):
    from vellum.functions.classify import link_target

    kinds = F.get(F.array(*map(F.lit, ("GoTo", "URI", "Launch", "GoToE", "GoToR", "Named", "URI", "URI"))), (F.col("page_id") % 8).cast("int"))
    uri = F.when(F.col("page_id") % 16 == 1, " ").when(F.col("page_id") % 16 == 6, F.concat(F.lit("FILE:"), "url")).when(F.col("page_id") % 16 == 14,
        "no scheme").otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", link_target(kinds, uri).alias("target")).where("target IS NOT NULL")


def field_filters(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    kind = F.get(F.array(*map(F.lit, ("text", "button", "choice", "signature"))), (F.col("c_custkey") % 4).cast("int"))
    f = c.select(F.col("c_custkey").alias("field"), kind.alias("kind"), (F.col("c_custkey") % 50).alias("left"),
        (F.col("c_custkey") % 40 * 10).alias("top"), F.col("c_nationkey").alias("doc_id"))
    return R.in_field_order(R.fields_of(f, "choice", "signature"), "doc_id").select("doc_id", "field", "kind", "place")


def page_spaces(spark, sf_dir):
    from vellum.functions import geometry as G

    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 600).cast("double").alias("x"),
        (F.col("o_orderkey") % 790).cast("double").alias("y"), (F.col("o_orderkey") % 4 * 90).alias("turn"))
    px, py = G.to_pixels(F.col("x"), F.col("y"), F.lit(792.0), F.lit(144))
    vx, vy = G.to_visual(F.col("x"), F.col("y"), F.lit(612.0), F.lit(792.0), F.col("turn"))
    bx, by = G.from_pixels(px, py, F.lit(792.0), F.lit(144))
    return o.select("o_orderkey", px.alias("px"), py.alias("py"), vx.alias("vx"), vy.alias("vy"), (bx == F.col("x")).alias("back_x"), (by == F.col("y")).alias("back_y"))


def matrix_boxes(spark, sf_dir):
    from vellum.functions import geometry as G

    s = load(spark, sf_dir, "supplier").select("s_suppkey", *[(F.col("s_suppkey") * k % 9 - 4).cast("double").alias(f"m{i}") for i, k in enumerate((2, 3, 5, 7, 11, 13))])
    a, b = tuple(F.col(f"m{i}") for i in range(6)), tuple(F.col(f"m{i}") + 1 for i in range(6))
    return s.select("s_suppkey", *[c.alias(n) for c, n in zip(G.unit_box(G.multiplied(a, b)), ("left", "bottom", "right", "top"), strict=True)])


def tint_functions(spark, sf_dir):
    from vellum.functions import tint

    s = load(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("t")).distinct()
    x = F.col("t") * 12.5
    low, high = tint.exponential(x, [0.0, 1.0], [1.0, 0.25], 2.0), tint.exponential(x, [0.5], [0.0, 1.0], 1.0)
    joined = tint.stitched(x, [lambda u: tint.exponential(u, [0.0], [1.0], 1.0)[0], lambda u: tint.exponential(u, [1.0], [0.0], 2.0)[0]], [0.4], [0.0, 1.0, 1.0, 0.0], (0.0, 1.0))
    sampled = tint.sampled(x, [0.0, 0.5, 0.25, 1.0], (0.0, 1.0))
    return s.select("t", *[F.round(c, 6).alias(n) for n, c in (("a", low[0]), ("b", low[1]), ("c", high[0]), ("d", high[1]), ("stitched", joined), ("sampled", sampled))])


def command_lookup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type")
    commands = spark.createDataFrame([("view", "document.open", "open"), ("click", "document.find", "search"), ("purchase", "document.save", "save")],
        "id string, title string, cli string")
    return R.commands(e, commands, "event_type").groupBy("event_type", "title", "known").agg(F.count("*").alias("n"))


def signature_gap(spark, sf_dir):
    from vellum.operators.audit import signature_error

    k = F.col("o_orderkey")
    r = [F.when(k % 13 == 0, 0.5).otherwise((k % 11 == 0).cast("double")), (k % 300).cast("double"),
        (k % 300 + k % 17 * 10 - F.when(k % 19 == 0, 400).otherwise(0)).cast("double"), (200 - F.col("o_custkey") % 60).cast("double")]
    ranges = F.when(k % 23 == 0, F.array(*r[:3])).otherwise(F.array(*r))
    out = signature_error(ranges, F.lit(500), F.array(F.struct((k % 300).cast("long").alias("from"), (k % 300 + k % 17 * 10 + F.when(k % 7 == 0,
        1).otherwise(0)).cast("long").alias("to"))))
    return load(spark, sf_dir, "orders").groupBy(out.alias("error")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def scrubbed_metadata(spark, sf_dir):
    from vellum.operators.redact import distinct_terms, scrub_metadata

    d = scrub_metadata(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["source"])
    terms = distinct_terms(load(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.left("n_name", F.lit(7))).alias("term")))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("kind",
        F.lit("documents")).unionByName(terms.select(F.col("term").alias("lang"), F.lit(None).cast("string").alias("source"),
            F.lit(1).cast("long").alias("n"), F.lit("term").alias("kind")))


def report_rows(spark, sf_dir):
    from vellum.sources.sinks import json_rows

    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") > 5, F.col("s_name")).alias("name"), "s_nationkey")
    return json_rows(s)


def rotate_pages(spark, sf_dir):
    p = load(spark, sf_dir, "conversations")
    return p.select("conv_id", "turn", P.turned(F.col("turn") * 90, 270).alias("right_of"), P.turned(F.col("turn") * -90, 180).alias("over"))


def form_name_dedupe(spark, sf_dir):
    p = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return P.unique_names(p, "conv_id", "role", "turn").select("conv_id", "turn", "unique_name")


def strong_rtl(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" שלום"))).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", T.has_rtl(F.col("text")).alias("rtl"))


def image_info(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    b = v.select("vec_id", F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("v").cast("double"))) + 0.5) * 255).alias("b"))
    return b.groupBy("vec_id").agg(F.round(F.avg("b"), 4).alias("mean"), F.count_if(F.col("b") < 100).alias("dark"), F.count_if(F.col("b") < 242).alias("not_white"))


QUERIES = {f.__name__: f for f in (scrubbed_metadata, report_rows, manifest_selection, named_destinations, link_targets, field_filters, page_spaces,
    matrix_boxes, tint_functions, command_lookup, signature_gap, page_selection, recent_files,
        marked_content_depth, form_autodetect, bates_position, segment_count_merge, orphan_widgets, destination_resolve, structure_text,
            xref_first_wins, near_white_fill, placeholder_strip, path_normalise, split_names, wall_budgets, agreement_class, rotate_pages,
                form_name_dedupe, strong_rtl, image_info)}

ORACLES = {
    "scrubbed_metadata": """WITH t AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE left(n_name, 7) END AS term FROM nation)
SELECT lang, CAST(NULL AS VARCHAR) AS source, count(*) AS n, 'documents' AS kind FROM documents GROUP BY lang UNION ALL
SELECT min(term), NULL, 1, 'term' FROM t WHERE length(term) >= 3 GROUP BY lower(term)""",
    "report_rows": "SELECT '{\"s_suppkey\":' || s_suppkey || ',\"name\":' || CASE WHEN s_nationkey > 5 THEN '\"' || s_name || '\"' "
        "ELSE 'null' END || ',\"s_nationkey\":' || s_nationkey || '}' AS json FROM supplier",
    "page_selection": "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) "
        "SELECT conv_id, CAST(p AS INTEGER) AS page_number, 'sample' AS mode FROM n, (SELECT unnest([1, 2, 5, 20]) AS p) WHERE p <= n UNION ALL "
            "SELECT conv_id, CAST(unnest(range(1, n + 1)) AS INTEGER), 'all' FROM n",
    "recent_files": "SELECT user_id, user_id % 10 = 0 AS pinned FROM events GROUP BY user_id ORDER BY pinned DESC, max(ts) DESC, user_id LIMIT 20",
    "marked_content_depth": "WITH t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<(/?)(?:ul|li|article|nav|body)[ >]')) AS tag, generate_subscripts(regexp_extract_all(html, '<(/?)(?:ul|li|article|nav|body)[ >]'), 1) AS ix FROM pages), d AS (SELECT doc_id, ix, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ix) AS depth FROM t) SELECT doc_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, ix) AS BIGINT) AS left_open FROM d GROUP BY doc_id",
    "form_autodetect": """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 = 1 AS line, l_suppkey % 30 AS x, l_partkey % 90 AS y, l_partkey % 90 - 10 AS w, l_suppkey % 30 - 4 AS h, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS m, 10 * l_linenumber AS f, l_linenumber * 1000000 + l_partkey AS ix FROM lineitem),
b AS (SELECT doc_id, line, ix, CASE WHEN line THEN least(x, w) ELSE m * x + least(0, m * w) END + 5 AS l, CASE WHEN line THEN least(y, h)
ELSE m * y + least(0, m * h) END + f AS b, CASE WHEN line THEN greatest(x, w) ELSE m * x + greatest(0, m * w) END + 5 AS r, CASE
WHEN line THEN greatest(y, h) ELSE m * y + greatest(0, m * h) END + f AS t FROM p),
k AS (SELECT *, CASE WHEN line AND r - l >= 50 AND t - b <= 2 THEN 'text'
WHEN NOT line AND r - l BETWEEN 6 AND 24 AND t - b BETWEEN 6 AND 24 AND abs((r - l) / (t - b) - 1) <= 0.4 THEN 'checkbox' END AS kind FROM b)
SELECT doc_id, 1 AS page_no, kind, CASE kind WHEN 'text' THEN 'Text'
ELSE 'Checkbox' END || row_number() OVER (PARTITION BY doc_id, kind ORDER BY ix) AS name, CAST(l AS DOUBLE) AS "left", CAST(CASE kind
WHEN 'text' THEN t + 1 ELSE b END AS DOUBLE) AS bottom,
CAST(r AS DOUBLE) AS "right", CAST(CASE kind WHEN 'text' THEN t + 17 ELSE t END AS DOUBLE) AS top FROM k WHERE kind IS NOT NULL""",
    "bates_position": "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 36.0 WHEN 1 THEN (612.0 - (o_custkey % 100 + 20)) / 2 "
        "ELSE 612.0 - 36.0 - (o_custkey % 100 + 20) END AS DOUBLE) AS x, CAST(CASE WHEN o_orderkey % 6 < 3 THEN 756.0 ELSE 36.0 END AS DOUBLE) AS y FROM orders",
    "segment_count_merge": "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1",
    "orphan_widgets": "SELECT origin, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, 'field' AS origin FROM labels UNION ALL "
        "SELECT doc_id, 'widget' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY origin",
    "destination_resolve": """SELECT s_suppkey AS link, CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'ref' || s_nationkey
WHEN 2 THEN CAST(s_nationkey AS VARCHAR) END AS target,
CAST(s_nationkey + CASE s_suppkey % 4 WHEN 0 THEN 1000 WHEN 2 THEN 0 ELSE 2000 END AS BIGINT) AS page FROM supplier""",
    "named_destinations": """WITH d AS (SELECT s_name AS name, s_nationkey AS n, s_suppkey AS k, s_suppkey % 4 AS params, CASE
WHEN s_suppkey % 10 > 0 THEN ['Fit', 'FitH', 'FitV', 'FitB', 'FitBH', 'FitBV', 'FitR', 'XYZ', 'Odd'][s_suppkey % 9 + 1] END AS raw FROM supplier),
f AS (SELECT *, CASE WHEN raw IS NULL OR raw = 'Odd' THEN 'XYZ' ELSE raw END AS fit, coalesce(raw, 'Odd') <> 'Odd' AS known FROM d)
SELECT name, CAST(CASE WHEN (n + 2000) % 5 > 0 THEN n + 2000 END AS BIGINT) AS page, fit, CAST(CASE
WHEN known AND fit IN ('FitV', 'FitBV', 'FitR', 'XYZ') AND params > 0 THEN n END AS DOUBLE) AS x,
CAST(CASE WHEN known AND fit IN ('FitH', 'FitBH') AND params > 0 THEN n
WHEN known AND fit IN ('FitR', 'XYZ') AND params > 1 THEN k END AS DOUBLE) AS y, CAST(CASE WHEN known AND fit = 'XYZ' AND params > 2 THEN 1.5 END AS DOUBLE) AS zoom FROM f""",
    "structure_text": f"""WITH {LINES_SQL}, g AS (SELECT doc_id, line_no // 50 AS page_no, line_no // 5 AS grp, string_agg(line, '|' ORDER BY -line_no) AS t FROM lines GROUP BY ALL),
p AS (SELECT doc_id, 'p' || page_no AS element, string_agg(t, '|' ORDER BY grp) AS t FROM g GROUP BY ALL)
SELECT doc_id, element, md5(t) AS digest, CAST(length(t) AS INTEGER) AS size FROM p""",
    "xref_first_wins": "SELECT l_orderkey AS object_id, l_linenumber * 1000000 + l_suppkey * 100000000 + l_partkey AS section, l_partkey "
        "FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_suppkey * 100000000 + l_partkey) = 1",
    "near_white_fill": "SELECT l_tax, l_discount, count_if((1 - l_tax) >= 0.95 AND (1 - l_discount) >= 0.95) AS white, count(*) AS n FROM lineitem GROUP BY ALL",
    "placeholder_strip": """WITH l AS (SELECT item_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT item_id, line_no, rtrim(regexp_extract(replace(line, ' th', ' ____'), '^(.*?)(?:_{3}|-{3}|$)', 1), ' ') AS text FROM l""",
    "path_normalise": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'dir/' ELSE 'other/' END || s_name AS path FROM supplier",
    "split_names": "SELECT conv_id, turn, 'c' || conv_id || '_' || lpad(CAST(turn + 1 AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY conv_id) AS VARCHAR)) AS INTEGER), '0') || '.pdf' AS name FROM conversations",
    "wall_budgets": "SELECT l_orderkey, least(400, (count(*) * (3 + l_orderkey % 3) + 2) * 20) AS seconds FROM lineitem GROUP BY l_orderkey",
    "agreement_class": f"""WITH {_ENTRIES}, s AS (SELECT *, list_contains(oracles, 'OK') AS ok, len(list_filter(oracles, lambda o: o IS NOT NULL)) > 0 AS tried FROM e)
SELECT CASE WHEN status = 'PASS' THEN 'PASS' WHEN status = 'PASS_ONE' THEN 'ORACLE_SPLIT' WHEN status IN ('DIFF', 'MISSING_CONTENT') THEN status
WHEN rendered THEN CASE WHEN ok THEN 'RENDERED' ELSE 'OWN_ONLY' END
WHEN status IN ('PASSWORD_REQUIRED', 'UNSUPPORTED_ENCRYPTED') THEN 'CREDENTIAL_BLOCKED' WHEN ok THEN 'OWN_SIDE_GAP' WHEN tried THEN 'AGREED_REFUSAL'
ELSE 'UNCORROBORATED' END AS state, count(*) AS n FROM s GROUP BY 1""",
    "manifest_selection": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), m AS (SELECT 'all' AS mode UNION ALL SELECT 'first')
SELECT conv_id, 2 AS page_number, mode FROM n, m WHERE conv_id % 3 = 1 AND n >= 2 UNION ALL SELECT conv_id, CAST(unnest(range(1, CASE mode
WHEN 'all' THEN n ELSE 1 END + 1)) AS INTEGER), mode FROM n, m WHERE conv_id % 3 = 0 OR (conv_id % 3 = 1 AND n < 2)""",
    "link_targets": """WITH l AS (SELECT page_id, ['GoTo', 'URI', 'Launch', 'GoToE', 'GoToR', 'Named', 'URI', 'URI'][page_id % 8 + 1] AS action, CASE page_id % 16 WHEN 1 THEN ' ' WHEN 6 THEN 'FILE:' || url WHEN 14 THEN 'no scheme' ELSE url END AS uri FROM pages),
s AS (SELECT *, lower(regexp_extract(trim(uri), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM l),
t AS (SELECT page_id, CASE WHEN action = 'GoTo' THEN 'internal' WHEN action = 'URI' THEN CASE WHEN trim(coalesce(uri, '')) = '' THEN NULL
WHEN scheme IN ('http', 'https', 'mailto') THEN 'external' WHEN scheme = '' THEN 'dangerous: URI:malformed' ELSE 'dangerous: URI:' || scheme END
WHEN action IN ('Launch', 'GoToE', 'GoToR') THEN 'dangerous: ' || action END AS target FROM s) SELECT * FROM t WHERE target IS NOT NULL""",
    "field_filters": """WITH f AS (SELECT c_custkey AS field, ['text', 'button', 'choice', 'signature'][c_custkey % 4 + 1] AS kind, c_custkey % 50 AS l, c_custkey % 40 * 10 AS t, c_nationkey AS doc_id FROM customer)
SELECT doc_id, field, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, l, field) AS INTEGER) AS place FROM f WHERE kind IN ('choice', 'signature')""",
    "page_spaces": """WITH o AS (SELECT o_orderkey, CAST(o_custkey % 600 AS DOUBLE) AS x, CAST(o_orderkey % 790 AS DOUBLE) AS y, o_orderkey % 4 * 90 AS turn FROM orders)
SELECT o_orderkey, x * 2 AS px, (792.0::DOUBLE - y) * 2 AS py, CASE turn WHEN 90 THEN y WHEN 180 THEN 612.0::DOUBLE - x
WHEN 270 THEN 792.0::DOUBLE - y ELSE x END AS vx, CASE turn WHEN 90 THEN 612.0::DOUBLE - x WHEN 180 THEN 792.0::DOUBLE - y WHEN 270 THEN x
ELSE y END AS vy, true AS back_x, true AS back_y FROM o""",
    "matrix_boxes": """WITH m AS (SELECT s_suppkey, CAST(s_suppkey * 2 % 9 - 4 AS DOUBLE) AS a, CAST(s_suppkey * 3 % 9 - 4 AS DOUBLE) AS b, CAST(s_suppkey * 5 % 9 - 4 AS DOUBLE) AS c, CAST(s_suppkey * 7 % 9 - 4 AS DOUBLE) AS d, CAST(s_suppkey * 11 % 9 - 4 AS DOUBLE) AS e, CAST(s_suppkey * 13 % 9 - 4 AS DOUBLE) AS f FROM supplier),
p AS (SELECT s_suppkey, a * (a + 1) + b * (c + 1) AS a, a * (b + 1) + b * (d + 1) AS b, c * (a + 1) + d * (c + 1) AS c, c * (b + 1) + d * (d + 1) AS d, e * (a + 1) + f * (c + 1) + e + 1 AS e, e * (b + 1) + f * (d + 1) + f + 1 AS f FROM m)
SELECT s_suppkey, e + least(0, a, c, a + c) AS "left", f + least(0, b, d, b + d) AS bottom, e + greatest(0, a, c, a + c) AS "right", f + greatest(0, b, d, b + d) AS top FROM p""",
    "tint_functions": """WITH s AS (SELECT DISTINCT l_tax AS t, l_tax * 12.5 AS x FROM lineitem)
SELECT t, round(x * x, 6) AS a, round(1 - x * x * 0.75, 6) AS b, round(0.5 - x * 0.5, 6) AS c, round(x, 6) AS d, round(CASE WHEN x < 0.4 THEN x / 0.4
ELSE 1 - power(1 - (x - 0.4) / 0.6, 2) END, 6) AS stitched,
round(CASE WHEN x * 3 < 1 THEN 0.5 * x * 3 WHEN x * 3 < 2 THEN 0.5 - 0.25 * (x * 3 - 1) ELSE 0.25 + 0.75 * (x * 3 - 2) END, 6) AS sampled FROM s""",
    "command_lookup": "SELECT event_type, title, title IS NOT NULL AS known, count(*) AS n FROM events LEFT "
        "JOIN (VALUES ('view', 'document.open'), ('click', 'document.find'), ('purchase', 'document.save')) c(id, title) ON id = event_type GROUP BY ALL",
    "signature_gap": """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 0.5 WHEN o_orderkey % 11 = 0 THEN 1
ELSE 0 END AS a, o_orderkey % 300 AS b, o_orderkey % 300 + o_orderkey % 17 * 10 - CASE WHEN o_orderkey % 19 = 0 THEN 400 ELSE 0 END AS c, 200 - o_custkey % 60 AS d,
o_orderkey % 300 AS gf, o_orderkey % 300 + o_orderkey % 17 * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS gt FROM orders)
SELECT CASE WHEN k % 23 = 0 THEN 'expected exactly four numbers' WHEN a = 0.5 THEN 'an entry is not an integer'
WHEN b < 0 OR c < 0 OR d < 0 THEN 'offsets and lengths must be non-negative' WHEN a <> 0 THEN 'first range must start at byte 0'
WHEN b > 500 OR c > 500 OR d > 500 - c THEN 'range extends beyond end of file' WHEN a + b > c THEN 'ranges overlap'
WHEN NOT (gf = b AND gt = c) THEN 'the value does not match the gap' END AS error, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM r GROUP BY 1""",
    "rotate_pages": "SELECT conv_id, turn, (turn * 90 + 270) % 360 AS right_of, (((turn * -90 + 180) % 360) + 360) % 360 AS over FROM conversations",
    "form_name_dedupe": "SELECT conv_id, turn, CASE WHEN n > 1 THEN role || '_' || n ELSE role END AS unique_name "
        "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)",
    "strong_rtl": "SELECT doc_id, doc_id % 2 = 0 AS rtl FROM documents",
    "image_info": "SELECT vec_id, round(avg(b), 4) AS mean, count_if(b < 100) AS dark, count_if(b < 242) AS not_white "
        "FROM (SELECT vec_id, CAST(floor((greatest(-0.5, least(0.5, CAST(v AS DOUBLE))) + 0.5) * 255) AS BIGINT) AS b "
            "FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)) GROUP BY vec_id",
}

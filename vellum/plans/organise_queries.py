"""Pages, trees, rules and forms.  Conversations stand for documents, their turns for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import classify as C
from vellum.operators import audit as A
from vellum.operators import organise as P
from vellum.operators import trees as R
from vellum.sources.tables import load


def _pages(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn")


def bates_numbers(spark, sf_dir):
    return P.bates(_pages(spark, sf_dir), "conv_id", "turn", prefix="B-")


def next_bates(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.agg(P.next_number(p))


def page_label_asof(spark, sf_dir):
    p = _pages(spark, sf_dir)
    marks = p.where((F.col("turn") % 3 == 1)).select("conv_id", F.col("turn").alias("first_page"),
        F.when(F.col("conv_id") % 2 == 0, "decimal").otherwise("letters").alias("style"), F.lit("p").alias("prefix"), (F.col("conv_id") % 40 + 1).alias("first_value"))
    return P.labels(p, "conv_id", "turn", marks)


def roman_labels(spark, sf_dir):
    p = _pages(spark, sf_dir)
    marks = p.where("turn = 0").select("conv_id", F.lit(0).cast("long").alias("first_page"), F.lit("roman").alias("style"), F.lit("").alias("prefix"),
        (F.col("conv_id") % 60 + 1).alias("first_value"))
    return P.labels(p, "conv_id", "turn", marks)


def merge_pages(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return P.merged([p.where("turn % 2 = 1"), p.where("turn % 2 = 0")], "conv_id", "turn")


def split_every_n(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.withColumn("part", P.split_every(p, "turn", 3)).groupBy("conv_id", "part").agg(F.count("*").alias("pages"), F.min("turn").alias("first"))


def split_boundaries(spark, sf_dir):
    p = _pages(spark, sf_dir)
    n = p.groupBy("conv_id").agg(F.count("*").alias("n"))
    return p.join(n, "conv_id").withColumn("part", P.split_at("turn", [5, 2, 400], F.col("n"))).groupBy("conv_id",
        "part").agg(F.count("*").alias("pages"), F.min("turn").alias("first"))


def move_pages(spark, sf_dir):
    return P.shifted(_pages(spark, sf_dir), "conv_id", "turn", F.col("turn") % 4 != 0)


def page_remove(spark, sf_dir):
    return P.removed(_pages(spark, sf_dir), "conv_id", "turn", F.col("turn") % 3 == 0)


def page_move(spark, sf_dir):
    return P.moved(_pages(spark, sf_dir), "conv_id", "turn", 3, 1)


def page_insert(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return P.inserted(p, p.where("turn < 2"), "conv_id", "turn", 2)


def page_extract(spark, sf_dir):
    return P.extracted(_pages(spark, sf_dir), "conv_id", "turn", [4, 0, 2, 0, 99])


def corpus_chunks(spark, sf_dir):
    return P.chunked(load(spark, sf_dir, "orders"), "o_orderkey", 7).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def shard_pages(spark, sf_dir):
    return P.shards(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 2)


def permission_bits(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", *C.permissions(F.col("o_orderkey")))


def link_classification(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    href = F.when(F.col("page_id") % 5 == 0, "javascript:alert(1)").when(F.col("page_id") % 5 == 1, "#top").when(F.col("page_id") % 5 == 2, " ").otherwise(F.col("url"))
    return pages.select("page_id", C.link_kind(href).alias("kind")).where("kind IS NOT NULL")


def outline_tree(spark, sf_dir):
    region = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("r_name").alias("title"))
    nation = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    supplier = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return R.walk(region.union(nation).union(supplier)).select("node_id", "depth", "path")


def role_map_resolve(spark, sf_dir):
    n = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.floor(F.col("s_suppkey") / 3).cast("long").alias("role")).where("name > 0")
    return R.resolve_roles(n)


def _tags(spark, sf_dir):
    """Start tags of pages in order: (doc_id, ix, tag)."""
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z]+[1-6]?)[ >]"), 1)).alias("ix", "tag"))
    return p


def heading_order(spark, sf_dir):
    h = _tags(spark, sf_dir).where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substr("tag", F.lit(2)).cast("int"))
    # of lists as second-level headings, so that there is something to find
    extra = _tags(spark, sf_dir).where("tag = 'ul'").withColumn("level", F.lit(3))
    return A.heading_problems(h.unionByName(extra), "doc_id", "ix").select("doc_id", "ix", "problem")


def stray_items(spark, sf_dir):
    # every fourth list of a page is taken for something else, so that there is something to find
    tag = F.posexplode(F.regexp_extract_all("html", F.lit("<(/?(?:ul|ol|li|nav|article|body))[ >]"), 1)).alias("ix", "raw")
    t = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tag)
    name = F.regexp_replace("raw", "^/", "")
    t = t.select("doc_id", "ix", F.when((name == "ul") & (F.col("doc_id") % 4 == 0), "div").otherwise(name).alias("tag"),
        F.when(F.col("raw").startswith("/"), -1).otherwise(1).alias("step"))
    return A.stray_items(t).groupBy("doc_id", "parent").agg(F.count("*").alias("n"))


def content_tagged(spark, sf_dir):
    t = _tags(spark, sf_dir).where("tag = 'p'").select("doc_id", F.floor(F.col("ix") / 10).cast("int").alias("page_no"), F.col("ix").alias("mcid"))
    return A.untagged(t, t.where("mcid % 3 = 0"), t.where("mcid % 5 = 0").select("doc_id", "mcid")).groupBy("doc_id").agg(F.count("*").alias("untagged"))


def byte_range_check(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    size = key + 1000
    valid, whole = A.byte_range(key % 50 - F.when(key % 50 > 2, key % 50).otherwise(0), key % 900, key % 900 + key % 40 - 3,
        size - key % 900 - key % 40 + F.when(key % 3 == 0, 3).otherwise(0), size)
    return o.select("o_orderkey", valid.alias("valid"), whole.alias("covers"))


def batch_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return A.batch_report(e, "user_id", "event_id", F.col("value") > 180)


def _filled(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "signature").when(F.col("event_type") == "click", "choice").when(F.col("event_type") == "purchase", "button").otherwise("text")
    fields = e.select("event_id", kind.alias("kind"), (F.col("user_id") % 9 == 0).alias("read_only"),
        F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("options"), F.lit("old").alias("value"))
    asked = F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 1_000_000).otherwise(F.col("event_id"))
    name, value = A.assignment(F.concat(asked.cast("string"), F.lit("="), F.get_json_object("props", "$.k")))
    values = e.where("event_id % 4 <> 0").select(name.cast("long").alias("event_id"), F.when(F.col("event_id") % 6 > 0, value).alias("value"))
    return A.filled(fields, values, "event_id")


def form_fill(spark, sf_dir):
    return _filled(spark, sf_dir)


def form_fill_result(spark, sf_dir):
    return A.fill_result(_filled(spark, sf_dir))


def _cells(spark, sf_dir):
    """Inked cells of one grid for each vector: its greater components, eight to a row."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid"), F.posexplode("embedding").alias("i", "v")).where("v > 0.05")
    return v.select("grid", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"))


def connected_components(spark, sf_dir):
    return R.grid_components(_cells(spark, sf_dir))


def ink_tiles(spark, sf_dir):
    c = _cells(spark, sf_dir)
    pages = c.select("grid").distinct().select("grid", F.lit(8).alias("width"), F.lit(7).alias("height"), F.when(F.col("grid") % 3 == 0, "DIFF").otherwise("PASS").alias("status"))
    other = c.where("y < 7 AND grid % 7 > 0").select((F.col("grid") + 1).alias("grid"), "x", "y")
    return A.ink_tiles(pages, other.where("x % 2 = 0"), c.where("y < 7"), 3, 0.3)


def most_inked(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return A.most_inked(c.select(F.floor(F.col("grid") / 5).cast("long").alias("page"), F.col("grid").alias("image"), "x", "y"))


QUERIES = {f.__name__: f for f in (bates_numbers, next_bates, page_label_asof, roman_labels, merge_pages, split_every_n, split_boundaries, move_pages,
    page_remove, page_move, page_insert, page_extract, corpus_chunks, shard_pages, permission_bits, link_classification, outline_tree,
        role_map_resolve, heading_order, stray_items, content_tagged, byte_range_check, batch_rollup, form_fill, form_fill_result, connected_components, ink_tiles, most_inked)}

_BIT = "((o_orderkey >> {0}) & 1) = 1"
_TAGS = "tags AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<([a-z]+[1-6]?)[ >]', 1)) AS tag, CAST(generate_subscripts(regexp_extract_all(html, '<([a-z]+[1-6]?)[ >]', 1), 1) - 1 AS INTEGER) AS ix FROM pages)"
_CELLS = "cells AS (SELECT grid, (i - 1) % 8 AS x, (i - 1) // 8 AS y FROM (SELECT vec_id AS grid, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE v > CAST(0.05 AS DOUBLE))"
_ALPHA = "CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER))"

_FILL = """WITH f AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'signature' WHEN 'click' THEN 'choice' WHEN 'purchase' THEN 'button'
ELSE 'text' END AS kind, user_id % 9 = 0 AS read_only FROM events),
v AS (SELECT CASE WHEN event_id % 5 = 0 THEN event_id + 1000000 ELSE event_id END AS id, CASE
WHEN event_id % 6 > 0 THEN json_extract_string(props, '$.k') END AS v, true AS given FROM events WHERE event_id % 4 <> 0),
o AS (SELECT coalesce(event_id, id) AS key, kind, v, CASE WHEN event_id IS NULL THEN 'no such field' WHEN given IS NULL THEN 'kept'
WHEN read_only THEN 'read-only' WHEN kind = 'signature' THEN 'refused' WHEN v IS NULL THEN 'cleared'
WHEN kind = 'choice' AND v NOT IN ('1', '2', '3') THEN 'not an option' ELSE 'set' END AS outcome FROM f FULL JOIN v ON event_id = id)"""

ORACLES = {
    "bates_numbers": "SELECT conv_id, turn, n AS number, 'B-' || CASE WHEN n > 999999 THEN CAST(n AS VARCHAR) "
        "ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS label FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)",
    "next_bates": "SELECT count(*) + 1 AS next FROM conversations",
    "page_label_asof": f"""WITH m AS (SELECT conv_id, turn AS first_page FROM conversations WHERE turn % 3 = 1),
j AS (SELECT c.conv_id, c.turn, (SELECT max(first_page) FROM m WHERE m.conv_id = c.conv_id AND first_page <= c.turn) AS f FROM conversations c),
k AS (SELECT *, turn - f + conv_id % 40 + 1 AS n FROM j)
SELECT conv_id, turn, CASE WHEN f IS NULL THEN CAST(turn + 1 AS VARCHAR) WHEN conv_id % 2 = 0 THEN 'p' || n ELSE 'p' || {_ALPHA} END AS label FROM k""",
    "roman_labels": "SELECT conv_id, turn, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS label FROM (SELECT conv_id, turn, turn + conv_id % 60 + 1 AS n FROM conversations)",
    "merge_pages": "SELECT conv_id, turn, CAST(1 - turn % 2 AS INTEGER) AS source, CAST(row_number() OVER (PARTITION BY conv_id "
        "ORDER BY 1 - turn % 2, turn) - 1 AS INTEGER) AS place FROM conversations",
    "split_every_n": "SELECT conv_id, CAST(turn // 3 AS INTEGER) AS part, count(*) AS pages, min(turn) AS first FROM conversations GROUP BY ALL",
    "split_boundaries": "SELECT conv_id, CAST(CASE WHEN turn >= 2 THEN 1 ELSE 0 END + CASE WHEN turn >= 5 THEN 1 "
        "ELSE 0 END AS INTEGER) AS part, count(*) AS pages, min(turn) AS first FROM conversations GROUP BY ALL",
    "move_pages": "SELECT conv_id, turn, CAST(CASE WHEN turn % 4 = 0 THEN least(turn + 3, max(turn) OVER (PARTITION BY conv_id)) "
        "ELSE turn - 1 END AS INTEGER) AS place FROM conversations",
    "page_remove": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place "
        "FROM (SELECT *, bool_and(turn % 3 = 0) OVER (PARTITION BY conv_id) AS every FROM conversations) WHERE turn % 3 <> 0 OR every",
    "page_move": "SELECT conv_id, turn, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) <= 3 THEN turn WHEN turn = 3 THEN 1 "
        "WHEN turn IN (1, 2) THEN turn + 1 ELSE turn END AS INTEGER) AS place FROM conversations",
    "page_insert": "SELECT conv_id, turn, source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, source, turn) - 1 AS INTEGER) AS place "
        "FROM (SELECT conv_id, turn, 0 AS source, CAST(turn AS DOUBLE) AS k FROM conversations UNION ALL SELECT conv_id, turn, 1, 1.5 FROM conversations WHERE turn < 2)",
    "page_extract": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id "
        "ORDER BY list_position([4, 0, 2], turn)) - 1 AS INTEGER) AS place FROM conversations WHERE turn IN (4, 0, 2)",
    "corpus_chunks": "SELECT (n - 1) % 7 AS chunk, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys "
        "FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_orderkey FROM orders)) GROUP BY 1",
    "shard_pages": "SELECT l_orderkey, CAST((n - 1) // 2 AS INTEGER) AS shard, count(*) AS pages, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY ALL",
    "permission_bits": f"SELECT o_orderkey, {_BIT.format(2)} AS can_print, {_BIT.format(3)} AS can_modify, {_BIT.format(4)} AS can_copy, {_BIT.format(5)} AS can_annotate, {_BIT.format(8)} OR {_BIT.format(5)} AS can_fill, {_BIT.format(2)} AND {_BIT.format(11)} AS can_print_well FROM orders",
    "link_classification": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'dangerous' WHEN page_id % 5 = 1 THEN 'internal' "
        "WHEN regexp_matches(lower(url), '^(http|https|mailto):') THEN 'external' ELSE 'dangerous' END AS kind FROM pages WHERE page_id % 5 <> 2",
    "outline_tree": "WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS title FROM region UNION ALL "
        "SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name "
            "FROM supplier), w AS (SELECT node_id, 0 AS depth, title AS path FROM t WHERE parent_id IS NULL UNION ALL "
                "SELECT t.node_id, depth + 1, path || '/' || title FROM t JOIN w ON t.parent_id = w.node_id) SELECT * FROM w",
    "role_map_resolve": "WITH RECURSIVE w AS (SELECT s_suppkey AS name, s_suppkey // 3 AS target, 1 AS hops FROM supplier WHERE s_suppkey > 0 "
        "UNION ALL SELECT name, target // 3, hops + 1 FROM w WHERE target > 0) SELECT name, min(target) AS target, max(hops) AS hops FROM w GROUP BY name",
    "heading_order": f"WITH {_TAGS}, h AS (SELECT doc_id, ix, CASE WHEN tag = 'ul' THEN 3 ELSE CAST(substr(tag, 2) AS INTEGER) END AS level FROM tags "
        f"WHERE tag = 'ul' OR regexp_matches(tag, '^h[1-6]$')), p AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ix) AS b FROM h) "
            f"SELECT doc_id, ix, CASE WHEN b IS NULL THEN 'first' ELSE 'skip' END AS problem FROM p WHERE (b IS NULL AND level <> 1) OR level > b + 1",
    "stray_items": """WITH r AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<(/?(?:ul|ol|li|nav|article|body))[ >]', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<(/?(?:ul|ol|li|nav|article|body))[ >]', 1), 1) AS ix FROM pages),
t AS (SELECT doc_id, ix, raw, CASE WHEN ltrim(raw, '/') = 'ul' AND doc_id % 4 = 0 THEN 'div' ELSE ltrim(raw, '/') END AS tag, sum(CASE
WHEN starts_with(raw, '/') THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ix) AS depth FROM r),
o AS (SELECT * FROM t WHERE NOT starts_with(raw, '/')), p AS (SELECT o.doc_id, o.ix, o.tag, arg_max(a.tag, a.ix) AS parent FROM o LEFT
JOIN o a ON a.doc_id = o.doc_id AND a.depth = o.depth - 1 AND a.ix < o.ix GROUP BY ALL)
SELECT doc_id, parent, count(*) AS n FROM p WHERE tag = 'li' AND coalesce(parent NOT IN ('ul', 'ol'), true) GROUP BY ALL""",
    "content_tagged": f"WITH {_TAGS} SELECT doc_id, count(*) AS untagged FROM tags WHERE tag = 'p' AND ix % 3 <> 0 AND ix % 5 <> 0 GROUP BY doc_id",
    "byte_range_check": """WITH r AS (SELECT o_orderkey, o_orderkey + 1000 AS size, o_orderkey % 50 - CASE
WHEN o_orderkey % 50 > 2 THEN o_orderkey % 50
ELSE 0 END AS a, o_orderkey % 900 AS b, o_orderkey % 900 + o_orderkey % 40 - 3 AS c, o_orderkey + 1000 - o_orderkey % 900 - o_orderkey % 40 + CASE
WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END AS d FROM orders),
v AS (SELECT *, a = 0 AND b >= 0 AND c >= 0 AND d >= 0 AND b <= size AND c + d <= size AND c >= a + b AS valid FROM r)
SELECT o_orderkey, valid, valid AND c + d = size AS covers FROM v""",
    "batch_rollup": "WITH f AS (SELECT user_id, value > 180 AS bad, coalesce(count_if(value > 180) OVER (PARTITION BY user_id "
        "ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS skip FROM events) "
            "SELECT user_id, count_if(NOT skip) AS run, count_if(bad AND NOT skip) AS failed, count_if(skip) AS skipped, CASE "
                "WHEN count_if(bad AND NOT skip) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN count_if(bad AND NOT skip) > 0 THEN 1 "
                    "ELSE 0 END AS exit_code FROM f GROUP BY user_id",
    "form_fill": _FILL + " SELECT key AS event_id, CASE WHEN outcome = 'set' THEN v "
        "WHEN outcome NOT IN ('cleared', 'no such field') THEN 'old' END AS value, CASE "
            "WHEN kind = 'button' AND outcome IN ('set', 'cleared') THEN coalesce(v, 'Off') END AS state, outcome FROM o",
    "form_fill_result": _FILL + ' SELECT count_if(outcome IN (\'set\', \'cleared\')) AS "set", count_if(outcome NOT IN (\'set\', \'cleared\', \'kept\')) AS errors FROM o',
    "connected_components": f"""WITH RECURSIVE {_CELLS},
w AS (SELECT grid, x, y, y * 8 + x AS root FROM cells UNION SELECT c.grid, c.x, c.y, w.root FROM w JOIN cells c ON c.grid = w.grid AND abs(c.x - w.x) + abs(c.y - w.y) = 1),
l AS (SELECT grid, x, y, min(root) AS label FROM w GROUP BY ALL)
SELECT grid, CAST(min(x) AS INT) AS "left", CAST(max(x) AS INT) AS "right", CAST(min(y) AS INT) AS low, CAST(max(y) AS INT) AS high, count(*) AS cells,
  round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) AS density FROM l GROUP BY grid, label""",
    "ink_tiles": f"""WITH {_CELLS}, m AS (SELECT grid + 1 AS grid, x, y FROM cells WHERE y < 7 AND grid % 7 > 0 AND x % 2 = 0),
a AS (SELECT grid, x // 2 AS tx, y // 2 AS ty, count(*) / any_value(least(2, 8 - x // 2 * 2) * least(2, 7 - y // 2 * 2)) >= 0.3 AS want FROM cells WHERE y < 7 GROUP BY ALL),
b AS (SELECT grid, x // 2 AS tx, y // 2 AS ty, count(*) / any_value(least(2, 8 - x // 2 * 2) * least(2, 7 - y // 2 * 2)) >= 0.3 AS have FROM m
GROUP BY ALL), j AS (SELECT coalesce(a.grid, b.grid) AS grid, coalesce(want, false) AS want, coalesce(have, false) AS have FROM a FULL
JOIN b ON a.grid = b.grid AND a.tx = b.tx AND a.ty = b.ty),
c AS (SELECT grid, count_if(want) AS inked, count_if(want AND NOT have) AS missing, count_if(NOT want AND have) AS extra FROM j
WHERE grid IN (SELECT grid FROM cells) GROUP BY grid)
SELECT *, CASE WHEN grid % 3 = 0 THEN 'DIFF' WHEN inked >= 3 AND missing = inked THEN 'MISSING_CONTENT' ELSE 'PASS' END AS status FROM c""",
    "most_inked": f"WITH {_CELLS}, i AS (SELECT grid // 5 AS page, grid AS image, count_if(x % 4 = 0 AND y % 4 = 0) AS ink FROM cells GROUP BY ALL) "
        f"SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY page ORDER BY ink DESC, image) = 1",
}

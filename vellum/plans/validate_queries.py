"""Queries over structure trees, guards, inherited attributes and chains of actions.

Each order stands for a document and its lines for the nodes of its tree (a node's parent is half its number); kinds,
attributes and actions follow from the keys of the line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import records as R
from vellum.operators import validate as V
from vellum.sources.tables import load

#: Kinds that the lines of orders take in turn; the last ones need a role map.
KINDS = ("Table", "TR", "TD", "L", "LI", "LBody", "H1", "H2", "H3", "H", "Figure", "P", "Chapter", "Row", "Odd", "Loop")
#: Role maps of all documents: a chain, a plain one, and a cycle.
ROLES = (("Chapter", "Title"), ("Title", "H1"), ("Row", "TR"), ("Loop", "Loop2"), ("Loop2", "Loop"))


def _docs(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("doc_id"), (k % 3 > 0).alias("marked"), F.when(k % 5 > 0, F.lit("en")).otherwise(" ").alias("lang"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("title"),
        F.when(k % 8 == 0, F.lit("x")).alias("xmp_title"), (k % 7 > 0).alias("shows_title"), (k % 11 > 0).alias("has_tree"),
    )


def _lines(spark, sf_dir):
    """Lines of orders with their place among those of the order."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").cast("long").alias("node_id")).agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"))


def _nodes(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod("part", F.lit(len(KINDS))).cast("int"))
    up = F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2))
    return _lines(spark, sf_dir).select(
        "doc_id", "node_id", up.alias("parent_id"), kind.alias("kind"), F.when(F.col("supp") % 3 == 0, F.lit("a picture")).alias("alt"),
            F.when(F.col("supp") % 5 == 0, F.lit(" ")).alias("actual")
    )


def _resolved(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    role = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("role")) for a, b in ROLES]))
    roles = nodes.select("doc_id").distinct().where("doc_id % 2 = 0").select("doc_id", role.alias("r")).select("doc_id", "r.*")
    return V.resolved_kinds(V.within_depth(nodes), roles)


def accessible_rules(spark, sf_dir):
    loose = _lines(spark, sf_dir).where("part % 9 = 0")
    return V.accessible(_docs(spark, sf_dir), _resolved(spark, sf_dir), loose).groupBy("rule", "status").agg(F.count("*").alias("documents"), F.sum("problems").alias("problems"))


def validation_rules(spark, sf_dir):
    """The twelve rules for each document."""
    loose = _lines(spark, sf_dir).where("part % 9 = 0")
    return V.accessible(_docs(spark, sf_dir), _resolved(spark, sf_dir), loose)


def subset_conformance(spark, sf_dir):
    return R.conformant(validation_rules(spark, sf_dir), "doc_id")


def heading_rules(spark, sf_dir):
    return V.heading_findings(_resolved(spark, sf_dir))


def table_report(spark, sf_dir):
    return V.listed(V.table_problems(_resolved(spark, sf_dir)), 2)


def list_rules(spark, sf_dir):
    structure, bodies = V.list_findings(_resolved(spark, sf_dir))
    return structure.withColumn("rule", F.lit("structure")).unionByName(bodies.withColumn("rule", F.lit("bodies")))


def tree_depths(spark, sf_dir):
    return V.within_depth(_nodes(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("n"))


def archive_rules(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    xmp = F.when(k % 4 > 0, F.concat(F.lit("<pdfaid:part>"), (k % 3).cast("string"), F.lit("</pdfaid:part><pdfaid:conformance>"), F.when(k % 5 > 0, "B").otherwise("U")))
    intents = F.array(F.struct(F.lit("GTS_PDFX").alias("kind"), F.lit(True).alias("has_profile")), F.struct(F.lit("GTS_PDFA1").alias("kind"), (k % 2 == 0).alias("has_profile")))
    docs = s.select(k.alias("doc_id"), xmp.alias("xmp"), intents.alias("intents"), (k % 6 > 0).alias("has_id"))
    return V.archivable(docs, 1).select("doc_id", "rule", "status")


def permission_guard(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    actions = F.array(*[F.lit(a) for a in ("extract", "modify", "fill", "assemble", "view")])
    held = o.select("o_orderkey", F.explode(actions).alias("action"))
    out = V.guard(F.col("o_orderkey") * 37 % 4096, F.col("action"), F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 2 == 0)
    return held.groupBy("action", out.alias("outcome")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def page_range_check(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("pages"), F.max("l_suppkey").alias("s"))
    return n.select("doc_id", V.page_error(F.col("s") % 9 - 1, F.col("pages")).alias("error")).where("error IS NOT NULL")


def confidence_policy(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tier = F.get(F.array(*map(F.lit, ("Ok", "Degraded", "Severe"))), (k % 3).cast("int"))
    out = V.policy(F.when(k % 4 > 0, F.lit("reader")), tier, k % 5 == 0, k % 7 == 0)
    return o.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def inherited_boxes(spark, sf_dir):
    nodes = _lines(spark, sf_dir).select("doc_id", "node_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2)).alias("parent_id"),
        F.when(F.col("part") % 3 == 0, F.col("part")).alias("box"))
    return V.inherited(nodes, "box").select("doc_id", "node_id", F.coalesce("value", F.lit(612)).alias("box"))


def field_tree(spark, sf_dir):
    nodes = _lines(spark, sf_dir).select("doc_id", "node_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2)).alias("parent_id"),
        F.when(F.col("part") % 4 > 0, F.concat(F.lit("f"), F.col("node_id").cast("string"))).alias("title"))
    return V.field_names(nodes)


def action_chain(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("GoTo", "URI", "Named"))), (F.col("part") % 3).cast("int"))
    a = _lines(spark, sf_dir).select("doc_id", F.col("node_id").alias("action_id"), F.when(F.col("node_id") == 1, F.lit("O")).alias("trigger"),
        kind.alias("kind"), F.when(F.col("node_id") == 5, F.lit(2)).otherwise(F.col("node_id") + 1).alias("next_id"))
    return V.action_chains(a).groupBy("doc_id", "trigger").agg(F.count("*").alias("steps"),
        F.concat_ws(">", F.transform(F.sort_array(F.collect_list(F.struct("step", "kind"))), lambda x: x["kind"])).alias("kinds"))


QUERIES = {
    f.__name__: f
    for f in (
        accessible_rules, validation_rules, subset_conformance, heading_rules, table_report, list_rules, tree_depths, archive_rules, permission_guard, page_range_check, confidence_policy, inherited_boxes,
        field_tree, action_chain,
    )
}

_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_ROLES = ", ".join(f"('{a}', '{b}')" for a, b in ROLES)
_STANDARD = ", ".join(f"'{k}'" for k in V.STANDARD)
_LINES = "ln AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS node_id, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL)"
_NODES = f"""{_LINES},
docs AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 > 0 AS marked, o_orderkey % 5 > 0 AS lang, o_orderkey % 4 > 0 OR o_orderkey % 8 = 0 AS title, o_orderkey % 7 > 0 AS shows, o_orderkey % 11 > 0 AS has_tree FROM orders),
raw AS (SELECT doc_id, node_id, CASE WHEN node_id > 1 THEN node_id // 2 END AS parent_id, {_KINDS}[part % {len(KINDS)} + 1] AS raw, supp % 3 = 0 AS alt FROM ln),
up(doc_id, node_id, depth) AS (SELECT doc_id, node_id, 0 FROM raw WHERE parent_id IS NULL UNION ALL SELECT r.doc_id, r.node_id, depth + 1 FROM raw r
JOIN up u ON r.doc_id = u.doc_id AND r.parent_id = u.node_id),
n AS (SELECT r.*, depth, doc_id % 2 = 0 AS has_roles, CASE WHEN doc_id % 2 = 0 THEN CASE raw WHEN 'Chapter' THEN 'H1' WHEN 'Row' THEN 'TR'
ELSE raw END ELSE raw END AS kind FROM raw r JOIN up USING (doc_id, node_id)),
n2 AS (SELECT *, raw NOT IN ({_STANDARD}) AND NOT (has_roles AND raw IN ('Chapter', 'Title', 'Row', 'Loop', 'Loop2')) AS unmapped FROM n)"""
_HEADS = """h AS (SELECT *, CASE WHEN kind = 'H' THEN 0 ELSE CAST(substr(kind, 2, 1) AS INTEGER) END AS level FROM own WHERE regexp_matches(kind, '^H[1-6]?$')),
hl AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY node_id) AS before FROM h WHERE level > 0),
hs AS (SELECT doc_id, count_if((before IS NULL AND level <> 1) OR level > before + 1) AS skips FROM hl GROUP BY doc_id),
heads AS (SELECT h.doc_id, count(*) AS n, CAST(CASE WHEN count_if(level = 0) BETWEEN 1 AND count(*) - 1 THEN 1
ELSE coalesce(any_value(skips), 0) END AS BIGINT) AS bad FROM h LEFT JOIN hs USING (doc_id) GROUP BY h.doc_id)"""
_TABLES = """k AS (SELECT t.doc_id, t.node_id, c.node_id AS kid, c.kind AS kid_kind FROM own t
JOIN own c ON c.doc_id = t.doc_id AND c.parent_id = t.node_id WHERE t.kind = 'Table'),
rw AS (SELECT doc_id, node_id, kid FROM k WHERE kid_kind = 'TR' UNION ALL SELECT k.doc_id, k.node_id, c.node_id FROM k
JOIN own c ON c.doc_id = k.doc_id AND c.parent_id = k.kid WHERE kid_kind IN ('THead', 'TBody', 'TFoot') AND c.kind = 'TR'),
tp AS (SELECT doc_id, node_id, 'unexpected child ' || kid_kind AS problem FROM k WHERE kid_kind NOT IN ('TR', 'THead', 'TBody', 'TFoot', 'Caption')
  UNION ALL SELECT doc_id, node_id, 'no rows' FROM own t WHERE kind = 'Table' AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.doc_id = t.doc_id AND rw.node_id = t.node_id)
  UNION ALL SELECT rw.doc_id, rw.node_id, 'no cell ' || c.kind FROM rw JOIN own c ON c.doc_id = rw.doc_id AND c.parent_id = rw.kid WHERE c.kind NOT IN ('TH', 'TD'))"""
_LISTS = """pl AS (SELECT c.*, u.kind AS up_kind FROM own c LEFT JOIN own u ON u.doc_id = c.doc_id AND u.node_id = c.parent_id),
bl AS (SELECT l.doc_id, 1 AS n, CASE WHEN coalesce(count_if(c.kind = 'LI'), 0) = 0 THEN 1
ELSE 0 END + coalesce(count_if(c.kind NOT IN ('LI', 'Caption')), 0) AS bad FROM own l LEFT
JOIN own c ON c.doc_id = l.doc_id AND c.parent_id = l.node_id WHERE l.kind = 'L' GROUP BY l.doc_id, l.node_id
  UNION ALL SELECT doc_id, 1, 1 FROM pl WHERE kind = 'LI' AND coalesce(up_kind, '') <> 'L'),
ls AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM bl GROUP BY doc_id),
lb AS (SELECT doc_id, count(*) AS n, count_if(NOT EXISTS (SELECT 1 FROM own b
WHERE b.doc_id = pl.doc_id AND b.parent_id = pl.node_id AND b.kind = 'LBody')) AS bad FROM pl WHERE kind = 'LI' AND up_kind = 'L' GROUP BY doc_id)"""
_ALL = f"WITH RECURSIVE {_NODES}, own AS (SELECT * FROM n2)"
_OWN = f"WITH RECURSIVE {_NODES}, own AS (SELECT n2.* FROM n2 JOIN docs USING (doc_id) WHERE has_tree)"


def _status(bad: str, n: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN 'NotApplicable' WHEN {bad} = 0 THEN 'Pass' ELSE 'Fail' END, coalesce({bad}, 0)"


def _plain(test: str) -> str:
    return f"CASE WHEN {test} THEN 'Pass' ELSE 'Fail' END, 0"


def _if_tree(bad: str) -> str:
    return f"CASE WHEN NOT has_tree THEN 'NotChecked' WHEN coalesce({bad}, 0) = 0 THEN 'Pass' ELSE 'Fail' END, CASE WHEN has_tree THEN coalesce({bad}, 0) ELSE 0 END"


#: The twelve rules of each document.
_TWELVE = f"""{_OWN}, {_HEADS}, {_TABLES}, {_LISTS},
um AS (SELECT doc_id, count(DISTINCT raw) AS bad FROM own WHERE unmapped GROUP BY doc_id), lo AS (SELECT doc_id, count(*) AS bad FROM ln WHERE part % 9 = 0 GROUP BY doc_id),
fi AS (SELECT doc_id, count(*) AS n, count_if(NOT alt) AS bad FROM own WHERE kind = 'Figure' GROUP BY doc_id),
ta AS (SELECT doc_id, count(*) AS n, (SELECT count(*) FROM tp WHERE tp.doc_id = own.doc_id) AS bad FROM own WHERE kind = 'Table' GROUP BY doc_id),
r(doc_id, rule, status, problems) AS (SELECT doc_id, 'Marked', {_plain('marked')} FROM docs UNION ALL SELECT doc_id, 'StructTreeRoot', {_plain('has_tree')} FROM docs
UNION ALL SELECT doc_id, 'Lang', {_plain('lang')} FROM docs
UNION ALL SELECT doc_id, 'Title', {_plain('title')} FROM docs UNION ALL SELECT doc_id, 'DisplayDocTitle', {_plain('shows')} FROM docs
UNION ALL SELECT doc_id, 'RoleMap', {_if_tree('um.bad')} FROM docs LEFT JOIN um USING (doc_id) UNION ALL SELECT doc_id, 'Content-Tagged', {_if_tree('lo.bad')} FROM docs LEFT JOIN lo USING (doc_id)
UNION ALL SELECT doc_id, 'Figure-Alt', {_status('fi.bad', 'fi.n')} FROM docs LEFT JOIN fi USING (doc_id) UNION ALL
SELECT doc_id, 'Heading-Order', {_status('heads.bad', 'heads.n')} FROM docs LEFT JOIN heads USING (doc_id)
UNION ALL SELECT doc_id, 'Table-Structure', {_status('ta.bad', 'ta.n')} FROM docs LEFT JOIN ta USING (doc_id) UNION ALL
SELECT doc_id, 'List-Structure', {_status('ls.bad', 'ls.n')} FROM docs LEFT JOIN ls USING (doc_id)
UNION ALL SELECT doc_id, 'List-ItemBody', {_status('lb.bad', 'lb.n')} FROM docs JOIN lb USING (doc_id))"""

ORACLES = {
    "accessible_rules": f"{_TWELVE} SELECT rule, status, count(*) AS documents, CAST(sum(problems) AS BIGINT) AS problems FROM r GROUP BY ALL",
    "validation_rules": f"{_TWELVE} SELECT doc_id, rule, status, problems FROM r",
    "subset_conformance": f"{_TWELVE} SELECT doc_id, NOT bool_or(status = 'Fail') AS conformant, count_if(status = 'Fail') AS failures FROM r GROUP BY doc_id",
    "heading_rules": f"{_ALL}, {_HEADS} SELECT doc_id, n, bad FROM heads",
    "table_report": f"""{_ALL}, {_TABLES}, o AS (SELECT doc_id, list(problem ORDER BY node_id, problem) AS p FROM tp GROUP BY doc_id)
SELECT doc_id, array_to_string(p[1:2], '; ') || CASE WHEN len(p) > 2 THEN '; +' || (len(p) - 2) || ' more' ELSE '' END AS report FROM o""",
    "list_rules": f"{_ALL}, {_LISTS} SELECT doc_id, n, bad, 'structure' AS rule FROM ls UNION ALL SELECT doc_id, n, bad, 'bodies' FROM lb",
    "tree_depths": f"{_ALL} SELECT depth, count(*) AS n FROM n GROUP BY depth",
    "archive_rules": """SELECT s_suppkey AS doc_id, rule, CASE WHEN ok THEN 'Pass' ELSE 'Fail' END AS status FROM supplier, LATERAL (VALUES
 ('XmpPdfaId', s_suppkey % 4 > 0 AND s_suppkey % 3 = 1 AND s_suppkey % 5 > 0), ('OutputIntent', s_suppkey % 2 = 0), ('TrailerId', s_suppkey % 6 > 0)) r(rule, ok)""",
    "permission_guard": """WITH o AS (SELECT o_orderkey AS k, o_orderkey * 37 % 4096 AS m, unnest(['extract', 'modify', 'fill', 'assemble', 'view']) AS action FROM orders),
p AS (SELECT *, CASE action WHEN 'extract' THEN m & 16 > 0 WHEN 'modify' THEN m & 8 > 0 WHEN 'fill' THEN m & 32 > 0 OR m & 256 > 0
WHEN 'assemble' THEN m & 1024 > 0 ELSE true END AS ok FROM o)
SELECT action, CASE WHEN ok THEN 'allowed' WHEN action = 'extract' AND k % 2 = 0 AND m & 512 > 0 THEN 'allowed for accessibility'
WHEN k % 5 = 0 THEN 'overridden' ELSE 'blocked' END AS outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM p GROUP BY ALL""",
    "page_range_check": """WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS pages, max(l_suppkey) % 9 - 1 AS p FROM lineitem GROUP BY 1)
SELECT doc_id, 'PAGE_OUT_OF_RANGE: ' || p || ' is outside 1..' || pages AS error FROM n WHERE p < 1 OR p > pages""",
    "confidence_policy": """SELECT CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'refuse' ELSE 'warn' END
WHEN o_orderkey % 3 = 2 AND o_orderkey % 7 > 0 THEN 'refuse' WHEN o_orderkey % 3 > 0 THEN 'warn' ELSE 'proceed' END AS outcome,
count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
    "inherited_boxes": f"""WITH RECURSIVE {_LINES}, t AS (SELECT doc_id, node_id, CASE WHEN node_id > 1 THEN node_id // 2 END AS parent_id, CASE
WHEN part % 3 = 0 THEN part END AS box FROM ln),
w(doc_id, node_id, up, box) AS (SELECT doc_id, node_id, parent_id, box FROM t UNION ALL SELECT w.doc_id, w.node_id, t.parent_id, t.box FROM w
JOIN t ON t.doc_id = w.doc_id AND t.node_id = w.up WHERE w.box IS NULL)
SELECT doc_id, node_id, CAST(coalesce(max(box), 612) AS BIGINT) AS box FROM w GROUP BY ALL""",
    "field_tree": f"""WITH RECURSIVE {_LINES}, t AS (SELECT doc_id, node_id, CASE WHEN node_id > 1 THEN node_id // 2 END AS parent_id, CASE
WHEN part % 4 > 0 THEN 'f' || node_id ELSE '' END AS title FROM ln),
w(doc_id, node_id, full_name) AS (SELECT doc_id, node_id, title FROM t WHERE parent_id IS NULL UNION ALL
SELECT t.doc_id, t.node_id, CASE WHEN title = '' THEN full_name WHEN full_name = '' THEN title ELSE full_name || '.' || title END FROM t
JOIN w ON t.doc_id = w.doc_id AND t.parent_id = w.node_id) SELECT * FROM w""",
    "action_chain": f"""WITH RECURSIVE {_LINES}, a AS (SELECT doc_id, node_id AS id, CASE WHEN node_id = 5 THEN 2
ELSE node_id + 1 END AS nxt, ['GoTo', 'URI', 'Named'][part % 3 + 1] AS kind FROM ln),
w(doc_id, step, nxt, kind, seen) AS (SELECT doc_id, 0, nxt, kind, [id] FROM a WHERE id = 1 UNION ALL
SELECT a.doc_id, step + 1, a.nxt, a.kind, list_append(seen, a.id) FROM a JOIN w ON a.doc_id = w.doc_id AND a.id = w.nxt WHERE NOT list_contains(seen, a.id))
SELECT doc_id, 'O' AS "trigger", count(*) AS steps, string_agg(kind, '>' ORDER BY step) AS kinds FROM w GROUP BY doc_id""",
}

"""Rules over structure trees: what a tagged document must have, an archive's markers, and guards.

A tree is a table (doc_id, node_id, parent_id, kind, alt, actual) in document order of ``node_id``; a document has
(doc_id, marked, lang, title, xmp_title, shows_title, has_tree).  Each rule gives a row for each document; all joins
are by document and node, so nothing grows beyond a document's own tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.scratch import discard
from vellum.sources.scratch import written_large as written

#: Structure types of the standard (fixed values).
STANDARD = (
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot "
    "Span Quote Note Reference BibEntry Code Link Annot Ruby Warichu RB RT RP WT WP Figure Formula Form"
).split()
#: Levels below which a tree isn't followed, and problems that a report lists.
DEEPEST, LISTED = 64, 5
PASS, FAIL, NOT_APPLICABLE, NOT_CHECKED = "Pass", "Fail", "NotApplicable", "NotChecked"


def resolved_kinds(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Nodes with ``kind`` mapped on by roles (doc_id, name, role) until a name has none; a cycle ends where it began.

    The map of a document is walked as one expression over its own entries, which are few.
    """
    maps = roles.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "role"))).alias("_roles"))
    held = nodes.join(maps.hint("merge"), "doc_id", "left").withColumn("raw", F.col("kind"))
    start = F.struct(F.col("kind").alias("at"), F.array().cast("array<string>").alias("seen"))

    def onward(state: Column, _: Column) -> Column:
        known = F.map_contains_key("_roles", state["at"]) & ~F.array_contains(state["seen"], state["at"])
        return F.when(known, F.struct(F.element_at("_roles", state["at"]).alias("at"), F.array_append(state["seen"], state["at"]).alias("seen"))).otherwise(state)

    # as many steps as the map has entries, and one more
    steps = F.sequence(F.lit(0), F.size("_roles"))
    walked = F.when(F.col("_roles").isNotNull(), F.aggregate(steps, start, onward)["at"]).otherwise(F.col("kind"))
    mapped = F.coalesce(F.map_contains_key("_roles", F.col("raw")), F.lit(False))
    return held.withColumn("kind", walked).withColumn("unmapped", ~F.col("raw").isin(*STANDARD) & ~mapped).drop("_roles")


def within_depth(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Nodes that are reached from roots in at most ``deepest`` steps, with their ``depth``; one join and one written table for each level."""
    level = nodes.where("parent_id IS NULL").withColumn("depth", F.lit(0))
    tables = [written(level, "level")]
    for depth in range(1, deepest + 1):
        above = tables[-1].select("doc_id", F.col("node_id").alias("parent_id"))
        below = written(nodes.join(above, ["doc_id", "parent_id"]).select(*nodes.columns).withColumn("depth", F.lit(depth)), "level")
        if below.isEmpty():
            discard(below)
            break
        tables.append(below)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _rule(docs: DataFrame, rule: str, status: Column, problems: Column | None = None) -> DataFrame:
    return docs.select("doc_id", F.lit(rule).alias("rule"), status.alias("status"), (F.lit(0) if problems is None else problems).cast("long").alias("problems"))


def _holds(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), PASS).otherwise(FAIL)


def _said(text: str) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def _over(docs: DataFrame, found: DataFrame, rule: str, kind: str = FAIL) -> DataFrame:
    """A rule from (doc_id, n, bad): not applicable to a document without ``n``."""
    held = docs.select("doc_id").join(found, "doc_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, NOT_APPLICABLE).when(F.col("bad") == 0, PASS).otherwise(kind)
    return _rule(held, rule, status, F.coalesce("bad", F.lit(0)))


def heading_findings(nodes: DataFrame) -> DataFrame:
    """(doc_id, n, bad) of headings in document order: levels that begin below 1 or skip one, or numbered headings beside plain ones."""
    level = F.when(F.col("kind") == "H", 0).when(F.col("kind").rlike("^H[1-6]$"), F.substring("kind", 2, 1).cast("int"))
    heads = nodes.withColumn("level", level).where("level IS NOT NULL")
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("node_id"))
    numbered = heads.where("level > 0").withColumn("_before", before)
    skips = numbered.groupBy("doc_id").agg(F.count_if((F.col("_before").isNull() & (F.col("level") != 1)) | (F.col("level") > F.col("_before") + 1)).alias("skips"))
    out = heads.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == 0).alias("plain")).join(skips.hint("merge"), "doc_id", "left")
    mixed = (F.col("plain") > 0) & (F.col("plain") < F.col("n"))
    return out.select("doc_id", "n", F.when(mixed, 1).otherwise(F.coalesce("skips", F.lit(0))).alias("bad"))


def table_problems(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, problem): children of tables that don't belong there, tables without rows, cells that are none."""
    kids = nodes.select("doc_id", F.col("parent_id").alias("_up"), F.col("node_id").alias("kid"), F.col("kind").alias("kid_kind"))
    tables = nodes.where("kind = 'Table'").select("doc_id", "node_id")
    below = tables.join(kids.hint("merge"), (tables["doc_id"] == kids["doc_id"]) & (tables["node_id"] == kids["_up"])).select(tables["doc_id"], "node_id", "kid", "kid_kind")
    odd = below.where("kid_kind NOT IN ('TR', 'THead', 'TBody', 'TFoot', 'Caption')").select("doc_id", "node_id", F.concat(F.lit("unexpected child "), "kid_kind").alias("problem"))
    groups = below.where("kid_kind IN ('THead', 'TBody', 'TFoot')").select("doc_id", "node_id", F.col("kid").alias("group"))
    inner = groups.join(kids.hint("merge"), (groups["doc_id"] == kids["doc_id"]) & (groups["group"] == kids["_up"])).where("kid_kind = 'TR'").select(groups["doc_id"], "node_id", "kid")
    rows = below.where("kid_kind = 'TR'").select("doc_id", "node_id", "kid").unionByName(inner)
    empty = tables.join(rows.hint("merge"), ["doc_id", "node_id"], "left_anti").withColumn("problem", F.lit("no rows"))
    row = rows.select("doc_id", "node_id", F.col("kid").alias("row"))
    cells = row.join(kids.hint("merge"), (row["doc_id"] == kids["doc_id"]) & (row["row"] == kids["_up"])).where("kid_kind NOT IN ('TH', 'TD')")
    return odd.unionByName(empty).unionByName(cells.select(row["doc_id"], "node_id", F.concat(F.lit("no cell "), "kid_kind").alias("problem")))


def listed(problems: DataFrame, most: int = LISTED) -> DataFrame:
    """(doc_id, report): the first problems of each document, and how many more there are."""
    held = F.transform(F.sort_array(F.collect_list(F.struct("node_id", "problem"))), lambda p: p["problem"])
    out = problems.groupBy("doc_id").agg(held.alias("_all"))
    more = F.size("_all") - most
    return out.select("doc_id", F.concat(F.concat_ws("; ", F.slice("_all", 1, most)), F.when(more > 0, F.concat(F.lit("; +"), more.cast("string"),
        F.lit(" more"))).otherwise("")).alias("report"))


def list_findings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, bad) of lists, and of their items' bodies: lists without items, children that are none, items outside of lists."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("up_kind"))
    placed = nodes.join(up.hint("merge"), ["doc_id", "parent_id"], "left")
    lists = nodes.where("kind = 'L'").select("doc_id", "node_id")
    kids = placed.where("up_kind = 'L'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("kind") == "LI").alias("items"),
        F.count_if(~F.col("kind").isin("LI", "Caption")).alias("odd"))
    by_list = lists.join(kids.hint("merge"), ["doc_id", "node_id"], "left").select("doc_id", F.lit(1).alias("n"),
        (F.when(F.coalesce("items", F.lit(0)) == 0, 1).otherwise(0) + F.coalesce("odd", F.lit(0))).alias("bad"))
    stray = placed.where("kind = 'LI' AND coalesce(up_kind, '') <> 'L'").select("doc_id", F.lit(1).alias("n"), F.lit(1).alias("bad"))
    structure = by_list.unionByName(stray).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    items = placed.where("kind = 'LI' AND up_kind = 'L'").select("doc_id", "node_id")
    bodies = nodes.where("kind = 'LBody'").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_body", F.lit(True))
    body = items.join(bodies.hint("merge"), ["doc_id", "node_id"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("_body").isNull()).alias("bad"))
    return structure, body


def accessible(docs: DataFrame, nodes: DataFrame, untagged: DataFrame) -> DataFrame:
    """(doc_id, rule, status, problems) of the twelve rules of tagged documents.

    ``nodes`` hold resolved kinds and ``unmapped``; ``untagged`` are text runs outside of the tree (doc_id, ...).
    A document without lists has no row for their items.
    """
    docs = docs.hint("merge")
    tree = docs.where("has_tree").select("doc_id")
    own = written(nodes.join(tree, "doc_id", "left_semi"), "nodes")
    unmapped = own.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("unmapped"), F.col("raw"))).alias("bad"))
    loose = untagged.groupBy("doc_id").agg(F.count("*").alias("bad"))
    figures = own.where("kind = 'Figure'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~_said("alt") & ~_said("actual")).alias("bad"))
    tables = own.where("kind = 'Table'").groupBy("doc_id").agg(F.count("*").alias("n"))
    bad_tables = table_problems(own).groupBy("doc_id").agg(F.count("*").alias("bad"))
    tables = tables.join(bad_tables.hint("merge"), "doc_id", "left").select("doc_id", "n", F.coalesce("bad", F.lit(0)).alias("bad"))
    structure, bodies = list_findings(own)

    def if_tree(found: DataFrame, rule: str) -> DataFrame:
        held = docs.select("doc_id", "has_tree").join(found, "doc_id", "left")
        bad = F.coalesce("bad", F.lit(0))
        return _rule(held, rule, F.when(~F.col("has_tree"), NOT_CHECKED).otherwise(_holds(bad == 0)), F.when(F.col("has_tree"), bad).otherwise(0))

    parts = [
        _rule(docs, "Marked", _holds(F.col("marked"))), _rule(docs, "StructTreeRoot", _holds(F.col("has_tree"))), _rule(docs, "Lang", _holds(_said("lang"))),
        _rule(docs, "Title", _holds(_said("title") | _said("xmp_title"))), _rule(docs, "DisplayDocTitle", _holds(F.col("shows_title"))), if_tree(unmapped, "RoleMap"),
        _over(docs, figures, "Figure-Alt"), _over(docs, heading_findings(own), "Heading-Order"), _over(docs, tables, "Table-Structure"), _over(docs, structure, "List-Structure"),
        _over(docs, bodies, "List-ItemBody").where(F.col("status") != NOT_APPLICABLE), if_tree(loose, "Content-Tagged"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def archivable(docs: DataFrame, part: int) -> DataFrame:
    """(doc_id, rule, status, problems) of an archive's three markers, from (doc_id, xmp, intents, has_id): ``intents`` are (kind, has_profile)."""
    xmp = F.coalesce("xmp", F.lit(""))
    named = F.contains(xmp, F.lit(f"pdfaid:part>{part}")) & F.contains(xmp, F.lit("pdfaid:conformance>B"))
    profiled = F.exists("intents", lambda i: (i["kind"] == "GTS_PDFA1") & i["has_profile"])
    return _rule(docs, "XmpPdfaId", _holds(named)).unionByName(_rule(docs, "OutputIntent", _holds(profiled))).unionByName(_rule(docs, "TrailerId", _holds(F.col("has_id"))))


#: Actions with the bits of a mask that allow them, counted from 1 (fixed values).
ALLOWING = {"extract": (5,), "modify": (4,), "fill": (6, 9), "assemble": (11,)}
FOR_ACCESS = 10


def guard(mask: Column, action: Column, ignores: Column, for_access: Column) -> Column:
    """What comes of an action under a mask: allowed, allowed for accessibility, overridden or blocked; other actions are allowed."""

    def bit(n: int) -> Column:
        return F.shiftright(mask, n - 1).bitwiseAND(1) == 1

    allowed = F.lit(None).cast("boolean")
    for name, bits in ALLOWING.items():
        any_bit = F.lit(False)
        for n in bits:
            any_bit = any_bit | bit(n)
        allowed = F.when(action == name, any_bit).otherwise(allowed)
    accessible_copy = (action == "extract") & for_access & bit(FOR_ACCESS)
    return F.when(F.coalesce(allowed, F.lit(True)), "allowed").when(accessible_copy, "allowed for accessibility").when(ignores, "overridden").otherwise("blocked")


def page_error(page: Column, pages: Column) -> Column:
    """The error of a page number outside of a document, else null."""
    inside = (page >= 1) & (page <= pages)
    return F.when(~inside, F.concat(F.lit("PAGE_OUT_OF_RANGE: "), page.cast("string"), F.lit(" is outside 1.."), pages.cast("string")))


def policy(oracle: Column, tier: Column, strict: Column, allows_low: Column) -> Column:
    """Whether a redaction goes on, from an independent reading's tier: refuse, warn or proceed."""
    unread = F.when(strict, "refuse").otherwise("warn")
    return F.when(oracle.isNull(), unread).when((tier == "Severe") & ~allows_low, "refuse").when(tier.isin("Severe", "Degraded"), "warn").otherwise("proceed")


def inherited(nodes: DataFrame, attribute: str, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, node_id, value): a node's own attribute, else that of the nearest node above that has one.

    Each round looks twice as far up, and is a written table, so 64 levels take six rounds.
    """
    state = written(nodes.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.col(attribute).alias("value")), "inherited")
    reach = 1
    while reach < deepest:
        above = state.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_next"), F.col("value").alias("_value"))
        onward = state.join(above, ["doc_id", "up"], "left")
        step = written(onward.select("doc_id", "node_id", F.when(F.col("value").isNull(), F.col("_next")).alias("up"), F.coalesce("value", "_value").alias("value")), "inherited")
        discard(state)
        state, reach = step, reach * 2
        if state.where("up IS NOT NULL").isEmpty():
            break
    return state.select("doc_id", "node_id", "value")


def field_names(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, node_id, full_name): partial names from the root on, joined by dots; a field without one adds none."""
    level = nodes.where("parent_id IS NULL").select("doc_id", "node_id", F.coalesce("title", F.lit("")).alias("full_name"))
    tables = [written(level, "fields")]
    for _ in range(deepest):
        above = tables[-1].select("doc_id", F.col("node_id").alias("parent_id"), F.col("full_name").alias("_above"))
        name = F.when(F.length(F.coalesce("title", F.lit(""))) == 0, F.col("_above")).when(F.col("_above") == "", F.col("title")).otherwise(F.concat("_above", F.lit("."), "title"))
        below = written(nodes.join(above, ["doc_id", "parent_id"]).select("doc_id", "node_id", name.alias("full_name")), "fields")
        if below.isEmpty():
            discard(below)
            break
        tables.append(below)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def action_chains(actions: DataFrame, deepest: int = 32) -> DataFrame:
    """(doc_id, trigger, step, action_id, kind): the actions that a trigger sets off, one after the other.

    ``actions`` are (doc_id, action_id, trigger, kind, next_id): a chain starts where a trigger stands and goes on by
    ``next_id`` until there is none, it comes back to an action, or it is too deep.
    """
    flat = actions.select("doc_id", F.col("action_id").alias("at"), F.col("kind").alias("_kind"), F.col("next_id").alias("_next"))
    front = actions.where("trigger IS NOT NULL").select("doc_id", "trigger", F.lit(0).alias("step"), "action_id", "kind",
        F.col("next_id").alias("at"), F.array("action_id").alias("seen"))
    tables = [written(front, "chain")]
    for step in range(1, deepest):
        on = tables[-1].select("doc_id", "trigger", "at", "seen").join(flat, ["doc_id", "at"]).where(~F.array_contains("seen", F.col("at")))
        nxt = written(on.select("doc_id", "trigger", F.lit(step).alias("step"), F.col("at").alias("action_id"), F.col("_kind").alias("kind"),
            F.col("_next").alias("at"), F.array_append("seen", F.col("at")).alias("seen")), "chain")
        if nxt.isEmpty():
            discard(nxt)
            break
        tables.append(nxt)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("doc_id", "trigger", "step", "action_id", "kind")

"""Trees of names: listed in order, or looked up by descending only where a node's limits hold the name; files and packets that documents hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.scratch import discard, written


def _levels(roots: DataFrame, kids: DataFrame, on: Column, keep: list[str], deepest: int) -> DataFrame:
    """Nodes reached from ``roots``, with the places of their path; a node that stands above itself isn't entered."""
    level = written(roots, "names")
    out = level
    for _ in range(deepest):
        below = level.alias("above").join(kids.alias("kid"), on).where("NOT array_contains(above.trail, kid.kid_node)")
        down = below.select(*[f"above.{k}" for k in keep], F.col("kid.kid_node").alias("node"), F.concat("above.path", F.array("kid.kid_place")).alias("path"),
            F.concat("above.trail", F.array("kid.kid_node")).alias("trail"))
        level = written(down, "names")
        if level.isEmpty():
            discard(level)
            break
        out = out.unionByName(level)
    return out


def _kids(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select(F.col("doc_id").alias("kid_doc"), "parent", F.col("node").alias("kid_node"), F.col("place").alias("kid_place"), "low", "high")


def listed(nodes: DataFrame, entries: DataFrame, deepest: int = 32) -> DataFrame:
    """(doc_id, path, place, name, value): all entries (doc_id, node, place, name, value) below the roots of ``nodes`` (doc_id, node, parent, place, low, high).

    ``path`` and ``place`` order a document's entries as a walk from the root meets them: a node's own entries, then its kids'.
    """
    roots = nodes.where("parent IS NULL").select("doc_id", "node", F.array().cast("array<int>").alias("path"), F.array("node").alias("trail"))
    reached = _levels(roots, _kids(nodes), F.expr("above.doc_id = kid.kid_doc AND above.node = kid.parent"), ["doc_id"], deepest)
    return reached.join(entries, ["doc_id", "node"]).where("name IS NOT NULL").select("doc_id", "path", "place", "name", "value")


def looked_up(wanted: DataFrame, nodes: DataFrame, entries: DataFrame, deepest: int = 32) -> DataFrame:
    """(doc_id, name, value) of the wanted (doc_id, name): each descends only into kids whose limits hold the name; null if it isn't there.

    A node without limits is entered.  So a name visits a path, not the tree.
    """
    asked = wanted.select("doc_id", "name").distinct()
    roots = asked.join(nodes.where("parent IS NULL").select("doc_id", "node"), "doc_id").select("doc_id", "name", "node", F.array().cast("array<int>").alias("path"), F.array("node").alias("trail"))
    holds = "above.doc_id = kid.kid_doc AND above.node = kid.parent AND above.name >= coalesce(kid.low, above.name) AND above.name <= coalesce(kid.high, above.name)"
    reached = _levels(roots, _kids(nodes), F.expr(holds), ["doc_id", "name"], deepest)
    found = reached.join(entries, ["doc_id", "node", "name"]).groupBy("doc_id", "name").agg(F.min_by("value", F.struct("path", "place")).alias("value"))
    return wanted.join(found, ["doc_id", "name"], "left")


def embedded_files(nodes: DataFrame, entries: DataFrame, attached: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc_id, number, key, file_name, description, mime, size) of the files that documents hold, in the order of their tree of names.

    ``attached`` (doc_id, place, value) is the older list without names: it counts where a document's tree gives no file, under names of its own.  ``specs`` are
    (value, uf, f, description, mime, size); the Unicode name is taken before the plain one; a value without a specification is no file.
    """
    files = specs.select("value", F.coalesce("uf", "f").alias("file_name"), "description", "mime", "size")
    tree = listed(nodes, entries).join(files, "value")
    have = tree.select("doc_id").distinct()
    older = attached.join(have, "doc_id", "left_anti").join(files, "value").select("doc_id", F.array().cast("array<int>").alias("path"), "place",
        F.lit(None).cast("string").alias("name"), "file_name", "description", "mime", "size")
    rows = tree.select(older.columns).unionByName(older)
    # a document's files are few against its pages: one list for each
    held = F.sort_array(F.collect_list(F.struct("path", "place", "name", "file_name", "description", "mime", "size")))
    each = rows.groupBy("doc_id").agg(held.alias("files")).select("doc_id", F.posexplode("files").alias("number", "f"))
    return each.select("doc_id", "number", F.coalesce("f.name", F.concat(F.lit("_AF_"), F.col("number").cast("string"))).alias("key"), "f.file_name", "f.description", "f.mime", "f.size")


_LIST = "struct<li:array<string>>"
_PACKET = (
    f"RDF struct<Description:array<struct<title:struct<Alt:{_LIST}>,creator:struct<Seq:{_LIST}>,description:struct<Alt:{_LIST}>,subject:struct<Bag:{_LIST}>,"
    "Keywords:string,Producer:string,CreatorTool:string,CreateDate:string,ModifyDate:string,part:string,conformance:string,"
    "`_CreatorTool`:string,`_CreateDate`:string,`_ModifyDate`:string,`_Producer`:string,`_part`:string,`_conformance`:string>>>, _bad string"
)


def packet(xml: Column) -> Column:
    """A metadata packet as a struct: title, creators, description, subjects, keywords, producer, tool, created, modified, part, conformance; null if it isn't well formed.

    Properties may be elements or attributes, in any of several descriptions; the first counts.
    """
    body = F.regexp_replace(F.regexp_replace(xml, r"<\?xpacket[^>]*\?>", ""), r"^[\s\x{FEFF}]+", "")
    x = F.from_xml(body, _PACKET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"})
    all_of = x["RDF"]["Description"]
    first = lambda f: F.get(F.filter(F.transform(all_of, f), lambda v: v.isNotNull()), F.lit(0))
    simple = lambda n: first(lambda d: F.coalesce(d[n], d[f"_{n}"]))
    return F.when(
        x["_bad"].isNull() & x["RDF"].isNotNull(),
        F.struct(
            F.get(first(lambda d: d["title"]["Alt"]["li"]), F.lit(0)).alias("title"), first(lambda d: d["creator"]["Seq"]["li"]).alias("creators"),
                F.get(first(lambda d: d["description"]["Alt"]["li"]), F.lit(0)).alias("description"),
            first(lambda d: d["subject"]["Bag"]["li"]).alias("subjects"), first(lambda d: d["Keywords"]).alias("keywords"), simple("Producer").alias("producer"), simple("CreatorTool").alias("tool"),
            simple("CreateDate").alias("created"), simple("ModifyDate").alias("modified"), simple("part").alias("part"), simple("conformance").alias("conformance"),
        ),
    )

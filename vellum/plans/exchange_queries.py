"""Queries over annotations, calculator functions, chains of trust, trees of names, character maps, glyph order, outlines and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import calculator as K
from vellum.functions import codespaces as C
from vellum.operators import bidi, nametree, organise, trees, trust
from vellum.sources import annotations as A
from vellum.sources.tables import ADVANCE, JUMP, LEADING, LETTERS_SQL, PAGE_LINES, RUN, TOP, by_document, lines, load

_KINDS = ("Link", "Highlight", "Square", "Ink", "Text", "FreeText", "Line", "Polygon")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation for each line of an order: the order is the document."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 8).cast("int"))
    t = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("place"), kind.alias("subtype"), ((F.col("l_suppkey") % 100) * 1.5).alias("x"), (F.col("l_quantity") * 8).alias("y"),
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    k, x, y, x2, y2 = F.col("subtype"), F.col("x"), F.col("y"), F.col("x") + 50.25, F.col("y") + 20
    of = lambda kinds, *v: F.when(k.isin(*kinds), F.array(*v))
    text = F.concat("l_returnflag", F.lit(" & <"), "l_linestatus", F.lit(">"))
    own = {
        "page": (F.col("place") - 1).cast("int"), "subtype": k, "rect": F.array(x, y, x2, y2), "color": of(("Highlight", "Square"), F.col("l_discount") * 5, F.col("l_tax") * 5, F.lit(0.25)),
        "interior": of(("Square",), F.lit(0.0), F.lit(1.0), F.lit(0.2)), "flags": F.when(F.col("place") % 3 == 0, 4 + 128).otherwise(4), "name": F.concat_ws("-", F.lit("n"), "doc_id", "place"),
        "width": F.when(k.isin("Square", "Ink"), 2.5), "style": F.when(k == "Square", "D"), "dashes": of(("Square",), F.lit(3.0), F.lit(1.5)), "quads": of(("Highlight",), x, y2, x2, y2, x, y, x2, y),
        "line": of(("Line",), x2, y, x, y2), "vertices": of(("Polygon",), x, y, x2, y, x2, y2),
            "strokes": F.when(k == "Ink", F.array(F.array(x, y, x2, y2), F.array(x, y2, x2, y))), "icon": F.when(k == "Text", "Help"),
        "open": F.when(k == "Text", F.col("place") % 2 == 0), "quadding": F.when(k == "FreeText", (F.col("place") % 3).cast("int")),
            "appearance": F.when(k == "FreeText", "0 0.5 1 rg /Helv 9.5 Tf"), "contents": F.when(~k.isin("Ink", "Line"), text),
    }
    fields = [own.get(n.split()[0], F.lit(None)).cast(n.split(" ", 1)[1]).alias(n.split()[0]) for n in A.FIELDS.split(", ")]
    return t.select("doc_id", "place", *fields)


def xfdf_export(spark, sf_dir):
    return A.exported(_annotations(spark, sf_dir))


def xfdf_import(spark, sf_dir):
    files = A.exported(_annotations(spark, sf_dir))
    rows = A.imported(files, files.select("doc_id", F.lit(5).alias("n_pages")))
    scaled = lambda c: F.array_join(F.transform(c, lambda v: F.rint(v * 255).cast("int").cast("string")), ",")
    return rows.select(
        "doc_id", "place", "element", "page", "subtype", A.numbers(F.col("rect")).alias("rect"), scaled(F.col("color")).alias("color"),
            scaled(F.col("interior")).alias("interior"), "flags", "name", A.number(F.col("width")).alias("width"),
        "style", A.numbers(F.col("dashes")).alias("dashes"), A.numbers(F.col("quads")).alias("quads"), A.numbers(F.col("line")).alias("line"),
            A.numbers(F.col("vertices")).alias("vertices"), A.numbers(F.flatten("strokes")).alias("strokes"),
        "icon", "open", "quadding", scaled(F.col("letter_color")).alias("letter_color"), A.number(F.col("letter_size")).alias("letter_size"), "contents", "skipped",
    )


#: Programs of three inputs, how many values they leave, and the same in SQL over x, y and q; the last two can't run.
_PROGRAMS = (
    ("mix", "{ pop 2 copy add 3 1 roll mul }", ("x + y", "x * y")),
    ("branch", "{ 25 lt { exch pop 10 mul } { pop neg } ifelse }", ("CASE WHEN q < 25 THEN y * 10 ELSE 0 - x END",)),
    ("nested", "{ dup 10 le { pop add } { dup 40 gt { pop sub } { 3 1 roll add mul } ifelse } ifelse }", ("CASE WHEN q <= 10 THEN x + y WHEN q > 40 THEN x - y ELSE q * (x + y) END",)),
    ("angle", "{ 3 -1 roll pop dup sin exch cos 3 -1 roll 100 mul 1 atan }", ("sin(radians(q))", "cos(radians(q))", "degrees(atan(y * 100))")),
    ("whole", "{ exch pop cvi dup 7 idiv exch 7 mod 2 index 0 eq { 1 } { 0 } ifelse }", ("trunc(q / 7)", "q % 7", "CASE WHEN x = 0 THEN 1 ELSE 0 END")),
    ("roots", "{ 1 index sqrt exch 50 div 2 exp 3 index 0 div }", ("sqrt(y)", "power(q / 50, 2)", "0")),
    ("bits", "{ cvi dup 5 and exch dup 5 or exch 5 xor }", ("CAST(q AS INT) & 5", "CAST(q AS INT) | 5", "xor(CAST(q AS INT), 5)")),
    ("unknown", "{ add frobnicate }", ("NULL",)),
    ("too_few", "{ pop pop pop pop 1 }", ("NULL",)),
)


def calculator_functions(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").alias("q")).distinct()
    out = [F.round(v, 6).alias(f"{name}_{i}") for name, program, sql in _PROGRAMS for i, v in enumerate(K.calculator(program, [F.col("x"), F.col("y"), F.col("q")], [(-1000.0, 1000.0)] * len(sql)))]
    return t.select("x", "y", "q", *out)


def _certificates(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("S"), n.cast("string"))
    up = F.floor(k / 4)
    issuer = F.when(k < 4, name(k)).when(k % 29 == 0, "nobody").when(k % 31 == 0, name(k + 1)).when(k % 31 == 1, name(k - 1)).otherwise(name(up))
    subject = F.when(k % 37 == 0, None).otherwise(name(F.when(k % 23 == 0, k - 1).otherwise(k)))
    return load(spark, sf_dir, "customer").select(
        k.cast("string").alias("cert"), subject.alias("subject"), issuer.alias("issuer"), (k % 7).alias("valid_from"), (F.lit(18) + k % 13).alias("valid_to"), (k % 17 != 3).alias("is_ca")
    )


def signature_trust(spark, sf_dir):
    signers = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sig"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 10_000_000).otherwise(0)).cast("string").alias("cert"), (F.col("o_orderkey") % 25).alias("at"))
    certs = _certificates(spark, sf_dir)
    return trust.trust(signers, certs, certs.where("cert IN ('1', '2')"))


def _files(spark, sf_dir):
    """Files of suppliers in the trees of their nations: leaves of four, knots of three leaves, a root; every third nation has the older list."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"), F.col("s_suppkey").alias("k"),
        F.concat(F.lit("f"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    tree = s.where("doc_id % 3 <> 0").withColumns({"leaf": F.floor(F.col("k") / 4).cast("int"), "knot": F.floor(F.col("k") / 12).cast("int")})
    limits = [F.min("name").alias("low"), F.max("name").alias("high")]
    leaf = tree.groupBy("doc_id", "leaf", "knot").agg(*limits).select("doc_id", F.concat(F.lit("L"), "leaf").alias("node"), F.concat(F.lit("K"), "knot").alias("parent"),
        F.col("leaf").alias("place"), "low", "high")
    knot = tree.groupBy("doc_id", "knot").agg(*limits).select("doc_id", F.concat(F.lit("K"), "knot").alias("node"), F.lit("root").alias("parent"), F.col("knot").alias("place"), "low", "high")
    root = tree.select("doc_id").distinct().select("doc_id", F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("place"),
        F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
    nodes = root.unionByName(knot).unionByName(leaf)
    entries = tree.select("doc_id", F.concat(F.lit("L"), "leaf").alias("node"), (F.col("k") % 4).cast("int").alias("place"), "name", F.col("k").alias("value"))
    attached = s.where("doc_id % 3 = 0 OR k % 5 = 0").select("doc_id", F.col("k").cast("int").alias("place"), F.col("k").alias("value"))
    return nodes, entries, attached


def embedded_files(spark, sf_dir):
    specs = load(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").select(
        F.col("s_suppkey").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ü"), "s_name")).alias("uf"), F.col("s_name").alias("f"), F.lit(None).cast("string").alias("description"),
        F.lit("text/plain").alias("mime"), (F.col("s_suppkey") * 10).alias("size"),
    )
    return nametree.embedded_files(*_files(spark, sf_dir), specs)


def name_lookup(spark, sf_dir):
    nodes, entries, _ = _files(spark, sf_dir)
    wanted = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"),
        F.concat(F.lit("f"), F.lpad((F.col("s_suppkey") + F.col("s_suppkey") % 2).cast("string"), 9, "0")).alias("name"))
    return nametree.looked_up(wanted, nodes, entries)


def metadata_packet(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("line"))
    title = A.escaped(F.col("line"))
    whole = F.concat(
        F.lit('<?xpacket begin="﻿" id="p"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:CreatorTool="'), F.col("source"),
        F.lit('"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">'), title, F.lit("</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>"), F.col("source"),
            F.lit("</rdf:li><rdf:li>"), F.col("lang"),
        F.lit('</rdf:li></rdf:Seq></dc:creator></rdf:Description><rdf:Description rdf:about="" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"><pdf:Producer>made</pdf:Producer><pdfaid:part>2</pdfaid:part>'
              "</rdf:Description></rdf:RDF></x:xmpmeta>"), F.lit('<?xpacket end="w"?>'),
    )
    whole = F.when(F.col("doc_id") % 10 == 3, F.replace(whole, F.lit("</rdf:RDF>"), F.lit(""))).otherwise(whole)
    p = d.select("doc_id", nametree.packet(whole).alias("p"))
    return p.select("doc_id", F.col("p").isNotNull().alias("read"), "p.title", F.array_join("p.creators", "|").alias("creators"), "p.producer", "p.tool", "p.part")


def utf8_map() -> C.CharacterMap:
    """The codes of UTF-8 as a character map: one to four bytes, and a range for each run of last bytes."""
    ranges = [(bytes([a]), bytes([a + 31]), chr(a)) for a in range(0, 128, 32)]
    blocks = [p for p in range(0x80, 0x10000, 64) if not 0xD800 <= p < 0xE000] + list(range(0x1F000, 0x20000, 64))
    ranges += [(chr(p).encode(), chr(p + 63).encode(), chr(p)) for p in blocks]
    spaces = [(b"\x00", b"\x7f"), (b"\xc2\x80", b"\xdf\xbf"), (b"\xe0\x80\x80", b"\xef\xbf\xbf"), (b"\xf0\x80\x80\x80", b"\xf4\xbf\xbf\xbf")]
    return C.CharacterMap(spaces, ranges)


def cmap_decode(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id",
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.encode("text", "utf-8"), F.lit(b"\xff\xe2\x82"))).otherwise(F.encode("text", "utf-8")).alias("raw"))
    return d.select("doc_id", C.decoded(F.col("raw"), utf8_map()).alias("d")).select("doc_id", "d.text", "d.codes", "d.unknown")


_HEBREW = "אבגדהוזחטיכלמנסעפצקר"


def bidi_order(spark, sf_dir):
    """Lines of documents with Hebrew letters for some Latin ones: painted from the left where their number is even, from the right (already in order) where it is odd."""
    line = lines(by_document(load(spark, sf_dir, "documents").select("doc_id", "text"))).where(F.length("line") > 0)
    latin, others = "abcdefghijklmnopqrst", "uvwxyzóíáéúñüöäßçèêâàôîûùë"
    hebrew = F.transform(F.split("line", ""), lambda v: F.translate(F.lower(v), latin, _HEBREW))
    digits = F.transform(F.split("line", ""), lambda v: F.translate(F.lower(v), latin + others, _HEBREW + "1" * len(others)))
    line = line.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page_no"), "line_no", F.when(F.col("line_no") % 3 == 2, hebrew).otherwise(digits).alias("values"))
    left = F.transform("values", lambda _, c: F.when(F.col("line_no") % 2 == 0, 1).otherwise(-1) * (ADVANCE * c + JUMP * F.floor(c / RUN)))
    bottom = F.array_repeat(TOP - LEADING * F.col("line_no"), F.size("values"))
    held = line.select("doc_id", "page_no", F.struct("line_no", "values", left.alias("x"), bottom.alias("y")).alias("l"))
    page = held.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return bidi.lines_of_pages(page.select("doc_id", "page_no", *[F.flatten(F.col("l")[c]).alias(c) for c in ("values", "x", "y")]), ["doc_id", "page_no"])


def split_by_outline(spark, sf_dir):
    p = load(spark, sf_dir, "conversations")
    above = F.when(F.col("turn") % 3 == 2, F.col("turn") - 1)
    outline = p.where("conv_id % 5 <> 0 AND turn % 3 <> 0").select("conv_id", (F.col("turn") * 10).alias("node"), above.alias("parent"),
        F.concat("role", F.lit(" "), "turn").alias("title"), (F.col("turn") + F.col("conv_id") % 2).alias("page"))
    return organise.split_by_outline(p, outline, "conv_id", "turn")


def _objects(spark, sf_dir):
    o = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    refs = o.select(F.col("id").alias("src"), F.posexplode(F.array(F.col("id") * 2 + 1, F.col("id") * 3 + 2, F.col("id") - 40)).alias("place", "dst"))
    return o, refs.where("src % 7 <> 3"), o.where("id % 97 = 1")


def pruned_objects(spark, sf_dir):
    _, refs = trees.pruned(*_objects(spark, sf_dir))
    return refs.select("src", "place", "dst")


def top_regions(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid"), F.posexplode("embedding").alias("i", "v")).where(F.col("v").cast("double") > 0.05)
    cells = v.select("grid", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), F.floor(F.col("v").cast("double") * 1000).cast("long").alias("delta"))
    return trees.top_regions(cells, 3).select("grid", "rank", "left", "right", "low", "high", "pixels", "delta", F.round("mean", 6).alias("mean"))


QUERIES = {f.__name__: f for f in (xfdf_export, xfdf_import, calculator_functions, signature_trust, embedded_files, name_lookup, metadata_packet, cmap_decode, bidi_order,
    split_by_outline, pruned_objects, top_regions)}

_NUMBER = r"regexp_replace(CAST(CAST(round({0}, 6) AS DECIMAL(24, 6)) AS VARCHAR), '\.?0+$', '')"


def _list(*values: str) -> str:
    return " || ',' || ".join(_NUMBER.format(v) for v in values)


_BYTE = "lpad(upper(printf('%x', CAST(round_even({0} * 255, 0) AS BIGINT))), 2, '0')"
_ANNOTATIONS = f"""a AS (
  SELECT *, x + 50.25 AS x2, y + 20 AS y2, 'n-' || doc_id || '-' || place AS name, place - 1 AS page, rf || ' & <' || ls || '>' AS said FROM (
    SELECT l_orderkey AS doc_id, l_linenumber AS place, l_partkey % 8 AS kind, (l_suppkey % 100) * 1.5 AS x, l_quantity * 8 AS y, l_discount * 5 AS r, l_tax * 5 AS g, l_returnflag
  AS rf, l_linestatus AS ls FROM lineitem)),
n AS (SELECT *, {_NUMBER.format("x")} AS nx, {_NUMBER.format("y")} AS ny, {_NUMBER.format("x2")} AS nx2, {_NUMBER.format("y2")} AS ny2, CASE kind WHEN 1 THEN 'highlight' WHEN 2
  THEN 'square' WHEN 3 THEN 'ink' WHEN 4 THEN 'text' WHEN 5 THEN 'freetext' WHEN 6 THEN 'line' WHEN 7 THEN 'polygon' END AS tag,
  CASE WHEN kind IN (1, 2) THEN '#' || {_BYTE.format("r")} || {_BYTE.format("g")} || '40' END AS color FROM a),
x AS (SELECT *, '<' || tag || ' page="' || page || '" rect="' || nx || ',' || ny || ',' || nx2 || ',' || ny2 || '"' || coalesce(' color="' || color || '"', '')
  || CASE WHEN kind = 2 THEN ' interior-color="#00FF33"' ELSE '' END || ' flags="print' || CASE WHEN place % 3 = 0 THEN ',locked' ELSE '' END || '" name="' || name || '"'
  || CASE WHEN kind IN (2, 3) THEN ' width="2.5"' ELSE '' END || CASE WHEN kind = 2 THEN ' style="dash" dashes="3,1.5"' ELSE '' END
  || CASE kind WHEN 1 THEN ' coords="' || concat_ws(',', nx, ny2, nx2, ny2, nx, ny, nx2, ny) || '"' WHEN 6 THEN ' start="' || nx2 || ',' || ny || '" end="' || nx || ',' || ny2 || '"'
    WHEN 7 THEN ' vertices="' || nx || ',' || ny || ';' || nx2 || ',' || ny || ';' || nx2 || ',' || ny2 || '"' WHEN 4 THEN ' icon="Help" open="' || CASE WHEN place % 2 = 0 THEN
  'yes' ELSE 'no' END || '"'
    WHEN 5 THEN CASE place % 3 WHEN 1 THEN ' justification="centered"' WHEN 2 THEN ' justification="right"' ELSE '' END ELSE '' END || '>'
  || CASE kind WHEN 3 THEN '<inklist><gesture>' || nx || ',' || ny || ';' || nx2 || ',' || ny2 || '</gesture><gesture>' || nx || ',' || ny2 || ';' || nx2 || ',' || ny || '</gesture></inklist>'
    WHEN 5 THEN '<defaultappearance>0 0.5 1 rg /Helv 9.5 Tf</defaultappearance>' ELSE '' END
  || CASE WHEN kind NOT IN (3, 6) THEN '<contents>' || rf || ' &amp; &lt;' || ls || '&gt;</contents>' ELSE '' END || '</' || tag || '>' || chr(10) AS xml FROM n WHERE kind > 0)"""
_ORDERED = "row_number() OVER (PARTITION BY doc_id ORDER BY page, place, xml)"

_TRUST = """WITH RECURSIVE c AS (
  SELECT CAST(c_custkey AS VARCHAR) AS cert, CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'S' || (c_custkey - 1) ELSE 'S' || c_custkey END AS subject,
    CASE WHEN c_custkey < 4 THEN 'S' || c_custkey WHEN c_custkey % 29 = 0 THEN 'nobody' WHEN c_custkey % 31 = 0 THEN 'S' || (c_custkey + 1) WHEN c_custkey % 31 = 1 THEN 'S' ||
  (c_custkey - 1) ELSE 'S' || (c_custkey // 4) END AS issuer,
    c_custkey % 7 AS lo, 18 + c_custkey % 13 AS hi, c_custkey % 17 <> 3 AS ca, c_custkey IN (1, 2) AS anchor FROM customer),
s AS (SELECT o_orderkey AS sig, CAST(o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS cert, o_orderkey % 25 AS t FROM orders),
w AS (
  SELECT s.cert, s.t, c.cert AS tip, c.subject, c.issuer, c.anchor, [c.cert] AS chain, CASE WHEN s.t < lo OR s.t > hi THEN 1 ELSE 0 END AS wrong, 1 AS n, false AS stop
  FROM (SELECT DISTINCT cert, t FROM s) s JOIN c USING (cert) WHERE subject IS NOT NULL AND issuer IS NOT NULL
  UNION ALL
  SELECT w.cert, w.t, c.cert, c.subject, c.issuer, c.anchor, list_append(w.chain, c.cert), w.wrong | CASE WHEN w.t < lo OR w.t > hi THEN 1 ELSE 0 END | CASE WHEN NOT ca THEN 2 ELSE 0 END
    | CASE WHEN c.cert IS NULL THEN 4 ELSE 0 END | CASE WHEN list_contains(w.chain, c.cert) THEN 16 ELSE 0 END, CASE WHEN c.cert IS NULL OR list_contains(w.chain, c.cert) THEN w.n
  ELSE w.n + 1 END, c.cert IS NULL OR list_contains(w.chain, c.cert)
  FROM w LEFT JOIN (SELECT * FROM c WHERE issuer IS NOT NULL) c ON c.subject = w.issuer WHERE NOT stop AND w.subject <> w.issuer AND w.n < 17),
e AS (SELECT cert, t, CASE WHEN NOT stop THEN subject ELSE '' END AS root, n, wrong | CASE WHEN NOT stop AND NOT anchor THEN 8 ELSE 0 END AS wrong FROM w WHERE stop OR subject = issuer),
b AS (SELECT cert, t, min(struct_pack(k := bit_count(CAST(wrong AS INT)), o := root = '', n := n, root := root, wrong := wrong)) AS b FROM e GROUP BY cert, t)
SELECT sig, CASE WHEN b IS NULL THEN 'Indeterminate' WHEN b.wrong = 0 THEN 'Trusted' ELSE 'Untrusted' END AS status, nullif(b.root, '') AS root, CAST(b.n AS INT) AS links,
  CASE WHEN b IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN b.wrong & 1 > 0 THEN 'certificate not valid at the time' END, CASE WHEN b.wrong & 2 > 0 THEN
  'issuer is no authority' END, CASE WHEN b.wrong & 4 > 0 THEN 'issuer not found' END,
    CASE WHEN b.wrong & 8 > 0 THEN 'root not trusted' END, CASE WHEN b.wrong & 16 > 0 THEN 'chain leads back to itself' END], lambda x: x IS NOT NULL), '; ') END AS details
FROM s LEFT JOIN b USING (cert, t)"""

_RUNS = f"""WITH {LETTERS_SQL},
g AS (SELECT doc_id, page_no, line_no, c AS pos_x, CASE WHEN line_no % 3 = 2 THEN h ELSE regexp_replace(h, '[uvwxyzóíáéúñüöäßçèêâàôîûùë]', '1') END AS v
  FROM (SELECT *, translate(lower(value), 'abcdefghijklmnopqrst', '{_HEBREW}') AS h FROM letters)),
k AS (SELECT *, CASE WHEN regexp_matches(v, '^[א-ת]$') THEN 'R' WHEN regexp_matches(v, '^[0-9]$') THEN 'D' WHEN regexp_matches(v, '^[\\s\\p{{Z}}\\p{{P}}\\p{{S}}]$') THEN 'N' ELSE
  'O' END AS k, regexp_matches(v, '^[.,:/+-]$') AS sep FROM g),
d AS (SELECT *, bool_and(k <> 'O') OVER (PARTITION BY doc_id, line_no) AS digits, lag(k) OVER l AS b1, lag(k, 2) OVER l AS b2, lag(sep) OVER l AS s1, lead(k) OVER l AS a1 FROM k
  WINDOW l AS (PARTITION BY doc_id, line_no ORDER BY pos_x)),
m AS (SELECT *, k = 'R' OR digits AND k = 'D' AS member, digits AND coalesce(k = 'D' AND (b1 = 'D' OR s1 AND b2 = 'D') OR sep AND b1 = 'D' AND a1 = 'D', false) AS glued FROM d),
r AS (SELECT *, count_if(NOT member AND k <> 'N') OVER l AS run, count_if(NOT glued) OVER l AS block FROM m WINDOW l AS (PARTITION BY doc_id, line_no ORDER BY pos_x)),
f AS (SELECT *, min(CASE WHEN member THEN pos_x END) OVER w AS f, max(CASE WHEN member THEN pos_x END) OVER w AS t, bool_or(k = 'R') OVER w AS any_r FROM r WINDOW w AS (PARTITION
  BY doc_id, line_no, run)),
t AS (SELECT *, coalesce(any_r AND t > f AND line_no % 2 = 0 AND pos_x BETWEEN f AND t, false) AS turns FROM f),
p AS (SELECT *, CASE WHEN turns THEN f + t - max(pos_x) OVER (PARTITION BY doc_id, line_no, run, block, turns) + pos_x - min(pos_x) OVER (PARTITION BY doc_id, line_no, run, block, turns) ELSE pos_x END AS pos FROM t)"""

ORACLES = {
    "xfdf_export": f"""WITH {_ANNOTATIONS}
SELECT doc_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<xfdf xml:space="preserve" xmlns="http://ns.adobe.com/xfdf/">' || chr(10) || '<annots>' || chr(10) ||
  string_agg(xml, '' ORDER BY page, place, xml)
  || '</annots>' || chr(10) || '</xfdf>' AS xfdf FROM x GROUP BY doc_id""",
    "xfdf_import": f"""WITH {_ANNOTATIONS}, o AS (SELECT *, CAST({_ORDERED} - 1 AS INT) AS ord, page < 5 AS ok, CAST(round_even(r * 255, 0) AS INT) AS r8, CAST(round_even(g * 255,
  0) AS INT) AS g8 FROM x)
SELECT doc_id, ord AS place, tag AS element, CAST(page AS INT) AS page, CASE kind WHEN 1 THEN 'Highlight' WHEN 2 THEN 'Square' WHEN 3 THEN 'Ink' WHEN 4 THEN 'Text' WHEN 5 THEN
  'FreeText' WHEN 6 THEN 'Line' ELSE 'Polygon' END AS subtype,
  CASE WHEN ok THEN concat_ws(',', nx, ny, nx2, ny2) END AS rect, CASE WHEN ok AND kind IN (1, 2) THEN concat_ws(',', r8, g8, 64) WHEN ok AND kind = 3 THEN '0,0,0' END AS color,
  CASE WHEN ok AND kind = 2 THEN '0,255,51' END AS interior,
  CASE WHEN ok THEN CAST(4 + CASE WHEN place % 3 = 0 THEN 128 ELSE 0 END AS INT) END AS flags, CASE WHEN ok THEN name END AS name, CASE WHEN ok AND kind IN (2, 3) THEN '2.5' WHEN
  ok AND kind = 5 THEN '0' END AS width,
  CASE WHEN ok AND kind = 2 THEN 'D' WHEN ok AND kind IN (3, 5) THEN 'S' END AS style, CASE WHEN ok AND kind = 2 THEN '3,1.5' END AS dashes, CASE WHEN ok AND kind = 1 THEN
  concat_ws(',', nx, ny2, nx2, ny2, nx, ny, nx2, ny) END AS quads,
  CASE WHEN ok AND kind = 6 THEN concat_ws(',', nx2, ny, nx, ny2) END AS line, CASE WHEN ok AND kind = 7 THEN concat_ws(',', nx, ny, nx2, ny, nx2, ny2) END AS vertices, CASE WHEN
  ok AND kind = 3 THEN concat_ws(',', nx, ny, nx2, ny2, nx, ny2, nx2, ny) END AS strokes,
  CASE WHEN ok AND kind = 4 THEN 'Help' END AS icon, CASE WHEN ok AND kind = 4 THEN place % 2 = 0 END AS open, CASE WHEN ok AND kind = 5 THEN CAST(place % 3 AS INT) END AS
  quadding, CASE WHEN ok AND kind = 5 THEN '0,128,255' END AS letter_color,
  CASE WHEN ok AND kind = 5 THEN '9.5' END AS letter_size, CASE WHEN ok AND kind NOT IN (3, 6) THEN said END AS contents, CASE WHEN NOT ok THEN 'page ' || page || ' out of range' END AS skipped FROM o""",
    "calculator_functions": "SELECT x, y, q, "
    + ", ".join(f"round(CAST({'NULL' if v == 'NULL' else f'greatest(-1000, least(1000, {v}))'} AS DOUBLE), 6) AS {name}_{i}" for name, _, sql in _PROGRAMS for i, v in enumerate(sql))
    + " FROM (SELECT DISTINCT l_discount AS x, l_tax AS y, l_quantity AS q FROM lineitem)",
    "signature_trust": _TRUST,
    "embedded_files": """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 11 <> 0),
t AS (SELECT DISTINCT doc_id FROM s WHERE doc_id % 3 <> 0),
f AS (SELECT *, 'f' || lpad(CAST(k AS VARCHAR), 9, '0') AS key FROM s WHERE doc_id % 3 <> 0 UNION ALL SELECT *, NULL FROM s WHERE doc_id % 3 = 0 OR k % 5 = 0 AND doc_id NOT IN (FROM t)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS number FROM f)
SELECT doc_id, number, coalesce(key, '_AF_' || number) AS key, CASE WHEN k % 2 = 0 THEN 'ü' ELSE '' END || s_name AS file_name, CAST(NULL AS VARCHAR) AS description, 'text/plain' AS mime, k * 10 AS size FROM n""",
    "name_lookup": """WITH w AS (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey + s_suppkey % 2 AS k FROM supplier)
SELECT w.doc_id, 'f' || lpad(CAST(k AS VARCHAR), 9, '0') AS name, s_suppkey AS value FROM w LEFT JOIN supplier s ON s.s_suppkey = k AND s.s_nationkey = w.doc_id AND w.doc_id % 3 <> 0""",
    "metadata_packet": """WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS line, doc_id % 10 <> 3 AS ok FROM documents)
SELECT doc_id, ok AS read, CASE WHEN ok THEN line END AS title, CASE WHEN ok THEN source || '|' || lang END AS creators, CASE WHEN ok THEN 'made' END AS producer, CASE WHEN ok THEN source END AS tool, CASE WHEN ok THEN '2' END AS part FROM d""",
    "cmap_decode": """SELECT doc_id, text || CASE WHEN doc_id % 4 = 1 THEN chr(65533) || chr(65533) ELSE '' END AS text, CAST(length(text) + CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0
  END AS BIGINT) AS codes,
  CAST(length(text) - length(replace(text, chr(65533), '')) + CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS unknown FROM documents""",
    "bidi_order": f"""{_RUNS}
SELECT doc_id, page_no, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS INT) AS line, string_agg(v, '' ORDER BY pos) AS text FROM p GROUP BY doc_id, page_no, line_no""",
    "split_by_outline": """WITH top AS (SELECT conv_id, turn + conv_id % 2 AS turn, arg_min(role || ' ' || turn, turn) AS title FROM conversations WHERE conv_id % 5 <> 0 AND turn
  % 3 = 1 GROUP BY 1, 2),
b AS (SELECT c.conv_id, c.turn, t.title, t.title IS NOT NULL OR row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) = 1 AS starts FROM conversations c LEFT JOIN top t USING (conv_id, turn)),
p AS (SELECT conv_id, turn, CAST(count_if(starts) OVER w - 1 AS INT) AS part, last_value(title IGNORE NULLS) OVER w AS title FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, part, title, CAST(row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) - 1 AS INT) AS place FROM p""",
    "pruned_objects": """WITH RECURSIVE o AS (SELECT p_partkey AS id FROM part),
e AS (SELECT id AS src, p AS place, dst FROM (SELECT id, unnest([0, 1, 2]) AS p, unnest([id * 2 + 1, id * 3 + 2, id - 40]) AS dst FROM o WHERE id % 7 <> 3) WHERE dst IN (FROM o)),
r AS (SELECT id FROM o WHERE id % 97 = 1 UNION SELECT dst FROM r JOIN e ON src = id), n AS (SELECT id, row_number() OVER (ORDER BY id) AS number FROM r)
SELECT a.number AS src, CAST(place AS INT) AS place, b.number AS dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst""",
    "top_regions": """WITH RECURSIVE c AS (SELECT grid, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(floor(v * 1000) AS BIGINT) AS delta FROM (
  SELECT vec_id AS grid, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE v > 0.05),
w AS (SELECT grid, x, y, y * 8 + x AS root FROM c UNION SELECT c.grid, c.x, c.y, w.root FROM w JOIN c ON c.grid = w.grid AND abs(c.x - w.x) + abs(c.y - w.y) = 1),
l AS (SELECT grid, x, y, min(root) AS label FROM w GROUP BY ALL),
b AS (SELECT grid, label, min(x) AS "left", max(x) AS "right", min(y) AS low, max(y) AS high, count(*) AS pixels, CAST(sum(delta) AS BIGINT) AS delta FROM l JOIN c USING (grid, x,
  y) GROUP BY grid, label),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY grid ORDER BY pixels DESC, delta DESC, label) AS INT) AS rank FROM b)
SELECT grid, rank, CAST("left" AS INT) AS "left", CAST("right" AS INT) AS "right", low, high, pixels, delta, round(delta / pixels, 6) AS mean FROM k WHERE rank <= 3""",
}

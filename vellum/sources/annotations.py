"""Exchange of annotations as XML (XFDF): texts of documents from annotation rows, and annotation rows from such texts.

An annotation row has the columns of ``FIELDS``; what a kind of annotation doesn't have is null.  ``exported`` writes one text for each
document, ``imported`` reads texts back and says of each element that it can't take why, instead of failing.  Both
are column functions: elements are put together as strings, and read by ``from_xml`` with one schema for all kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an annotation, besides its document and its place there.
FIELDS = (
    "page int, subtype string, rect array<double>, color array<double>, interior array<double>, flags int, name string, title string, subject string, date string, creationdate string, "
    "opacity double, width double, style string, dashes array<double>, quads array<double>, line array<double>, vertices array<double>, strokes array<array<double>>, icon string, "
    "open boolean, quadding int, appearance string, contents string"
)
NAMES = [x.split()[0] for x in FIELDS.split(", ")]

# Elements and their subtypes, those that are read back, flags by bit, border styles, and the namespace of the format.
SUBTYPES = {
    "text": "Text", "freetext": "FreeText", "line": "Line", "square": "Square", "circle": "Circle", "polygon": "Polygon", "polyline": "PolyLine", "highlight": "Highlight",
    "underline": "Underline", "squiggly": "Squiggly", "strikeout": "StrikeOut", "stamp": "Stamp", "caret": "Caret", "ink": "Ink", "watermark": "Watermark", "redact": "Redact",
}
NOT_READ = ("watermark", "redact")
MARKUP = ("Highlight", "Underline", "Squiggly", "StrikeOut")
FLAGS = ("invisible", "hidden", "print", "nozoom", "norotate", "noview", "readonly", "locked", "togglenoview", "lockedcontents")
STYLES = {"S": "solid", "D": "dash", "B": "bevelled", "I": "inset", "U": "underline"}
NAMESPACE = "http://ns.adobe.com/xfdf/"

_HEAD = f'<?xml version="1.0" encoding="utf-8"?>\n<xfdf xml:space="preserve" xmlns="{NAMESPACE}">\n<annots>\n'
_TAIL = "</annots>\n</xfdf>"


def number(x: Column) -> Column:
    """At most six decimals, without zeros at the end."""
    return F.regexp_replace(F.round(x, 6).cast("decimal(24,6)").cast("string"), r"\.?0+$", "")


def numbers(xs: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(xs, number), sep)


def points(xs: Column) -> Column:
    """x,y;x,y of a flat list."""
    pair = lambda i: F.concat(number(F.get(xs, 2 * i)), F.lit(","), number(F.get(xs, 2 * i + 1)))
    n = F.floor(F.size(xs) / 2).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), pair), ";")).when(xs.isNotNull(), "")


def escaped(x: Column) -> Column:
    """A text for an element or an attribute: without characters that XML can't hold."""
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x


def hex_color(rgb: Column) -> Column:
    """#RRGGBB; halves go to the even number."""
    return F.concat(F.lit("#"), F.array_join(F.transform(rgb, lambda c: F.lpad(F.hex(F.least(F.greatest(F.rint(c * 255), F.lit(0.0)), F.lit(255.0)).cast("long")), 2, "0")), ""))


def flag_names(flags: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(flags.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(FLAGS)]), lambda x: x.isNotNull()), ",")


def _chosen(x: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for p in pairs.items() for v in p]), x)


def element(c=F.col) -> Column:
    """The element of an annotation; null for kinds that aren't exchanged (links, form fields, attached files)."""
    kind = c("subtype")
    tag = _chosen(kind, {v: k for k, v in SUBTYPES.items()})
    filled = lambda x: F.when(x != "", x)
    some = lambda x, n=1: F.when(F.size(x) >= n, x)
    attributes = {
        "page": c("page").cast("string"),
        "rect": numbers(c("rect")),
        "color": hex_color(c("color")),
        "interior-color": F.when(F.size("interior") == 3, hex_color(c("interior"))),
        "flags": F.when(c("flags") != 0, flag_names(c("flags"))),
        **{n: escaped(filled(c(n))) for n in ("name", "title", "subject", "date", "creationdate")},
        "opacity": number(c("opacity")),
        "width": number(c("width")),
        "style": _chosen(c("style"), STYLES),
        "dashes": numbers(some(c("dashes"))),
        "coords": F.when(kind.isin(*MARKUP, "Redact"), numbers(some(c("quads"), 8))),
        "start": numbers(F.slice(c("line"), 1, 2)),
        "end": numbers(F.slice(c("line"), 3, 2)),
        "vertices": points(some(c("vertices"))),
        "icon": F.when(kind.isin("Text", "Stamp"), escaped(filled(c("icon")))),
        "open": F.when(kind == "Text", F.when(c("open"), "yes").otherwise("no")),
        "justification": F.when(kind == "FreeText", F.when(c("quadding") == 1, "centered").when(c("quadding") > 1, "right")),
    }
    written = F.concat_ws("", *[F.concat(F.lit(f' {n}="'), v, F.lit('"')) for n, v in attributes.items()])
    gestures = F.transform(c("strokes"), lambda s: F.concat(F.lit("<gesture>"), points(s), F.lit("</gesture>")))
    wrap = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    kids = F.concat_ws(
        "",
        F.when(F.size("strokes") > 0, wrap("inklist", F.array_join(gestures, ""))),
        F.when(kind == "FreeText", wrap("defaultappearance", escaped(c("appearance")))),
        wrap("contents", escaped(filled(c("contents")))),
    )
    return F.concat(F.lit("<"), tag, written, F.lit(">"), kids, F.lit("</"), tag, F.lit(">\n"))


def exported(annotations: DataFrame, doc: str = "doc_id", order: str = "place") -> DataFrame:
    """(doc, xfdf): the annotations of each document by page and place, as one text.

    A document's annotations are gathered, as they make one file; a document without any that are exchanged isn't listed.
    """
    made = annotations.select(doc, F.struct("page", order, element().alias("xml")).alias("e")).where("e.xml IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["xml"]), "")
    return made.groupBy(doc).agg(F.concat(F.lit(_HEAD), text, F.lit(_TAIL)).alias("xfdf"))


#: Elements that stand within annotations or around them; any other one is an annotation.
_PARTS = "xfdf|annots|contents|contents-richtext|inklist|gesture|defaultappearance|defaultstyle|appearance|popup|fields|field|value|f|ids|body|p|span|data"
_ATTRIBUTES = ("page", "rect", "color", "interior-color", "flags", "name", "title", "subject", "date", "creationdate", "opacity", "width", "style", "dashes", "coords", "start",
    "end", "vertices", "icon", "open", "justification")
_SCHEMA = (
    "annots struct<annot:array<struct<_element:string,"
    + ",".join(f"`_{a}`:string" for a in _ATTRIBUTES)
    + ",inklist:struct<gesture:array<string>>,defaultappearance:string,contents:string>>>"
)


def parsed_number(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double"))


def parsed_numbers(x: Column) -> Column:
    """The numbers of a list; signs that aren't numbers are passed over, a list without any is null."""
    found = F.filter(F.transform(F.split(x, "[,; \t\r\n]+"), parsed_number), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, found)


def parsed_color(x: Column) -> Column:
    digits = F.substring(F.trim(x), 2, 6)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255
    return F.when(F.trim(x).rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))


def parsed_flags(x: Column) -> Column:
    bits = F.transform(F.split(F.lower(x), ","), lambda t: F.coalesce(_chosen(F.trim(t), {n: str(1 << i) for i, n in enumerate(FLAGS)}).cast("int"), F.lit(0)))
    return F.when(F.trim(x) != "", F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b)))


def _normal(rect: Column) -> Column:
    """A rectangle of four numbers with its lower left corner first."""
    at = lambda i: F.get(rect, F.lit(i))
    return F.when(F.size(rect) >= 4, F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))))


def _bounds(flat: Column) -> Column:
    xs = F.filter(flat, lambda _, i: i % 2 == 0)
    ys = F.filter(flat, lambda _, i: i % 2 == 1)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _clamped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def appearance(text: Column) -> tuple[Column, Column]:
    """Colour and size of the letters that a default appearance names: black and 12 without any."""
    value = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double")
    rgb = r"([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+rg\b"
    gray = _clamped(value(r"([\d.]+)\s+g\b", 1))
    coloured = F.array(*[_clamped(value(rgb, i)) for i in (1, 2, 3)])
    color = F.when(value(rgb, 1).isNotNull(), coloured).when(gray.isNotNull(), F.array(gray, gray, gray)).otherwise(F.array(*[F.lit(0.0)] * 3))
    size = value(r"/\S+\s+([\d.]+)\s+Tf\b", 1)
    return color, F.when(size > 0, size).otherwise(12.0)


def imported(files: DataFrame, pages: DataFrame, doc: str = "doc_id", text: str = "xfdf") -> DataFrame:
    """The elements of each text as annotations: doc, place, ``FIELDS``, letter_color and letter_size of free text, and ``skipped``.

    ``skipped`` says why an element isn't taken (its kind, its page, what it lacks), else it is null; ``pages`` holds (doc, n_pages).  A text that isn't
    well formed, or whose root has another name, gives one row with place null and the reason.  A null text gives nothing.
    """
    # every kind of annotation becomes one element, so that one schema reads them and their order stays
    t = F.regexp_replace(F.col(text), r"<(/?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "<$1")
    t = F.regexp_replace(t, rf"<(?!(?:{_PARTS})[\s/>])([A-Za-z][\w.-]*)", '<annot element="$1"')
    t = F.regexp_replace(t, rf"</(?!(?:{_PARTS})\s*>)[A-Za-z][\w.-]*\s*>", "</annot>")
    root = F.lower(F.regexp_extract(F.col(text), r"^\s*(?:<\?[^>]*\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1))
    read = files.where(F.col(text).isNotNull()).select(doc, root.alias("_root"),
        F.from_xml(t, _SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}).alias("_x"))
    wrong = F.when(F.col("_root") != "xfdf",
        F.concat(F.lit("not an xfdf text: "), F.when(F.col("_root") == "", "(none)").otherwise(F.col("_root")))).when(F.col("_x._bad").isNotNull(), "not well formed")
    read = read.withColumn("_wrong", wrong)
    rows = read.select(doc, "_wrong", F.posexplode_outer(F.when(F.col("_wrong").isNull(), F.col("_x.annots.annot"))).alias("place", "a")).where("a IS NOT NULL OR _wrong IS NOT NULL")
    a = lambda n: F.col("a")[f"_{n}"]
    tag, kind = a("element"), _chosen(a("element"), {k: v for k, v in SUBTYPES.items() if k not in NOT_READ})
    page = F.coalesce(F.when(a("page").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(a("page")).try_cast("int")), F.lit(0))
    start, end, vertices = parsed_numbers(a("start")), parsed_numbers(a("end")), parsed_numbers(a("vertices"))
    contents, filled = F.col("a.contents"), lambda x: F.when(F.trim(x) != "", x)
    strokes = F.filter(F.transform(F.col("a.inklist.gesture"), lambda g: F.coalesce(parsed_numbers(g), F.array().cast("array<double>"))), lambda s: F.size(s) >= 4)
    strokes = F.transform(strokes, lambda s: F.slice(s, F.lit(1), (F.floor(F.size(s) / 2) * 2).cast("int")))
    rows = rows.select(doc, "place", "a", "_wrong", tag.alias("_tag"), kind.alias("subtype"), page.alias("page"), _normal(parsed_numbers(a("rect"))).alias("_rect"),
        start.alias("_start"), end.alias("_end"), vertices.alias("_vertices"), F.when(kind == "Ink", strokes).alias("strokes"))
    rows = rows.join(pages.select(doc, "n_pages"), doc, "left")
    k, lacks = F.col("subtype"), lambda c, n: F.coalesce(F.size(c), F.lit(0)) < n
    own_box = k.isin("Line", "Polygon", "PolyLine", "Ink")
    # the page is looked at before the kind, so that order stays even for kinds that aren't taken
    skipped = F.coalesce(
        "_wrong",
        F.when((F.col("page") < 0) | (F.col("page") >= F.coalesce("n_pages", F.lit(0))), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" out of range"))),
        F.when(k.isNull(), "kind isn't taken"),
        F.when(~own_box & F.col("_rect").isNull(), "no rect"),
        F.when((k == "FreeText") & filled(contents).isNull(), "free text without contents"),
        F.when((k == "Ink") & lacks(F.col("strokes"), 1), "ink without a stroke"),
        F.when((k == "Line") & (lacks(F.col("_start"), 2) | lacks(F.col("_end"), 2)), "line without its ends"),
        F.when(k.isin("Polygon", "PolyLine") & lacks(F.col("_vertices"), 4), "no vertices"),
    )
    line = F.when(k == "Line", F.concat(F.slice("_start", 1, 2), F.slice("_end", 1, 2)))
    vertices = F.when(k.isin("Polygon", "PolyLine"), F.col("_vertices"))
    rect = F.when(k == "Ink", _bounds(F.flatten("strokes"))).otherwise(F.coalesce("_rect", F.when(k == "Line", _bounds(line)), F.when(vertices.isNotNull(), _bounds(vertices))))
    at = lambda i: F.get("_rect", F.lit(i))
    coords = parsed_numbers(a("coords"))
    quads = F.when(k.isin(*MARKUP), F.when((F.size(coords) >= 8) & (F.size(coords) % 8 == 0), coords).otherwise(F.array(at(0), at(3), at(2), at(3), at(0), at(1), at(2), at(1))))
    plain = {"Square": [1.0, 0.0, 0.0], "Circle": [1.0, 0.0, 0.0], "Ink": [0.0, 0.0, 0.0]}
    color = F.coalesce(parsed_color(a("color")), *[F.when(k == s, F.array(*map(F.lit, v))) for s, v in plain.items()])
    width = F.coalesce(parsed_number(a("width")), F.when(k.isin("Square", "Circle"), 1.0).when(k == "Ink", 2.0).when(k == "FreeText", 0.0))
    dashes = parsed_numbers(a("dashes"))
    style = F.coalesce(_chosen(F.replace(F.lower(F.trim(a("style"))), F.lit("beveled"), F.lit("bevelled")), {v: s for s, v in STYLES.items()}),
        F.when(dashes.isNotNull(), "D").when(width.isNotNull(), "S"))
    where = F.lower(F.trim(a("justification")))
    letters, size = appearance(F.coalesce(F.col("a.defaultappearance"), F.lit("")))
    nonempty = lambda n: F.when(a(n) != "", a(n))
    values = {
        "page": F.col("page"), "subtype": k, "rect": rect, "color": color, "interior": F.when(k.isin("Square", "Circle", "Polygon"), parsed_color(a("interior-color"))),
            "flags": F.coalesce(parsed_flags(a("flags")), F.lit(4)),
        "name": nonempty("name"), "title": filled(a("title")), "subject": nonempty("subject"), "date": nonempty("date"), "creationdate": nonempty("creationdate"),
            "opacity": _clamped(parsed_number(a("opacity"))), "width": width,
        "style": style, "dashes": dashes, "quads": quads, "line": line, "vertices": vertices, "strokes": F.col("strokes"),
            "icon": F.when(k == "Text", F.coalesce(filled(a("icon")), F.lit("Note"))).when(k == "Stamp", filled(a("icon"))),
        "open": F.when(k == "Text", F.coalesce(F.lower(a("open")) == "yes", F.lit(False))),
            "quadding": F.when(k == "FreeText", F.when(where.isin("centered", "center", "1"), 1).when(where.isin("right", "2"), 2).otherwise(0)),
        "appearance": F.when(k == "FreeText", F.col("a.defaultappearance")), "contents": F.when(contents != "", contents),
    }
    taken = F.col("skipped").isNull()
    rows = rows.withColumn("skipped", skipped)
    out = [F.when(taken, v).alias(n) if n not in ("page", "subtype") else v.alias(n) for n, v in values.items()]
    free = taken & (k == "FreeText")
    return rows.select(doc, "place", F.col("_tag").alias("element"), *out, F.when(free, letters).alias("letter_color"), F.when(free, size).alias("letter_size"), "skipped")


def taken(rows: DataFrame) -> DataFrame:
    """Rows that ``imported`` took, with the columns that ``exported`` writes."""
    return rows.where("skipped IS NULL").drop("element", "letter_color", "letter_size", "skipped")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Whether two rows of annotations agree in every field."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in NAMES if n not in keys])

"""Tables of drawing operators: categories, filters, state, marks, and what redaction takes out of them.

Rows are (doc_id, page_no, ix, name, operands, arg, mcid, left, bottom, right, top).  What depends on the nesting of
states and marks is folded page by page in Arrow batches, as a page's operators are bounded; all else is plain columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators.records import near_white, rgb_of_cmyk
from vellum.sources.tables import by_page

#: Categories of operators by name (fixed values of the format).
CATEGORIES = {
    "GraphicsState": "q Q cm w J j M d ri i gs",
    "PathConstruction": "m l c v y h re",
    "PathPainting": "S s f F f* B B* b b* n",
    "Clipping": "W W*",
    "TextState": "Tc Tw Tz TL Tf Tr Ts",
    "TextPositioning": "Td TD Tm T*",
    "TextShowing": "Tj TJ ' \"",
    "TextObject": "BT ET",
    "Color": "CS cs SC SCN sc scn G g RG rg K k",
    "Shading": "sh",
    "XObject": "BI ID EI Do",
    "MarkedContent": "MP DP BMC BDC EMC",
    "Compatibility": "BX EX",
}
_FILLS, _PAINTS = ("f", "F", "f*", "B", "B*", "b", "b*"), tuple(CATEGORIES["PathPainting"].split())
_SHOWS = tuple(CATEGORIES["TextShowing"].split())
_PAGE = ["doc_id", "page_no"]
_BOX = ("left", "bottom", "right", "top")


def category(name: Column) -> Column:
    """The category of an operator; Unknown for names that no category has."""
    out = F.lit("Unknown")
    for kind, names in CATEGORIES.items():
        out = F.when(name.isin(*names.split()), kind).otherwise(out)
    return out


def without_category(ops: DataFrame, *kinds: str) -> DataFrame:
    return ops.where(~category(F.col("name")).isin(*kinds))


def of_category(ops: DataFrame, *kinds: str) -> DataFrame:
    return ops.where(category(F.col("name")).isin(*kinds))


def find_text(ops: DataFrame, needle: str, ignore_case: bool = True) -> DataFrame:
    """Operators that show a text with ``needle`` in it; none for an empty one."""
    text = F.lower("arg") if ignore_case else F.col("arg")
    found = F.contains(text, F.lit(needle.lower() if ignore_case else needle))
    return ops.where(F.col("name").isin(*_SHOWS) & found & F.lit(needle != ""))


def transformed(ops: DataFrame, **columns: Column) -> DataFrame:
    """Each operator with some of its columns replaced."""
    return ops.withColumns(columns)


def _areas(areas: DataFrame) -> DataFrame:
    return areas.select(*_PAGE, *[F.col(c).cast("double").alias(f"a_{c}") for c in _BOX])


def without_area(ops: DataFrame, areas: DataFrame) -> DataFrame:
    """Operators that no area of their page meets; one without a box meets none, so it stays."""
    a = _areas(areas).withColumnsRenamed({c: f"_{c}" for c in _PAGE})
    meets = G.overlaps(tuple(F.col(c) for c in _BOX), tuple(F.col(f"a_{c}") for c in _BOX))
    on = (ops["doc_id"] == a["_doc_id"]) & (ops["page_no"] == a["_page_no"]) & F.coalesce(meets, F.lit(False))
    return ops.join(a, on, "left_anti")


def without_contained(ops: DataFrame, areas: DataFrame) -> DataFrame:
    """Operators whose box no area of their page holds whole, edges included; one without a box stays."""
    a = _areas(areas).withColumnsRenamed({c: f"_{c}" for c in _PAGE})
    holds = (F.col("left") >= F.col("a_left")) & (F.col("right") <= F.col("a_right")) & (F.col("bottom") >= F.col("a_bottom")) & (F.col("top") <= F.col("a_top"))
    on = (ops["doc_id"] == a["_doc_id"]) & (ops["page_no"] == a["_page_no"]) & F.coalesce(holds, F.lit(False))
    return ops.join(a, on, "left_anti")


def with_state(ops: DataFrame) -> DataFrame:
    """Operators with the state that they meet: matrix (a to f), inherited ``mark``, ``artifact`` and all ``marks`` around them.

    q and Q save and restore the matrix, cm multiplies it; BDC and BMC open marks, EMC closes one.  A mark without an
    id has that of the one around it, and what stands in an artifact is one.  Ends without a beginning are passed over.
    """

    @F.arrow_udf("matrix array<array<double>>, mark array<long>, artifact array<boolean>, marks array<array<int>>")
    def run(names: pa.Array, operands: pa.Array, artifacts: pa.Array, mcids: pa.Array) -> pa.Array:
        ends = names.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
        name, artifact, mcid, numbers = names.flatten(), artifacts.flatten().to_pylist(), mcids.flatten().to_pylist(), operands.flatten()
        changes = np.flatnonzero(pc.is_in(name, pa.array(["q", "Q", "cm", "BDC", "BMC", "EMC"])).to_numpy(zero_copy_only=False))
        name, of = name.to_pylist(), np.zeros(len(name), np.int64)  # of: which of the states that follow each operator meets
        states: list[tuple] = []
        begins = set(ends[:-1].tolist())
        matrix, saved, marks = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
        for at in sorted(begins.union(changes.tolist())):
            if at >= len(name):
                break
            if at in begins:
                matrix, saved, marks = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
            what = name[at]
            if what == "q":
                saved.append(matrix)
            elif what == "Q" and saved:
                matrix = saved.pop()
            elif what == "cm":
                given = numbers[at].as_py()
                if given is not None and len(given) >= 6:
                    a, b, c, d, e, f = given[:6]
                    ma, mb, mc, md, me, mf = matrix
                    matrix = (a * ma + b * mc, a * mb + b * md, c * ma + d * mc, c * mb + d * md, e * ma + f * mc + me, e * mb + f * md + mf)
            elif what in ("BDC", "BMC"):
                above = marks[-1] if marks else (None, False, None)
                own = mcid[at] if what == "BDC" else None
                marks.append((above[0] if own is None else own, above[1] or artifact[at], own))
            elif what == "EMC" and marks:
                marks.pop()
            mark, inside, _ = marks[-1] if marks else (None, False, None)
            of[at] = 1
            states.append((matrix, mark, inside, [m for _, _, m in marks if m is not None]))
        of = pa.array(np.cumsum(of) - 1)
        bounds, kinds = pa.array(ends, pa.int32()), (pa.list_(pa.float64()), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
        held = [pa.array([s[i] for s in states], kind).take(of) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds, h) for h in held], ["matrix", "mark", "artifact", "marks"])

    found, o = ["matrix", "mark", "artifact", "marks"], F.col("_ops")
    pages = by_page(ops.withColumn("_artifact", F.coalesce(F.col("arg") == "Artifact", F.lit(False))), ["ix"], "_ops")
    held = pages.select(*_PAGE, "_ops", run(o["name"], o["operands"], o["_artifact"], o["mcid"]).alias("_s")).select(*_PAGE, "_ops", "_s.*")
    each = held.select(*_PAGE, F.explode(F.arrays_zip("_ops", *found)).alias("_e"))
    return each.select(*[F.col(c) if c in _PAGE else F.col(f"_e._ops.{c}").alias(c) for c in ops.columns], *[F.col(f"_e.{c}").alias(c) for c in found])


def unit_square(matrix: Column) -> tuple[Column, ...]:
    """The box around the unit square under a matrix, which is where an image is drawn."""
    a, b, c, d, e, f = (matrix[i] for i in range(6))
    xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def image_overlaps(state: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, page_no, arg, area) for each image that is drawn across an area."""
    drawn = state.where("name IN ('Do', 'BI')").select(*_PAGE, "ix", "arg", *[c.alias(b) for c, b in zip(unit_square(F.col("matrix")), _BOX, strict=True)])
    meets = G.overlaps(tuple(F.col(c) for c in _BOX), tuple(F.col(f"a_{c}") for c in _BOX))
    return drawn.join(_areas(areas), _PAGE).where(meets)


def unused_images(declared: DataFrame, ops: DataFrame) -> DataFrame:
    """Declared images (doc_id, page_no, arg) that no operator left on the page draws."""
    used = ops.where("name = 'Do' AND arg IS NOT NULL").select(*_PAGE, "arg").distinct()
    return declared.join(used, [*_PAGE, "arg"], "left_anti")


def untagged_runs(state: DataFrame, tagged: DataFrame, anywhere: DataFrame) -> DataFrame:
    """Shown texts, not empty and outside of artifacts, whose mark is tagged neither on their page nor for all pages."""
    shown = state.where(F.col("name").isin(*_SHOWS) & (F.length("arg") > 0) & ~F.col("artifact")).select(*_PAGE, "ix", "mark")
    left = shown.join(tagged.select(*_PAGE, F.col("mcid").cast("long").alias("mark")).distinct(), [*_PAGE, "mark"], "left_anti")
    return left.join(anywhere.select("doc_id", F.col("mcid").cast("long").alias("mark")).distinct(), ["doc_id", "mark"], "left_anti")


def affected_marks(state: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, page_no, mcid) of all marks around operators that an area meets."""
    meets = G.overlaps(tuple(F.col(c) for c in _BOX), tuple(F.col(f"a_{c}") for c in _BOX))
    boxed = state.where("left IS NOT NULL AND size(marks) > 0 AND name NOT IN ('BDC', 'BMC', 'EMC')")
    hit = boxed.join(_areas(areas), _PAGE).where(meets)
    return hit.select(*_PAGE, F.explode("marks").alias("mcid")).distinct()


def scrubbed_structure(elements: DataFrame, marks: DataFrame, removed: DataFrame, least: int = 3) -> DataFrame:
    """Elements (doc_id, page_no, element, mcid, carrier, value) with ``cleared``: by their mark, by a removed text that they restate, or not.

    ``removed`` holds a page's removed texts (doc_id, page_no, term); those under ``least`` characters don't count.
    """
    by_mark = elements.join(marks.withColumn("_mark", F.lit(True)), [*_PAGE, "mcid"], "left")
    terms = removed.where(F.length("term") >= least).groupBy(*_PAGE).agg(F.collect_set("term").alias("_terms"))
    held = by_mark.join(terms, _PAGE, "left")
    restates = F.coalesce(F.exists("_terms", lambda t: F.contains("value", t)), F.lit(False))
    return held.select(*elements.columns, F.when(F.col("_mark"), "mark").when(restates, "text").otherwise("kept").alias("cleared"))


def scrubbed_widgets(widgets: DataFrame, areas: DataFrame) -> DataFrame:
    """Widgets (doc_id, page_no, widget, kind, box) that areas meet: buttons stay, other values go, and options of choices, too."""
    meets = G.overlaps(tuple(F.col(c) for c in _BOX), tuple(F.col(f"a_{c}") for c in _BOX))
    a = _areas(areas).withColumnsRenamed({c: f"_{c}" for c in _PAGE})
    hit = widgets.join(a, (widgets["doc_id"] == a["_doc_id"]) & (widgets["page_no"] == a["_page_no"]) & meets, "left_semi")
    action = F.when(F.col("kind") == "annotation", "removed").when(F.col("kind") == "button", "kept").when(F.col("kind") == "choice",
        "value and options cleared").otherwise("value cleared")
    return hit.withColumn("action", action)


def _dark(name: Column, operands: Column) -> Column:
    """Whether an operator sets a fill that hides what is below it; null if it sets none."""
    grey = operands[0]
    return (
        F.when((name == "rg") & (F.size(operands) >= 3), ~near_white(operands[0], operands[1],
            operands[2])).when((name == "g") & (F.size(operands) >= 1), ~near_white(grey, grey, grey))
        .when((name == "k") & (F.size(operands) >= 4), ~near_white(*rgb_of_cmyk(*(F.get(operands, F.lit(i)) for i in range(4)))))
    )


def with_fills(ops: DataFrame) -> DataFrame:
    """Operators with ``path``, the number of paints before them, and ``dark``, whether the fill that holds hides things."""
    order = Window.partitionBy(*_PAGE).orderBy("ix")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    paint = F.col("name").isin(*_PAINTS).cast("int")
    dark = F.last(_dark(F.col("name"), F.col("operands")), ignorenulls=True).over(so_far)
    return ops.withColumn("path", F.coalesce(F.sum(paint).over(before), F.lit(0))).withColumn("dark", F.coalesce(dark, F.lit(False)))


def without_obstructions(ops: DataFrame) -> DataFrame:
    """Operators without dark fills and the paths that these paint; a fill without a path stays."""
    whole = Window.partitionBy(*_PAGE, "path")
    built = category(F.col("name")) == "PathConstruction"
    fills = F.col("name").isin(*_FILLS) & F.col("dark")
    marked = with_fills(ops).withColumn("_has", F.bool_or(built).over(whole)).withColumn("_hides", F.bool_or(fills).over(whole))
    return marked.where(~(F.col("_has") & F.col("_hides") & (built | fills))).select(*ops.columns)


def hidden_texts(ops: DataFrame, least: float = 0.5) -> DataFrame:
    """Shown texts that a dark fill painted after them covers by at least a share: (doc_id, page_no, ix, hidden_by)."""
    filled = with_fills(ops)
    covers = filled.where(F.col("name").isin(*_FILLS) & F.col("dark") & F.col("left").isNotNull()).select(*_PAGE, F.col("ix").alias("cover"),
        *[F.col(c).alias(f"a_{c}") for c in _BOX])
    shown = ops.where(F.col("name").isin(*_SHOWS) & F.col("left").isNotNull())
    share = G.covered(tuple(F.col(c) for c in _BOX), tuple(F.col(f"a_{c}") for c in _BOX))
    hit = shown.join(covers, _PAGE).where((F.col("cover") > F.col("ix")) & (share >= least))
    return hit.groupBy(*_PAGE, "ix").agg(F.min("cover").alias("hidden_by"))

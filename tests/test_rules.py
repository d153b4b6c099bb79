"""Rules of operators on rows that their definitions name: layouts, marks, trees, forms, guards."""

import random
from collections import Counter

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import audit, content, corpus, layout, redact, search, validate

GLYPH = "doc_id long, page_no int, line_no int, c int, value string, left int, right int, bottom int, top int"


def glyphs(spark, lines, left=0):
    """Glyphs of lines (text, x, y), six points wide and ten high."""
    rows = [(1, 0, n, c, v, left + x + 6 * c, left + x + 6 * c + 6, y, y + 10) for n, (text, x, y) in enumerate(lines) for c, v in enumerate(text)]
    return spark.createDataFrame(rows, GLYPH)


def text_in(df):
    return "".join(r.value for r in sorted(df.collect(), key=lambda r: r.place))


def test_columns_read_one_after_the_other(spark):
    left, right = ["aaa bbb ccc"] * 5, ["ddd eee fff"] * 5
    rows = [("heading across the whole of the page here", 0, 800)]
    for k in range(5):
        rows += [(left[k], 0, 780 - 12 * k), (right[k], 180, 774 - 12 * k)]
    assert text_in(layout.columned(glyphs(spark, rows))) == rows[0][0] + "".join(left) + "".join(right)
    few = rows[:3]  # a line beside another one is no column
    got = text_in(layout.columned(glyphs(spark, few)))
    assert got == "".join(t for t, _, _ in few)


def test_paragraphs_lists_and_split_words(spark):
    rows = [("first line of a para-", 0, 800), ("graph that goes on", 0, 788), ("another one", 0, 764), ("- an item", 20, 752), ("- one more", 20, 740), ("last", 0, 728)]
    got = layout.smart_join(layout.joined_lines(glyphs(spark, rows))).first().text
    assert got == "first line of a paragraph that goes on\n\nanother one\n    - an item\n    - one more\nlast"


def test_spaces_by_gaps_or_by_advances(spark):
    wide = [(1, 0, 0, c, v, x, x + 6, 0, 10) for c, (v, x) in enumerate([("a", 0), ("b", 6), ("c", 16), ("d", 22)])]
    thin = [(1, 0, 1, c, v, x, x + 1, 0, 10) for c, (v, x) in enumerate([("a", 0), ("b", 6), ("c", 12), ("d", 24), ("e", 30)])]
    held = [(1, 0, 2, c, v, 20 * c, 20 * c + 6, 0, 10) for c, v in enumerate("a b")]
    got = {r.line_no: (r.spaces, r.inferred) for r in layout.inferred_spaces(spark.createDataFrame(wide + thin + held, GLYPH)).collect()}
    assert got == {0: (1, True), 1: (1, True), 2: (1, False)}


def test_terms_go_with_their_glyphs_until_none_is_left(spark):
    g = glyphs(spark, [("the sesecretcret is SECRET", 0, 100), ("plain", 0, 80)])
    for strategy in ("any", "full", "centre"):
        left = layout.without_term(g, "secret", strategy).orderBy("line_no", "c").collect()
        assert "".join(r.value for r in left) == "the  is plain"
    assert layout.without_term(g, "").count() == g.count()


def test_matched_glyphs_lie_closest_together(spark):
    g = glyphs(spark, [("ab", 0, 100), ("c abc", 0, 80), ("Name: ____", 0, 60)])
    texts = spark.createDataFrame([(1, 0, 1, "abc"), (1, 0, 2, "Name: ________"), (1, 0, 3, "none"), (1, 0, 4, "")], "doc_id long, page_no int, ix int, arg string")
    # the first "abc" runs over two lines
    assert {(r.ix, r.first, r.n) for r in layout.matched_glyphs(texts, g).collect()} == {(1, 4, 3), (2, 7, 5)}


def test_hits_first_then_the_nearest_row(spark):
    g = glyphs(spark, [("ab", 0, 100), ("abcdef", 0, 80)])
    points = spark.createDataFrame([(1, 0, 0, 7, 105), (1, 0, 1, 60, 103), (1, 0, 2, 60, 84)], "doc_id long, page_no int, point_id int, x int, y int")
    assert {r.point_id: (r.line_no, r.c) for r in layout.nearest(points, g).collect()} == {0: (0, 1), 1: (0, 1), 2: (1, 5)}


def test_lines_in_the_order_in_which_they_are_read():
    assert T.logical_order("הנס 30 רמע") == "עמר 30 סנה"
    assert T.logical_order("הנס 12.5, רמע") == "עמר ,12.5 סנה"
    assert T.logical_order("abc רמע 30 xyz") == "abc עמר 30 xyz"
    assert T.logical_order("\u05d1\u05bc\u05d0") == "\u05d0\u05d1\u05bc"  # a mark stays behind its letter
    assert T.logical_order("plain 12") == "plain 12" and T.logical_order("") == "" and T.logical_order(None) is None
    assert T.folded_letters(["e", "\u0301", "x", "", "\u0301"]) == ["é", "", "x\u0301", "", ""] and T.folded_letters(["\ufb01"]) == ["fi"]


OPS = "doc_id long, page_no int, ix int, name string, operands array<double>, arg string, mcid int, left double, bottom double, right double, top double"


def ops(spark, *rows):
    """Operators (name, operands, arg, mcid, box)."""
    return spark.createDataFrame([(1, 0, i, n, o, a, m, *(b or (None,) * 4)) for i, (n, o, a, m, b) in enumerate(rows)], OPS)


def test_states_and_marks_nest(spark):
    got = content.with_state(ops(
        spark, ("EMC", None, None, None, None), ("Q", None, None, None, None), ("BDC", None, "P", 7, None), ("q", None, None, None, None), ("cm", [2.0, 0.0, 0.0, 2.0, 5.0, 0.0], None, None, None),
        ("BMC", None, "Artifact", None, None), ("cm", [1.0, 0.0, 0.0, 1.0, 3.0, 1.0], None, None, None), ("Tj", None, "a", None, None), ("EMC", None, None, None, None), ("Q", None, None, None, None),
        ("BDC", None, "Span", 9, None), ("Tj", None, "b", None, None), ("EMC", None, None, None, None), ("EMC", None, None, None, None), ("Tj", None, "c", None, None),
    )).where("name = 'Tj'").orderBy("ix").collect()
    assert [(r.mark, r.artifact, list(r.marks)) for r in got] == [(7, True, [7]), (9, False, [7, 9]), (None, False, [])]
    assert [list(r.matrix) for r in got] == [[2, 0, 0, 2, 11, 2], [1, 0, 0, 1, 0, 0], [1, 0, 0, 1, 0, 0]]


def test_dark_fills_go_with_their_paths(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    table = ops(
        spark, ("Tj", None, "x", None, box), ("g", [0.0], None, None, None), ("re", None, None, None, box), ("f", None, None, None, box), ("f", None, None, None, box), ("k", [0.0, 0.0, 0.0, 0.0], None, None, None),
        ("re", None, None, None, box), ("B", None, None, None, box), ("rg", [0.95, 0.95, 0.95], None, None, None), ("re", None, None, None, box), ("S", None, None, None, box), ("re", None, None, None, box), ("f", None, None, None, box),
    )
    assert [r.ix for r in content.without_obstructions(table).orderBy("ix").collect()] == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert [r.hidden_by for r in content.hidden_texts(table).collect()] == [3]
    assert content.hidden_texts(table.where("ix >= 5 OR ix = 0")).count() == 0
    area = spark.createDataFrame([(1, 0, 50, 50, 60, 60)], "doc_id long, page_no int, left int, bottom int, right int, top int")
    assert content.without_area(table, area).count() == table.count()
    assert content.without_area(table, area.withColumn("left", F.lit(5)).withColumn("bottom", F.lit(5))).where("left IS NOT NULL").count() == 0


def test_redactions_in_a_chain(spark):
    g, table = glyphs(spark, [("keep secret", 0, 100)]), ops(spark, ("Tj", None, "keep secret", None, (0.0, 100.0, 66.0, 110.0)), ("Do", None, "Im", None, None))
    letters, left = redact.Redaction(g, table).text("secret").letters(F.col("value") == "k").category("XObject").apply()
    assert "".join(r.value for r in letters.orderBy("c").collect()) == "eep " and [r.name for r in left.collect()] == ["Tj"]
    letters, left = redact.Redaction(g, table).all_text().apply()
    assert letters.count() == 0 and [r.name for r in left.collect()] == ["Do"]


def nodes(spark, *rows):
    return spark.createDataFrame([(1, i, p, k) for i, p, k in rows], "doc_id long, node_id long, parent_id long, kind string")


def test_headings_tables_and_lists(spark):
    def bad(*kinds):
        r = validate.heading_findings(nodes(spark, *[(i, None, k) for i, k in enumerate(kinds)])).first()
        return r and r.bad

    assert bad("P") is None and bad("H1", "H2", "H1", "H2", "H3") == 0 and bad("H2") == 1 and bad("H1", "H3") == 1 and bad("H", "H") == 0 and bad("H1", "H") == 1
    tree = nodes(spark, (1, None, "Table"), (2, 1, "TBody"), (3, 2, "TR"), (4, 3, "TD"), (5, 3, "P"), (6, 1, "Caption"), (7, 1, "Div"), (8, None, "Table"), (9, None, "L"), (10, 9, "LI"), (11, 10, "LBody"), (12, None, "LI"), (13, 9, "P"))
    assert sorted((r.node_id, r.problem) for r in validate.table_problems(tree).collect()) == [(1, "no cell P"), (1, "unexpected child Div"), (8, "no rows")]
    assert validate.listed(validate.table_problems(tree), 2).first().report == "no cell P; unexpected child Div; +1 more"
    structure, bodies = validate.list_findings(tree)
    assert (structure.first().n, structure.first().bad) == (2, 2) and (bodies.first().n, bodies.first().bad) == (1, 0)


def test_roles_of_a_cycle_end(spark):
    tree = nodes(spark, (1, None, "A"), (2, 1, "X"), (3, 1, "Z"))
    roles = spark.createDataFrame([(1, "A", "B"), (1, "B", "H1"), (1, "X", "Y"), (1, "Y", "X")], "doc_id long, name string, role string")
    got = {r.node_id: (r.kind, r.unmapped) for r in validate.resolved_kinds(tree, roles).collect()}
    assert got == {1: ("H1", False), 2: ("X", False), 3: ("Z", True)}


def test_deep_trees_end(spark):
    chain = nodes(spark, *[(i, i - 1 if i else None, "P") for i in range(10)], (50, 51, "P"), (51, 50, "P"))
    assert validate.within_depth(chain, 3).count() == 4 and validate.within_depth(chain).count() == 10
    got = {r.node_id: r.value for r in validate.inherited(chain.withColumn("box", F.when(F.col("node_id") == 2, 7)), "box").collect()}
    assert got[9] == 7 and got[2] == 7 and got[1] is None and got[50] is None


def test_exact_percentiles_of_a_hot_group(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-50, 50), 2) for _ in range(3000)] + [7.0] * 2000
    df = spark.createDataFrame([("a", v) for v in values] + [("b", -1.5), ("c", None), (None, 2.0)], "k string, v double")
    got = {r.k: (r.p10, r.p50, r.p95, r.all) for r in corpus.percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95, "all": 1.0}).collect()}
    ranked = sorted(values)
    want = tuple(next(v for i, v in enumerate(ranked, 1) if i >= p * len(ranked)) for p in (0.1, 0.5, 0.95, 1.0))
    assert got == {"a": want, "b": (-1.5,) * 4, None: (2.0,) * 4}


def test_pair_similarity_equals_sets(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ab1z", k=rng.randint(0, 9))), "".join(rng.choices("ab1z", k=rng.randint(0, 9)))) for _ in range(60)] + [("", ""), ("a", "b"), (None, "ab")]
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", T.pair_similarity("a", "b").alias("s")).collect():
        either = r.a is not None and pairs(r.a) | pairs(r.b)
        assert r.s == (None if r.a is None else len(pairs(r.a) & pairs(r.b)) / len(either) if either else 1.0)


def test_matches_and_words_have_their_offsets(spark):
    docs = spark.createDataFrame([(1, "xx ab  ab abab\nnone\nAb")], "doc_id long, text string")
    assert Counter((r.line_no, r.start) for r in search.match_spans(docs, "ab").collect()) == Counter([(0, 3), (0, 7), (0, 10), (0, 12), (2, 0)])
    got = {(r.line_no, r.match_start): (r.first_word, r.last_word, r.left_c, r.right_c) for r in search.word_bounds(docs, "b  a").collect()}
    assert got == {(0, 4): ("ab", "ab", 3, 9)}


def test_forms_refuse_unknown_fields(spark):
    fields = spark.createDataFrame([(1, "text", False, None, "old"), (2, "button", False, None, "Yes"), (3, "choice", False, [], "x"), (4, "text", True, None, "y")], "f long, kind string, read_only boolean, options array<string>, value string")
    values = spark.createDataFrame([(1, "new"), (2, None), (3, "any"), (4, "z"), (9, "q")], "f long, value string")
    out = audit.filled(fields, values, "f")
    assert {r.f: (r.value, r.state, r.outcome) for r in out.collect()} == {1: ("new", None, "set"), 2: (None, "Off", "cleared"), 3: ("any", None, "set"), 4: ("y", None, "read-only"), 9: (None, None, "no such field")}
    assert tuple(audit.fill_result(out).first()) == (3, 2)


def test_readers_and_sinks(spark, tmp_path):
    import json

    from vellum.sources import readers, sinks

    (tmp_path / "contracts").mkdir()
    page = {"ExpectedRawStatus": "PASS", "ReleaseStatus": "OK", "QualityStatus": "X", "PixelAgreement": "Y", "ReferenceSituation": "Z"}
    (tmp_path / "contracts" / "a.json").write_text(json.dumps({"Path": "a.pdf", "Source": "s", "Owner": "o", "Pages": {"1": page, "3": page}}, indent=1))
    got = readers.contracts(spark, f"file://{tmp_path}/contracts")
    assert sorted((r.path, r.page_number, r.ExpectedRawStatus) for r in got.collect()) == [("a.pdf", 1, "PASS"), ("a.pdf", 3, "PASS")]
    (tmp_path / "report.json").write_text(json.dumps({"results": [{"a": 1}, {"a": 2}]}, indent=1))
    assert sorted(r.a for r in readers.report_results(spark, f"file://{tmp_path}/report.json").collect()) == [1, 2]
    assert readers.report_results(spark, f"file://{tmp_path}/report.json", "none").count() == 0
    rows = ["level\tx", "\t".join(["5", *["0"] * 5, "300", "600", "150", "30", "95.5", "word"]), "\t".join(["4", *["0"] * 10, "line"]), "\t".join(["5", *["0"] * 10, " "])]
    (tmp_path / "words.tsv").write_text("\n".join(rows))
    w = readers.recognised_words(spark, f"file://{tmp_path}/words.tsv").collect()
    assert [(r.text, r.left, r.right, round(r.bottom, 3), r.top, r.confidence) for r in w] == [("word", 72.0, 108.0, 640.8, 648.0, 0.955)]
    df = spark.createDataFrame([(1, None), (2, 'say "hi"')], "a int, b string")
    assert sorted(r.json for r in sinks.json_rows(df).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"say \\"hi\\""}']
    sinks.json_lines(df, f"file://{tmp_path}/lines")
    assert spark.read.json(f"file://{tmp_path}/lines").count() == 2
    scrubbed = redact.scrub_metadata(df, ["b"])
    assert scrubbed.dtypes == df.dtypes and {r.b for r in scrubbed.collect()} == {None}
    assert sorted(r.term for r in redact.distinct_terms(spark.createDataFrame([("Abc",), ("abc",), ("ab",), ("xyz",)], "term string")).collect()) == ["Abc", "xyz"]

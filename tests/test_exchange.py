"""Annotations as XML, calculator programs, trust, name trees and codespaces: rows known beforehand."""

from pyspark.sql import functions as F

from vellum.sources import annotations as A

HEAD, TAIL = '<?xml version="1.0"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>', "</annots></xfdf>"


def read(spark, *texts, pages=3):
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xfdf string")
    return A.imported(files, files.select("doc_id", F.lit(pages).alias("n_pages"))).orderBy("doc_id", "place").collect()


def test_elements_are_read(spark):
    rows = read(
        spark,
        HEAD
        + '<highlight page="1" rect="10,20,30,25" color="#FF8000" title="Ann" name="n1" opacity="1.5" flags="print,locked,odd"><contents>a &lt; b &amp; "c"</contents></highlight>'
        + '<square page="0" rect="30;40;10;20" interior-color="#00ff00" dashes="3,2"/>'
        + '<line page="2" start="5,9" end="1,2" width="2.5" style="Beveled"/>'
        + '<ink page="0" rect="0,0,9,9"><inklist><gesture>1,2;3,4;5</gesture><gesture>7,7</gesture></inklist></ink>'
        + '<freetext page="0" rect="0,0,5,5" justification="center"><defaultappearance>0.5 g /Helv 9.5 Tf</defaultappearance><contents>x</contents></freetext>'
        + '<polygon page="0" vertices="0,0;4,1;2,8"/><text page="0" rect="1,1,2,2" open="YES"/>'
        + TAIL,
    )
    assert [r.skipped for r in rows] == [None] * 7 and [r.place for r in rows] == list(range(7))
    h, s, line, ink, free, poly, text = rows
    assert (h.subtype, h.page, h.color, h.opacity, h.flags, h.contents) == ("Highlight", 1, [1.0, 128 / 255, 0.0], 1.0, 4 + 128, 'a < b & "c"')
    assert h.quads == [10, 25, 30, 25, 10, 20, 30, 20]
    assert (s.rect, s.color, s.interior, s.width, s.style, s.dashes, s.flags) == ([10, 20, 30, 40], [1, 0, 0], [0, 1, 0], 1, "D", [3, 2], 4)
    assert (line.rect, line.line, line.style, line.width) == ([1, 2, 5, 9], [5, 9, 1, 2], "B", 2.5)
    assert (ink.strokes, ink.rect, ink.width) == ([[1, 2, 3, 4]], [1, 2, 3, 4], 2)
    assert (free.quadding, free.letter_color, free.letter_size) == (1, [0.5] * 3, 9.5)
    assert (poly.rect, poly.vertices) == ([0, 0, 4, 8], [0, 0, 4, 1, 2, 8])
    assert (text.icon, text.open) == ("Note", True)


def test_what_is_not_taken(spark):
    body = '<link page="0" rect="0,0,1,1"/><highlight page="3" rect="0,0,1,1"/><caret page="0"/><freetext page="0" rect="0,0,1,1"><contents> </contents></freetext><ink page="0"/><line page="0" start="1" end="2,3"/><polyline page="0" vertices="1,2"/><redact page="0" rect="0,0,1,1"/>'
    rows = read(spark, HEAD + body + TAIL, "<html/>", HEAD + "<square", None, HEAD + TAIL, '<x:xfdf xmlns:x="u"><x:annots><x:caret rect="0,0,1,1"/></x:annots></x:xfdf>')
    assert [(r.doc_id, r.skipped) for r in rows] == [
        *[(0, s) for s in ("kind isn't taken", "page 3 out of range", "no rect", "free text without contents", "ink without a stroke", "line without its ends", "no vertices", "kind isn't taken")],
        (1, "not an xfdf text: html"), (2, "not well formed"), (5, None),
    ]
    assert rows[0].element == "link" and rows[0].rect is None


def test_export_of_an_import_is_its_source(spark):
    rows = [
        {"page": 0, "subtype": "Highlight", "rect": [1.0, 2.0, 3.5, 4.0], "color": [1.0, 0.0, 0.2], "flags": 4, "name": "a&b", "title": "T \"q\"",
            "quads": [float(i) for i in range(16)], "contents": "line\none\t<x> é \U0001f389"},
        {"page": 2, "subtype": "Ink", "rect": [1.0, 1.0, 3.0, 2.123456], "color": [0.0, 0.0, 0.0], "flags": 68, "width": 2.0, "style": "S", "strokes": [[1.0, 1.0, 3.0, 2.123456]]},
        {"page": 1, "subtype": "Text", "rect": [0.0, 0.0, 1.0, 1.0], "flags": 4, "icon": "Note", "open": True, "opacity": 0.25},
        {"page": 1, "subtype": "FreeText", "rect": [0.0, 0.0, 1.0, 1.0], "flags": 4, "width": 0.0, "style": "S", "quadding": 2, "appearance": "1 0 0 rg /F 8 Tf", "contents": "y"},
        {"page": 1, "subtype": "Line", "rect": [-1.0, 0.0, 1.0, 1.0], "flags": 4, "line": [-1.0, 0.0, 1.0, 1.0], "width": 1.0, "style": "D", "dashes": [3.0, 1.5]},
        {"page": 0, "subtype": "Link", "rect": [0.0, 0.0, 1.0, 1.0]},
    ]
    df = spark.createDataFrame([(7, i, *[r.get(n) for n in A.NAMES]) for i, r in enumerate(rows)], "doc_id long, place int, " + A.FIELDS)
    first = A.exported(df)
    (text,) = [r.xfdf for r in first.collect()]
    assert "Link" not in text and 'contents>line&#xA;one&#x9;&lt;x&gt;' in text and text.count("<gesture>1,1;3,2.123456</gesture>") == 1
    back = A.taken(A.imported(first, spark.createDataFrame([(7, 3)], "doc_id long, n_pages int")))
    assert A.exported(back).collect()[0].xfdf == text
    want = {(r["page"], r["subtype"]): tuple(r.get(n) for n in A.NAMES) for r in rows[:-1]}
    got = {(r.page, r.subtype): tuple(list(r[n]) if isinstance(r[n], list) else r[n] for n in A.NAMES) for r in back.collect()}
    assert got == want


def values(spark, program, inputs, n, low=-1e9, high=1e9, **more):
    from vellum.functions.calculator import calculator

    df = spark.createDataFrame([inputs], ", ".join(f"x{i} double" for i in range(len(inputs)))) if inputs else spark.range(1)
    got = df.select(*[c.alias(f"v{i}") for i, c in enumerate(calculator(program, [F.col(f"x{i}") for i in range(len(inputs))], [(low, high)] * n, **more))]).first()
    return [None if v is None else round(v, 9) for v in got]


def test_calculator_words(spark):
    cases = [
        ("{ 2 mul 1 add }", (3.0,), [7]), ("{ exch sub }", (3.0, 10.0), [7]), ("{ dup mul }", (4.0,), [16]), ("{ div }", (1.0, 0.0), [0]), ("{ div }", (1.0, 4.0), [0.25]),
            ("{ idiv }", (-7.0, 2.0), [-3]),
        ("{ mod }", (-7.0, 3.0), [-1]), ("{ mod }", (7.0, 0.0), [0]), ("{ sqrt }", (-4.0,), [0]), ("{ sin }", (90.0,), [1]), ("{ cos }", (180.0,), [-1]),
            ("{ atan }", (-1.0, 0.0), [270]), ("{ atan }", (1.0, 1.0), [45]),
        ("{ 3 1 roll }", (1.0, 2.0, 3.0), [3, 1, 2]), ("{ 3 -1 roll }", (1.0, 2.0, 3.0), [2, 3, 1]), ("{ 2 copy }", (1.0, 2.0), [1, 2, 1, 2]),
            ("{ 1 index }", (5.0, 6.0), [5, 6, 5]), ("{ 1 1 add copy add }", (5.0, 6.0), [5, 6, 11]),
        ("{ dup 0.5 lt { 2 mul } { pop 1 } ifelse }", (0.25,), [0.5]), ("{ dup 0.5 lt { 2 mul } { pop 1 } ifelse }", (0.75,), [1]), ("{ dup 0 lt { neg } if }", (-3.0,), [3]),
            ("{ true { 4 } { 5 6 } ifelse }", (), [4]),
        ("{ 5 3 and 5 3 or 5 3 xor 1 3 bitshift 16 -2 bitshift }", (), [1, 7, 6, 8, 4]), ("{ 1 not 5 not }", (), [0, -6]),
            ("{ 2.5 round -2.5 round -2.7 truncate -2.2 ceiling -2.2 floor 3.9 cvi }", (), [3, -2, -2, -2, -3, 3]),
        ("{ 2 10 exp 100 log 1 ln }", (), [1024, 2, 0]), ("{ 1 2 eq 1 2 ne 1 2 le 1 2 gt 2 2 ge }", (), [0, 1, 1, 0, 1]), ("{ 16#ff % a comment }\n }", (), [255]),
            ("dup 3 1 roll", (1.0, 2.0), [2, 1, 2]),
    ]
    for program, inputs, want in cases:
        assert values(spark, program, inputs, len(want)) == want, program


def test_calculator_that_cannot_run(spark):
    for program, inputs in [("{ add }", (1.0,)), ("{ nothing }", (1.0,)), ("{ copy }", (1.0, 1.0)), ("{ 9 index }", (1.0,)), ("{ 1.5 copy }", (1.0,)),
        ("{ dup { pop } if }", (1.0,)), ("{ if }", (1.0,)), ("{ { 1 }", (1.0,)), ("{ pop }", (1.0,)), ("{ -1 ln }", (1.0,))]:
        assert values(spark, program, inputs, 1) == [None], program
    assert values(spark, "{ 3 mul }", (0.9,), 1, 0, 1) == [1] and values(spark, "{ 3 mul }", (9.0,), 1, domain=[(0, 2)]) == [6]
    assert values(spark, "{ 2 }", (None,), 1) == [2] and values(spark, "{ 2 mul }", (None,), 1) == [None]


def chains(spark, certs, signers, anchors=("root",)):
    from vellum.operators.trust import trust

    c = spark.createDataFrame(certs, "cert string, subject string, issuer string, valid_from int, valid_to int, is_ca boolean")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(signers)], "sig int, cert string, at int")
    rows = trust(s, c, spark.createDataFrame([(a,) for a in anchors], "cert string")).orderBy("sig").collect()
    return [(r.status, r.root, r.links, r.details) for r in rows]


def test_trust_states(spark):
    certs = [
        ("root", "R", "R", 0, 99, True), ("mid", "M", "R", 0, 50, True), ("leaf", "L", "M", 10, 40, False), ("odd", "O", "O", 0, 99, True), ("under_odd", "U", "O", 0, 99, False),
            ("alone", "A", "nobody", 0, 99, False),
        ("c1", "C1", "C2", 0, 99, True), ("c2", "C2", "C1", 0, 99, True), ("by_leaf", "B", "L", 0, 99, False), ("nameless", None, "R", 0, 99, False), ("mid2", "M", "nobody", 0, 99, True),
    ]
    got = chains(spark, certs,
        [("leaf", 20), ("leaf", 45), ("leaf", 60), ("root", 1), ("under_odd", 1), ("alone", 1), ("c1", 1), ("by_leaf", 20), ("nameless", 1), ("gone", 1), ("leaf", 20), (None, 1)])
    assert got == [
        ("Trusted", "R", 3, ""), ("Untrusted", "R", 3, "certificate not valid at the time"), ("Untrusted", "R", 3, "certificate not valid at the time"), ("Trusted", "R", 1, ""),
            ("Untrusted", "O", 2, "root not trusted"),
        ("Untrusted", None, 1, "issuer not found"), ("Untrusted", None, 2, "chain leads back to itself"), ("Untrusted", "R", 4, "issuer is no authority"),
            ("Indeterminate", None, None, ""), ("Indeterminate", None, None, ""), ("Trusted", "R", 3, ""),
        ("Indeterminate", None, None, ""),
    ]
    assert chains(spark, certs, [("leaf", 20)], anchors=()) == [("Untrusted", "R", 3, "root not trusted")]
    long = [(f"x{i}", f"X{i}", f"X{i + 1}", 0, 99, True) for i in range(40)]
    assert chains(spark, long, [("x0", 1)]) == [("Untrusted", None, 16, "chain too long")]


def test_name_trees(spark):
    from vellum.operators import nametree as N

    nodes = spark.createDataFrame(
        [(1, "r", None, 0, None, None), (1, "b", "r", 1, "m", "z"), (1, "a", "r", 0, "a", "f"), (1, "a2", "a", 0, "c", "f"), (1, "a", "a2", 0, "a", "z"), (2, "r", None, 0, None, None)],
        "doc_id long, node string, parent string, place int, low string, high string",
    )
    entries = spark.createDataFrame(
        [(1, "a", 0, "ab", 10), (1, "a2", 0, "cd", 11), (1, "b", 0, "mn", 12), (1, "b", 1, "cd", 13), (1, "b", 2, None, 14), (1, "r", 0, "zz", 15), (1, "lost", 0, "q", 16)],
            "doc_id long, node string, place int, name string, value long"
    )
    rows = N.listed(nodes, entries).orderBy("doc_id", "path", "place").collect()
    assert [(r.name, r.value) for r in rows] == [("zz", 15), ("ab", 10), ("cd", 11), ("mn", 12), ("cd", 13)]
    asked = spark.createDataFrame([(1, "cd"), (1, "mn"), (1, "no"), (3, "cd")], "doc_id long, name string")
    assert {(r.doc_id, r.name): r.value for r in N.looked_up(asked, nodes, entries).collect()} == {(1, "cd"): 11, (1, "mn"): 12, (1, "no"): None, (3, "cd"): None}
    attached = spark.createDataFrame([(1, 0, 10), (2, 1, 12), (2, 0, 11), (2, 2, 99)], "doc_id long, place int, value long")
    specs = spark.createDataFrame([(10, "ü", "u", "d", "m", 1), (11, None, "f", None, None, 2), (12, None, None, None, None, 3)],
        "value long, uf string, f string, description string, mime string, size long")
    got = N.embedded_files(nodes, entries, attached, specs).orderBy("doc_id", "number").collect()
    assert [(r.doc_id, r.key, r.file_name, r.size) for r in got] == [(1, "ab", "ü", 1), (1, "cd", "f", 2), (1, "mn", None, 3), (2, "_AF_0", "f", 2), (2, "_AF_1", None, 3)]


def test_packets(spark):
    from vellum.operators.nametree import packet

    rdf = '<rdf:RDF xmlns:rdf="r"><rdf:Description xmlns:xmp="x" xmp:CreateDate="2020" xmp:CreatorTool="T"><dc:title xmlns:dc="d"><rdf:Alt><rdf:li xml:lang="x-default">A &amp; B</rdf:li><rdf:li>C</rdf:li></rdf:Alt></dc:title></rdf:Description><rdf:Description xmlns:p="p"><p:Keywords>k</p:Keywords><xmp:CreateDate xmlns:xmp="x">2021</xmp:CreateDate></rdf:Description></rdf:RDF>'
    texts = [f'﻿<?xpacket begin="" id="x"?><x:xmpmeta xmlns:x="a">{rdf}</x:xmpmeta><?xpacket end="w"?>', "<x:xmpmeta><open>", "", None, "<other/>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, xml string").select("i", packet(F.col("xml")).alias("p")).orderBy("i").collect()
    p = rows[0].p
    assert (p.title, p.tool, p.created, p.keywords, p.creators, p.part) == ("A & B", "T", "2020", "k", None, None)
    assert [r.p for r in rows[1:]] == [None] * 4


def test_codespaces():
    from vellum.functions.codespaces import UNKNOWN, CharacterMap

    mixed = CharacterMap([(b"\x00", b"\x80"), (b"\x81\x40", b"\x9f\xfc"), (b"\xa0", b"\xdf"), (b"\xe0\x40", b"\xfc\xfc")],
        [(b"\x41", b"\x43", "a"), (b"\x81\x40", b"\x81\x50", "あ"), (b"\x81\x45", b"\x81\x46", "fi"), (b"\xa0", b"\xa0", "\U0001f600")])
    assert mixed.cut(b"A\x81\x40\xa0\xe0\x41") == [b"A", b"\x81\x40", b"\xa0", b"\xe0\x41"]
    assert mixed.cut(b"\x81\xffA") == [b"\x81\xff", b"A"]  # each byte must be in its range; the first one claims the width
    assert mixed.cut(b"\xfd\x81") == [b"\xfd", b"\x81"] and mixed.cut(b"") == []
    assert mixed.decode(b"AC\x81\x40\x81\x42\x81\x45\x81\x46\x81\x47\xa0") == ("acあえfifjか\U0001f600"[:2] + "あ" + chr(ord("あ") + 2) + "fi" + "fj" + chr(ord("あ") + 7) + "\U0001f600", 8, 0)
    assert mixed.decode(b"DA\xfd") == (UNKNOWN + "a" + UNKNOWN, 3, 2)
    assert CharacterMap([], []).cut(b"\x00A\x01") == [b"\x00A", b"\x01"]


def test_strings_are_decoded_without_an_object_for_each_code(monkeypatch):
    from vellum.functions.codespaces import UNKNOWN, CharacterMap
    from vellum.plans.exchange_queries import utf8_map

    monkeypatch.setattr(CharacterMap, "cut", None)
    text = "aé€😀" * 50_000
    assert utf8_map().decode(text.encode() + b"\xff\xe2\x82") == (text + UNKNOWN * 2, 200_002, 2)
    assert CharacterMap([(b"\0", b"\xff")], [(b"a", b"c", "x" + UNKNOWN), (b"b", b"b", UNKNOWN)]).decode(b"abcd") == ("x" + UNKNOWN * 2 + "x" + chr(0xFFFF) + UNKNOWN, 4, 2)


def glyph_lines(spark, rows):
    from vellum.operators import bidi

    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, ix int, value string, x double, y double")
    out = bidi.lines_read(bidi.reading_order(df, ["doc_id"]), ["doc_id"]).orderBy("line").collect()
    return [r.text for r in out]


def painted(text, y=0.0, step=6.0, x=0.0):
    return [(c, x + step * i, y) for i, c in enumerate(text)]


def test_right_to_left_by_geometry(spark):
    assert glyph_lines(spark, painted("םולש")) == ["שלום"]
    assert glyph_lines(spark, painted("שלום", step=-6.0, x=99.0)) == ["שלום"]
    assert glyph_lines(spark, painted("הנס 30 רמע")) == ["עמר 30 סנה"]
    assert glyph_lines(spark, painted("הנס 12.5, רמע")) == ["עמר ,12.5 סנה"]
    assert glyph_lines(spark, painted("abc רמע 30 xyz")) == ["abc עמר 30 xyz"]
    assert glyph_lines(spark, painted("plain 12")) == ["plain 12"] and glyph_lines(spark, painted("12.5")) == ["12.5"]
    assert glyph_lines(spark, painted("(םולש).")) == ["(שלום)."]
    # a mark stays behind its letter; lines go on within five points of the glyph before
    assert glyph_lines(spark, [("ב", 0.0, 0.0), ("ּ", 3.0, 0.0), ("א", 6.0, 4.0), ("ג", 12.0, 20.0), ("ד", 18.0, 20.0)]) == ["אבּ", "דג"]
    assert glyph_lines(spark, [(None, 0.0, 0.0), ("א", 6.0, 0.0), ("ב", 12.0, 0.0)]) == ["בא"]


def test_pages_of_glyphs_are_read_as_arrays(spark, monkeypatch):
    from vellum.operators import bidi

    monkeypatch.setattr(bidi, "TOGETHER", 5)
    rows = [(1, list("םולש") + ["x"], [0.0, 6.0, 12.0, 18.0, 0.0], [0.0] * 4 + [12.0]), (2, [None, "א", "ב"], [0.0, 6.0, 12.0], [0.0] * 3), (3, ["ב", "ּ", "א"], [0.0, 3.0, 6.0], [0.0, 0.0, 4.0]), (4, [], [], [])]
    pages = spark.createDataFrame(rows, "doc_id int, values array<string>, x array<double>, y array<double>").coalesce(1)
    assert sorted(map(tuple, bidi.lines_of_pages(pages, ["doc_id"]).collect())) == [(1, 0, "שלום"), (1, 1, "x"), (2, 0, "בא"), (3, 0, "אבּ")]


def test_split_by_outline(spark):
    from vellum.operators.organise import split_by_outline

    pages = spark.createDataFrame([(d, p) for d in (1, 2) for p in range(6)], "doc int, page int")
    outline = spark.createDataFrame([(1, 5, None, "B", 3), (1, 6, None, "late", 3), (1, 7, 5, "nested", 4), (1, 8, None, "gone", 99), (1, 9, None, "none", None)],
        "doc int, node int, parent int, title string, page int")
    rows = split_by_outline(pages, outline, "doc", "page").orderBy("doc", "page").collect()
    assert [(r.part, r.title, r.place) for r in rows] == [(0, None, 0), (0, None, 1), (0, None, 2), (1, "B", 0), (1, "B", 1), (1, "B", 2), *[(0, None, i) for i in range(6)]]


def test_pruned_objects(spark):
    from vellum.operators.trees import pruned

    objects = spark.createDataFrame([(i, f"o{i}") for i in (3, 5, 9, 20, 30)], "id long, body string")
    refs = spark.createDataFrame([(3, 9, 0), (9, 3, 0), (9, 77, 1), (20, 30, 0), (9, 30, 2), (77, 5, 0)], "src long, dst long, place int")
    kept, ends = pruned(objects, refs, spark.createDataFrame([(3,), (88,)], "id long"))
    assert sorted((r.id, r.body, r.number) for r in kept.collect()) == [(3, "o3", 1), (9, "o9", 2), (30, "o30", 3)]
    assert sorted(ends.collect()) == [(1, 2, 0), (2, 1, 0), (2, 3, 2)]


def test_objects_at_the_end_of_a_long_path_are_kept(spark):
    """No number of steps ends the search (F7): it ended after 64 before."""
    from vellum.operators.trees import pruned

    objects = spark.range(80).select("id")
    refs = spark.range(79).selectExpr("id AS src", "id + 1 AS dst", "0 AS place").where("src <> 74")
    kept, ends = pruned(objects, refs, spark.range(1))
    assert sorted((r.id, r.number) for r in kept.collect()) == [(i, i + 1) for i in range(75)] and ends.count() == 74


def test_redaction_takes_a_term_out_once(spark, tmp_path):
    """What only a removal brings together isn't a term, nor is what runs over two lines; as in SQL (F1)."""
    page, _, _, done = redact(spark, ["x a and nd b", "x and", " and y"], [], " and ", case_sensitive=True, anew=False)
    assert page == "x and b" + "x and" + "y" and done == (2, 2, 0)
    assert redact(spark, ["x a and nd b"], [], " and ", case_sensitive=True)[0] == "xb"

    import duckdb

    from vellum.plans.document_queries import ORACLES, redact_document

    texts = ["esin a and nd eaount", "x and\n and y", "first\nthe a and nd b", "plain", "", " and ", "a and and b"]
    docs = spark.createDataFrame([(i + 1, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = redact_document(spark, str(tmp_path)), con.sql(ORACLES["redact_document"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_text_index_takes_each_page_once(spark, tmp_path):
    from vellum.streaming import text_index as I

    src, path, marks = str(tmp_path / "src"), str(tmp_path / "index"), str(tmp_path / "marks")
    schema = "doc_id long, page_no int, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda m=marks: I.indexed(spark.readStream.schema(schema).parquet(src), path, m).awaitTermination()
    assert I.read_index(spark, path).count() == 0
    put([(1, 0, "Straße and word"), (1, 1, None), (2, 0, "word WORD")])
    run()
    put([(1, 0, "other text"), (3, 0, "new word")])
    run()
    index = I.read_index(spark, path)
    state = sorted((r.doc_id, r.page_no, r.text, tuple(r.words)) for r in index.collect())
    assert state == [(1, 0, "Straße and word", ("straße", "and", "word")), (1, 1, "", ()), (2, 0, "word WORD", ("word", "word")), (3, 0, "new word", ("new", "word"))]
    # the last batch again, as after a failure between its write and its commit; then all of the source again
    I.add_batch(spark.createDataFrame([(1, 0, "other text"), (3, 0, "new word")], schema), 1, path)
    assert sorted((r.doc_id, r.page_no, r.text, tuple(r.words)) for r in I.read_index(spark, path).collect()) == state
    assert {(r.doc_id, r.page_no): r.hits for r in I.found(I.read_index(spark, path), "Word").collect()} == {(1, 0): 1, (2, 0): 2, (3, 0): 1}


def glyph_rows(rows):
    return [(1, 0, line, c, v, 6 * c, 800 - 12 * line, 6 * c + 6, 810 - 12 * line, hidden) for line, (text, hidden) in enumerate(rows) for c, v in enumerate(text)]


def redact(spark, lines, carriers, term, **more):
    from vellum.operators.redact import redact_document

    schema = "doc_id long, page_no int, line_no int, c int, value string, left int, bottom int, right int, top int, hidden boolean"
    letters = spark.createDataFrame(glyph_rows([x if isinstance(x, tuple) else (x, False) for x in lines]), schema)
    ops = spark.createDataFrame([(1, 0, i, "Tj", x if isinstance(x, str) else x[0]) for i, x in enumerate(lines)], "doc_id long, page_no int, ix int, name string, arg string")
    held = spark.createDataFrame([(1, k, i, t) for i, (k, t) in enumerate(carriers)], "doc_id long, carrier string, place int, text string")
    out = redact_document(letters, ops, held, term, **more)
    page = "".join(r.value for r in out.letters.orderBy("line_no", "c").collect())
    report = out.report.first()
    return page, [r.arg for r in out.ops.orderBy("ix").collect()], {r.place: r.text for r in out.carriers.collect()}, (report.matches, report.operators, report.carriers)


def test_redaction_reaches_every_carrier(spark):
    carriers = [("info", "Ann Smith"), ("packet", "<t>by SMITH</t>"), ("outline", "smith"), ("annotation", "Smith"), ("annotation", None), ("info", "nobody")]
    page, ops, left, done = redact(spark, ["call Smith now", "no one", "SMITH"], carriers, "smith")
    assert page == "call  nowno one" and ops == ["no one"] and done == (2, 2, 4)
    assert left == {0: "Ann", 1: "<t>by </t>", 2: "[redacted]", 4: None, 5: "nobody"}


def test_redaction_modes(spark):
    lines = ["call Smith now", "smith"]
    page, ops, left, done = redact(spark, lines, [("info", "smith Smith")], "Smith", case_sensitive=True)
    assert page == "call  nowsmith" and ops == ["smith"] and left == {0: "smith"} and done == (1, 1, 1)
    assert redact(spark, ["plain"], [("info", "Smith")], "Smith")[2:] == ({}, (0, 0, 1))  # a term that only a carrier has
    assert redact(spark, ["ab ab"], [("info", "ab")], "ab")[2:] == ({0: "ab"}, (2, 1, 0))  # too short for carriers
    assert redact(spark, lines, [("info", "Smith")], "Smith", scrub=False)[2] == {0: "Smith"}
    assert redact(spark, lines, [("info", "Smith")], "")[3] == (0, 0, 0)
    # a removal that brings the term together anew is found by a later pass
    page, _, _, done = redact(spark, ["xSmiSmithth y"], [], "smith")
    assert "smith" not in page.lower() and done[0] >= 1
    # hidden layers: searched or not
    assert redact(spark, [("Smith", True), "other"], [], "Smith")[0] == "other"
    assert redact(spark, [("Smith", True), "other"], [], "Smith", hidden_layers=False)[::3] == ("Smithother", (0, 0, 0))


def test_contracts_by_path(spark):
    from vellum.operators.corpus import contract_pages

    pages = spark.createDataFrame([("a.x", 1), ("c/b.x", 1), ("o\\c.x", 1), ("o/d.x", 1), ("a.x", 2)], "path string, page int").withColumn("q", F.lit("own"))
    contracts = spark.createDataFrame([("c/a.x", 1, "A"), ("b.x", 1, "B"), ("o/c.x", 1, " "), ("d.x", 1, "D")], "path string, page int, q string")
    rows = {(r.path, r.page): (r.q, r.contract_status) for r in contract_pages(pages, contracts, "path", "page", "c/", ["q"]).collect()}
    assert rows == {("a.x", 1): ("A", "APPLIED"), ("c/b.x", 1): ("B", "APPLIED"), ("o\\c.x", 1): ("own", "APPLIED"), ("o/d.x", 1): ("own", "MISSING"), ("a.x", 2): ("own", "MISSING")}
    strict = contract_pages(pages, contracts, "path", "page", "c/", ["q"], strict=True)
    assert strict.where("contract_status = 'MISSING' AND q = 'NEEDS_REVIEW'").count() == 2


def test_pages_move_down(spark):
    from vellum.operators.organise import shifted

    pages = spark.createDataFrame([(1, p) for p in range(6)], "doc int, page int")
    order = lambda chosen, down: [r.page for r in shifted(pages, "doc", "page", F.col("page").isin(*chosen), down=down).orderBy("place").collect()]
    assert order([1, 2], True) == [0, 3, 1, 2, 4, 5] and order([4, 5], True) == [0, 1, 2, 3, 4, 5] and order([0, 5], True) == [1, 0, 2, 3, 4, 5]
    assert order([1, 2], False) == [1, 2, 0, 3, 4, 5]


def test_colours(spark):
    from vellum.functions import colour

    one = lambda *cs: [round(v, 3) for v in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first()]
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    assert one(*colour.process_rgb(*lit(0, 1, 0, 0))) == [0.925, 0.0, 0.549] and one(*colour.process_rgb(*lit(0, 0, 0, 0))) == [1, 1, 1]
    assert one(*colour.plain_rgb(*lit(0, 1, 0, 0.25))) == [0.75, 0, 0.75]
    assert all(abs(v - 1) < 0.005 for v in one(*colour.lab_rgb(*lit(100, 0, 0)))) and one(*colour.lab_rgb(*lit(0, 0, 0))) == [0, 0, 0]
    assert one(*colour.indexed(F.lit(9), [(0.0, 1.0), (0.5, 0.25)])) == [0.5, 0.25]
    # bilinear between the corners 0, 1, 2, 3, and held at the edges
    square = [(0.0,), (1.0,), (2.0,), (3.0,)]
    assert one(*colour.sampled(lit(0.5, 0.5), [2, 2], square)) == [1.5] and one(*colour.sampled(lit(9, 0), [2, 2], square)) == [1] and one(*colour.sampled(lit(0.25, 1), [2, 2], square)) == [2.25]
    assert one(*colour.sampled(lit(0.3), [1], [(0.7,)])) == [0.7]


def test_lists_of_pages_and_passwords(spark, tmp_path):
    import pytest

    from vellum.sources import readers as R

    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    pages = R.page_manifest(spark, put("p", "path\tpage\n# note\n\na\\b.x\t0\n a/b.x \t 0 \nc.x\t12\tmore\n"))
    assert sorted(map(tuple, pages.collect())) == [("a/b.x", 0), ("c.x", 12)]
    words = R.passwords(spark, put("w", "a.x\t first \nb.x\t\na.x\tlast #1\n"))
    assert sorted(map(tuple, words.collect())) == [("a.x", "last #1"), ("b.x", "")]
    for name, text, read in (("q", "a.x\n", R.page_manifest), ("r", "a.x\t-1\n", R.page_manifest), ("s", "a.x\tone\n", R.page_manifest), ("t", "\tpw\n", R.passwords)):
        with pytest.raises(Exception, match="not a"):
            read(spark, put(name, text)).collect()


def test_reports(spark):
    import json

    from vellum.sources import sinks as S

    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", None), (2, None, 0.5)], "doc int, name string, v double")
    got = {r.doc: json.loads(r.json) for r in S.envelopes(rows, "doc", "scan", {"n": F.count("*"), "named": F.count("name")}).collect()}
    assert got[1] == {"schemaVersion": 1, "kind": "scan", "document": 1, "totals": {"n": 2, "named": 2}, "results": [{"name": "a", "v": None}, {"name": "b", "v": 2.0}]}
    pages = spark.createDataFrame([("p", 1, "OK"), ("q", 1, "OK"), ("s", 1, "OK")], "path string, page int, status string")
    refs = spark.createDataFrame(
        [("p", 1, "y", "OK", True, 0.2, 0.1, 1.0, None), ("p", 1, "x", "OK", False, 0.2, 0.1, 2.0, None), ("p", 1, "w", "ERROR", False, 0.0, 0.0, 0.0, None),
            ("p", 1, "v", "OK", True, None, 0.0, 0.0, None), ("q", 1, "z", "ERROR", False, 0.1, 0.1, 0.1, 0.1)],
        "path string, page int, name string, status string, passed boolean, diff double, mae double, rmse double, ssim double",
    )
    out = {r.path: (r.references, r.passing, r.best_name, r.best_rmse) for r in S.benchmark_rows(pages, refs).collect()}
    assert out == {"p": (4, 2, "x", 2.0), "q": (1, 0, None, None), "s": (0, 0, None, None)}
    assert [r.line for r in S.csv_lines(spark.createDataFrame([('a "q", b', 0.5, None, 7), (None, 1e-7, 2.0, None)],
        "s string, x double, y double, n int")).collect()] == ['"a ""q"", b",0.5,,7', '"",0,2,']
    text = S.benchmark_report("Run", {"Pages": "3"}, {"Checks": pages.orderBy("path").limit(1)})
    assert text.startswith("# Run\n\n- Pages: `3`\n\n## Checks\n\n| path | page | status |\n") and "| p | 1 | OK |" in text


def test_written_tables_are_released(spark):
    from vellum.sources import scratch

    scratch.release(spark)
    kept, gone = (scratch.written(spark.range(5), "release") for _ in range(2))
    scratch.discard(gone)
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._scratch_path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert kept.count() == 5 and files.exists(path)
    assert scratch.release(spark) == 1 and not files.exists(path) and scratch.release(spark) == 0

"""Every operator over rows with great, null and repeated ids, and with columns whose names the operators use."""

import hashlib

import public_tokenizers as P
import pytest

from vellum.llm import bpe, html_extract, mpeg_audio, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter, winnow
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"
GREAT = 1 << 60
LONG = "a very long text that goes on and on " * 40_000
TEXTS = ["one two three", "four", None, "", "one two three", "six é 日本", "seven eight", "seven eight", LONG, "ten"]
IDS = [GREAT + 1, None, GREAT + 7, 5, 5, 5, None, (1 << 62) + 3, -4, GREAT + 1]
CLASH = ("_id", "_row", "_text", "_h", "_run", "_tail", "_rank", "_salt", "h", "sum", "node", "keys", "host", "rule", "verdict", "score", "n_chars", "held_out", "length", "start")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *[f"x{k}"] * len(CLASH)) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).coalesce(2)


def kept(rows, *columns):
    return sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in columns)) for r in rows)


def wanted(value):
    return sorted((i is None, i or 0, *value(t or "")) for i, t in zip(IDS, TEXTS, strict=True))


def test_mapped_operators(docs):
    utf = lambda t: len(t.encode())
    assert kept(mpeg_audio.media_digest(docs).collect(), "n_bytes") == wanted(lambda t: (utf(t),))
    assert kept(mpeg_audio.media_store(docs).collect(), "n_bytes") == wanted(lambda t: (utf(t),))
    ranks = P.path("byte_bpe_50k.tiktoken")
    got = bpe.bpe_digest(docs, ranks, P.PATTERN).collect()
    assert kept(got, "decoded_sha256") == wanted(lambda t: (hashlib.sha256(t.encode()).hexdigest(),))


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert kept([r for r in got if r.start == 0], "doc_tokens") == wanted(lambda t: (size(t),))
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert (s2, o2) == (s, o + n) or (o2 == 0 and s2 > s)


def test_fingerprints(docs):
    got = winnow.edited_digest(docs).collect()
    assert kept(got, "n_chars") == wanted(lambda t: (len(t),))
    after = {r.doc_id: r.edited_sha256 for r in got if r.doc_id in (-4, (1 << 62) + 3)}
    cut = len(LONG) // 4
    follows = sorted((t for i, t in zip(IDS, TEXTS, strict=True) if i == 5), key=len)
    assert after[-4] in {hashlib.sha256((LONG[: len(LONG) - cut] + t[:cut]).encode()).hexdigest() for t in follows}
    text = "seven eight"
    assert after[(1 << 62) + 3] == hashlib.sha256((text[:-2] + LONG[:2]).encode()).hexdigest()
    alone = {r.fingerprint: (r.edited_sha256, r.near_next) for r in got if r.doc_id is None}
    assert all(near == 1 for _, near in alone.values()) and len(alone) == 2


def test_many_equal_ids(spark):
    """One id in most rows: each row but the last is followed by another one, in an order that splits between runs."""
    docs = spark.range(3000).selectExpr("CAST(if(id < 2500, 7, id) AS bigint) AS doc_id", "concat('row ', id, ' of the table') AS text")
    got = winnow.edited_digest(docs).collect()
    assert len(got) == 3000 and sorted(r.n_chars for r in got) == sorted(len(f"row {i} of the table") for i in range(3000))
    texts = [f"row {i} of the table" for i in range(3000)]
    followed = {r.edited_sha256 for r in got}
    possible = lambda t: {hashlib.sha256((t[: len(t) - len(t) // 4] + x[: len(t) // 4]).encode()).hexdigest() for x in ("row 1", "row 2", "row 9", "row 5")}
    assert all(possible(t) & followed for t in texts[:50])


def test_scores(spark, docs):
    labels = table(spark, SMALL, "labels")
    base = table(spark, SMALL, "documents").select("doc_id", "text")
    both = base.unionByName(docs.select("doc_id", "text"))
    for scored in (quality.quality_scores(both, labels), toxicity.toxicity_scores(both, labels)):
        rows = scored.collect()
        assert len(rows) == base.count() + len(IDS)
        ids = [r.doc_id for r in rows]
        assert all(ids.count(i) >= IDS.count(i) for i in IDS) and all(0 <= r.score <= 1 for r in rows)


def test_pairs(docs):
    got = kept(ngram_join.link_components(docs).collect(), "n_shingles", "component_id")
    assert [g[:2] for g in got] == [w[:2] for w in wanted(lambda t: (0,))]
    assert {g[1]: g[3] for g in got if not g[0]} == {GREAT + 1: 5, GREAT + 7: GREAT + 7, 5: 5, (1 << 62) + 3: (1 << 62) + 3, -4: -4}
    got = suffix_dedup.repeated_digest(docs).collect()
    assert kept(got, "n_bytes") == wanted(lambda t: (len(t.encode()),))
    assert {r.n_removed for r in got} == {0, len(LONG)}


def test_pages(spark):
    page = "<html><body><article><p>{}</p></article></body></html>"
    urls = ["http://a.com/en/x", None, "no host", "http://example.org/es/1", "http://a.com/" + "x/" * 50_000, "http://a.com/en/x"]
    pages = [(i, u, page.format("some words that make a text. " * 5 + str(k)), *[f"c{k}"] * len(CLASH)) for k, (i, u) in enumerate(zip([GREAT + 1, None, GREAT + 7, None, 3, 3], urls, strict=True))]
    names = [c for c in CLASH if c != "text"]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in names)).withColumnRenamed("_text", "text").coalesce(1)
    ids = sorted((i is None, i or 0) for i, *_ in pages)
    found = html_extract.main_text(df).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in found) == ids
    assert sorted(r.text[-1] for r in found) == list("012345") and sorted(str(r.url) for r in found) == sorted(map(str, urls))
    judged = url_filter.url_verdicts(df).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in judged) == ids and {r.verdict for r in judged} <= {"allow", "block"}
    assert {r.rule for r in judged} == {"com/en/", "org/es/", None}


def test_deep_pages_keep_their_menus_apart():
    model = html_extract.trained()
    inner = "<article><p>" + "A sentence that belongs to the article, with words. " * 6 + "</p></article><aside class='sidebar'><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></aside>"
    for depth in (1, 150, 400, 3000):
        page = "<html><body>" + "<div>" * depth + inner + "</div>" * depth + "</body></html>"
        assert "Home" not in html_extract.extract([page], model)[0]
    assert "kept" in html_extract.extract(["<body><article><div/><p>" + "These words are kept, as a slash closes nothing in a page. " * 4 + "</p></article></body>"], model)[0]


LONG_P = "A long paragraph with many words, that goes on for a while. " * 5


def test_odd_markup_and_short_pages():
    model = html_extract.trained()
    text = lambda page: html_extract.extract([page], model)[0]
    # a quote that isn't closed ends nothing, and no markup is left
    assert text('<article><p>Start of it all.</p><p title="abc>Text here</p><p>More text, of words.</p></article>') == "Start of it all.\nText here\nMore text, of words."
    assert text('<p>a <b title="x > y < z">bold</b> <i data-a=\'>\'>c</i></p>') == "a bold c" and text("<p>x and more <p") == "x and more"
    # short pages and pages without a wrapper are whole
    assert text("<html><body><p>Hello world.</p></body></html>") == "Hello world." and text("<p>only one para</p>") == "only one para"
    assert text("<h1>Title only</h1><p>One.</p><p>Two.</p>") == "Title only\nOne.\nTwo."
    long = LONG_P.strip()
    assert text(f"<div><h1>Head line here</h1><p>{LONG_P}</p><p>x &lt;b&gt; &amp;amp; 3</p><p>{LONG_P}</p></div>") == f"Head line here\n{long}\nx <b> &amp; 3\n{long}"
    assert text(f"<html><body><h1>Head line</h1><p>{LONG_P}</p></body></html>") == f"Head line\n{long}"
    assert text(f'<article><p>{LONG_P}</p><p>See <a href="/x">this</a></p><p><a href="/y">All link</a></p></article>') == f"{long}\nSee this\nAll link"
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
    assert text(f"<html><body>{menu}<h1>Head line</h1><p>{LONG_P}</p><p>Short.</p><footer>&copy; Me 2020. All rights.</footer></body></html>") == f"Head line\n{long}\nShort."


@pytest.mark.parametrize("junk", ['<b " ', '<b ="', "</b ", "<! ", "<b <", "<a href=\"x' ", "<!--", "<svg/>"])
def test_parser_is_linear(junk):
    import time

    began = time.process_time()
    html_extract.parse(junk * 100_000 + "<p>end</p>")
    assert time.process_time() - began < 3

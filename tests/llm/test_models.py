"""URL filters, toxicity, HTML extraction, quality."""

import random
import zlib

import numpy as np

from vellum.llm import boosting, html_extract, quality, toxicity, url_filter
from vellum.llm.common import table

SMALL, SOME = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- URL filters


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/7?x#y", "http://a.com/en/1", "http://com/en/", "http://acom/en/", "http://example.com/EN/", "http://xexample.com/en/72", "http://a.net?/de/", "http://a.net/de/8", "http://b.example.net/de/88/", "http://É.org/es/\n\n", "http://a.org\n/es/", "a://b://c.org/es/x", "http://Ä.net/de/"]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for i, url in enumerate(URLS):
        host, path, rule = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0]), url
        assert got[i].verdict == rule[1] if rule else got[i].verdict in ("allow", "block")


def test_url_models(spark):
    pages = table(spark, SOME, "pages", "page_id", "url")
    rows = url_filter.url_verdicts(pages).collect()
    judged = [r for r in rows if r.rule]
    assert len(rows) == pages.count()
    good, bad = ([r.score for r in judged if r.verdict == v] for v in ("allow", "block"))
    assert np.mean(good) > np.mean(bad)
    # URLs without a rule that look like blocked ones are blocked
    assert sum(r.verdict == "block" for r in rows if not r.rule and r.host.endswith(".org")) > 0
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_url_model_is_a_distribution(spark):
    labelled = spark.createDataFrame([(f"http://x.net/{k % 7}", True) for k in range(40)] + [(f"http://y.org/{k % 3}a", False) for k in range(40)], "url string, accepted boolean")
    model = url_filter.train(labelled)
    alphabet = [chr(c) for c in range(32, 127)] + ["\x7f", "\0"]
    assert len(alphabet) == url_filter.ALPHABET
    for m in (model.accepted, model.rejected):
        for context in ("", "h", "http", "x.ne", "zzzz", "rg/"):
            assert abs(sum(m.probability(context, c) for c in alphabet) - 1) < 1e-9
    assert model.score("http://x.net/3") > 0 > model.score("http://y.org/1a") and model.score(None) == 0


def test_url_scores_use_every_count(spark, monkeypatch):
    """One host has most URLs, so grams of the others are below any share; some are joined, not broadcast."""
    monkeypatch.setattr(url_filter, "COMMON", 1 / 200, raising=False)
    urls = [f"http://hot.net/de/{k % 50}" for k in range(10_000)] + [f"http://n{k}y.net/de/{k}" for k in range(50)] + [f"http://q{k}zx.org/es/{k % 7}w{k}" for k in range(60)] + [f"http://q{k}zx.org/xx/{k % 7}w{k}" for k in range(90)] + ["", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.url_verdicts(pages).collect()
    kept = [(urls[r.page_id], r.verdict == "allow") for r in rows if r.rule and zlib.crc32(urls[r.page_id].encode()) % 5]
    model = url_filter.train(spark.createDataFrame(kept, "url string, accepted boolean"))
    assert len(rows) == len(urls) and all(abs(r.score - model.score(urls[r.page_id])) < 1e-9 for r in rows)
    for m, side in ((model.accepted, True), (model.rejected, False)):
        assert m.grams.keys() == {s[max(0, i - k) : i + 1] for u, good in kept if good == side for s in [url_filter.symbols(u)] for i in range(len(s)) for k in range(5)}


# --- toxicity


def distance(a, b):
    """Insertions, deletions, replacements and swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_levenshtein_walk_equals_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(5, 11))) for _ in range(40)]
    lexicon = toxicity.Lexicon(dict.fromkeys(words, 1.0))
    for _ in range(12000):
        form = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        if rng.random() < 0.6:  # near a word
            form = list(rng.choice(words))
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(form) - 1)
                form[k : k + 2] = rng.choice([form[k + 1 : k - 1 if k else None : -1], form[k : k + 1], [*form[k : k + 2], "a"], ["b", form[k + 1]]])
            form = "".join(form)
        near = sorted(w for w in words if distance(w, form) <= 1) or sorted(w for w in words if len(w) >= 8 and distance(w, form) <= 2)
        assert lexicon.nearest(form) == (near[0] if near else None), form


def test_disguised_terms():
    finder = toxicity.Finder(toxicity.Lexicon({"idiot": 3.0, "disgusting": 3.0, "scum": 2.0}))
    hits = lambda t: [(h.term, h.fuzzy) for h in finder.find(t)[1]]
    for form in ("1d10t", "id10t!", "i.d.i.o.t", "i-d-i-o-t", "idoit", "iidiot", "diiot", "ID!OT", "d1sgust1ng", "disgusing", "disugsting", "dizgustimg", "5cum", "s.c.u.m", '"1d10t"'):
        assert len(hits(form)) == 1 and hits(form)[0][1], form
    assert hits("1970 10 4.5 idea scam a.m. p.m. $100 disquieting") == []
    assert hits("x" * 50 + "idiot") == [] and hits("idiot" + "," * 60 + "scum") == [("idiot", False)]


def test_quoting_scores_below_using(spark):
    """With a trained model: quoted terms score below the same terms when they are used."""
    docs, labels = table(spark, SOME, "documents"), table(spark, SOME, "labels")
    model = toxicity.train(docs, labels)
    finder, neutral = toxicity.Finder(model.lexicon), "these are plain words that stand here without any meaning at all " * 18
    score = lambda t: float(toxicity.features(*finder.find(neutral + t + " " + neutral), model.context) @ model.weights)
    assert model.weights[2] <= 0
    terms = [w for w in model.lexicon.words if len(w) >= 5][:20]
    assert len(terms) >= 5
    for w in terms:
        used = score(f"you {w}, stop it")
        assert max(score(f'they wrote "{w}" on paper'), score(f"the word “{w}” means a fool, a dictionary says")) < used
    assert score("nothing here") <= min(score(f'a "{w}"') + 1e-9 for w in terms) or model.weights[2] < 0


def test_gate():
    marked, plain = [1.0, 1.0, 0.0], [1.0, 0.0, 0.0]
    assert toxicity.fit_gate(np.zeros((1, 3)), np.zeros(1), np.zeros(1)) == toxicity.GATE
    # quotation marks that stand around hits of toxic texts as often tell less
    x, y, n = np.array([marked, plain, marked, plain]), np.array([1.0, 1.0, 0.0, 0.0]), np.array([50.0, 50.0, 50.0, 50.0])
    assert toxicity.fit_gate(x, y, n)[1] < toxicity.GATE[1]


def test_lexicon_and_context():
    lexicon = toxicity.Lexicon({"moron": 3.0, "lowe*": 4.0}, frozenset({"oron"}))
    finder = toxicity.Finder(lexicon)
    hits = lambda t: [(h.term, h.fuzzy, h.marked) for h in finder.find(t)[1]]
    assert hits("you MORON!") == [("moron", False, False)]
    assert hits("you m0ron, oron loweich") == [("moron", True, False), ("lowe*", False, False)]
    assert hits('she said "moron" today') == [("moron", False, True)]
    assert hits("he wrote “what a moron” there") == [("moron", False, True)]
    assert hits("ｍｏｒｏｎ a,moron,b") == [("moron", False, False), ("moron", False, False)]
    plain, quoted = (toxicity.quotation(finder.find(t)[1][0], toxicity.Context()) for t in ("a moron b", 'a "moron" b'))
    assert plain < 0.1 < 0.5 < quoted


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def held_out_scores(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    pairs = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def test_toxicity_held_out(spark, odd_docs, no_docs):
    docs, labels = table(spark, SOME, "documents"), table(spark, SOME, "labels")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    score, label = held_out_scores(rows, labels, "toxic")
    assert auc(score, label) > 0.9 and ((score >= 0.7) & (label == 0)).sum() <= 1
    odd = {r.doc_id: r for r in toxicity.toxicity_scores(odd_docs, labels).collect()}
    assert len(odd) == 9 and odd[0].score == odd[1].score and odd[5].score == odd[6].score
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0


def test_copies_of_a_toxic_text_do_not_crowd_out_terms(spark):
    rng = random.Random(21)
    make = lambda a, b: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(a, b)))
    common, terms, copied = [make(3, 7) for _ in range(200)], [make(14, 16) for _ in range(12)], " ".join(make(5, 11) for _ in range(2500))
    plain = lambda: rng.choices(common, k=30)
    rows = [(i, copied, 1) for i in range(120)]
    rows += [(i, " ".join([*plain(), terms[i % 12], *plain()]), 1) for i in range(120, 420)]
    rows += [(i, " ".join(plain()), 0) for i in range(420, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = [r for r in toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect() if r.held_out]
    assert all(r.predicted == 1 for r in got if 120 <= r.doc_id < 420) and all(r.predicted == 0 for r in got if r.doc_id >= 420)


def test_whole_words_of_a_beginning_are_found_with_an_error():
    found = {"lowe*": (40, 4.0), **{w: (10, 3.0) for w in ("lowest", "lowering", "loweich", "lowedan")}}
    words = [w for w in found if w != "lowe*"]
    held = [{"lowe*", words[i % 4]} for i in range(40)]
    lexicon = toxicity.Lexicon(toxicity.choose_terms(found, held, 1000))
    assert "lowe*" in lexicon.terms and lexicon.match("loewich")[0] == "loweich" and lexicon.match("l0weich")[0] == "loweich"
    many = {f"{chr(97 + i // 26)}{chr(97 + i % 26)}word": (5, 3.0) for i in range(600)}
    assert len(toxicity.choose_terms(many, [{w} for w in many for _ in range(5)], 3000)) == 600


# --- quality


def test_nnpu_separates_and_estimates_the_prior():
    rng = np.random.default_rng(0)
    make = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    positive = make(800, 1.5)
    unlabelled = np.concatenate((make(900, 1.5), make(600, -1.5)))
    prior = quality.estimate_prior(positive, unlabelled)
    assert 0.5 < prior < 0.75
    model = quality.fit_nnpu(positive, unlabelled, prior)
    assert (model.raw(make(500, 1.5)) > 0).mean() > 0.95 and (model.raw(make(500, -1.5)) > 0).mean() < 0.05


def test_quality_held_out(spark, odd_docs, no_docs):
    docs, labels = table(spark, SOME, "documents"), table(spark, SOME, "labels")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    score, label = held_out_scores(rows, labels, "quality")
    assert auc(score, label) > 0.9 and ((score >= 0.3) == (label == 1)).mean() > 0.85
    odd = {r.doc_id: r for r in quality.quality_scores(odd_docs, labels).collect()}
    assert len(odd) == 9 and odd[0].score == odd[1].score and odd[5].score == odd[6].score
    assert quality.quality_scores(no_docs, labels).count() == 0


# --- HTML extraction


def test_boosting_learns_and():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    assert ((boosting.fit(x, y).probability(x) > 0.5) == y).mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">More</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph, with <b>bold</b>&nbsp;words and&#32;a <a href="#">link</a> in it.
<p>Second paragraph of the text, which is a good deal longer than the first one; it goes on.<script>var t="</p>";</script></article>
<section class="comments"><p>Nice!</p><p>I agree with all of that, thanks.</p></section>
<footer>&copy; me &middot; all rights</footer>"""


def test_main_text():
    model = html_extract.trained()
    want = "A title & more\nFirst paragraph, with bold words and a link in it.\nSecond paragraph of the text, which is a good deal longer than the first one; it goes on."
    assert html_extract.extract([PAGE, "", "no markup", "<p", "<article>", "&" * 50], model)[:2] == [want, ""]


def under(page):
    """Each text block of a page with the tags above it."""
    out, stack = {}, [(html_extract.parse(page), ())]
    while stack:
        node, above = stack.pop()
        if node.tag == "#":
            out[node.text] = above
        stack += [(c, (*above, node.tag)) for c in node.children]
    return out


def test_parser_drops_no_text():
    article = "<article><h1>A title</h1><p>" + "A long sentence of the text, which goes on. " * 5 + "</p></article>"
    model = html_extract.trained()
    want = html_extract.extract([f"<html><head><title>T</title></head><body>{article}</body></html>"], model)
    assert want[0].startswith("A title")
    for head in ("<head><title>T</title><body>", "<head><meta charset=x><script>a</script>", "<head>\n<link href=x>\n<body>", "<svg viewBox='0 0 1 1'/>", "<script src='x'/>", "<iframe src='x' />"):
        assert html_extract.extract([f"<html>{head}{article}"], model) == want, head
    assert list(under("<head><title>T</title>some text")) == ["some text"]
    assert list(under("<script src='x'/>var a</script><p>b</p><script>c</script>")) == ["b"]
    assert list(under("<script src='x'/><p>b</p><script>c</script>")) == ["b"]
    # end tags of elements that are too deep close those, not the ones above
    deep = under("<nav><div>" + "<section>" * 150 + "<div>" * 100 + "</div>" * 100 + "inner" + "</section>" * 150 + "here</div>there</nav>out")
    assert deep["inner"][-1] == "section" and deep["here"] == ("#root", "nav", "div") and deep["there"] == ("#root", "nav") and deep["out"] == ("#root",)


def test_decoding_is_consistent():
    rng = random.Random(3)
    for _ in range(40):
        nodes, parents, _ = html_extract.vectors(html_extract.parse(html_extract.make_page(rng)))
        kept = html_extract.decode(nodes, parents, np.random.default_rng(len(nodes)).random(len(nodes)))
        assert all(not k or p < 0 or kept[p] for k, p in zip(kept, parents, strict=True))


def test_made_pages_held_out():
    rng, model, both, extra, missed = random.Random(12345), html_extract.trained(), 0, 0, 0
    for _ in range(150):
        page = html_extract.make_page(rng)
        want = [n.text.replace("\x01", "") for n in html_extract.vectors(html_extract.parse(page))[0] if n.tag == "#" and "\x01" in n.text]
        got = html_extract.extract([page.replace("\x01", "")], model)[0].split("\n")
        both, extra, missed = both + len(set(want) & set(got)), extra + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert both / (both + extra) > 0.95 and both / (both + missed) > 0.95


def test_pages_table(spark):
    pages = table(spark, SMALL, "pages")
    rows = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert len(rows) == pages.count()
    for r in pages.collect():
        nodes, parents, _ = html_extract.vectors(html_extract.parse(r.html))
        inside = []
        for n, p in zip(nodes, parents, strict=True):
            inside.append(n.tag == "article" or (p >= 0 and inside[p]))
        want = "\n".join(n.text for n, k in zip(nodes, inside, strict=True) if k and n.tag == "#")
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>" * 3000 + "x")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_extract.main_text(odd).collect()}.keys() == {1, 2, 3}


def test_all_unlabelled_rows_count(spark):
    """Sums by cell, and counts of scores, are those of all rows, whatever the partitions; labelled and held-out rows stay out."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.001", "labels")
    known = {r.doc_id for r in labels.collect()}
    rows = [r for r in docs.collect() if r.doc_id not in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    x = np.stack([quality.features(r.text or "") for r in rows]).astype(np.float64)
    free = quality._free(docs, labels, 5, 0, "doc_id", "text")
    centre, scale = x.mean(0), x.std(0) + 1e-3
    for parts in (1, 7):
        a, b = quality.summed(free.repartition(parts), centre, scale)
        assert a.rows + b.rows == len(rows) and abs(a.rows - b.rows) < len(rows) / 2
        assert np.allclose((a.centre * a.rows + b.centre * b.rows) / len(rows), centre)
        second = (a.rows * (a.spread**2 + a.centre**2) + b.rows * (b.spread**2 + b.centre**2)) / len(rows)
        assert np.allclose(second - centre**2, x.var(0), atol=1e-6)
        model = quality.fit_nnpu(x[:50], a, 0.5, rounds=2)
        edges = np.linspace(-3, 3, 50) + 0.00037
        assert np.array_equal(quality.score_counts(free.repartition(parts), model, edges), np.bincount(np.searchsorted(edges, model.raw(np.stack([quality.features(r.text or "") for r in rows])), "right"), minlength=len(edges) + 1))

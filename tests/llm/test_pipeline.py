"""The stages against plain versions of them, and the whole run."""

from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import brute as brute_components
from vellum.llm import quality, suffix_dedup, toxicity
from vellum.llm.common import table, written

SMALL = "/root/testdata/sf0.001"


def brute_cut(rows):
    """{id: text} without repeated bytes, code points that a cut splits left out."""
    raws = {i: (t or "").encode() for i, t in rows}
    seen = Counter(r[x : x + 200] for r in raws.values() for x in range(len(r) - 199))
    out = {}
    for i, r in raws.items():
        gone = bytearray(len(r))
        for x in range(len(r) - 199):
            if seen[r[x : x + 200]] > 1:
                gone[x : x + 200] = b"\1" * 200
        runs, at = [], None
        for k in range(len(r) + 1):
            if k < len(r) and not gone[k]:
                at = k if at is None else at
            elif at is not None:
                runs.append(r[at:k].decode(errors="ignore"))
                at = None
        out[i] = "".join(runs)
    return out


@pytest.mark.parametrize("name", ["small", "odd"])
def test_stages(spark, odd_docs, name):
    docs = table(spark, SMALL, "documents") if name == "small" else odd_docs
    columns = docs.columns
    labels = table(spark, SMALL, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "packing"]

    good = written(stages["quality_classifier"](spark, docs, SMALL), "t1")
    model = quality.train(docs, labels)
    want = [r.doc_id for r in docs.select("doc_id", quality.score(model).alias("s")).collect() if r.s >= quality.THRESHOLD]
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(want)

    calm = written(stages["toxicity"](spark, good, SMALL), "t2")
    model = toxicity.train(good, labels)
    want = [r.doc_id for r in good.select("doc_id", toxicity.score(good, model).alias("s")).collect() if r.s < toxicity.THRESHOLD]
    assert calm.columns == columns and sorted(r.doc_id for r in calm.collect()) == sorted(want)

    single = written(stages["ngram_jaccard_join"](spark, calm, SMALL), "t3")
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    want = [i for i, (_, c) in brute_components(rows, 5, 80, 100).items() if i == c]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)

    cut = written(stages["suffix_array_dedup"](spark, single, SMALL), "t4")
    rows = {r.doc_id: r for r in single.collect()}
    left = brute_cut([(i, r.text) for i, r in rows.items()])
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns
    assert {i: r.text or "" for i, r in got.items()} == {i: t for i, t in left.items() if t or not rows[i].text}
    for i, r in got.items():
        same = r.text == rows[i].text
        assert r.n_chars == (rows[i].n_chars if same else len(r.text)) and (r.lang, r.source) == (rows[i].lang, rows[i].source)

    packed = stages["packing"](spark, cut, SMALL).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in got.items()}


def test_run_on_empty_documents(spark, no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    table(spark, SMALL, "documents").limit(0).write.parquet(f"{folder}/documents.parquet")
    table(spark, SMALL, "labels").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_repeated_ids_leave_one(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "a", 5), (3, "", "en", "a", 0), (4, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_shared_null_and_great_ids_lose_no_text(spark):
    """Rows of one id with different texts stay, as do rows without an id; columns of any name are kept."""
    words = "one two three four five six seven eight nine ten "
    great = (1 << 60) + 1
    rows = [(5, words, 1.0), (5, words * 2, None), (5, words, 1.0), (None, words, 2.0), (None, words, 2.0), (great, words, 3.0), (great + 2, "some other words that stand alone here", None), (great + 4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone double").withColumn("component_id", F.lit("x")).withColumn("n_chars", F.lit(None).cast("long"))
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(5, words), (5, words * 2), (0, words), (0, words), (great + 2, rows[6][1]), (great + 4, "")])
    long_a, long_b = "abcdefghij" * 25, "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(None, long_b, 1.0), (None, long_b + "tail", None), (great, "head" + long_b, None), (great, None, None), (great + 2, "short", None), (7, long_a, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _left double").withColumn("n_chars", F.lit(None).cast("long"))
    got = corpus_pipeline.repeats_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in got.collect()) == [(0, "tail", 4), (great, "", 0), (great, "head", 4), (great + 2, "short", 0)]


def test_cut_text_never_joins_halves_of_code_points():
    assert suffix_dedup.cut_text("aéb", [(2, 3)]) == "ab"
    assert suffix_dedup.cut_text("é日", [(1, 3)]) == ""
    assert suffix_dedup.cut_text("abc", []) == "abc"

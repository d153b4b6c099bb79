"""The rule ledger against a plain version, its policies and ablations."""

import re

import pytest

from vellum.llm import quality_rules as q
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"
FULL = q.POLICIES[q.CURRENT]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, "", " \t\n\x0b\f\r ", "one", "a b c d e", "a b c d e f a b c d e", "x x x x x x x", "a b c d e a b c d e f g", "\na\n\n b \nb\na\n b ", "日本語 🎉 text joined   # $5", "a " * 200, "\x1c a\x85b", "p q r s t\n" * 3]
    return spark.createDataFrame([(1 << 61 if k else None, t, k, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, id int, words string, fail_bits int"), texts


def test_measures(spark, rows):
    df, texts = rows
    got = q.ledger(df).collect()
    assert [{k: r[k] for k in plain("")} for r in got] == [plain(t) for t in texts]
    assert [r.doc_id for r in got] == [None] + [1 << 61] * (len(texts) - 1) and got[0].fail_bits == 1
    docs = table(spark, SMALL, "documents").where("length(text) < 6000")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r.doc_id: {k: r[k] for k in plain("")} for r in q.ledger(docs).collect()} == want


def test_long_text(spark):
    text = " ".join(str(i) for i in range(200_000)) + " 5 6 7 8 9 10"
    (r,) = q.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.n_repeat_words) == (200_006, 12)


def test_no_rows(no_docs):
    stored = q.ledger(no_docs)
    assert q.verdicts(stored, FULL).count() == 0 and q.ablations(stored, FULL).count() == 0 and q.changes(stored, q.BASE, FULL).count() == 0


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([(1, 0, 5), (2, 1, 5), (3, 4, 50), (4, 5, 7), (5, 4, 10), (6, 1 << 7, 1), (None, 0, 3)], "doc_id long, fail_bits long, n_words long")


def test_policies(stored):
    surface = q.POLICIES["2-surface"]
    assert (q.BASE.mask, surface.mask, FULL.mask) == (3, 15, 255)
    got = {r.doc_id: (r.kept, r.sole_rule) for r in q.apply_policy(stored, surface).collect()}
    assert got == {1: (True, None), 2: (False, "few_words"), 3: (False, "symbols"), 4: (False, None), 5: (False, "symbols"), 6: (True, None), None: (True, None)}


def test_ablations_are_what_leaving_a_rule_out_does(stored):
    for policy in q.POLICIES.values():
        got = {r.rule: r for r in q.ablations(stored, policy).collect()}
        assert set(got) == set(policy.rules)
        for rule in policy.rules:
            less = q.Policy("less", tuple(x for x in policy.rules if x != rule))
            kept = q.apply_policy(stored, less).where("kept").count()
            assert (got[rule].kept_without, got[rule].failed_alone) == (kept, kept - got[rule].kept)
    assert {r.rule: r.words_alone for r in q.ablations(stored, q.POLICIES["2-surface"]).collect()}["symbols"] == 60


def test_changes(stored):
    got = {(r.kept_before, r.kept_after): (r.docs, r.words, r.any_bits, r.all_bits) for r in q.changes(stored, q.BASE, FULL).collect()}
    assert got == {(True, True): (2, 8, 0, 0), (True, False): (3, 61, 132, 0), (False, False): (2, 12, 5, 1)}


def test_native(stored, rows):
    plan = q.verdicts(q.ledger(rows[0]), FULL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

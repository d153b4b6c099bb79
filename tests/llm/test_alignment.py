"""Alignment against whole texts, tokens at their byte offsets, and all overlapping pairs."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from vellum.llm import alignment
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, tokenizers):
    """(ids, byte ranges) of A and B, or None."""
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = tokenizers
    if not text:
        return None
    whole, out = (" " + text).encode(), []
    back = {}
    for byte in range(256):  # the tokenizer's own way of showing a byte, by bytes that make characters
        if byte < 128:
            back[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(byte))[0][0]] = byte
    for byte in range(128, 192):
        back[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([0xC2, byte]).decode())[0][0][1]] = byte
    ids = a.encode(" " + text, add_special_tokens=False).ids
    shown = alignment._byte_level()
    assert all(shown[k] == v for k, v in back.items())
    parts_a = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in ids]
    parts_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        parts_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    for parts in (parts_a, parts_b):
        if b"".join(x for _, x in parts) != whole:
            return None
        at, spans = 0, []
        for i, raw in parts:
            spans.append((i, at, at + len(raw)))
            at += len(raw)
        out.append(spans)
    return out


def plain(texts, tokenizers):
    found = [tokens(t, tokenizers) for t in texts]
    links, counts = [], Counter()
    for f in found:
        own = [(i, j) for i, s, e in f[0] for j, s2, e2 in f[1] if s < e2 and s2 < e] if f else []
        links.append(own)
        counts.update(own)
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for f, own in zip(found, links, strict=True):
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in f[0]} & {e for *_, e in f[1]})
        names, start = [], 0
        for e in ends:
            names.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < e) for side in f))
            start = e
        out.append((len(f[0]), len(f[1]), len(ends), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(names).encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(docs, tokenizers):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0, *w) for r, w in zip(rows, plain([r.text for r in rows], tokenizers), strict=True)))
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in alignment.align(docs, A, B).collect())
    assert got == want


PARTS = ["a", "the", " ", "  ", "\n", "\t", "▁", " ", "　", "\x1c", "\x85", "é", "é", "日本", "🎉", "'s", "'ll", "12", "!", "...", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "ｆ", "​", "\x00", "Überschrift", "x" * 30, "\r\n"]


def test_segments_equal_whole_texts(tokenizers):
    a, b = tokenizers
    both, rng = alignment.Aligner(A, B), random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(4000)]
    none = 0
    for text, found in zip(texts, both.texts(texts), strict=True):
        f = tokens(text, tokenizers) if rng.random() < 0.2 else ()
        ids = [g for s in found for g in s.decode().split(";")]
        if f is None:
            assert not found
            none += 1
        elif f:
            assert [int(x) for g in ids for x in g.split("|")[0].split(",")] == [i for i, *_ in f[0]]
            assert [int(x) for g in ids for x in g.split("|")[1].split(",")] == [i for i, *_ in f[1]]
    assert none > 20


def test_random_and_odd_rows(spark, tokenizers, no_docs):
    rng = random.Random(6)
    texts = [None, "", " ", "▁", "a ", " a", "word " * 300, *["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(150)]]
    rows = [(None if k % 50 == 3 else (1 << 62) + k // 2, t, 1, 2, "x", 3) for k, t in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, n_a int, key string, chunk int")
    check(docs.repartition(3), tokenizers)
    assert alignment.align(no_docs, A, B).count() == 0


def test_given_table(spark, tokenizers):
    check(table(spark, SMALL, "documents").where("length(text) < 2500").repartition(4), tokenizers)


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "a long text of words that goes on, " * 60_000), (2, "日本語" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert got[1].n_groups > 500_000 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values())


def test_chunks_do_not_change_results(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    want = sorted(alignment.align(docs, A, B).collect())
    monkeypatch.setattr(alignment, "CHUNK", 3000)
    assert sum(1 for _ in alignment._chunks(["x" * 2000] * 4)) == 4
    assert sorted(alignment.align(docs.repartition(7), A, B).collect()) == want


def test_document_weights(spark):
    docs = spark.createDataFrame([(1, "cat cat cat"), (2, "cat")], "doc_id long, text string")
    links = alignment.expanded(alignment.interned(docs, A, B), A, B)
    by = {w: [r["count"] for r in alignment.pair_counts(links, w).collect()] for w in ("freq", "docs")}
    assert by == {"freq": [4], "docs": [2]}


def test_workers_hold_little():
    import public_tokenizers

    both = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    words = [f"w{i:x}" for i in range(130_000)]
    sizes = []
    split, learn = both.split, both.learn
    both.split = lambda t: sizes.append(len(t)) or split(t)
    both.learn = lambda segments: sizes.append(0) or learn(segments)  # after each run of texts
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    assert [b";".join(x) for x in both.texts(texts)][:2] == [b";".join(learn(split(t))) for t in texts[:2]]
    runs = "".join("|" if not s else "t" for s in sizes).split("|")
    assert len(runs) > 2 and max(len(r) for r in runs) * 7_000 <= 2 * alignment.SPLIT
    both.rest()
    assert len(both.memo) > alignment.KEPT  # a task that learnt much leaves it to the next one
    list(both.texts(["a few words"]))
    both.rest()
    assert len(both.memo) == alignment.KEPT // 2

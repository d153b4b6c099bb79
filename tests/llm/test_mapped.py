"""Byte-level BPE, media columns, packing, fingerprints."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from vellum.llm import bpe, mpeg_audio, packing, winnow
from vellum.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")


def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_on_random_strings():
    enc, c, rng = reference_encoding(), bpe.codec(RANKS, P.PATTERN), random.Random(7)
    parts = ["a", "b", " ", "\n", "\t", "\x1c", "é", "'s", "'ll", "1", "２", "!", "日", "🎉", "​", "the", "  ", "\x85", "\r\n", "　", "x" * 30, "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(c.encode(s), "<u4").tolist() == enc.encode_ordinary(s), repr(s)
    for _ in range(1000):
        s = bytes(rng.choices(range(97, 123), k=rng.randint(1, 40))).decode()
        assert np.frombuffer(c.encode(s), "<u4").tolist() == enc.encode_ordinary(s), repr(s)


def test_bpe_long_piece_is_linear():
    enc, c = reference_encoding(), bpe.codec(RANKS, P.PATTERN)
    s = "a" * 100_000 + "ab" * 20_000
    assert np.frombuffer(c.encode(s), "<u4").tolist() == enc.encode_ordinary(s)


def test_bpe_query(spark, odd_docs, no_docs):
    enc = reference_encoding()
    for docs in (odd_docs, table(spark, SMALL, "documents")):
        got = {r.doc_id: r for r in bpe.bpe_digest(docs, RANKS, P.PATTERN).collect()}
        want = docs.select("doc_id", "text").collect()
        assert len(got) == len(want)
        for r in want:
            ids = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
            g = got[r.doc_id]
            assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.bpe_digest(no_docs, RANKS, P.PATTERN).count() == 0


def test_crc16_and_headers():
    assert mpeg_audio.header(b"\xff\xfb\x90\x00").size == 417  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
    assert mpeg_audio.header(b"\xff\xfb\x92\x00").size == 418
    assert mpeg_audio.header(b"\xff\xfb\xf0\x00") is None
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_mpeg_round_trip_with_false_syncs_and_junk():
    head = mpeg_audio._HEAD
    for raw in (b"", b"x", head * 5000, bytes(range(256)) * 40):
        payload = mpeg_audio.padded(raw)
        media = mpeg_audio.pack(payload)
        s = mpeg_audio.read(media)
        assert mpeg_audio.unpack(media, s) == payload and s.crc_bad == 0 and s.skipped == 0
        assert (s.table, s.table_frames) == ("Xing", len(payload) // 576) and s.samples == len(payload)
        assert s.duration_us == len(payload) * 1_000_000 // 16000
    media = mpeg_audio.pack(mpeg_audio.padded(b"hello"))
    tag = 10 + media[9]
    broken = media[:tag] + b"\xff\xf2junk\xff" + media[tag:]
    s = mpeg_audio.read(broken)
    assert s.skipped == 7 and len(s.offsets) == 1
    flipped = bytearray(media)
    flipped[s.offsets[0] - 7 + 5] ^= 1
    assert mpeg_audio.read(bytes(flipped)).crc_bad == 1


def test_media_query(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in mpeg_audio.media_digest(odd_docs).collect()}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload, g = mpeg_audio.padded(raw), got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature
    assert mpeg_audio.media_digest(no_docs).count() == 0
    stored = mpeg_audio.media_store(odd_docs)
    index = {r.doc_id: r for r in mpeg_audio.media_index(stored).collect()}
    assert index[4].samples == got[4].payload_bytes and len(index[4].seek_offsets) == index[4].frames


def test_fill_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fill(counts, room)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in got.items())


def test_plan_uses_every_piece():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 100) for _ in range(3000))
    used, windows = Counter(), 0
    for times, window in packing.plan(dict(counts), 100):
        assert sum(x * n for x, n in window.items()) <= 100
        windows += times
        for x, n in window.items():
            used[x] += n * times
    assert used == counts
    assert windows <= 1.01 * sum(x * n for x, n in counts.items()) / 100 + 1


@pytest.mark.parametrize("which", ["odd", "small"])
def test_pack(spark, odd_docs, which):
    from tokenizers import Tokenizer

    docs = odd_docs if which == "odd" else table(spark, SMALL, "documents")
    tok = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for d in docs.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= total // 2048 + 2


def test_pack_empty(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0


def brute_winnow(text, k, w):
    """Positions chosen, by the definition, from the hashes that ``winnow`` gives each gram."""
    if len(text) < k:
        return [0] if text else []
    hashes = [int(winnow.winnow(text[i : i + k], k, 1)[0, 0]) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1] != at:
            out.append(at)
    return out


def test_winnow_by_definition():
    rng = random.Random(11)
    for _ in range(60):
        text = "".join(rng.choices("ab é日", k=rng.randint(0, 150)))
        got = winnow.winnow(text, 8, 13)[:, 1].tolist()
        assert got == brute_winnow(text, 8, 13)


def test_winnow_guarantee():
    rng = random.Random(2)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = make(winnow.GRAM + winnow.WINDOW - 1)
    for _ in range(20):
        a, b = (winnow.winnow(make(300) + shared + make(300)) for _ in range(2))
        assert set(a[:, 0]) & set(b[:, 0])


def test_short_texts_share_hashes_with_their_edited_ones(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=42 + i % 300))) for i in range(600)]
    got = winnow.edited_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600 and all(r.near_edited > 0 for r in got)


def test_edited_digest(spark, odd_docs, no_docs):
    for docs in (odd_docs, table(spark, SMALL, "documents")):
        rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in winnow.edited_digest(docs).collect()}
        assert len(got) == len(rows)
        for j, (i, t) in enumerate(rows):
            after = rows[(j + 1) % len(rows)][1]
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            g = got[i]
            assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert g.fingerprint == winnow.fingerprint(winnow.winnow(t)) and g.edited_fingerprint == winnow.fingerprint(winnow.winnow(edited))
            assert 0 <= g.near_next <= 1 and 0 <= g.near_edited <= 1
    assert winnow.edited_digest(no_docs).count() == 0


def test_edited_digest_over_many_runs(spark):
    docs = spark.range(0, 9000, 3).selectExpr("id * id - 5 AS doc_id", "repeat(concat('text number ', id, ' '), 3) AS text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    runs = winnow.in_runs(docs, "doc_id", "text").groupBy("_run").count().collect()
    assert len(runs) > 20 and max(r["count"] for r in runs) < 3000 / 10
    winnow_rows = {r.doc_id: r.edited_sha256 for r in winnow.edited_digest(docs).collect()}
    for j, (i, t) in enumerate(rows):
        after, q = rows[(j + 1) % len(rows)][1], len(t) // 4
        assert winnow_rows[i] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()


def test_words_are_learnt_in_runs_and_few_stay_after_a_task(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 20)
    monkeypatch.setattr(packing, "RUN", 7)
    words, runs = packing.WordIds(WORDS), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda w: (runs.append(len(w)), learn(w)))
    texts = [" ".join(f"word{i}, and{i}!" for i in range(n)) for n in (0, 3, 40)]
    whole = list(words.encode(texts))
    assert whole == [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert max(runs) == 7 and sum(runs) == 80
    words.rest()  # a task that learnt much leaves all of it
    assert len(words.memo) > 80
    list(words.encode(["and so"]))
    words.rest()
    assert len(words.memo) <= 11 and list(words.encode(texts)) == whole

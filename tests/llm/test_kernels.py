"""Kernels against the libraries, brute force and exact round trips; no tables."""

import hashlib
import random
import subprocess
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomframe.llm import ann, arrowtext, bpe, components, flac, neardup, packing, passages, pii, quality, sharding, tokencount, wordhash

PARTS = ["a", "B", "é", "É", "Σ", "σ", "İ", "ß", " ", "  ", "\n", "\x1c", "\x85", "　", " ", "’", "1", "2", "'s", "'T", "'ll", "!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "日", "👍", "é", "ͅ", "½", "Ⅷ", "the", "ing", "\x00", "$%", "''s"]


def mixed(n: int, most: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(1, most))) for _ in range(n)]


def test_bpe_is_the_library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    mine = bpe.word_bpe(bpe.default_path())
    texts = [*mixed(1500, 40, 1), "", None, "x", "a" * 3000, "ab" * 700 + "!" * 300, "<|endoftext|>"]
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    ids, off = mine.encode(texts)
    text, spans = mine.decode(ids, off)
    raw = text.tobytes()
    for i, w in enumerate(want):
        assert ids[off[i] : off[i + 1]].tolist() == w.ids
        assert raw[spans[i][0] : spans[i][1]].decode() == t.decode(w.ids, skip_special_tokens=False)
    assert mine.encode([])[1].tolist() == [0] and mine.encode([None, ""])[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("n", [40_000, 140_000, 1_000_000])
def test_bpe_of_very_long_words_is_the_library(n):
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    text = "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=n))
    ids, _ = bpe.word_bpe(bpe.default_path()).encode([text])
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def library_ids(texts):
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_every_character_is_the_library():
    mine, points = bpe.word_bpe(bpe.default_path()), [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{chr(p)}a {chr(p)}{chr(p)}! " for p in points[i : i + 64]) for i in range(0, len(points), 64)]
    marks = [p for p in points if unicodedata.combining(chr(p))]
    texts += [f"a{chr(p)}{x}b a{x}{chr(p)}b" for p in marks for x in "\u0316\u0301\u0327\u0345"]
    texts += [unicodedata.normalize("NFD", chr(p)) for p in points if unicodedata.decomposition(chr(p))]
    ids, off = mine.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == library_ids(texts)


def test_bpe_in_pieces_is_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 512)
    mine = bpe.word_bpe(bpe.default_path())
    for text in [" ".join(mixed(900, 20, 7)), "word\n" * 3000, "x" * 5000 + " y" * 900, "\n" * 4000 + "é" * 2000]:
        raw = np.frombuffer(text.encode(), np.uint8)
        parts = list(arrowtext.white_pieces(raw, 512))
        assert b"".join(p.tobytes() for p in parts) == text.encode() and (len(parts) > 3 or "x" not in text)
        want = library_ids([text])[0]
        assert np.concatenate(list(mine.encode_pieces(raw))).tolist() == want
        row = bpe.long_digest(mine, pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])).to_pylist()[0]
        decoded = Tokenizer.from_file(bpe.default_path()).decode(want, skip_special_tokens=False)
        assert row == {"doc_id": 1, "n_tokens": len(want), "ids_sha256": hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}


def test_token_counts_are_the_library(monkeypatch):
    monkeypatch.setattr(tokencount, "BATCH_BYTES", 5000)
    c = tokencount.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*mixed(2000, 40, 2), "", None, "word " * 2000, " lead", "trail ", "a\n\nb \n c\r\nd \t", "\n x", "x\x1c y", "x \x1c y"]
    texts += ["".join(random.Random(i).choices(["日本", "。", "a1", "don't", "'s", "'", "!!", "<|endoftext|>", "é", "½", "x"], k=40_000)) for i in range(3)]
    data, off = arrowtext.string_buffers(pa.array(texts))
    assert c.count(data, off).tolist() == [len(x) for x in c.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@given(st.lists(st.text(max_size=300), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_flac_round_trip(texts):
    payload, off = flac.payloads(*arrowtext.string_buffers(pa.array(texts)))
    streams = flac.encode(payload, off)
    back, at = flac.decode(streams)
    assert (back == payload).all() and (at == off).all()


def test_flac_kinds_seeks_and_errors():
    r = random.Random(3)
    texts = ["", None, "a" * 9024, "é" * 5000, "".join(chr(r.randint(1, 127)) for _ in range(9000)), "".join(chr(33 + int(40 + 40 * np.sin(i / 30))) for i in range(20000))]
    payload, off = flac.payloads(*arrowtext.string_buffers(pa.array(texts)))
    streams = flac.encode(payload, off)
    assert (flac.decode(streams)[0] == payload).all()
    assert len(streams[2]) < 200 and len(streams[5]) < 19000  # constants and predictors are used
    first, block = flac.read_block(streams[5], 9000)
    assert first == 8192 and block == texts[5].encode()[8192 : 8192 + 4096]
    for at in (80, len(streams[5]) // 2, len(streams[5]) - 1):
        bad = bytearray(streams[5])
        bad[at] ^= 4
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bytes(bad)])


def test_crc16_of_odd_and_even():
    data = np.frombuffer(b"\x00123456789", np.uint8)
    assert flac.crc16(data, np.array([1]), np.array([9])).tolist() == [0xFEE8]
    assert flac.crc8(b"123456789") == 0xF4


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit(sizes):
    where, offset = packing.best_fit(np.array(sizes, np.int64), 64)
    for b in set(where.tolist()):
        mine = sorted((offset[i], sizes[i]) for i in np.flatnonzero(where == b))
        at = 0
        for o, s in mine:
            assert o == at
            at += s
        assert at <= 64
    assert len(set(where.tolist())) <= 11 / 9 * -(-sum(sizes) // 64) + 1 or max(sizes, default=0) > 32


def test_hypergeometric_law():
    r, g = random.Random(1), np.random.default_rng(0)
    for a, b, d in ((500, 300, 200), (30, 1000, 100), (1000, 30, 900), (700, 20, 650), (5, 3000, 40)):
        x = np.array([sharding.hypergeometric(r, a, b, d) for _ in range(4000)])
        y = g.hypergeometric(a, b, d, 4000)
        assert abs(x.mean() - y.mean()) < 5 * y.std() / 4000**0.5 + 0.02 and max(0, d - b) <= x.min() and x.max() <= min(a, d)
    m = sharding.communication_matrix([100, 2000, 3, 0, 977], [770, 770, 770, 770], 1)
    assert [sum(x) for x in m] == [100, 2000, 3, 0, 977] and [sum(c) for c in zip(*m, strict=True)] == [770] * 4


def test_words_and_shingles():
    texts = ["One two  three\tfour", "", None, "x", "ONE TWO three four"]
    data, off = arrowtext.string_buffers(pa.array(texts))
    b, e, first = wordhash.words(data, off)
    assert first.tolist() == [0, 4, 4, 4, 5, 9]
    h = wordhash.word_hashes(data, b, e)
    assert h[:4].tolist() == h[5:].tolist()
    s, at = wordhash.shingle_hashes(h, first, 3)
    assert at.tolist() == [0, 2, 2, 2, 3, 5] and s[:2].tolist() == s[3:].tolist()


@pytest.mark.parametrize("step", [1, 2, 7, 64, 5000])
def test_long_texts_have_the_same_shingles(step):
    r = random.Random(step)
    for text in ["", " ", "x", "a b", " a b ", "word" * 900, " ".join("ab"[: r.randint(0, 2)] * r.randint(0, 9) for _ in range(300)), "one two three four " * 9]:
        data, off = arrowtext.string_buffers(pa.array([text]))
        b, e, first = wordhash.words(data, off)
        want = wordhash.word_hashes(data, b, e)
        assert np.concatenate([np.zeros(0, np.uint64), *wordhash.word_stream(data, step)]).tolist() == want.tolist()
        for width in (1, 3, 5):
            assert wordhash.long_shingles(data, width, step).tolist() == np.unique(wordhash.shingle_hashes(want, first, width)[0]).tolist()


@pytest.mark.parametrize("step", [1, 3, 50, 4096])
def test_long_texts_have_the_same_terms(step):
    for text in ["x", "One two two  2!", " ".join(mixed(60, 30, step)), "a" * 500 + " b c" * 200]:
        data, off = arrowtext.string_buffers(pa.array([text]))
        assert (quality.long_term_counts(data, step) == quality.term_counts(data, off)).all()


def test_votes_are_those_of_all_neighbours():
    g = np.random.default_rng(8)
    texts = [" ".join(mixed(30, 12, i)) + " word" * int(g.integers(0, 40)) for i in range(400)]
    terms = quality.term_counts(*arrowtext.string_buffers(pa.array(texts)))
    v = quality.Voters(terms[:300], g.integers(0, 2, 300))
    got, unit = v.score(terms[300:]), v._unit(terms[300:])
    for x, s in zip(unit, got, strict=True):
        cosine = sorted(((float(np.dot(x, y)), int(label)) for y, label in zip(v.vectors, v.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(0.0, min(1.0, c)) ** quality.SHARPNESS for c, _ in cosine]
        assert abs(s - sum(w * label for w, (_, label) in zip(weight, cosine, strict=True)) / sum(weight)) < 1e-3


def test_flac_of_long_texts(monkeypatch):
    monkeypatch.setattr(flac, "LONG_FRAMES", 3)
    r = random.Random(5)
    for text in ["", "a" * 100, "".join(r.choices("abc \n", k=12288)), "".join(r.choices("abcé \n\x00", k=50_001)), "b" * 40_000]:
        raw, off = arrowtext.string_buffers(pa.array([text]))
        payload, at = flac.payloads(raw, off)
        whole = flac.encode(payload, at)[0]
        media, (n, sha, tail, feature) = flac.long_row(raw)
        assert media == whole and n == len(payload) and sha == hashlib.sha256(payload.tobytes()).hexdigest()
        assert tail == zlib.crc32(payload[-64:].tobytes()) and feature == flac.features(payload, at)[0]
        bad = bytearray(media)
        bad[-3] ^= 1
        with pytest.raises((flac.FlacError, IndexError)):
            list(flac.decode_long(bytes(bad)))


@pytest.mark.parametrize("kernel", ["flac", "terms", "shingles", "bpe"])
def test_a_text_of_50_mb_in_bounded_memory(kernel):
    code = {
        "flac": "from loomframe.llm import flac; flac.long_row(raw)",
        "terms": "from loomframe.llm import quality; quality.term_counts(raw, np.array([0, len(raw)]))",
        "shingles": "from loomframe.llm import wordhash; wordhash.long_shingles(raw, 5)",
        "bpe": "from loomframe.llm import bpe; sum(map(len, bpe.word_bpe(bpe.default_path()).encode_pieces(raw)))",
    }[kernel]
    head = "import resource, numpy as np; g = np.random.default_rng(1); w = np.array([b'word%d ' % i for i in range(5000)]); raw = np.frombuffer(b''.join(w[g.integers(0, 5000, 6_000_000)]), np.uint8); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
    out = subprocess.run([sys.executable, "-c", f"{head}{code}; print(len(raw) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)"], capture_output=True, text=True, check=True, timeout=600, cwd=Path(__file__).resolve().parents[2])
    size, more = map(int, out.stdout.split())
    assert size >= 40 and more < 600, (size, more)


def test_local_roots():
    nodes, roots = components.local_roots(np.array([5, 3, 9, 2]), np.array([3, 1, 8, 2]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {1: 1, 2: 2, 3: 1, 5: 1, 8: 8, 9: 8}


def test_prefixes_of_similar_sets_meet():
    g = np.random.default_rng(2)
    frequent = np.zeros(0, [("hash", np.uint64), ("rank", np.uint64)])
    for _ in range(200):
        a = np.unique(g.integers(0, 2**63, g.integers(2, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([g.permutation(a)[: max(1, int(len(a) * 0.93))], g.integers(0, 2**63, 2).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(neardup.prefix(a, frequent, 80), neardup.prefix(b, frequent, 80)))


def test_chains_and_alignment():
    assert passages.chains([(0, 100), (10, 110), (20, 120), (5, 3)])[0] == [(0, 100), (10, 110), (20, 120)]
    a = np.arange(200)
    b = np.concatenate([np.arange(1000, 1030), np.arange(40, 140), np.arange(2000, 2020)])
    b[80] = -1
    p, q, s, t, same = passages.align([(50, 40), (120, 110)], a, b)
    assert (p, q, s, t) == (40, 140, 30, 130) and same == 99


def test_routed_bitmaps_are_short_and_tell_sets_apart():
    g = np.random.default_rng(6)
    for n in (600, 1000, 4000):
        base = np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
        near, far = np.unique(np.concatenate([base[n // 20 :], base[: n // 50] + np.uint64(1)])), np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
        bits = neardup.bitmap(base, neardup.route_width(n, 90))
        assert bits.nbytes * 8 < 2 * n  # one bit a shingle, up to the next power of two
        assert neardup.route_width(n, 80) >= 3 * n
        sets = neardup.Signatures(np.array([len(s) for s in (base, near, far)]), np.stack([neardup.bitmap(s, len(bits) * 64) for s in (base, near, far)]), 90)
        shared = len(np.intersect1d(base, near))
        assert 100 * shared >= 90 * (len(base) + len(near) - shared)  # linked
        assert sets.possible(np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


@pytest.mark.parametrize("long", [60, 200])
@pytest.mark.parametrize("gap", [20, 31, 60, 100, 170, 350, 600])
def test_passages_around_a_gap_are_kept(long, gap):
    g = np.random.default_rng(gap)
    first, second, third = (g.integers(1 << 40, size=long) for _ in range(3))
    fresh = lambda: g.integers(1 << 40, size=gap)
    for pieces, more in (((first, second), 0), ((first, second, third), 0), ((first, second), gap)):
        a, b, seeds, held = [], [], [], []
        for p in pieces:
            if a:
                a.append(fresh())
                b.append(fresh()[: gap - more])  # none: put into one side only
            at, there = sum(map(len, a)), sum(map(len, b))
            seeds += [(at + k, there + k) for k in range(0, long - passages.SEED + 1, 5)]
            held.append((at, at + long))
            a.append(p)
            b.append(p)
        a, b = np.concatenate(a), np.concatenate(b)
        found = [f for c in passages.chains(seeds) for f in passages.parts(c, a, b)]
        covered = np.zeros(len(a), bool)
        for p, q, s, t, same in found:
            assert q - p >= passages.MIN_WORDS and same >= passages.IDENTITY * max(q - p, t - s)
            covered[p:q] = True
        assert all(covered[p:q].all() for p, q in held)


@pytest.mark.parametrize("kind", ["replaced", "left out", "both"])
def test_words_around_a_seed_allow_every_passage(kind):
    g = np.random.default_rng(6)
    reach = 2 * passages.MIN_WORDS - 4
    near = np.zeros((400, passages.SEED + 2 * reach), np.uint16)
    for k in range(0, len(near), 2):  # a passage of 50 to 99 words, of which 80 % agree, around a seed anywhere in it
        n = int(g.integers(50, 100))
        at = int(g.integers(0, n - passages.SEED + 1))
        mine = g.integers(2, 65536, n).astype(np.uint16)
        free = np.setdiff1d(np.arange(n), np.arange(at, at + passages.SEED))
        off = g.choice(free, n - -(-8 * n // 10), replace=False)
        theirs, spot = mine.copy(), at
        if kind == "replaced":
            theirs[off] = g.integers(2, 65536, len(off))
        else:
            theirs, spot = np.delete(theirs, off), at - int((off < at).sum())
        if kind == "both":  # and as many words put in elsewhere
            put = g.choice(np.setdiff1d(np.arange(len(theirs) + 1), np.arange(spot, spot + passages.SEED + 1)), len(off))
            theirs, spot = np.insert(theirs, put, g.integers(2, 65536, len(put))), spot + int((put <= spot).sum())
        for row, text, place in ((k, mine, at), (k + 1, theirs, spot)):
            near[row, reach - place : reach - place + len(text)] = text
    mine, yours = np.arange(0, len(near), 2), np.arange(1, len(near), 2)
    assert passages.dense(near[mine], near[yours]).all() and not passages.dense(near[mine], near[np.roll(yours, 1)]).any()
    pairs = {(int(i), int(j)) for a, b in passages.in_common(near, mine, yours) for i, j in zip(a, b, strict=True)}
    assert pairs >= set(zip(mine.tolist(), yours.tolist(), strict=True)) and len(pairs) < 2 * len(mine)


def test_minimizers_are_shared():
    g = np.random.default_rng(4)
    run = g.integers(0, 2**63, passages.WINDOW).astype(np.uint64)
    x, y = np.concatenate([g.integers(0, 2**63, 9).astype(np.uint64), run]), np.concatenate([run, g.integers(0, 2**63, 7).astype(np.uint64)])
    hashes, off = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
    pick = passages.minimizers(hashes, off)
    assert set(hashes[pick[pick < len(x)]]) & set(hashes[pick[pick >= len(x)]])


def test_graph_recall():
    g = np.random.default_rng(5)
    x = ann._unit(g.normal(size=(1500, 32)))
    graph = ann.Graph(x)
    found, _ = graph.search(x[:100].astype(np.float32), 64)
    truth = np.argsort(-(x[:100] @ x.T), 1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, truth, strict=True)]) > 0.9
    one = ann.Graph(x[:1])
    assert one.search(x[:1].astype(np.float32), 5)[0].tolist() == [[0]]


def test_voters_without_labels():
    v = quality.Voters(np.zeros((0, quality.TERMS), np.float32), np.zeros(0))
    assert v.score(quality.term_counts(*arrowtext.string_buffers(pa.array(["x", ""])))).tolist() == [0.5, 0.5]


def test_boosted_trees_learn():
    g = np.random.default_rng(6)
    x = g.normal(size=(600, 4))
    y = ((x[:, 1] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    score = sum(pii.apply_tree(t, x) for t in pii.fit_trees(x, y, trees=40))
    assert ((score > 0) == (y == 1)).mean() > 0.95
    a, _ = pii.calibrate(score, y)
    assert a > 0


def test_checksum_of_unsigned_ids():
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["hello world"])], ["doc_id", "text"])
    got = packing.token_pieces(batch, bpe.default_path(), 4096, 1, True).column(1)[0].values[0].as_py()
    assert got["ids"][-1] == 1 and got["ids_crc32"] == zlib.crc32(np.array(got["ids"], "<u4").tobytes())

"""Kernels without Spark, against brute force or the library."""

import random
import unicodedata  # noqa: F401

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswright.llm import ann_forest, golay_simhash, line_crf, string_kernel, toxicity
from glosswright.llm._shared import local_components
from glosswright.llm.bpe import vocabulary
from glosswright.llm.byte_windows import BASE_A, anchors, gram_hashes, sliding_min
from glosswright.llm.language_id import LanguageModel, has_letter
from glosswright.llm.token_counts import counter


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


ODD = "aAbBzZ '’\t\n\r\x0b\x1c\x85\xa0 　éÉßΣσςİı½²٣0129.,!?<|>_-́̈한글漢字😀👍🏽‍﻿$€ſKÅ\x00\x01"
TEXTS = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "don't I'LL we've", "a" * 3000, "hahahaha " * 50, "ΑΣ ΣΑΣ", "  x   y  ", "x  \n  y"]


@given(st.lists(st.text(alphabet=ODD, max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_library(texts):
    from tokenizers import Tokenizer

    v, tok = vocabulary(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    for text, ids in zip(texts + TEXTS, v.encode_batch(texts + TEXTS)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert v.decode(ids) == tok.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(alphabet=ODD, max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_counts_equal_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    every = texts + TEXTS
    assert counter(path("byte_bpe_50k.json"))(every) == [len(tok.encode(x, add_special_tokens=False).ids) for x in every]


def test_counts_of_mixed_white_space():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["word \xa0 \xa0 \xa0 \xa0 word", "a \xa0 \xa0 \xa0b", "a\n b", "a \n \n b", "a\t \t c", "x \u3000 \u3000 y  z"]
    assert counter(path("byte_bpe_50k.json"))(texts) == [len(tok.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts_of_piece_model():
    import sentencepiece

    p = path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=p)
    assert counter(p)(["some text", "", None]) == [len(sp.encode("some text")), 0, 0]


def test_memo_may_overflow(monkeypatch):
    from glosswright.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 50)
    v = bpe.Vocabulary(path("word_bpe_49k.json"))
    words = [f"w{k} and<|endoftext|>" for k in range(300)]
    assert [x.tolist() for x in v.encode_batch(words)] == [x.tolist() for x in vocabulary(path("word_bpe_49k.json")).encode_batch(words)]


@given(st.binary(max_size=60), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_gram_hashes_tell_grams_apart(data, width):
    x = np.frombuffer(data, np.uint8)
    h = gram_hashes(x, width, BASE_A)
    grams = [data[i : i + width] for i in range(len(data) - width + 1)]
    assert len(h) == len(grams)
    assert all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(i))


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_sliding_min(values, width):
    if width <= len(values):
        x = np.array(values, np.uint64)
        assert sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_runs_cover_every_window_once(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(x) for x in raw])
    _, s, e = anchors(np.frombuffer(b"".join(raw), np.uint8), 20, 8, ends)
    got = sorted(k for a, b in zip(s, e) for k in range(a, b + 1))
    want = [b + k for b, x in zip(ends - [len(x) for x in raw], raw) for k in range(max(0, len(x) - 19))]
    assert got == want


def test_golay_keys_are_exact():
    table = golay_simhash.golay_table()
    assert (np.bincount(table, minlength=4096) == 2048).all()  # perfect: every codeword owns as many words
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    keys = [set() for _ in a]
    for r, k in zip(*golay_simhash.bucket_keys(a)):
        keys[r].add(k)
    met = {r for r, k in zip(*golay_simhash.bucket_keys(b)) if k in keys[r]}
    assert len(met) == len(a)


def test_fingerprint():
    import xxhash

    def slow(text):
        w = [x for x in text.encode().lower().split() if x]
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    for text in ("", " \t ", "One", "one two", "A b C d", "É é x a b c a b c", "a b\x0bc\x1cd e"):
        assert golay_simhash.fingerprint(text) == slow(text), text
    assert golay_simhash.fingerprint(None) == 0


def test_string_kernel_by_brute_force():
    from itertools import combinations

    def phi(w):
        c = string_kernel.codes([w])[len(w)][1][0]
        out = {}
        for n in (2, 3):
            for at in combinations(range(len(w)), n):
                u = tuple(c[list(at)])
                out[u] = out.get(u, 0) + string_kernel.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["ab", "idiot", "idxiot", "banana", "aaaa", "worthless", "x"]
    norms = string_kernel.norms(words)
    sums = string_kernel.sums(words, string_kernel.tables(["idiot", "banana"]))
    for k, w in enumerate(words):
        p = phi(w)
        assert norms[k] == pytest.approx(sum(v * v for v in p.values()) ** 0.5)
        for j, m in enumerate(("idiot", "banana")):
            q = phi(m)
            assert sums[k, j] == pytest.approx(sum(v * q.get(u, 0) for u, v in p.items()) / sum(v * v for v in q.values()) ** 0.5, rel=1e-5)


def _toxic_sample(n=300):
    rng = random.Random(2)
    syl = ["ta", "re", "mi", "no", "lu", "ke", "son", "ber", "al"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(25)]
        if k % 3 == 0:
            words[rng.randrange(25)] = rng.choice(["idiot", "moron", "scum"])
        rows.append((int(k % 3 == 0), " ".join(words)))
    return pd.DataFrame(rows, columns=["label", "text"])


def test_toxicity_learns_words_and_gaps():
    m = toxicity.train(_toxic_sample())
    p = m.probability(m.highest(["ta re idiot mi", "ta re idxiot mi", "you i d i o t ta", "m.o-ron ta", "ta re mi noluke", "", None]))
    assert min(p[0], p[2], p[3]) > 0.5 and p[1] > p[4] and max(p[4:]) < 0.3
    for empty in (pd.DataFrame({"label": [], "text": []}), pd.DataFrame({"label": [0, 0], "text": ["a b", "c d"]})):
        q = toxicity.train(empty)
        assert (q.probability(q.highest(["x", ""])) < 0.01).all()


def _quality_sample(n=120):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(n):
        lines = [" ".join(word() for _ in range(15)) + "." for _ in range(rng.randint(1, 6))]
        if k % 2:
            bad = " | ".join(word() for _ in range(20)) if k % 4 == 1 else " ".join([word()] * 25)
            lines[rng.randrange(len(lines))] = bad
        rows.append((1 - k % 2, "\n".join(lines)))
    return pd.DataFrame(rows, columns=["label", "text"])


def test_line_field_learns_from_text_labels():
    s = _quality_sample()
    m = line_crf.train(s)
    q = m.quality(s["text"].tolist())
    assert ((q >= 0.3) == (s["label"] == 1)).mean() > 0.95
    assert len(m.quality(["", None, "\n\n", "x"])) == 4
    long = m.quality(["a line of words here.\n" * 3000])
    assert 0 <= long[0] <= 1


def test_marginals_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    u, link = rng.normal(size=7), rng.normal(size=(2, 2))
    rows = np.array([[0, 1, 2, 3], [4, 5, 6, -1]])
    bad, pair = line_crf.marginals(u, link, rows)
    total = np.zeros((2, 2))
    for r, line in enumerate(([0, 1, 2, 3], [4, 5, 6])):
        w = {s: np.exp(sum(u[k] * b for k, b in zip(line, s)) + sum(link[a, b] for a, b in zip(s, s[1:]))) for s in product((0, 1), repeat=len(line))}
        z = sum(w.values())
        for k in range(len(line)):
            assert bad[r, k] == pytest.approx(sum(v for s, v in w.items() if s[k]) / z)
        for s, v in w.items():
            for a, b in zip(s, s[1:]):
                total[a, b] += v / z
    assert pair == pytest.approx(total)


def test_languages():
    s = pd.DataFrame({"label": ["en"] * 3 + ["de"] * 3, "text": ["the cat and the dog", "of the and", "this is that", "der hund und die katze", "und der die", "das ist nicht"]})
    m = LanguageModel.fit(s)
    p = m.scores(["the dog and that", "die katze und der hund"])
    assert [m.langs[k] for k in p.argmax(1)] == ["en", "de"] and np.allclose(p.sum(1), 1)
    one = np.vstack([m.scores([t]) for t in ("the dog and that", "die katze und der hund")])
    assert np.allclose(p, one)  # a batch's texts don't reach into each other
    assert not has_letter("12 !?") and not has_letter(None) and has_letter("1ö")


@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=20))
@settings(max_examples=100, deadline=None)
def test_local_components(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = local_components(n, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
    assert got.tolist() == root


def test_forest_leaves_part_all_points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    x[:100] = x[0]
    t = ann_forest.grow(x, 1, leaf=20)
    leaf = t.leaves(x)
    assert leaf.min() == 0 and len(set(leaf[:100])) == 1
    sizes = [np.bincount(leaf)]
    assert sum(sizes[0][k] for _, k in ann_forest.walk([t], sizes, x[3], 1e9)) == 500
    for few in (x[:0], x[:1], x[:2]):
        assert len(ann_forest.grow(few, 1).leaves(x)) == 500

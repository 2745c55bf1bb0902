"""Sampled segmentations against enumeration of small lattices, exact decoding, and independence from batches."""

import itertools
import math

import numpy as np
import public_tokenizers
import pytest

from changelake.llm import subword

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return subword.Lattices(PATH)


def enumerate_all(vocabulary, text, alpha=1.0):
    """All segmentations of a text with their probabilities, by plain recursion over the model's pieces."""
    p = vocabulary.processor
    ids = {p.id_to_piece(i): i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    flat = ("▁" + text.replace(" ", "▁")) if text else ""

    def run(i):
        if i == len(flat):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(flat) + 1):
            if flat[i:j] in ids:
                s = vocabulary.score[ids[flat[i:j]]]
                out += [((ids[flat[i:j]], *t), s + v) for t, v in run(j)]
        if flat[i] not in ids:
            raw = [p.piece_to_id(f"<0x{b:02X}>") for b in flat[i].encode()]
            out += [((*raw, *t), len(raw) * vocabulary.low + v) for t, v in run(i + 1)]
        return out

    found = run(0)
    total = math.log(sum(math.exp(alpha * s) for _, s in found))
    return {t: alpha * s - total for t, s in found}


def test_probabilities_and_order(lattice):
    for text in ["hello", "a b", " two  words", "naïve\n", "日本語 ok", "x\U0001f600y"]:
        want = enumerate_all(lattice.vocabulary, text)
        for key in range(20):
            rows = subword.sample(lattice, [text], np.array([key], dtype=np.uint64), 4)[0]
            assert len(rows) == min(4, len(want)) and len({tuple(r[0]) for r in rows}) == len(rows)
            for ids, logp, value, inclusion in rows:
                assert math.isclose(want[tuple(ids.tolist())], logp, abs_tol=1e-5)
                assert 0 < inclusion <= 1
                assert lattice.vocabulary.decode(ids.tolist()) == text
            assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)


def test_all_segmentations_come_out_if_asked(lattice):
    want = enumerate_all(lattice.vocabulary, "the cat")
    rows = subword.sample(lattice, ["the cat"], np.array([5], dtype=np.uint64), len(want) + 10)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(want) and all(r[3] == 1 for r in rows)


def test_frequencies(lattice):
    """First samples follow the distribution; pairs follow sampling without replacement; inclusion scores are unbiased."""
    flat = subword.Lattices(PATH, alpha=0.25)
    want = enumerate_all(flat.vocabulary, "ab c", 0.25)
    n = 20_000
    found = subword.sample(flat, ["ab c"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), 2)
    first, pairs, weight = {}, {}, {}
    for rows in found:
        a, b = (tuple(r[0].tolist()) for r in rows)
        first[a] = first.get(a, 0) + 1
        pairs[a, b] = pairs.get((a, b), 0) + 1
        for r in rows:
            weight[tuple(r[0].tolist())] = weight.get(tuple(r[0].tolist()), 0) + math.exp(r[1]) / r[3]
    for t, p in want.items():
        p = math.exp(p)
        assert abs(first.get(t, 0) / n - p) < 5 * math.sqrt(p / n) + 1e-4
    for a, b in itertools.permutations(want, 2):
        p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
        assert abs(pairs.get((a, b), 0) / n - p) < 5 * math.sqrt(p / n) + 1e-4
    for t, p in want.items():
        assert abs(weight.get(t, 0) / n - math.exp(p)) < 0.05


def test_long_texts_and_independence_of_batches(lattice, monkeypatch):
    texts = ["", "one two three " * 300, "x" * 3000, "ünïcode 中文 \U0001f600 " * 50, "a"]
    keys = np.arange(5, dtype=np.uint64)
    together = subword.sample(lattice, texts, keys, 3)
    monkeypatch.setattr(subword, "KEPT", 100)
    small = subword.Lattices(PATH)
    for i, t in enumerate(texts):
        alone = subword.sample(small, [t], keys[i : i + 1], 3)[0]
        assert [(a[0].tolist(), a[2]) for a in alone] == [(a[0].tolist(), a[2]) for a in together[i]]
        assert all(lattice.vocabulary.decode(a[0].tolist()) == t == lattice.vocabulary.processor.decode(a[0].tolist()) for a in alone)
    assert [x[0].tolist() for x in together[0]] == [[]] and len(together[1]) == 3


def test_words_of_one_hash(monkeypatch):
    """A polynomial modulo 2^64 takes these two words for one, whatever its base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts = [word, word.translate({97: "b", 98: "a"}), "c"]
    for kept in (subword.KEPT, 100):
        monkeypatch.setattr(subword, "KEPT", kept)
        own = subword.Lattices(PATH)
        for some in ([0], [1], [0, 1, 2], [1, 0]):
            rows = subword.sample(own, [texts[i] for i in some], np.array(some, dtype=np.uint64), 2)
            assert [own.vocabulary.decode(r[0][0].tolist()) for r in rows] == [texts[i] for i in some]


def test_rare_pieces_can_be_drawn(lattice):
    """Noise has 53 bits, so cumulative probabilities are kept with as many."""
    assert lattice.upto.dtype == np.float64
    row = lattice.rows(subword._points("▁antidisestablishmentarianism"), np.array([0]), np.array([29]))
    root = lattice.root[row[0]]
    a, b = lattice.first[root], lattice.first[root + 1]
    assert (np.diff(lattice.upto[a : b - 1]) > 0).all()


def test_columns(spark):
    rows = [(1, "some text", "clash", "x"), (1, "some text", "clash", "x"), (2, None, "", ""), (None, "no id", "", ""), (None, "no id", "", ""), (3, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, sample string")
    got = subword.decode(subword.encode(docs, PATH, k=3), PATH).collect()
    for i, t in [(1, "some text"), (2, ""), (None, "no id"), (3, "")]:
        mine = [r for r in got if r.doc_id == i]
        assert {r.text for r in mine} == {t}
        assert len({tuple(r.ids) for r in mine}) == (3 if t else 1)
        assert len(mine) == sum(x[0] == i for x in rows) * (3 if t else 1)
    assert subword.encode(docs.limit(0), PATH).count() == 0

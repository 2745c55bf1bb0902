"""Covering LSH against brute force, and the defined edge cases."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from changelake.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text):
    words, cur = [], b""
    for byte in (text or "").encode():
        c = bytes([byte + 32 if 65 <= byte <= 90 else byte])
        if c in b" \t\n\x0b\x0c\r":
            words, cur = words + [cur] * bool(cur), b""
        else:
            cur += c
    words += [cur] * bool(cur)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(points):
    """points: (id, fingerprint); the smallest id of each one's component."""
    low = {p: min(i for i, q in points if q == p) for _, p in points}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(low, 2):
            if (a ^ b).bit_count() <= 3 and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: low[p] for i, p in points}


def test_every_close_pair_meets():
    rng = random.Random(1)
    covers = simhash.masks()
    assert len(covers) == 15
    for _ in range(500):
        x, y = rng.getrandbits(64), 0
        y = x
        for i in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << i
        assert any(x & m == y & m for m in covers)


def test_fingerprint():
    for text in ["", " \t\n", "One", "one Two", "a b c", "ÉA b\x0bC d e f E F", "x " * 500, "ab\x85c d e f g h"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("held", [4096, 2])
def test_components(spark, held):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    texts = [None, "", "   ", *base, *base[:4]]
    for b in base[:6]:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(60)] = "zz"
            texts.append(" ".join(w))
    rows = [(i * 3 + 1, t, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "lonely words of nobody", "", "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), held=held).toPandas()
    assert len(found) == len(rows)
    want = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in rows if i is not None])
    known = found.dropna(subset=["doc_id"])
    assert {int(a): int(b) for a, b in zip(known.doc_id, known.component_id)} == want
    assert found[found.doc_id.isna()].component_id.isna().all()


def test_links_of_a_dense_bucket(spark):
    rng = np.random.default_rng(3)
    points = {simhash.signed(int(x) ^ (0xABCD << 40)) for x in rng.integers(0, 1 << 10, 300)}
    frame = spark.createDataFrame(pd.DataFrame({"fp": list(points)}))
    for held in (4096, 20):
        roots = simhash.components(simhash.links(frame, held=held)).toPandas()
        want = brute_components([(p, p) for p in points])
        got = dict(zip(roots.node, roots.root))
        assert all(got.get(p, p) == q for p, q in want.items())


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

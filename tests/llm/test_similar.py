"""Verified groups against brute-force similarities, and the defined edge cases."""

import itertools
import random

import pytest

from changelake.llm import similar

SCHEMA = "doc_id long, text string, node long, key string"


def words_of(t):
    return tuple((t or "").encode().lower().split())


def jaccard(a, b):
    x, y = ({w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in (words_of(a), words_of(b)))
    return len(x & y) / len(x | y)


def brute(rows, least=0.8):
    low = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            if low[i] != low[j] and jaccard(a, b) >= least:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def corpus(seed, bases=20, copies=5, edits=3, n=150):
    rng, out = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(copies):
            w = base[:]
            for _ in range(rng.randint(1, edits)):
                w[rng.randrange(n)] = "new"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("held", [2048, 3])
def test_against_brute_force(spark, held):
    texts = corpus(1) + [None, "", " \n", "a b", "A  b", "one two three four five six", "one two three four five six seven"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(1, texts[0], 1, "x"), (None, "x", 1, "x"), (None, texts[7] + " x", 1, "x"), (None, texts[9], 1, "x")], SCHEMA)
    found = similar.groups(docs, held=held).collect()
    assert sorted((r.component_id or 0, r.first) for r in found if r.doc_id is None) == sorted([(0, True), *((r.component_id, False) for r in found if r.doc_id in (8, 10))])
    assert len(found) == len(rows) + 3 and all(r.first == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    for i in want:  # what is not similar is never joined
        assert want[got[i]] == want[i]
    assert got[len(texts) - 6] == got[len(texts) - 5] == got[len(texts) - 4] and got[len(texts) - 3] == got[len(texts) - 2]


def test_recall_at_the_threshold(spark):
    """Pairs of just over 0.8 similarity alone: 150 words with three edits lose up to 15 of 146 shingles."""
    rng, rows = random.Random(5), []
    while len(rows) < 400:
        a, b = corpus(rng.random(), 1, 1, 4, 160)
        if 0.8 <= jaccard(a, b) < 0.9:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in similar.groups(docs).collect()}
    assert sum(got[i] == i - 1 for i in range(1, 400, 2)) >= 0.9 * 200


@pytest.mark.parametrize("held", [2048, 50])
def test_dense_groups_around_the_threshold(spark, held):
    """Pairs of 0.8 similarity within 19 bits always meet, so their ends are joined whichever pairs of their buckets fail."""
    rng, texts = random.Random(3), []
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    for edits in (3, 4, 5):
        for _ in range(90):
            w = base[:]
            for at in rng.sample(range(300), edits):
                w[at] = f"v{rng.randint(0, 10**9)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in similar.groups(docs, held=held).collect()}
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]  # noqa: B905
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    (batch,) = similar._marks(docs.select("doc_id", similar.text_key().alias("t"), "text").coalesce(1).toArrow().combine_chunks().to_batches(), 5)
    bits = [(a & (1 << 64) - 1) | (b & (1 << 64) - 1) << 64 for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
    near = [(i, j) for i, j in alike if (bits[i] ^ bits[j]).bit_count() < 20]
    assert len(near) > 100 and [p for p in near if got[p[0]] != got[p[1]]] == []
    low = {i: i for i in range(len(texts))}
    for _ in texts:
        before = dict(low)
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    assert all(low[got[i]] == low[i] for i in got)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    a, b = corpus(5, bases=2, copies=0)
    docs = spark.createDataFrame([(1, a, 1, "x"), (1, b, 1, "x"), (1, b, 1, "x"), (2, b + " y", 1, "x"), (3, a, 1, "x")], SCHEMA)
    got = similar.groups(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.first) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_empty(spark):
    assert similar.groups(spark.createDataFrame([], SCHEMA)).count() == 0

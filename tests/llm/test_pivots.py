"""Pivot-permutation index against brute force: links, components, recall, and odd vectors."""

import numpy as np
import pytest

from changelake.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, pivot int"


def brute(rows, threshold=0.9):
    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)

    ids = [r[0] for r in rows]
    unit = [np.array(np.array(r[1], np.float32), float) / np.linalg.norm(np.array(np.array(r[1], np.float32), float)) if good(r[1]) else None for r in rows]
    links = {i: {j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in range(len(rows))}
    low = dict(enumerate(ids))
    for _ in rows:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
        if new == low:
            break
        low = new
    return sorted((ids[i], len(links[i]), low[i], ids[i] == low[i]) for i in low)


def cloud(seed=0, groups=12, each=9, width=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=width)
        out += [c + rng.normal(size=width) * 0.12 for _ in range(each)]
    out += list(rng.normal(size=(60, width)))
    return [[float(x) for x in np.float32(v)] for v in out]


@pytest.mark.parametrize("block", [2048, 5, 1])
def test_against_brute_force(spark, block):
    vectors = cloud()
    rows = [(3 * i + 5, v, 0, "clash", 1) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[4], 0, "copy", 1) for i in range(7)] + [rows[0]]
    rows += [(2000, None, 0, "", 1), (2001, [], 0, "", 1), (2002, [0.0] * 24, 0, "", 1), (2003, [float("nan")] * 24, 0, "", 1), (2004, [1.0] * 23 + [None], 0, "", 1), (2005, [float("inf")] * 24, 0, "", 1)]
    rows += [(2006, [1.0, 2.0], 0, "", 1), (2007, [2.0, 4.0], 0, "", 1), (2008, [-0.0] * 23 + [1.0], 0, "", 1), (2009, [0.0] * 23 + [1e-30], 0, "", 1)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, prefix=8).collect()
    want, found = brute(rows), sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert [x[0] for x in found] == [x[0] for x in want]
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(f[1] for f in found) >= 0.9 * sum(w[1] for w in want)
    same = dict((w[0], w) for w in want)
    for f in found:
        if f[0] >= 1000:
            assert f[1:] == same[f[0]][1:] or f[0] < 2000, (f, same[f[0]])


def test_all_pivots_give_all_links(spark):
    rows = [(i, v, 0, "", 0) for i, v in enumerate(cloud(5))]
    got = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA), prefix=10_000, shared=1).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("cosine", [0.97, 0.92])
def test_recall_in_a_group_of_a_third_of_all_rows(spark, cosine):
    rng = np.random.default_rng(3)
    centre, out = rng.normal(size=64), []
    centre /= np.linalg.norm(centre)
    for _ in range(400):
        off = rng.normal(size=64)
        off -= (off @ centre) * centre
        out.append(centre * np.sqrt(cosine) + off / np.linalg.norm(off) * np.sqrt(1 - cosine))
    out += list(rng.normal(size=(800, 64)))
    rows = [(i, [float(x) for x in np.float32(v)], 0, "", 0) for i, v in enumerate(out)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = np.array([r.n_links for r in pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0


@pytest.mark.parametrize(("cosine", "width"), [(0.85, 64), (0.6, 32)])
def test_vectors_with_a_common_direction(spark, cosine, width):
    """As learned embeddings have: the index keeps its pivots and compares few of all pairs."""
    rng = np.random.default_rng(9)
    centre = np.zeros(width)
    centre[0] = 1
    off = rng.normal(size=(5000, width))
    off[:, 0] = 0
    out = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * pivots.unit(off)
    near = rng.normal(size=(1000, width))
    near = pivots.unit(near - (near * out[:1000]).sum(axis=1, keepdims=True) * out[:1000])
    at = rng.uniform(0.9, 0.96, size=(1000, 1))
    out = np.concatenate([out, at * out[:1000] + np.sqrt(1 - at * at) * near]).astype(np.float32)
    sample = pivots.unit(out.astype(np.float64)[rng.permutation(6000)])
    index = pivots.fit(sample[:900], 300, 0.9, pivots.PREFIX, pivots.SHARED)
    assert len(index.pivots) >= 200 and index.prefix <= 36
    x = pivots.unit(out.astype(np.float64))
    want = (x @ x.T >= 0.9).sum() - len(x)
    rows = [(i, v, 0, "", 0) for i, v in enumerate(out.tolist())]
    got = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)).agg({"n_links": "sum"}).first()[0]
    assert want >= got >= 0.9 * want > 0


def test_null_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0], 0, "", 0), (None, [1.0, 0.01], 0, "", 0), (4, [0.0, 1.0], 0, "", 0)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 1, False), (0, 1, False), (4, 0, True)]
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

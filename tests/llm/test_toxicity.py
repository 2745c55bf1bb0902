"""Learning on planted words, held-out rows, and the edge cases."""

import math
import random
import zlib

import numpy as np

from changelake.llm import toxicity


def corpus(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr".split()) + str(rng.randint(0, 50)) for _ in range(60)]
        bad = rng.random() < 0.3
        for _ in range(3 * bad):
            words[rng.randrange(60)] = rng.choice(["trashy", "ÉVIL", "vile"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_features_match_a_plain_count():
    from changelake.llm.words import Words

    texts = ["The cat, the CAT!", "", "one", "é-ü a"]
    at, slot = toxicity.features(texts)
    words = [4, 0, 1, 3]
    assert np.bincount(at, minlength=4).tolist() == [sum(max(0, w - k) for k in (0, 1, 2)) for w in words]
    a, b = Words([b"abc x"]), Words([b"zz", b"x", b"abc"])
    assert set(a.hash) <= set(b.hash) and slot.max() < toxicity.BIAS


def plain_fit(examples, labels, epochs):
    """Follow the regularised leader over dicts, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        x = z.get(i, 0.0)
        if abs(x) <= toxicity.L1:
            return 0.0
        return -(x - math.copysign(toxicity.L1, x)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for slots, y in zip(examples, labels):
            own = [*slots, toxicity.BIAS]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_fit_against_plain_dicts():
    rng = random.Random(4)
    examples, labels = [], []
    for _ in range(400):
        y = rng.random() < 0.4
        slots = {rng.randrange(200) for _ in range(12)} | ({900, 901} if y and rng.random() < 0.9 else set()) | ({950} if not y else set())
        examples.append(np.array(sorted(slots)))
        labels.append(int(y))
    slots, weights = toxicity.fit(examples, labels, 5)
    want = plain_fit([e.tolist() for e in examples], labels, 5)
    assert {900, 901, 950} <= set(want) and len(want) < 150
    assert slots.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)], rtol=1e-9)


def test_scores_against_plain_sums(spark):
    """Every distinct feature of a whole text counts once; columns of the scores' names are replaced."""
    texts = ["trashy lorem vile ipsum", "", None, "dolor " * 50_000 + "trashy", "TRASHY trashy trashy"]
    rows = [(i, t, 7.5, "clash") for i, t in enumerate(texts)] * 2
    model = np.array([*range(0, toxicity.BIAS, 3), toxicity.BIAS]), np.array([((i * 2654435761) % 1000 - 500) / 700 for i in range(0, toxicity.BIAS, 3)] + [-0.4])
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string"), model).collect()
    assert len(got) == 10 and got[0].__fields__ == ["doc_id", "text", "score", "predicted"]
    for r in got:
        slots = set(toxicity.features([r.text or ""])[1].tolist())
        total = sum(weights.get(i, 0.0) for i in slots) + weights[toxicity.BIAS]
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9) and r.predicted == int(r.score >= 0.7)


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (10_000, "", "x"), rows[0]], "doc_id long, text string, score2 string")
    schema = "doc_id long, quality int, toxic int"
    model = toxicity.train(docs, spark.createDataFrame(flipped, schema))
    again = toxicity.train(docs, spark.createDataFrame([*labels, labels[0], (None, 0, 1), (3, 0, None)], schema))
    assert model[0].tolist() == again[0].tolist() and np.allclose(model[1], again[1])
    got = toxicity.score(docs, model).withColumn("out", toxicity.held_out()).toPandas()
    assert len(got) == len(rows) + 3 and got.score.between(0, 1).all() and got.score.notna().all()
    truth = {i: t for i, _, t in labels}
    held = got[got.out & got.doc_id.isin(truth)]
    assert (held.predicted == [truth[int(i)] for i in held.doc_id]).mean() > 0.97
    assert got[got.doc_id.isna()].out.tolist() == [False]
    assert (got.predicted == (got.score >= 0.7)).all()


def test_sample_is_bounded(spark):
    known = spark.createDataFrame([(i, 0, i % 2) for i in range(30_000)] + [(3, 0, 1)] * 10, "doc_id long, quality int, toxic int")
    want = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30_000))
    assert toxicity.sampled(known, 30_000).count() == want
    assert 850 < toxicity.sampled(known, 1000).count() < 1150
    assert toxicity.sampled(known, 1000).where(toxicity.held_out()).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_large_batch_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(str(rng.randint(0, 99_999)) for _ in range(300)) for _ in range(1500)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([1] * len(texts), pa.int32()), pa.array(texts)], names=["doc_id", "toxic", "text"])
    at, slot = toxicity.features([t or "" for t in texts])
    expected = [np.unique(slot[at == i]).tolist() for i in range(len(texts))]
    del at, slot
    tracemalloc.start()
    try:
        ids = [x for made in toxicity._featurise(iter([batch])) for x in made.column(2).to_pylist()]
        # The lists themselves, some 40 bytes for a feature, are not the worker's.
        peak = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert ids == expected
    assert peak < 15e6, peak

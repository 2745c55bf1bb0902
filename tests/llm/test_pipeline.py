"""The pipeline's stages against brute-force versions, and its effects on planted cases."""

import hashlib
import random

import pytest
from test_linededup import brute as brute_lines
from test_similar import brute as brute_groups

import corpus_pipeline
from changelake.llm import packing, pii, toxicity
from changelake.llm.queries import vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(12), tmp_path_factory.mktemp("corpus")
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elitr"]) + str(rng.randint(0, 99))
    lines = lambda n: "\n".join(" ".join(word() for _ in range(rng.randint(5, 25))) for _ in range(n))
    texts, toxic = [], []
    for i in range(240):
        t = lines(rng.randint(1, 6))
        bad = i % 4 == 0
        if bad:
            t += " trashy scummy trashy"
        texts.append(t)
        toxic.append(int(bad))
    passage = lines(4)
    for i in (21, 33, 45):
        texts[i] += "\n" + passage
        toxic[i] = 0
    texts += [texts[1], texts[2], texts[3] + " extra", None, "", "mail jo@mail1.example.com or +1 (988) 555-2485 " + lines(1)]
    toxic += [toxic[1], toxic[2], toxic[3], 0, 0, 0]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id " + texts[5], "en", "s", 1)]
    rows += [(i, t, "en", "s", 1) for i in (7, None) for t in (lines(1), "completely different " + lines(1))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    key = lambda x: (str(x[0]), str(x[1]))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
        out = stage(spark, docs, folder)
        assert number == 4 or out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "packing":
            ids = packing.Tokens(vocabulary("word_bpe_49k.json")).encode([t or "" for _, t in before])
            assert out.count() == sum(-(-(len(x) + 1) // packing.ROOM) for x in ids)
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
            break
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
        if name == "toxicity":
            weights = dict(zip(model[0].tolist(), model[1].tolist()))
            want = []
            for i, t in before:
                _, slots = toxicity.features([t or ""])
                total = sum(weights.get(s, 0) for s in set(slots.tolist())) + weights.get(toxicity.BIAS, 0)
                want += [(i, t)] * (total < 0.8472978603872034)  # the logit of 0.7
            assert 0 < len(want) < len(before)
        elif name == "line_dedup":
            want = [(i, t) for i, t, n in brute_lines(before) if not n or t.strip()]
            assert sum(n > 0 for *_, n in brute_lines(before)) >= 2
        elif name == "simhash":
            # Distinct rows by id, those without one last.
            known = sorted(set(before), key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256((d[1] or "").encode()).digest()))
            low = brute_groups([(n, t) for n, (_, t) in enumerate(known)])
            want = [d for n, d in enumerate(known) if low[n] == n]
            assert len([d for d in want if d[0] == 7]) == 3 and len([d for d in want if d[0] is None]) >= 2
            assert len(want) < len(before)
        else:
            want = [(i, pii.masked(t, pii.all_spans(t, pii.model())) if t is not None else None) for i, t in before]
            assert any("[EMAIL]" in (t or "") and "[PHONE]" in t for _, t in want)
        assert got == sorted(want, key=key), name
        assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect()) or name == "toxicity" or name == "simhash"
        docs = out


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= packing.ROOM).all() and len(got) > 50


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_any_columns(spark, tmp_path, empty):
    schema = "doc_id long, text string, score double, predicted int, key string, n_lines int, removed_lines int, id long, h long, fp long, component_id long, row long, word string, bits long"
    rows = [] if empty else [(i, t, 0.5, 1, "k", 1, 1, 1, 1, 1, 1, 1, "w", 1) for i, t in [(1, "one two three"), (1, "one two three"), (None, "nobody's"), (2, None), (3, ""), (4, "long " * 40_000), (None, None)]]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept = sorted((r.doc_id or 0) for r in docs.collect())
        # Equal rows are near copies of one another; texts without words are as well, and ids come before none.
        want = {"simhash": [0, 1, 2, 4], "pii": [0, 1, 2, 4]}.get(name, [0, 0, 1, 1, 2, 3, 4])
        if name != "packing":
            assert kept == ([] if empty else want), name


def test_exact_copies_of_several_lines_leave_one_document(spark, tmp_path):
    rng = random.Random(23)
    texts = ["\n".join(" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, top))) for _ in range(rng.randint(2, 7))) for top in (4, 12, 30, 60) for _ in range(15)]
    rows = [(i, texts[i % 60] + "\n" * (i >= 120 and i % 60 >= 45), 0) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    corpus_pipeline.dedup_lines(spark, docs, "").write.parquet(f"{tmp_path}/lines")
    docs = spark.read.parquet(f"{tmp_path}/lines")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(i, t) for i, t, _ in rows[:60]]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(60))

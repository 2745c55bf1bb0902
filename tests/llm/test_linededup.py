"""Chunks of lines against a brute-force deduplication, and the properties that the method promises."""

import hashlib
import random
import time

import pytest

from changelake.llm import linededup

SCHEMA = "doc_id long, text string, n_lines string, id string, h int, cuts int"


def brute(rows):
    """Texts by row, from every candidate chunk's bytes over all rows. A row is known by its doc_id, its text and how many such rows come before it."""
    seen, keys, said = {}, [], {}
    for i, t, *_ in rows:
        sum_ = hashlib.sha256((t or "").encode()).digest()[:16]
        said[i, sum_] = said.get((i, sum_), 0) + 1
        keys.append((i is not None, i or 0, sum_, said[i, sum_]))  # nulls first
        lines = (t or "").encode().split(b"\n")
        for a, b, _h in linededup.candidates(lines):
            seen.setdefault(b"\n".join(lines[a:b]), set()).add((*keys[-1], a))
    out = []
    for (i, t, *_), key in zip(rows, keys):
        lines = (t or "").encode().split(b"\n")
        gone = set()
        for a, b, _h in linededup.candidates(lines):
            if min(seen[b"\n".join(lines[a:b])]) != (*key, a):
                gone.update(range(a, b))
        out.append((i, b"\n".join(x for n, x in enumerate(lines) if n not in gone).decode() if t is not None else None, len(gone)))
    return out


def line(rng, n=8):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(rng.randint(0, 99)) for _ in range(n))


def test_chunks_cover_all_lines_and_resist_shifts():
    rng = random.Random(1)
    passage = [line(rng).encode() for _ in range(60)]
    for before in range(4):
        lines = [line(rng).encode() for _ in range(before)] + passage
        parts = linededup.chunks(lines)
        assert [x for a, b in parts for x in lines[a:b]] == lines
        own = {tuple(lines[a:b]) for a, b in parts}
        shared = {tuple(passage[a:b]) for a, b in linededup.chunks(passage)}
        assert len(own & shared) >= len(shared) - 2
    assert linededup.chunks([b"same"] * 1000)[0][1] <= linededup.MOST


@pytest.mark.parametrize("hot", [linededup.HOT, 1, 30])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(4)
    passages = [[line(rng) for _ in range(rng.randint(2, 12))] for _ in range(5)] + [[line(rng, 60)]]
    texts = [None, "", "\n", "\n\n\n", "one line"]
    for _ in range(60):
        lines = [line(rng) for _ in range(rng.randint(0, 6))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(lines))
            lines[at:at] = p
        texts.append("\n".join(lines))
    texts += [texts[10], texts[11], texts[12] + "\n" + texts[12]]
    rows = [(100 - i, t, "clash", "x", i, 1) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (rows[21][0], texts[25], "same id, other text", "", 0, 0)]
    rows += [(None, t, "", "", 0, 0) for t in (texts[30], texts[31], texts[31], texts[31], None, "one line", "one line", line(rng, 70))] * 2
    got = linededup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [f for f in got[0].__fields__] == ["doc_id", "text", "id", "h", "cuts", "n_lines", "removed_lines"]
    order = lambda x: (str(x[0]), str(x[1]), x[2])
    assert sorted(((r.doc_id, r.text, r.removed_lines) for r in got), key=order) == sorted(brute(rows), key=order)
    assert sum(r.removed_lines > 0 for r in got) > 10


def test_rows_of_one_id_lose_what_others_of_it_have(spark):
    rng = random.Random(12)
    passage = "\n".join(line(rng) for _ in range(60))
    rows = [(None, f"{line(rng)} {n}\n{passage}\n{line(rng)}", "", "", 0, 0) for n in range(3)] + [(7, passage, "", "", 0, 0), (7, passage + "\nmore", "", "", 0, 0)]
    got = linededup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.removed_lines for r in got) == [0, 60, 60, 60, 60]


def test_time_grows_with_the_rows_of_one_id(spark):
    rng = random.Random(13)
    passages = ["\n".join(line(rng) for _ in range(8)) for _ in range(20)]
    texts = [f"{line(rng)}\n{rng.choice(passages)}\n{line(rng)}" for _ in range(4000)]
    seconds = []
    for n in (1000, 4000):
        frame = spark.createDataFrame([(None, t, "", "", 0, 0) for t in texts[:n]], SCHEMA).repartition(4)
        start = time.perf_counter()
        assert linededup.deduplicate(frame).agg({"removed_lines": "sum"}).first()[0] >= (n - 20) * 8
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 4 * seconds[0] + 5


def test_very_long_texts(spark):
    long = "\n".join(f"line {i % 5000} of many words and more of them" for i in range(60_000))
    got = linededup.deduplicate(spark.createDataFrame([(1, long, "", "", 0, 0), (2, "start\n" + long, "", "", 0, 0)], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in got}[2] in ("start", "") and {r.doc_id: r.n_lines - r.removed_lines for r in got}[1] >= 5000


def test_long_passages_stay_once(spark):
    rng = random.Random(8)
    passage = line(rng, 55)
    rows = [(i, "\n".join([line(rng), passage, line(rng)]), "", "", 0, 0) for i in range(20)]
    got = linededup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.doc_id for r in got if passage in r.text] == [0]


def test_empty(spark):
    assert linededup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def repeated(rows, least=50):
    """The lines that stand in runs of `least` words or more whose equal stands at a smaller (doc_id, line), by (doc_id, line), from all pairs of lines."""
    lines = {i: t.split("\n") for i, t in rows}
    places = {}
    for i in sorted(lines):
        for a, x in enumerate(lines[i]):
            places.setdefault(x, []).append((i, a))
    out = set()
    for at in places.values():
        for low in range(len(at)):
            for i, a in at[low + 1 :]:
                j, b = at[low]
                n = 0
                while a + n < len(lines[i]) and b + n < len(lines[j]) and lines[i][a + n] == lines[j][b + n]:
                    n += 1
                if sum(len(x.split()) for x in lines[i][a : a + n]) >= least:
                    out.update((i, a + k) for k in range(n))
    return out


def test_runs_of_short_lines_against_all_pairs_of_lines(spark):
    rng = random.Random(17)
    own = lambda n: [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 30))) for _ in range(n)]
    passages, docs = [own(rng.randint(1, 9)) for _ in range(12)], {}
    for i in range(80):
        lines = own(rng.randint(0, 4))
        for p in rng.sample(passages, rng.randint(0, 3)):
            a, at = rng.randint(0, 2), rng.randint(0, len(lines))
            lines[at:at] = p[a : len(p) - rng.randint(0, 2)]
        docs[i] = lines
    docs[80] = docs[3]
    rows = [(i, "\n".join(lines)) for i, lines in docs.items()]
    want = repeated(rows)
    got = linededup.deduplicate(spark.createDataFrame([(*r, "", "", 0, 0) for r in rows], SCHEMA)).collect()
    left = {(r.doc_id, x) for r in got for x in r.text.split("\n")}
    assert len(want) > 100 and not [w for w in want if (w[0], docs[w[0]][w[1]]) in left]
    # Besides, only chunks of several lines go, and a whole text.
    first, more = {}, set()
    for i, lines in docs.items():
        lines = [x.encode() for x in lines]
        for a, b in {*linededup.chunks(lines), (0, len(lines))}:
            if b - a > 1 and first.setdefault(tuple(lines[a:b]), i) != i:
                more.update((i, k) for k in range(a, b))
    assert {r.doc_id: r.removed_lines for r in got} == {i: sum((i, a) in want | more for a in range(len(docs[i]))) for i in docs}


def test_a_passage_that_overlaps_itself_keeps_its_first_place(spark):
    verse = ["ten words of a refrain that comes again and again"] * 30
    (got,) = linededup.deduplicate(spark.createDataFrame([(1, "\n".join(verse), "", "", 0, 0)], SCHEMA)).collect()
    assert got.text.split("\n") == verse[: 30 - got.removed_lines] and len(got.text.split()) >= 50

"""Base patterns against plain scans, the dynamic programme against enumeration, and the field on generated windows it was not fitted on."""

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from changelake.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and (not 14 <= len(d) <= 19 or odd % 10)) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_against_plain_scans():
    rng = random.Random(6)
    parts = ["a", "@", "b.c", "..", "-", "1", "23", "255", "256", "."] + [" ", "+", "(", ")", "4111111111111111", "é", "@x.y", "00000000255", "+1 (988) 555-2485"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def small():
    return pii.train(examples=300, epochs=4)


def test_dynamic_programme_against_enumeration(small):
    rng = random.Random(2)
    for _ in range(25):
        text, _ = pii.generated(rng)
        for run in pii.windows(text):
            n = len(run)
            if n > 3:
                continue
            arcs = small.lattice(n, pii.segments(text, run))
            flat = [(i, j, y, s) for j, ends in enumerate(arcs) for i, scores in ends for y, s in enumerate(scores) if s > -math.inf]
            total, best, mass = 0.0, None, {}
            for size in range(1, n + 1):
                for parts in itertools.product(flat, repeat=size):
                    if parts[0][0] or parts[-1][1] != n or any(p[1] != q[0] for p, q in itertools.pairwise(parts)):
                        continue
                    score = sum(p[3] for p in parts) + sum(small.step(x, y) for x, y in itertools.pairwise([0, *(p[2] for p in parts)]))
                    total += math.exp(score)
                    best = max(best or (score, parts), (score, parts), key=lambda t: t[0])
                    for p in parts:
                        mass[p[:3]] = mass.get(p[:3], 0) + math.exp(score)
            p, _, z = small.marginals(n, arcs)
            assert math.isclose(math.exp(z), total, rel_tol=1e-9)
            assert all(math.isclose(p[k], v / total, abs_tol=1e-9) for k, v in mass.items())
            assert small.decode(n, arcs) == [q[:3] for q in best[1]]


def test_finds_what_it_was_not_fitted_on(small):
    rng, hit, wrong, missed = random.Random(77), 0, 0, 0
    for _ in range(300):
        text, spans = pii.generated(rng)
        got = set(pii.all_spans(text, small, []))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.9


def test_adds_and_keeps(small):
    text = "call (415) 555-2671 or mail jo.doe@mail3.example.com now, 10.2.3.4"
    base, spans = pii.base_spans(text), pii.all_spans(text, small)
    assert set(base) <= set(spans) and (text.index("(415)"), text.index(" or"), 3) in spans
    assert pii.masked(text, spans) == "call [PHONE] or mail [EMAIL] now, [IP]"
    assert pii.all_spans("plain words only", small) == []


def test_long_tokens_are_other_tokens(small):
    text = "call (555) 123-4567 now"
    want = pii.all_spans(text, small)
    assert want == [(5, 19, 3)]
    url = " http://x.y/" + "a1b2c3" * 25
    assert pii.all_spans(text + url, small) == want
    assert pii.all_spans(f"{text[:-4]}{url} 7{url}", small) == want
    assert [(a - len(url), b - len(url), k) for a, b, k in pii.all_spans(f"{url[1:]} {text}", small)] == want
    dotted = "card 4111.1111.1111.1111 "
    assert pii.all_spans(dotted + "9" * 134, small) == pii.all_spans(dotted, small) != []


def test_windows_end_with_their_line():
    assert [len(w) for w in pii.windows("1 2\n3 4 5\n\nx 6")] == [2, 3, 1]


def test_time_grows_with_the_text(small):
    """Runs of digits, signs and numbers of a megabyte would take hours if any pattern started anew at each place."""
    for text in ("1" * 1_000_000, "a@" * 500_000, "+1" * 500_000, "1.2." * 250_000, "1 " * 300_000):
        start = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - start < 20
    assert pii.all_spans("12 345 6 " * 20_000, small) == []


def test_columns(spark, small):
    texts = [None, "", "mail a@b.co", "4111111111111111 é +1 (988) 555-2485", "long word " * 30_000 + "a@b.co", "9" * 5000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a@b.co", "x", 1), (2, texts[2], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int")
    got = pii.find(docs, small).collect()
    assert len(got) == len(rows)
    for r in got:
        b = plain((texts[r.doc_id] or "") if r.doc_id is not None else "a@b.co")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for *_, k in b) for n in range(4)]
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in b)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) <= set(r.spans.split(","))
    clean = pii.redact(docs, small)
    assert clean.schema == docs.schema
    assert {r.text for r in clean.where("doc_id = 2").collect()} == {"mail [EMAIL]"} and clean.where("doc_id = 0").first().text is None
    assert pii.find(docs.limit(0), small).count() == 0

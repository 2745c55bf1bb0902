"""Base phrases and template spans against brute force over words."""

import random

from changelake.llm import licenses

SCHEMA = "doc_id long, text string, labels string, row string, spans int"


def brute(text):
    words, cur = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_templates_fit():
    sizes = [len(licenses.words_of(t)) for texts in licenses.TEMPLATES.values() for t in texts]
    assert min(sizes) >= 4 and max(sizes) > 64 + 3  # a whole license has more k-grams than a long has bits


def test_scan(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["ere", "thé", "GPL", "license", "mit", "the"]) for _ in range(n))
    texts = [None, "", "MIT License", "mit-license,Apache  LICENSE", "general public\nlicense x general Public License", "mit\x80license", "MİT license mit"]
    planted = []
    for label, notices in licenses.TEMPLATES.items():
        for t in notices:
            planted.append((len(texts), label))
            texts.append(f"{noise(20)} {t.upper() if rng.random() < 0.5 else t.replace(' ', chr(10) + '# ')} {noise(30)}")
    whole = licenses.TEMPLATES["gpl"][1].split()
    planted.append((len(texts), "gpl"))
    texts.append(noise(9) + " " + " ".join(whole[:12] + ["inserted", "words"] + whole[12:]))
    texts.append(" ".join(whole[:6]) + " ere thé" * 150)
    texts.append((licenses.TEMPLATES["mit"][1] + " ") * 50)
    rows = [(i, t, "clash", "x", 1) for i, t in enumerate(texts)] + [(2, "MIT License", "", "", 0), (None, "MIT License", "", "", 0)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else "MIT License"
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base) == brute(t), t
        assert set(r.base) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    for i, label in planted:
        assert label in by[i].labels and by[i].score >= licenses.COVER, (label, texts[i])
        s = next(s for s in by[i].spans if s.label == label)
        assert licenses.words_of(texts[i])[s["from"]] == licenses.words_of(next(t for t in licenses.TEMPLATES[label] if licenses.words_of(t)[0] == licenses.words_of(texts[i])[s["from"]]))[0]
    assert by[planted[-1][0] + 1].labels == [] and by[planted[-1][0] + 1].score == 0
    repeated = by[planted[-1][0] + 2]
    assert len([s for s in repeated.spans if s.label == "mit"]) == 50


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0

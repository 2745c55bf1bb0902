"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds others, such as numbers written without their country code, in unusual groups or masked signs. It
works on windows of one line around tokens with digits or a commercial at. A segmentation of a window is a sequence of entities of up to LONGEST tokens
and WIDEST signs, and of single other tokens, of any length; its score sums whole-segment features (length, overall shape, digit groups, checks,
neighbouring words) and transitions. Training maximises the conditional likelihood of generated windows; decoding is a dynamic programme over boundaries and
types that looks back LONGEST tokens at most. Outside windows no token can start or end an entity, so windows are decoded one by one, with the same result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens in an entity at most; rounds and generated windows of training; the posterior that an added span must reach; weight decay.
LONGEST, EPOCHS, EXAMPLES, SURE, DECAY, SEED = 6, 6, 1500, 0.9, 1e-3, 11
#: Signs in an entity that the field adds, at most: the longest such number or address has far fewer.
WIDEST = 80
OTHER = "other"
#: The contract's patterns.
AFTER_AT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Tried at the starts of digit runs alone: what a later start in a run matches, the run's start does as well, and earlier.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"\S+")
CLUE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, kind by kind leftmost and non-overlapping, in the order of start, then kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # All that may stand before the sign lies in one run, which the leftmost match takes from its start.
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := AFTER_AT.match(text, start)):
            out.append((m.start(), end := m.end(), 0))
        at = text.find("@", max(at + 1, end))
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


@lru_cache(maxsize=50_000)
def _shape(text: str) -> str:
    """The text's pattern: runs of letters are A, of digits 9 with their length, other signs themselves."""
    text = re.sub(r"[0-9]+", lambda m: f"\0{len(m.group())}", text)
    return re.sub(r"[^\W\d_]+", "A", text, flags=re.ASCII if text.isascii() else 0).replace("\0", "9x")


@lru_cache(maxsize=50_000)
def _whole(text: str) -> tuple[str, ...]:
    """Features of a segment as a whole, without its surroundings."""
    d = _digits(text)
    groups = re.findall(r"[0-9]+", text)
    out = [f"n={min(len(d), 20)}", f"tokens={min(text.count(' ') + 1, LONGEST)}", f"groups={'-'.join(str(len(g)) for g in groups[:6])}", f"signs={''.join(sorted({c for c in text if not c.isalnum()} - {' '}))[:8]}"]
    out.append(f"at={text.count('@')}")
    out.append("letters" if any(c.isalpha() for c in text) else "no letters")
    out.append(f"first={'9' if text[:1].isdigit() else 'A' if text[:1].isalpha() else text[:1]}")
    out.append(f"last={'9' if text[-1:].isdigit() else 'A' if text[-1:].isalpha() else text[-1:]}")
    if 13 <= len(d) <= 19:
        out.append(f"luhn={luhn(d)}")
    if len(groups) == 4:
        out.append(f"octets={all(int(g) <= 255 for g in groups if len(g) <= 9) and max(map(len, groups)) <= 3}")
    if len(text) <= 40:
        out.append(f"shape={_shape(text)}")
    return tuple(out)


def _edges(token: str) -> tuple[int, int]:
    """How many signs stand around a token's core: quotes, brackets and closing punctuation are no part of an entity."""
    a, b = 0, len(token)
    while a < b and token[a] in "\"'<[{«“‘,;:=":
        a += 1
    while b > a and token[b - 1] in "\"'>]},;:!?.»”’=":
        b -= 1
    return a, len(token) - b


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens of one line, as (start, end) without surrounding signs, that may form an entity: a token with a digit or an at sign, and what may join such tokens."""
    if not CLUE.search(text):
        return
    run: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        token = m.group()
        if run and text.find("\n", run[-1][1], m.start()) >= 0:
            yield run
            run = []
        if CLUE.search(token) or (run and len(token) <= 3 and not token[0].isalpha()):
            a, b = _edges(token)
            if m.end() - b > m.start() + a:
                run.append((m.start() + a, m.end() - b))
        elif run:
            yield run
            run = []
    if run:
        yield run


def segments(text: str, run: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Every candidate segment, as its first token, the token after its last and its features: whole-segment ones and the neighbouring words.

    A token of over WIDEST signs is a segment too, without features, and can only be another token.
    """
    for i in range(len(run)):
        before = text[max(0, run[i][0] - 16) : run[i][0]].split()
        for j in range(i + 1, min(len(run), i + LONGEST) + 1):
            start, end = run[i][0], run[j - 1][1]
            if end - start > WIDEST:
                if j == i + 1:
                    yield i, j, ()
                break
            after = text[end : end + 12].split()
            yield i, j, (*_whole(text[start:end]), f"before={before[-1].lower() if before else ''}"[:20], f"after={_shape(after[0]) if after else ''}"[:12])


class Field:
    """Weights of (label, feature) and of transitions between labels; label 0 is OTHER, of one token."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}
        self._sums: dict[tuple[str, ...], tuple[float, ...]] = {}

    def scores(self, features: tuple[str, ...], single: bool) -> tuple[float, ...]:
        """The score of a segment under each label: several tokens are no other token, and a segment without features is nothing else."""
        key = (features, single)
        if key not in self._sums:
            if len(self._sums) > 50_000:
                self._sums.clear()
            w = self.weights
            own = [sum(w.get((y, f), 0.0) for f in features) if features else -math.inf for y in range(1, len(KINDS) + 1)]
            self._sums[key] = (sum(w.get((0, f), 0.0) for f in features) if single else -math.inf, *own)
        return self._sums[key]

    def lattice(self, n: int, found) -> list[list[tuple[int, tuple[float, ...]]]]:
        """For each place, the segments that end there, as (first token, score by label)."""
        out: list[list[tuple[int, tuple[float, ...]]]] = [[] for _ in range(n + 1)]
        for i, j, features in found:
            out[j].append((i, self.scores(features, j == i + 1)))
        return out

    def step(self, a: int, b: int) -> float:
        return self.weights.get((b, f"previous={a}"), 0.0)

    def sums(self, n: int, arcs: list) -> tuple[list[list[float]], list[list[float]], float]:
        """Forward and backward log sums by place and label, and the log of the sum over all segmentations."""
        labels, low = range(len(KINDS) + 1), -math.inf
        steps = [[self.step(x, y) for x in labels] for y in labels]
        forward = [[low] * len(labels) for _ in range(n + 1)]
        forward[0][0] = 0.0
        for j in range(1, n + 1):
            terms: list[list[float]] = [[] for _ in labels]
            for i, scores in arcs[j]:
                before = [(x, f) for x, f in enumerate(forward[i]) if f > low]
                for y in labels:
                    if (s := scores[y]) > low:
                        terms[y] += [f + steps[y][x] + s for x, f in before]
            forward[j] = [_logsum(t) for t in terms]
        backward = [[low] * len(labels) for _ in range(n + 1)]
        backward[n] = [0.0] * len(labels)
        starts: list[list] = [[] for _ in range(n + 1)]
        for j, ends in enumerate(arcs):
            for i, scores in ends:
                starts[i].append((j, scores))
        for i in range(n - 1, -1, -1):
            on = [(y, s + backward[j][y]) for j, scores in starts[i] for y, s in enumerate(scores) if s > low and backward[j][y] > low]
            backward[i] = [_logsum([steps[y][x] + v for y, v in on]) for x in labels]
        return forward, backward, _logsum([f for f in forward[n] if f > low])

    def marginals(self, n: int, arcs: list) -> tuple[dict[tuple[int, int, int], float], dict[tuple[int, int], float], float]:
        """The probabilities of segments with labels and of steps between labels, and the log of the sum over all segmentations."""
        forward, backward, total = self.sums(n, arcs)
        labels, low = range(len(KINDS) + 1), -math.inf
        table = [[self.step(x, y) for x in labels] for y in labels]
        taken = [[0.0] * len(labels) for _ in labels]
        segments_ = {}
        for j, ends in enumerate(arcs):
            for i, scores in ends:
                before = [(x, f) for x, f in enumerate(forward[i]) if f > low]
                for y in labels:
                    if scores[y] > low and backward[j][y] > low:
                        p, rest = 0.0, scores[y] + backward[j][y] - total
                        for x, f in before:
                            q = math.exp(f + table[y][x] + rest)
                            p += q
                            taken[x][y] += q
                        segments_[i, j, y] = p
        return segments_, {(x, y): taken[x][y] for x in labels for y in labels if taken[x][y]}, total

    def posterior(self, i: int, j: int, y: int, score: float, forward: list, backward: list, total: float) -> float:
        """The probability of one segment with its label."""
        return sum(math.exp(f + self.step(x, y) + score + backward[j][y] - total) for x, f in enumerate(forward[i]) if f > -math.inf)

    def decode(self, n: int, arcs: list) -> list[tuple[int, int, int]]:
        """The best segmentation: boundaries and labels together. Ties go to the segment that is listed first."""
        labels, low = range(len(KINDS) + 1), -math.inf
        steps = [[self.step(x, y) for x in labels] for y in labels]
        best = [[low] * len(labels) for _ in range(n + 1)]
        back: list[list] = [[None] * len(labels) for _ in range(n + 1)]
        best[0][0] = 0.0
        for j in range(1, n + 1):
            for i, scores in arcs[j]:
                for y in labels:
                    if scores[y] == low:
                        continue
                    for x in labels:
                        v = best[i][x] + steps[y][x] + scores[y]
                        if v > best[j][y]:
                            best[j][y], back[j][y] = v, (i, x)
        out, j = [], n
        y = max(labels, key=lambda k: best[n][k])
        while j > 0 and back[j][y]:
            i, x = back[j][y]
            out.append((i, j, y))
            j, y = i, x
        return out[::-1]


def _logsum(values: list[float]) -> float:
    if not values:
        return -math.inf
    m = max(values)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in values))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghilmnoprstuvéüñ") for _ in range(rng.randint(2, 9)))


def _entity(rng: random.Random, kind: int) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        ascii_word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8)))
        at = rng.choice(["@"] * 6 + ["(at)@", "@"])
        return ascii_word() + rng.choice(["", "." + ascii_word(), "_" + number(2), "." + number(2)]) + at + ascii_word() + rng.choice(["", number(1)]) + rng.choice([".com", ".example.com", ".org", ".co.uk"])
    if kind == 1:
        return rng.choice(["."] * 6 + ["-", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = rng.choice("3456") + number(rng.choice([13, 14, 14, 14, 14, 17]))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        sign = rng.choice(["", "", "", " ", "-", "."])
        return sign.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = number(3), number(3), number(4)
    return rng.choice([f"+{number(rng.randint(1, 2))} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {b} {c}", f"+{number(2)}-{a}-{b}{c}", f"{a}-{b}-{c}", f"+{number(2)}/{a}/{b}-{c}"])


def _distractor(rng: random.Random) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    d = number(rng.choice([13, 14, 15, 16]))
    bad = d + next(str(c) for c in range(10) if not luhn(d + str(c)))
    return rng.choice(
        [f"{number(1)}.0", f"{number(1)}.{number(1)}.{number(2)}", number(rng.randint(1, 7)), f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}", bad, f"${number(3)}.{number(2)}", f"{number(2)}:{number(2)}",
         f"{_word(rng)}{number(2)}", f"AKIA{number(3)}X{number(4)}", f"password={number(3)}d{number(4)}f", f"v{number(1)}.{number(1)}", f"@{_word(rng)}", f"{number(2)}%", f"{number(3)},{number(3)}", f"300.{number(3)}.{number(1)}.999",
         f"{number(4)} {number(2)}", f"{number(1)} {number(1)} {number(1)}", number(24), f"#{number(5)}", f"{number(3)}-{number(2)}"]
    )


def generated(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of words, entities of all forms and other numbers, with the entities' spans."""
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(_word(rng) for _ in range(rng.randint(1, 3))) + " "
        for _ in range(rng.choice([1, 1, 1, 2])):
            if rng.random() < 0.6:
                kind = rng.randrange(4)
                e = _entity(rng, kind)
                spans.append((len(text), len(text) + len(e), kind))
                text += e
            else:
                text += _distractor(rng)
            text += rng.choice(["", "", "", ".", ",", "!"]) + " "
    return text + _word(rng), spans


def train(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """A field fitted to generated windows by stochastic gradient steps (per-coordinate rates) on the conditional likelihood."""
    rng, field, squares = random.Random(seed), Field(), {}
    cases = []
    for _ in range(examples):
        text, spans = generated(rng)
        for run in windows(text):
            found = {(i, j): features for i, j, features in segments(text, run)}
            by = {(run[i][0], run[j - 1][1]): (i, j) for i, j in found}
            gold = [(*by[a, b], k + 1) for a, b, k in spans if (a, b) in by]
            inside = {t for i, j, _ in gold for t in range(i, j)}
            gold += [(t, t + 1, 0) for t in range(len(run)) if t not in inside]
            cases.append((len(run), found, sorted(gold)))
    for _ in range(epochs):
        rng.shuffle(cases)
        for n, found, gold in cases:
            field._sums.clear()
            segments_, steps, _ = field.marginals(n, field.lattice(n, ((i, j, features) for (i, j), features in found.items())))
            g: dict[tuple[int, str], float] = {}
            for (i, j, y), p in segments_.items():
                if p > 1e-4:
                    for f in found[i, j]:
                        g[y, f] = g.get((y, f), 0.0) - p
            for (x, y), p in steps.items():
                g[y, f"previous={x}"] = g.get((y, f"previous={x}"), 0.0) - p
            x = 0
            for i, j, y in gold:
                for f in found[i, j]:
                    g[y, f] = g.get((y, f), 0.0) + 1
                g[y, f"previous={x}"] = g.get((y, f"previous={x}"), 0.0) + 1
                x = y
            for k, v in g.items():
                v -= DECAY * field.weights.get(k, 0.0)
                squares[k] = squares.get(k, 0.0) + v * v
                field.weights[k] = field.weights.get(k, 0.0) + 0.5 * v / (1 + math.sqrt(squares[k]))
    field._sums.clear()
    return Field({k: round(v, 4) for k, v in field.weights.items() if abs(v) > 0.02})


_FIELD: list[Field] = []


def model() -> Field:
    """The field of the default parameters, fitted once in a process; it is the same in each."""
    if not _FIELD:
        _FIELD.append(train())
    return _FIELD[0]


def all_spans(text: str, field: Field, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans, and the entities of the best segmentation that overlap none of them and have a posterior of SURE at least."""
    base = base_spans(text) if base is None else base
    taken = sorted((a, b) for a, b, _ in base)
    added, k = [], 0
    for run in windows(text):
        while k < len(taken) and taken[k][1] <= run[0][0]:
            k += 1
        if k < len(taken) and len(run) <= LONGEST and taken[k][0] <= run[0][0] and taken[k][1] >= run[-1][1]:
            continue  # all of the window is a base span
        arcs = field.lattice(len(run), segments(text, run))
        best = [s for s in field.decode(len(run), arcs) if s[2]]
        if not best:
            continue
        forward, backward, total = field.sums(len(run), arcs)
        for i, j, y in best:
            a, b = run[i][0], run[j - 1][1]
            score = next(s[y] for start, s in arcs[j] if start == i)
            if field.posterior(i, j, y, score, forward, backward, total) >= SURE and not any(p < b and a < q for p, q in taken[max(0, k - 1) :]):
                added.append((a, b, y - 1))
    return sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1])) if added else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, spans string"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The spans of every row of `docs` (doc_id, text): base counts, base spans and all spans as kind:start:end, by start.

    A null text is empty and has no spans. Repeated rows and null ids come back as they are; an empty table gives an empty one.
    """
    weights = (field or model()).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in slices(batches, "text"):
            counts, base, spans = [], [], []
            for t in texts_of(batch.column(1)):
                b = base_spans(t)
                counts.append([sum(k == n for *_, k in b) for n in range(4)])
                base.append(_joined(b))
                spans.append(_joined(all_spans(t, own, b)))
            columns = [batch.column(0), *(pa.array([c[n] for c in counts], pa.int64()) for n in range(4))]
            columns += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, and its whole extent, counts."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
            end = b
        elif b > end:
            end = b
    return "".join([*out, text[end:]]) if spans else text


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind; all rows and columns come back, a null text stays null."""
    weights = (field or model()).weights
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in slices(batches, "text"):
            column = batch.column(place)
            texts = [masked(t, all_spans(t, own)) if t is not None else None for t in column.to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string()).cast(column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

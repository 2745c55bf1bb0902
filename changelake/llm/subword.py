"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by a perturbed A* search over the segmentation lattice.

A text's lattice has a node between any two characters and an arc for every piece of the vocabulary; a character without a piece has one arc of byte
pieces. No piece goes from a letter on to the word mark, so the lattice is a chain of word lattices; each is built once, with the
log sum of all its ways from every node to its end. These sums are the search's heuristic, and an exact one: they turn arcs into conditional
probabilities, so sampling arc by arc gives a whole segmentation with its probability.

Gumbel noise on all segmentations makes the k largest a sample without replacement. The largest is a path drawn arc by arc, with a Gumbel value for the
whole space. For each of its arcs, all segmentations that leave the path there form a region; the largest value in a region is a Gumbel with the
region's mass as its location, cut off at the value of the path. The next sample is in the region with the largest value, drawn in the
same way, and so on. All noise is a hash of the row's key, the sample's number and the place, so results depend on nothing else. Noise has 53 bits: an arc
of a conditional probability below 2^-53 is never drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import slices, texts_of
from changelake.llm.words import BASE, INVERSE, Lexicon, Spellings, mix, ranges

MARK = "▁"
SAMPLES, ALPHA, SEED = 2, 1.0, 17
#: Word lattices are kept up to this many arcs in a worker; then those of the less used half of the words go, and are built again when needed.
KEPT = 8_000_000
ONE = np.uint64(1)
#: Bounds of Gumbel noise made from 53-bit uniform numbers: no value is further above or below its location.
HIGH, LOW = 37.5, 3.7


def _prefix_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(points.size + 1, BASE, dtype=np.uint64)
    down = np.full(points.size + 1, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(points.size + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + ONE) * up[:-1], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def seeds(keys: np.ndarray, number: int) -> np.ndarray:
    """A hash of each key and a number."""
    return mix(mix(keys * np.uint64(BASE) + ONE) * np.uint64(BASE) + np.uint64(number))


def uniform(seed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 for the places, from an array of one seed."""
    return ((mix(seed + places.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces of a model file with log probabilities: those of a unigram model, or for a model of merges Zipf's law over the merges' order."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        kinds = proto.ModelProto.SentencePiece
        self.dummy = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation and byte fallback are read")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece goes on from a word to the next one")
        if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM:
            score = {i: s for i, _, s in normal}
        else:
            order = sorted(normal, key=lambda x: (-x[2], x[0]))
            total = math.log(sum(1 / (r + 2.7) for r in range(1, len(order) + 1)))
            score = {i: -math.log(r + 2.7) - total for r, (i, *_) in enumerate(order, 1)}
        low = min(score.values())
        self.bytes = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
        self.low = low
        self.longest = max(len(p) for _, p, _ in normal)
        #: All prefixes of pieces by hash, with the piece that ends there or -1.
        found: dict[str, int] = {}
        for i, p, _ in normal:
            for n in range(1, len(p)):
                found.setdefault(p[:n], -1)
            found[p] = i
        flat = _points("".join(found))
        sums, down = _prefix_hashes(flat)
        ends = np.cumsum([len(p) for p in found])
        self.prefixes = Lexicon(18)
        hashes = _hash(sums, down, np.concatenate([[0], ends[:-1]]), ends)
        if np.unique(hashes).size != hashes.size:
            raise ValueError("two prefixes of pieces have one hash")
        self.prefixes.add(hashes)
        #: A prefix is the one before it, or none, and a letter.
        number = {p: i for i, p in enumerate(found)}
        self.shorter = np.array([number.get(p[:-1], -1) for p in found], dtype=np.int64)
        self.letter = np.array([ord(p[-1]) for p in found], dtype=np.uint32)
        self.piece = np.array(list(found.values()), dtype=np.int64)
        self.score = np.full(len(model.pieces), low)
        for i, s in score.items():
            self.score[i] = s
        #: What each id stands for, as bytes.
        self.meaning = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in model.pieces]

        self.size = np.array([len(m) for m in self.meaning])
        self.spelled, self.at = np.frombuffer(b"".join(self.meaning), dtype=np.uint8), np.cumsum(self.size) - self.size

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks are spaces, and the space before the first word is none of the text."""
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of lists of ids that follow each other."""
        return [x.decode("utf-8", "replace") for x in self.decode_bytes(ids, bounds)]

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        sizes = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.spelled[np.repeat(self.at[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        ends = ends[bounds].tolist()
        parts = (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [x[1:] if self.dummy and x[:1] == b" " else x for x in parts]


class Lattices:
    """Word lattices in shared arrays. A word's nodes follow each other; an arc's target is in the same word."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.vocabulary, self.alpha = Vocabulary(path), alpha
        self._forget()

    def _forget(self) -> None:
        self.words = Spellings(np.uint32)
        self.root, self.uses = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        #: By node, and one more at the end: the node's first arc.
        self.first, self.nodes = np.zeros(1 << 16, dtype=np.int32), 0
        self.arcs = 0
        self.target, self.id = np.empty(1 << 16, dtype=np.int32), np.empty(1 << 16, dtype=np.int32)
        self.upto, self.logp = np.empty(1 << 16), np.empty(1 << 16, dtype=np.float32)

    def _append(self, first: np.ndarray, target: np.ndarray, ids: np.ndarray, upto: np.ndarray, logp: np.ndarray) -> None:
        """Add nodes, as the ends of their arcs, and arcs. Arrays grow by half, so that a word is seldom copied."""
        if self.nodes + first.size + 1 > self.first.size:
            self.first = np.concatenate([self.first[: self.nodes + 1], np.empty((self.nodes + first.size) // 2 + first.size, dtype=np.int32)])
        self.first[self.nodes + 1 : self.nodes + 1 + first.size] = first + self.arcs
        end = self.arcs + target.size
        if end > self.target.size:
            for name in ("target", "id", "upto", "logp"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old[: self.arcs], np.empty(end // 2 + target.size, dtype=old.dtype)]))
        for name, new in (("target", target), ("id", ids), ("upto", upto), ("logp", logp)):
            getattr(self, name)[self.arcs : end] = new
        self.nodes += first.size
        self.arcs = end

    def _keep_half(self) -> None:
        """Only the more used half of the words stay."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.uses.size // 2])
        ends = np.append(self.root[1:], self.nodes)
        sizes = (ends - self.root)[keep]
        nodes = ranges(self.root[keep], sizes)
        counts = (self.first[nodes + 1] - self.first[nodes]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        arcs = ranges(self.first[nodes], counts)
        root = np.cumsum(sizes) - sizes
        moved = np.repeat(np.repeat(root - self.root[keep], sizes), counts)
        kept = (self.target[arcs] + moved).astype(np.int32), self.id[arcs], self.upto[arcs], self.logp[arcs]
        uses, words = self.uses[keep] // 2, self.words.kept(keep)
        self._forget()
        self._append(first[1:], *kept)
        self.root, self.uses, self.words = root, uses, words

    def rows(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The word numbers of these ranges of characters; new words get their lattices."""
        if self.arcs > KEPT:
            self._keep_half()
        sums, down = _prefix_hashes(points)

        def learn(numbers: np.ndarray) -> None:
            for i in range(0, numbers.size, 20_000):
                some = numbers[i : i + 20_000]
                self._build(points, starts[some], ends[some], sums, down)
            self.uses = np.concatenate([self.uses, np.zeros(numbers.size, dtype=np.int64)])

        row = self.words.rows(_hash(sums, down, starts, ends), points, starts, ends, learn)
        self.uses += np.bincount(row, minlength=self.uses.size)
        return row

    def _build(self, points, starts, ends, sums, down) -> None:
        v = self.vocabulary
        sizes = ends - starts
        nodes = int((sizes + 1).sum())
        root = np.cumsum(sizes + 1) - (sizes + 1)
        word = np.repeat(np.arange(sizes.size), sizes)
        within = np.arange(word.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[word] - within
        # A row for each character, the last ones of words first; a column for each length, the longest first: the piece that starts there.
        order = np.argsort(left.astype(np.uint16) if sizes.max() < 1 << 16 else left, kind="stable")
        word, within, left = word[order], within[order], left[order]
        place, node = starts[word] + within, root[word] + within
        width = v.longest
        piece = np.full((word.size, width), -1, dtype=np.int32)
        live, before = np.arange(word.size), np.full(word.size, -1, dtype=np.int64)
        for n in range(1, width + 1):
            on = left[live] >= n
            live, before = live[on], before[on]
            if not live.size:
                break
            row = v.prefixes.find(_hash(sums, down, place[live], place[live] + n))
            # A hash only proposes a prefix: what it goes on from and its last letter must be the text's.
            on = (row >= 0) & (v.shorter[row] == before) & (v.letter[row] == points[place[live] + n - 1])
            live, before = live[on], row[on]
            piece[live, width - n] = v.piece[before]
        # A character without a piece: the byte's piece, or below -1 the character itself if it has several bytes.
        lone = np.flatnonzero(piece[:, -1] < 0)
        cp = points[place[lone]].astype(np.int64)
        single = self.alpha * v.score[np.maximum(piece[:, -1], 0)]
        single[lone] = self.alpha * v.low * (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        piece[lone, -1] = np.where(cp < 0x80, v.bytes[np.minimum(cp, 0x7F)], -2 - cp)
        # Log sums of all ways to the word's end, from the nodes before the end back to the first. Only lengths up to that distance can be.
        ways = np.zeros(nodes + width)
        bounds = np.searchsorted(left, np.arange(1, int(left[-1]) + 2)).tolist()
        scaled = (self.alpha * v.score).astype(np.float64)
        source, length, logps = [], [], []
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
            if a == b:
                continue
            c = min(d, width)
            own = piece[a:b, width - c :]
            row, column = np.nonzero(own != -1)
            n = c - column
            total = np.where(n == 1, single[a + row], scaled[np.maximum(own[row, column], 0)]) + ways[node[a + row] + n]
            heads = np.searchsorted(row, np.arange(b - a))
            top = np.maximum.reduceat(total, heads)
            sum_ = top + np.log(np.add.reduceat(np.exp(total - top[row]), heads))
            ways[node[a:b]] = sum_
            source.append(a + row)
            length.append(n)
            logps.append(np.minimum(total - sum_[row], 0.0))
        source, length, logp = np.concatenate(source), np.concatenate(length), np.concatenate(logps)
        # Arcs of a node stand together, the longest first.
        order = np.argsort(node[source].astype(np.uint32), kind="stable")
        source, length, logp = source[order], length[order], logp[order]
        at = node[source]
        count = np.bincount(at, minlength=nodes)
        logp[np.repeat(count == 1, count)] = 0.0
        first = np.concatenate([[0], np.cumsum(count)])
        run = np.concatenate([[0.0], np.cumsum(np.exp(logp))])
        upto = run[1:] - run[first[at]]
        upto[first[1:][count > 0] - 1] = 2.0
        base = self.nodes
        self.root = np.concatenate([self.root, root + base])
        self._append(first[1:], at + length + base, piece[source, width - length], upto, logp)

    def node_of(self, arc: int) -> tuple[int, int]:
        """The first arc of an arc's node, and the one after its last."""
        node = int(np.searchsorted(self.first[: self.nodes + 1], np.int32(arc), side="right")) - 1
        return int(self.first[node]), int(self.first[node + 1])

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs drawn from each node to its word's end, by its key: how many for each node, and the arcs one after another."""
        steps, live, at, step = [], np.arange(nodes.size), nodes, 0
        counts = np.zeros(nodes.size, dtype=np.int64)
        while True:
            arc = self.first[at].astype(np.int64)
            on = self.first[at + 1] > arc
            live, arc = live[on], arc[on]
            if not live.size:
                break
            u = (mix(keys[live] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            more = np.flatnonzero(u >= self.upto[arc])
            while more.size:
                arc[more] += 1
                more = more[u[more] >= self.upto[arc[more]]]
            steps.append((live, arc))
            counts[live] += 1
            at = self.target[arc]
            step += 1
        out = np.empty(int(counts.sum()), dtype=np.int64)
        begin = np.cumsum(counts) - counts
        for n, (where, arc) in enumerate(steps):
            out[begin[where] + n] = arc
        return counts, out

    def expand(self, arcs: np.ndarray) -> np.ndarray:
        """The piece ids of arcs; a character of several bytes without a piece becomes its bytes' pieces."""
        ids = self.id[arcs]
        if not (ids < 0).any():
            return ids
        parts, start = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            parts += [ids[start:i], self.vocabulary.bytes[list(chr(-2 - int(ids[i])).encode("utf-8", "surrogatepass"))]]
            start = i + 1
        return np.concatenate([*parts, ids[start:]])


_LATTICES: dict[tuple, Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """The worker's own lattices, kept from task to task."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


class _Path:
    """A drawn path: its arcs, their words' numbers, its value, and the regions that leave it from place `skip` on, as far as they can matter."""

    def __init__(self, arcs: np.ndarray, words: np.ndarray, value: float, skip: int, gone: list[int] | None):
        self.arcs, self.words, self.value, self.skip, self.gone = arcs, words, value, skip, gone
        self.logp, self.before, self.values = 0.0, np.empty(0), np.empty(0)

    def open(self, lattice: Lattices, logp: np.ndarray, start: float, seed: np.ndarray, k: int) -> None:
        """The values of the regions, from the log probabilities of the arcs from `skip` on. `start` is that of the arcs before; at `skip` the arcs `gone` are no longer open."""
        if not logp.size:
            self.logp = start
            return
        self.logp = start + float(logp.sum(dtype=np.float64))
        n = 160
        while True:
            run = start + np.cumsum(logp[:n], dtype=np.float64)
            before = np.concatenate([[start], run[:-1]])
            with np.errstate(divide="ignore"):
                mass = before + np.log(-np.expm1(logp[:n].astype(np.float64)))
            if self.gone:
                a, b = lattice.node_of(self.gone[-1])
                rest = [x for x in range(a, b) if x not in self.gone]
                mass[0] = before[0] + math.log(np.exp(lattice.logp[rest], dtype=np.float64).sum()) if rest else -math.inf
            # Masses only shrink along the path, so once k + 1 regions are sure to beat all later ones, these are left out.
            if n >= logp.size or (mass.size > k and run[-1] + HIGH < -np.partition(-np.minimum(self.value, mass - LOW), k)[k] - 0.7):
                break
            n *= 4
        self.before = before
        u = uniform(seed, np.arange(self.skip, self.skip + mass.size) * 4 + 1)
        # A Gumbel value of location m that is at most the path's value v: m - log(exp(m - v) + E), where E is exponential. No mass, no value.
        self.values = mass - np.log(np.exp(np.minimum(mass - self.value, 700.0)) - np.log(u))


def _best(paths: list[_Path]) -> tuple[float, int, int]:
    """The largest value of all open regions, its path's number and its place among the path's regions."""
    top = (-math.inf, -1, -1)
    for p, path in enumerate(paths):
        if path.values.size:
            i = int(path.values.argmax())
            if path.values[i] > top[0]:
                top = (float(path.values[i]), p, i)
    return top


def sample(lattice: Lattices, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations as (ids, log probability, value, inclusion probability), largest value first.

    The inclusion probability is that of a segmentation's value to exceed the (k+1)-th largest; 1 if there is none. A text has fewer than k if its lattice
    has; an empty text has the empty one.
    """
    v = lattice.vocabulary
    flat = [(MARK if v.dummy and t else "") + t.replace(" ", MARK) for t in texts]
    points = _points("".join(flat))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in flat])])
    if points.size:
        mark = points == ord(MARK)
        turn = mark & ~np.concatenate([[False], mark[:-1]])
        turn[bounds[:-1][bounds[:-1] < points.size]] = True
        starts = np.flatnonzero(turn)
        ends = np.append(starts[1:], points.size)
        rows = lattice.rows(points, starts, ends)
        roots = lattice.root[rows]
    else:
        starts, roots = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    split = np.searchsorted(starts, bounds)
    roots_of = [roots[a:b] for a, b in zip(split[:-1], split[1:], strict=True)]
    found: list[list[_Path]] = [[] for _ in texts]
    tops = -np.log(-np.log(uniform(seeds(keys, k + 1), np.zeros(1))))
    for n in range(k):
        # What each text draws now: the nodes to go on from, their words' numbers, and the part of an older path before them.
        plans, nodes, words = [], [], []
        seed = seeds(keys, n)
        for d, paths in enumerate(found):
            if n == 0:
                value = float(tops[d])
                begin, at = 0, roots_of[d]
                plans.append((d, value, None, 0, 0.0, None))
            else:
                value, p, i = _best(paths)
                if value == -math.inf:
                    continue
                path = paths[p]
                place = path.skip + i
                a, b = lattice.node_of(int(path.arcs[place]))
                gone = path.gone if i == 0 and path.gone else [int(path.arcs[place])]
                rest = [x for x in range(a, b) if x not in gone]
                sums = np.cumsum(np.exp(lattice.logp[rest]))
                u = float(uniform(seed[d : d + 1], np.array([place * 4 + 2]))[0])
                chosen = rest[min(int(np.searchsorted(sums, u * sums[-1], side="right")), len(rest) - 1)]
                path.values[i] = -math.inf
                begin = int(path.words[place])
                at = np.concatenate([[lattice.target[chosen]], roots_of[d][begin + 1 :]]).astype(np.int64)
                plans.append((d, value, path, place, float(path.before[i]), [*gone, chosen]))
            nodes.append(at)
            words.append(begin + np.arange(at.size))
        if not plans:
            break
        sizes = [x.size for x in nodes]
        number = np.concatenate(words)
        noise = mix(np.repeat(seed[[x[0] for x in plans]], sizes) + number.astype(np.uint64) * np.uint64(BASE))
        counts, arcs = lattice.walk(np.concatenate(nodes), noise)
        arc_words, logp = np.repeat(number, counts), lattice.logp[arcs]
        at = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        for (d, value, old, place, start, gone), a, b in zip(plans, at[:-1], at[1:], strict=True):
            if old is None:
                own, own_words, own_logp = arcs[a:b], arc_words[a:b], logp[a:b]
            else:
                own = np.concatenate([old.arcs[:place], gone[-1:], arcs[a:b]])
                own_words = np.concatenate([old.words[: place + 1], arc_words[a:b]])
                own_logp = np.concatenate([lattice.logp[gone[-1:]], logp[a:b]])
            path = _Path(own, own_words, value, place, gone)
            path.open(lattice, own_logp, start, seed[d : d + 1], k)
            found[d].append(path)
    results = []
    for paths in found:
        # Searches end here; a region's value is final.
        bound = _best(paths)[0]
        rows = []
        for path in paths:
            inclusion = 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(path.logp - bound, 700.0)))
            rows.append((lattice.expand(path.arcs), path.logp, path.value, inclusion))
        results.append(rows)
    return results


def keys_of(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit key for each row's id; all null ids have one key."""
    ids = np.asarray(pc.fill_null(column.cast(pa.int64()), -(1 << 63))).view(np.uint64)
    return mix(ids ^ np.uint64(mix(np.array([seed], dtype=np.uint64))[0]))


SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double"


def encode(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, decoded: bool = False) -> DataFrame:
    """Up to k distinct segmentations of every row of `docs` (doc_id, text), drawn without replacement: see SCHEMA.

    With `decoded`, there is also text_crc32, of the bytes that the ids decode to. `alpha` sharpens (above 1) or flattens the distribution. Equal (doc_id, text) give equal samples. A null text is empty and has the one empty
    segmentation; an empty table gives an empty one.
    """

    schema = SCHEMA + ", text_crc32 long" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices(path, alpha)
        for batch in slices(batches, "text", 1_000_000):
            found = sample(lattice, texts_of(batch.column(1)), keys_of(batch.column(0), seed), k)
            sizes = [len(rows) for rows in found]
            flat = [x for rows in found for x in rows]
            lengths = np.array([x[0].size for x in flat])
            ids = np.concatenate([x[0] for x in flat]).astype(np.int32) if flat else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))), pa.array([i for n in sizes for i in range(n)], pa.int32()), lists, pa.array(lengths.astype(np.int32))]
            columns += [pa.array([x[j] for x in flat], pa.float64()) for j in (1, 2, 3)]
            if decoded:
                texts = lattice.vocabulary.decode_bytes(ids, np.concatenate([[0], np.cumsum(lengths)]))
                columns.append(pa.array([zlib.crc32(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text of their ids; a null list gives a null text. A column of that name is replaced."""
    rows = rows.drop(text)
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattices(path, ALPHA).vocabulary
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(place)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                texts = vocabulary.decode_all(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)]))
                column = pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, text])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{text}` string"
    return rows.mapInArrow(run, out)

"""Packing of documents into sequences: best fit by decreasing length, then swap-based local search.

Documents are dealt evenly over groups of about GROUP rows; each group is packed by itself, so no task holds more, and only a group's
last sequence is worth less than full. In the search, sequences that are not full exchange one document for one, two for one, or take one or two
over. Every step moves length from an emptier sequence to one that is at least as full, so the sum of squared fills rises until the
emptier ones are empty, nothing improves, or SWEEPS rounds are done.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import slices, texts_of
from changelake.llm.words import SINGLE, Spellings, Words, ranges

ROOM, GROUP, SWEEPS = 2048, 16_384, 6
#: Lower-cased texts of these characters only, whose words are runs of letters, single digits or runs of other signs; any other text, or one
#: with a special token's string, goes whole through the tokenizer.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xdf-\xf6\xf8-ɏ]*")
#: A short form is a word of its own where it does not follow another sign; byte 1 stands for its apostrophe, as a letter.
SHORT = re.compile("(?<![^\\s0-9a-z\xdf-\xf6\xf8-ɏ])'(s|t|re|ve|m|ll|d)")
KINDS = np.full(256, 3, dtype=np.int8)
KINDS[[0x09, 0x0A, 0x0D, 0x20]] = 0
KINDS[0x30:0x3A] = SINGLE
KINDS[0x61:0x7B] = KINDS[0x80:] = KINDS[1] = 1
#: Words remembered, and bytes of texts encoded at once. Workers outlive the packing, and what they remember stays with them.
REMEMBERED, SLICE = 400_000, 500_000


class Tokens:
    """Token ids of texts. The ids of words are remembered by their spelling, as a word's ids do not depend on its context."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = Spellings(np.uint8), np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _rows(self, words: Words) -> np.ndarray:
        """The rows of all words; new ones go through the tokenizer, many at a time, a space between them."""

        def learn(numbers: np.ndarray) -> None:
            spelled = words.spelled(numbers)
            got = [self.tokenizer.encode(b" ".join(spelled[i : i + 4096]).replace(b"\1", b"'").decode(), add_special_tokens=False).ids for i in range(0, len(spelled), 4096)]
            flat = np.array([x for ids in got for x in ids], dtype=np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            if ends.size != numbers.size:
                raise ValueError("the tokenizer split a word")
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
            self.ids = np.concatenate([self.ids, flat])

        if self.known.size > REMEMBERED:
            self._forget()
        return self.known.rows(words.hash, words.units, words.from_, words.to, learn)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)
        plain, lowered = [], []
        for i, t in enumerate(texts):
            low = (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()
            if PLAIN.fullmatch(low) and "<|" not in t:
                plain.append(i)
                lowered.append((SHORT.sub(" \x01\\1 ", low) if "'" in low else low).encode())
            else:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
        if plain:
            words = Words(lowered, KINDS)
            row = self._rows(words)
            starts = self.ends[row]
            counts = self.ends[row + 1] - starts
            done = np.concatenate([[0], np.cumsum(counts)])
            ids = self.ids[ranges(starts, counts)].astype("<u4")
            bounds = done[words.first].tolist()
            for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
                out[i] = ids[a:b]
        return out


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The worker's own tokenizer, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def sized(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """(row, doc_id, n, crcs): each document's number of ids with the closing 0, and the CRC-32 of each piece of up to `room` ids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        for batch in slices(batches, "text", SLICE):
            ids = [b.tobytes() + b"\0\0\0\0" for b in coder.encode(texts_of(batch.column(2)))]
            crcs = [[zlib.crc32(b[i : i + 4 * room]) for i in range(0, len(b), 4 * room)] for b in ids]
            columns = [batch.column(0), batch.column(1), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "crcs"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(made, "row long, doc_id long, n long, crcs array<long>")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    spare: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit f is set if some bin has f left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        if above := mask >> s:
            f = s + (above & -above).bit_length() - 1
            b = spare[f].pop()
            if not spare[f]:
                mask &= ~(1 << f)
            bins[b].append(i)
        else:
            f, b = room, len(bins)
            bins.append([i])
        spare[f - s].append(b)
        mask |= 1 << f - s
    return bins


def _choices(items: list[int], sizes: list[int]) -> list[tuple[int, ...]]:
    """One or two of a bin's items, one choice for each different set of sizes, larger items first. A bin of room r has fewer than sqrt(2r) sizes."""
    by: dict[int, list[int]] = defaultdict(list)
    for i in items:
        by[sizes[i]].append(i)
    order = sorted(by, reverse=True)
    two = [(by[s][0], by[t][s == t]) for n, s in enumerate(order) for t in order[n:] if s != t or len(by[s]) > 1]
    return [(by[s][0],) for s in order] + two


class _Places:
    """Where something could go: by the room that a bin has in place of none, one or two of its items, the bins sorted by what they have left."""

    def __init__(self):
        self.lists: list[dict[int, list[tuple]]] = [{}, {}, {}]
        self.masks = [0, 0, 0]

    def add(self, room: int, left: int, bin_: int, version: int, items: tuple[int, ...]) -> None:
        own = self.lists[len(items)]
        if room not in own:
            own[room] = []
            self.masks[len(items)] |= 1 << room
        insort(own[room], (left, bin_, version, items))

    def find(self, size: int, most: int, given: int, giver: int, version: list[int]) -> tuple[int, tuple[int, ...]] | None:
        """The bin, and what it gives back, that is left fullest by taking `size`, of bins with at most `most` left. At most three items move, and the bin gains."""
        found: tuple[int, int, tuple[int, ...]] | None = None
        for back in range(min(3, 4 - given)):
            # With more room than that, the bin would have to have more left than `most` to gain.
            span = (most if found is None else min(most, found[0] - size)) if most > 0 else 0
            rooms = self.masks[back] >> size & (1 << max(span, 0)) - 1
            while rooms:
                low = rooms & -rooms
                rooms ^= low
                room = size + low.bit_length() - 1
                own = self.lists[back][room]
                k = bisect_right(own, (room - size, math.inf))
                while k < len(own) and own[k][0] <= most:
                    _, bin_, v, items = own[k]
                    if v != version[bin_]:
                        del own[k]
                    elif bin_ == giver:
                        k += 1
                    else:
                        found = room, bin_, items
                        break
                if not own:
                    del self.lists[back][room]
                    self.masks[back] ^= 1 << room
                if found and found[0] == room:
                    break
        return found and found[1:]


def improve(bins: list[list[int]], sizes: list[int], room: int, sweeps: int = SWEEPS) -> list[list[int]]:
    """Empty the emptiest bins: one or two items move to a bin that is at least as full, against none, one or two items of less length, three items at most.

    Every exchange raises the sum of squared fills. All bins that are not full and all their items are tried, the emptiest bins first, until no exchange is left or
    `sweeps` rounds over the bins are done. Items stay whole; empty bins go.
    """
    bins = [list(b) for b in bins]
    left = [room - sum(sizes[i] for i in b) for b in bins]
    loose = [b for b in range(len(bins)) if left[b] > 0]
    version = [0] * len(bins)
    places = _Places()

    def offer(b: int) -> None:
        if left[b] > 0 and bins[b]:
            for items in ((), *_choices(bins[b], sizes)):
                places.add(left[b] + sum(sizes[i] for i in items), left[b], b, version[b], items)

    for b in loose:
        offer(b)
    for _ in range(sweeps):
        changed = False
        for giver in sorted((b for b in loose if bins[b] and left[b] > 0), key=lambda b: (-left[b], b)):
            moved = True
            while moved and bins[giver]:
                moved = False
                for out in _choices(bins[giver], sizes):
                    found = places.find(sum(sizes[i] for i in out), left[giver], len(out), giver, version)
                    if not found:
                        continue
                    taker, back = found
                    bins[giver] = [i for i in bins[giver] if i not in out] + list(back)
                    bins[taker] = [i for i in bins[taker] if i not in back] + list(out)
                    for b in (giver, taker):
                        left[b] = room - sum(sizes[i] for i in bins[b])
                        version[b] += 1
                        offer(b)
                    moved = changed = True
                    break
        if not changed:
            break
    return [b for b in bins if b]


def _pack(table: pa.Table, room: int) -> pa.Table:
    table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
    group = table.column("part")[0].as_py()
    ids, n, crcs = (table.column(c).to_pylist() for c in ("doc_id", "n", "crcs"))
    out: list[tuple] = []
    sequence = group << 32
    rest: list[tuple[int, int, int]] = []
    for d, total in enumerate(n):
        for p in range(total // room):
            out.append((ids[d], p, p * room, room, crcs[d][p], sequence, 0))
            sequence += 1
        if total % room:
            rest.append((d, total // room, total % room))
    sizes = [s for *_, s in rest]
    for items in improve(best_fit(sizes, room), sizes, room):
        offset = 0
        for i in items:
            d, p, s = rest[i]
            out.append((ids[d], p, p * room, s, crcs[d][p], sequence, offset))
            offset += s
        sequence += 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def pack(docs: DataFrame, path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text), with their place in sequences of at most `room` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. Each row is a document of its own, repeated rows and null ids
    included. A null or empty text is the id 0 alone. Documents longer than `room` are cut into pieces of `room` ids and a rest; the full
    pieces are sequences by themselves. An empty table gives an empty one.
    """
    parts = max(1, -(-docs.count() // group))
    dealt = sized(docs, path, room).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInArrow(lambda t: _pack(t, room), schema)

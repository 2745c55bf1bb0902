"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit position i has a nonzero vector m(i) of radius + 1 bits, and for every nonzero vector v of that width
there is one table whose mask holds the positions with an odd inner product <m(i), v>. Two fingerprints that differ in at most `radius`
positions span at most `radius` dimensions, so some v is orthogonal to all of them: the pair agrees on that whole mask and meets in that
table. So no pair within the radius is lost, whatever the data.

Buckets hold distinct fingerprints only. A bucket of up to HELD of them is searched breadth first and gives a spanning forest of its links.
A larger one is passed on and resolved exactly through common neighbours: two fingerprints within three bits have a point z within one bit of
one and two bits of the other, and all points within two bits of z are within three bits of any that is within one, so linking each to the smallest of these
gives the same components at a cost linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.components import components
from changelake.llm.frames import settle, slices, sorted_groups, texts_of

BITS, RADIUS, SHINGLE, SEED, HELD = 64, 3, 3, 42, 4096


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 covering masks of so many bits, as unsigned integers."""
    width = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 7) % width for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, width + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The SimHash of a whole text over its word shingles, repeats included; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-width]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the points' links, breadth first."""
    left, edges = points, []
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _bucket_links(batches: Iterator[pa.RecordBatch], held: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links (table -1) from sorted buckets, and the rows of buckets that are too large to hold, unchanged."""
    rest: list[dict[str, np.ndarray]] = []

    def out(t, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (t, key, a, b)], names=["t", "key", "a", "b"])

    def drained():
        while rest:
            c = rest.pop()
            yield out(c["t"], c["key"], c["fp"], c["fp"])

    for columns, bounds in sorted_groups(batches, ["t", "key"], ["fp"], held, rest.append):
        yield from drained()
        sizes, fp, edges = np.diff(bounds), columns["fp"], []
        two = bounds[:-1][sizes == 2]
        close = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
        edges += zip(fp[close].tolist(), fp[close + 1].tolist(), strict=True)
        for g in np.flatnonzero(sizes > 2):
            edges += _forest(fp[bounds[g] : bounds[g + 1]], radius)
        if edges:
            a, b = np.array(edges, dtype=np.int64).T
            yield out(np.full(a.size, -1), np.zeros(a.size), a, b)
    yield from drained()


def _neighbours(batches: Iterator[pa.RecordBatch], covers: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """For each fingerprint of a large bucket, the points z within radius - 1 bits outside the bucket's mask, and the distance."""
    flips: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t, mask in enumerate(covers):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        found = [(0, 0)] + [(sum(c), d) for d in range(1, radius) for c in combinations(free, d)]
        flips[t] = np.array([signed(x) for x, _ in found], dtype=np.int64), np.array([d for _, d in found], dtype=np.int64)
    for batch in batches:
        for t, key, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x, d = flips[t]
            columns = [np.full(x.size, t), np.full(x.size, key), x ^ fp, np.full(x.size, fp), d]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["t", "key", "z", "fp", "d"])


def links(points: DataFrame, held: int = HELD, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the distinct longs `fp` exactly as all pairs within `radius` bits do. Empty in, empty out."""
    covers = masks(radius)
    tables = F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(covers)))
    rows = points.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    met = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = settle(met.mapInArrow(lambda it: _bucket_links(it, held, radius), "t long, key long, a long, b long"))
    near = found.where("t < 0").select("a", "b")
    large = found.where("t >= 0").select("t", "key", F.col("a").alias("fp"))
    if not large.isEmpty():
        around = large.mapInArrow(lambda it: _neighbours(it, covers, radius), "t long, key long, z long, fp long, d long")
        hub = around.groupBy("t", "key", "z").agg(F.min(F.when(F.col("d") <= 1, F.col("fp"))).alias("hub")).where("hub is not null")
        near = near.unionByName(around.join(hub, ["t", "key", "z"]).where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())
    return near


def near_duplicates(docs: DataFrame, held: int = HELD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that chains of links reach, the row's own included. Rows with equal fingerprints are one class, which
    is linked once and never expanded into pairs. A null text is empty; empty texts have fingerprint zero and link like any other. A null
    doc_id stays null and is no component's name unless all of its component's are null. Repeated rows give repeated rows; an empty table
    gives an empty one.
    """
    rows = settle(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = settle(classes)
    roots = components(links(classes.select("fp"), held, radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")

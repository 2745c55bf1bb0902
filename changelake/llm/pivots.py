"""Embedding near-duplicates through a pivot-permutation index.

Pivots are vectors of a bounded sample, no two of them near each other: in a dense group, many pivots of the group itself would rank by noise alone.
Every vector is described by its nearest pivots, in order, and stands in the inverted list of each of them. How near pivots may be, whether vectors are
centred first, and how many pivots describe a vector follow from the sample: of the indexes that find enough pairs of its held-out part, the one with the fewest
comparisons is taken. Two vectors are candidates if they share at least SHARED of those pivots; they are met once, in the list of the first pivot that they
share, and there the cosine is computed in double precision. Equal vectors are one class, which is never expanded into pairs. A list of over SPLIT blocks is
parted by the second pivot that candidates share. A list that is longer than BLOCK is cut into blocks, and each pair of blocks is a task's work, so no
task holds more than two blocks and no pair is lost. Each block pair returns counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.components import components
from changelake.llm.frames import settle

THRESHOLD = 0.9
#: The index is fitted on three times this many vectors at most, picked by a hash; PREFIX nearest pivots describe a vector, or up to four times as many.
MOST_PIVOTS, PREFIX, SHARED, BLOCK, SPLIT = 4096, 12, 2, 2048, 8
#: No two pivots have a cosine above one of these. How many vectors are held out at most, and the share to be found of their pairs and of pairs made at the threshold.
SPREADS, HELD_OUT, FOUND, FOUND_AT_THRESHOLD = (0.7, 0.9), 2048, 0.95, 0.9
#: Room for rounding in the single-precision screen that precedes double precision.
SLACK = 1e-4


def pivots_for(classes: int) -> int:
    """How many pivots index so many classes: lists grow slowly, and so does the cost of finding the nearest pivots."""
    return int(min(MOST_PIVOTS, max(16, 4 * math.sqrt(classes))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, or zeros. Rows are scaled by their largest component first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top == 0, 1, top)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def spread(candidates: np.ndarray, most: int, limit: float) -> np.ndarray:
    """Up to `most` of the unit vectors, in their order, without any that is too near to one taken before."""
    taken = np.empty((0, candidates.shape[1]))
    for start in range(0, len(candidates), 256):
        some = candidates[start : start + 256]
        some = some[(some @ taken.T).max(axis=1, initial=-1.0) <= limit]
        inner, kept = some @ some.T, []
        for i in range(len(some)):
            if not kept or inner[i, kept].max() <= limit:
                kept.append(i)
        taken = np.concatenate([taken, some[kept]])
        if len(taken) >= most:
            break
    return taken[:most]


class Index:
    """Pivots around a centre, and how many of them describe a vector."""

    def __init__(self, centre: np.ndarray, pivots: np.ndarray, prefix: int):
        self.centre, self.pivots, self.prefix = centre, pivots, min(prefix, len(pivots))

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The numbers of each unit vector's nearest pivots, the nearest first."""
        near = unit(vectors - self.centre) @ self.pivots.T
        top = np.argpartition(-near, self.prefix - 1, axis=1)[:, : self.prefix]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1).astype(np.int32)

    def found(self, a: np.ndarray, b: np.ndarray, shared: int) -> float:
        """The share of pairs of unit vectors that are candidates."""
        if not len(a):
            return 1.0
        x, y = self.nearest(a), self.nearest(b)
        both = np.array([(p[:, None] == q[None, :]).sum() for p, q in zip(x, y, strict=True)])
        return float((both >= min(shared, self.prefix)).mean())

    def cost(self, vectors: np.ndarray) -> float:
        """Comparisons within lists, as a share of all pairs of these unit vectors."""
        return float(((np.bincount(self.nearest(vectors).ravel(), minlength=len(self.pivots)) / len(vectors)) ** 2).sum())


def fit(sample: np.ndarray, want: int, threshold: float, prefix: int, shared: int) -> Index:
    """The index of up to `want` pivots with the fewest comparisons that finds enough pairs of the sample's held-out unit vectors; the most thorough one if none does.

    The pairs are those within the threshold among the held-out vectors, and each of them with a vector made to be at the threshold. An index of few pivots
    finds all pairs by comparing all, which only grows with the table, so it is the last resort.
    """
    known, held = sample[: 2 * want], sample[2 * want :][:HELD_OUT]
    held = held if len(held) >= 64 else known[:HELD_OUT]
    rng = np.random.default_rng(0)
    off = rng.normal(size=held.shape)
    off = unit(off - (off * held).sum(axis=1, keepdims=True) * held)
    made = threshold * held + math.sqrt(max(0.0, 1 - threshold * threshold)) * off
    i, j = np.nonzero(np.triu(held @ held.T >= threshold, 1))
    if len(i) > HELD_OUT:
        some = rng.choice(len(i), HELD_OUT, replace=False)
        i, j = i[some], j[some]
    best: tuple[bool, float, Index] | None = None
    for length in (n * prefix // 2 for n in (2, 3, 4, 6, 8)):
        good: list[tuple[float, Index]] = []
        for centre in (np.zeros(sample.shape[1]), known.mean(axis=0)):
            around = unit(known - centre)
            around = around[np.abs(around).max(axis=1) > 0]
            for limit in SPREADS if len(around) else ():
                index = Index(centre, spread(around, want, limit), length)
                share = min(index.found(held, made, shared) / FOUND_AT_THRESHOLD, index.found(held[i], held[j], shared) / FOUND)
                enough = len(index.pivots) >= min(want, len(known)) / 4
                if share >= 1 and enough:
                    good.append((index.cost(held), index))
                if best is None or (enough, share) > best[:2]:
                    best = enough, share, index
        if good:
            return min(good, key=lambda x: x[0])[1]
    return best[2]


def _described(index: Index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, width)
            top = index.nearest(unit(vectors)) if batch.num_rows else np.empty((0, index.prefix), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, index.prefix, dtype=np.int32)), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["class", "vector", "copies", "near"])

    return run


def _verify(table: pa.Table, width: int, threshold: float, shared: int) -> pa.Table:
    """Counts and a spanning forest of one pair of blocks of a list, which `second` may have parted."""
    pivot, second, left, right = (table.column(c)[0].as_py() for c in ("pivot", "second", "left", "right"))
    ids, copies = np.asarray(table.column("class")), np.asarray(table.column("copies"))
    block = np.asarray(table.column("block"))
    flat = table.column("vector").combine_chunks().flatten()
    x = unit(np.asarray(flat, dtype=np.float64).reshape(len(ids), width))
    near = np.sort(np.asarray(table.column("near").combine_chunks().flatten()).reshape(len(ids), -1), axis=1)
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    degree = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges: list[tuple[int, int]] = []
    narrow = x.astype(np.float32)
    for s in range(0, a.size, 256):
        some = a[s : s + 256]
        rows, columns = np.nonzero(narrow[some] @ narrow[b].T >= threshold - SLACK)
        i, j = some[rows], b[columns]
        keep = i < j if left == right else np.ones(i.size, dtype=bool)
        i, j = i[keep], j[keep]
        step = max(1, (1 << 23) // near.shape[1] ** 2)
        for t in range(0, i.size, step):
            p, q = i[t : t + step], j[t : t + step]
            alike = near[p][:, :, None] == near[q][:, None, :]
            common = alike.any(axis=2)
            nth = np.cumsum(common, axis=1)
            met = lambda n: np.where(nth[:, -1] >= n, near[p][np.arange(p.size), (nth >= n).argmax(axis=1)], -1)  # noqa: B023, E731
            ok = (nth[:, -1] >= min(shared, near.shape[1])) & (met(1) == pivot) & ((second < 0) | (met(2) == second))
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[ok], q[ok]
            np.add.at(degree, p, copies[q])
            np.add.at(degree, q, copies[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[rv] = ru
                    edges.append((u, v))
    counted = np.flatnonzero(degree)
    u = np.array([e[0] for e in edges], dtype=np.int64)
    v = np.array([e[1] for e in edges], dtype=np.int64)
    none = pa.nulls(counted.size, pa.int64())
    return pa.table(
        {
            "class": pa.concat_arrays([pa.array(ids[counted]), pa.array(ids[u] if u.size else u)]),
            "other": pa.concat_arrays([none, pa.array(ids[v] if v.size else v)]),
            "n": pa.concat_arrays([pa.array(degree[counted]), pa.array(np.zeros(u.size, dtype=np.int64))]),
        }
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding; other columns are ignored).

    n_links counts the other rows linked directly, copies included; component_id is the smallest vec_id reachable, the row's own included; kept says
    whether the two are equal. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different lengths with each other. A null vec_id stays null and names no component unless all of its component's are null. Repeated rows are copies of one
    another. An empty table gives an empty one.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    # -0.0 and 0.0 are the same component, so copies are equal in every bit.
    numbered = base.withColumn("sound", sound).withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))))
    grouped = numbered.where("sound").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # A class gets a number of its own, which is settled with it.
    classes = settle(grouped.withColumn("class", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    widths = [r["width"] for r in classes.select("width").distinct().collect()]
    found = None
    for width in sorted(widths):
        own = classes.where(F.col("width") == width)
        part = _links(own, width, threshold, prefix, shared, block, most_pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = settle(found)
    roots = components(found.where("other is not null").select("class", "other"))
    degree = found.where("other is null").groupBy("class").agg(F.sum("n").alias("n"))
    named = classes.join(degree, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    of = named.join(smallest, "root").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = numbered.where("sound").join(of, "vector").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = numbered.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, width: int, threshold: float, prefix: int, shared: int, block: int, most_pivots: int) -> DataFrame:
    """(class, other, n): a class's linked rows as n, and edges with another class, for vectors of one length."""
    count = classes.count()
    want = min(pivots_for(count), most_pivots, count)
    # A hash order that a copy cannot sway; the sample is bounded by three times most_pivots.
    picked = classes.orderBy(F.xxhash64("vector", F.lit("pivot")), "vector").select("vector").limit(3 * want).collect()
    index = fit(unit(np.array([r["vector"] for r in picked], dtype=np.float64)), want, threshold, prefix, shared)
    described = classes.select("class", "vector", "copies").mapInArrow(_described(index, width), f"class long, vector {classes.schema['vector'].dataType.simpleString()}, copies long, near array<int>")
    described = settle(described)
    sizes = described.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("members"))
    # One row per pivot, and there are most_pivots of these at most.
    listed = described.withColumn("pivot", F.explode("near")).join(F.broadcast(sizes), "pivot")
    none = F.array(F.lit(-1))
    if shared >= 2 and index.prefix >= 2:
        # In a list parted by the second pivot, a vector that has no further one cannot share two.
        none = F.when(F.col("members") > SPLIT * block, F.filter("near", lambda x: x > F.col("pivot"))).otherwise(none)
    parted = listed.withColumn("second", F.explode(none))
    parts = parted.where("second >= 0").groupBy("pivot", "second").agg(F.count("*").alias("part"))
    sized = parted.where("second < 0").withColumn("part", F.col("members")).unionByName(parted.where("second >= 0").join(parts, ["pivot", "second"]))
    blocked = sized.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("part") / block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = blocked.withColumn("partner", partner).withColumn("left", F.least("block", "partner")).withColumn("right", F.greatest("block", "partner"))
    wanted = ["class", "vector", "copies", "near", "pivot", "second", "block", "left", "right"]
    return dealt.select(*wanted).groupBy("pivot", "second", "left", "right").applyInArrow(lambda t: _verify(t, width, threshold, shared), "class long, other long, n long")

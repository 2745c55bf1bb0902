"""Documents of similar word shingles, by covering LSH over long SimHash fingerprints and exact verification.

A fingerprint of 128 bits over a document's distinct shingles is cut into PARTS parts, each with the covering masks of RADIUS. If two fingerprints differ in fewer
than PARTS * (RADIUS + 1) bits, some part differs in RADIUS bits or fewer, and the pair meets in one of that part's tables. Documents of 0.8 similarity differ in about
15 % of the bits; most of those beyond the radius still meet by chance in some table. In a bucket, pairs within NEAR bits
are linked by a spanning forest of the nearest ones; its edges are verified on the whole shingle sets. Where an edge fails and leaves two verified components apart,
the other pairs between such components are verified in further rounds, the nearest TRIED ones of each document first and four times as many each round, until none
is left. Before these rounds the shingles that stand in one document of such components alone are counted: they bound the similarity of a document to any other, so
pairs that cannot be similar are left out. A bucket of over HELD members is cut into blocks, and every pair of blocks is searched in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.components import components
from changelake.llm.frames import maybe, settle, slices, sorted_groups, text_key, texts_of
from changelake.llm.simhash import masks, signed

WIDTH, SIMILARITY = 5, 0.8
PARTS, RADIUS, NEAR, HELD, TRIED = 4, 4, 34, 2048, 8
SEED = 42


def shingles(text: str, width: int = WIDTH) -> list[bytes]:
    """The word shingles of a text, A to Z lower-cased; all words together if they are fewer than `width`."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]])
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, width)], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles by all shingles of two sets."""
    shared = np.intersect1d(a, b, assume_unique=True).size
    return shared / (a.size + b.size - shared)


def _marks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in slices(batches, "text"):
        out = []
        for t in texts_of(batch.column(2)):
            rows = np.frombuffer(b"".join({digest(s, SEED) for s in shingles(t, width)}), dtype=np.uint8).reshape(-1, 16)
            ones = np.zeros(128, dtype=np.int64)
            for i in range(0, len(rows), 1 << 15):
                ones += np.unpackbits(rows[i : i + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            own = np.packbits(2 * ones > len(rows), bitorder="little").view("<i8")
            whole = np.frombuffer(digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), SEED), dtype="<i8")
            out.append((*whole, *own))
        columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "h1", "h2", "f1", "f2"])


def _distance(f1: np.ndarray, f2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count((f1[i] ^ f1[j]).view(np.uint64)).astype(np.int16) + np.bitwise_count((f2[i] ^ f2[j]).view(np.uint64))


def _close(c: dict[str, np.ndarray], bounds: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of row numbers of one group within `near` bits, with their distances. Rows of a group follow each other; pairs are tried by their offset."""
    group = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    out, left = [], np.arange(group.size)
    for k in range(1, int(np.diff(bounds).max(initial=0))):
        left = left[left + k < group.size]
        left = left[group[left] == group[left + k]]
        for start in range(0, left.size, 1 << 20):
            some = left[start : start + (1 << 20)]
            d = _distance(c["f1"], c["f2"], some, some + k)
            hit = d <= near
            if hit.any():
                out.append((some[hit], some[hit] + k, d[hit]))
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, nearest ones first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    order = np.argsort(d, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            edges.append((a, b))
    return edges


def _edges(c: dict[str, np.ndarray], bounds: np.ndarray, near: int, tried: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges and their kinds: -1 is to be verified, -2 stands for pairs between two components that are left for later.

    Without roots, a spanning forest is to be verified. With roots, all pairs between different roots are that are among the `tried` nearest of one of their ends;
    with `size` shingles in all, of which `shared` stand elsewhere, two documents cannot have more in common than the fewer of their shared ones.
    """
    i, j, d = _close(c, bounds, near)
    if "root" not in c:
        a, b = np.array(_forest(i, j, d), dtype=np.int64).reshape(-1, 2).T
        return c["node"][a], c["node"][b], np.full(a.size, -1)
    common = np.minimum(c["shared"][i], c["shared"][j])
    apart = (c["root"][i] != c["root"][j]) & (common >= least * (c["size"][i] + c["size"][j] - common) - 1e-9)
    i, j, d = i[apart], j[apart], d[apart]
    ends, far = np.concatenate([i, j]), np.concatenate([d, d])
    order = np.lexsort((far, ends))
    starts = np.flatnonzero(np.diff(ends[order], prepend=-1))
    rank = np.empty(ends.size, dtype=np.int64)
    rank[order] = np.arange(ends.size) - np.repeat(starts, np.diff(np.append(starts, ends.size)))
    now = np.minimum(rank[: i.size], rank[i.size :]) < tried
    # One row for all rows of a root in a group.
    group = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    _, one, of = np.unique(np.stack([group, c["root"]]), axis=1, return_index=True, return_inverse=True)
    row = one[of.reshape(-1)]
    x, y = np.array(_forest(row[i[~now]], row[j[~now]], d[~now]), dtype=np.int64).reshape(-1, 2).T
    a, b = np.concatenate([i[now], x]), np.concatenate([j[now], y])
    return c["node"][a], c["node"][b], np.repeat([-1, -2], [int(now.sum()), x.size])


COLUMNS = ["t", "key", "node", "f1", "f2"]


def _met(batches: Iterator[pa.RecordBatch], held: int, near: int, tried: int, least: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Edges (t -1 or -2, between key and node) of sorted buckets, and the rows of buckets too large to hold, unchanged."""
    rest: list[dict[str, np.ndarray]] = []

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in columns], names=names)

    for c, bounds in sorted_groups(batches, ["t", "key"], names[2:], held, rest.append):
        while rest:
            yield out(*(rest[-1][n] for n in names))
            rest.pop()
        several = np.diff(bounds) > 1
        keep = np.repeat(several, np.diff(bounds))
        if keep.any():
            sizes = np.diff(bounds)[several]
            a, b, kind = _edges({n: c[n][keep] for n in names}, np.concatenate([[0], np.cumsum(sizes)]), near, tried, least)
            if a.size:
                yield out(kind, a, b, *(np.zeros(a.size) for _ in names[3:]))
    while rest:
        yield out(*(rest[-1][n] for n in names))
        rest.pop()


def _blocks(table: pa.Table, near: int, tried: int, least: float, names: list[str]) -> pa.Table:
    c = {n: np.asarray(table.column(n)) for n in names[2:]}
    a, b, kind = _edges(c, np.array([0, table.num_rows]), near, tried, least)
    return pa.table({"t": pa.array(kind, pa.int64()), "key": a, "node": b})


def candidates(classes: DataFrame, held: int = HELD, near: int = NEAR, tried: int = TRIED, least: float = SIMILARITY) -> DataFrame:
    """Distinct edges (a, b, later) between the nodes of `classes` (node, f1, f2), which connect what pairs within `near` bits that meet in a table do.

    If the classes have a root each, and the counts of `unshared`, edges join different roots only: those to be verified, and, as later, some that connect the roots
    of all other pairs. Pairs that cannot have a similarity of `least` are left out.
    """
    bits = 128 // PARTS
    tables = []
    for part in range(PARTS):
        column, shift = ("f1", "f2")[part * bits // 64], part * bits % 64
        tables += [F.struct(F.lit(len(tables) + n).cast("long").alias("t"), F.col(column).bitwiseAND(F.lit(signed(m << shift))).alias("key")) for n, m in enumerate(masks(RADIUS, bits))]
    names = [*COLUMNS, *(["root", "size", "shared"] if "root" in classes.columns else [])]
    rows = classes.select(*names[2:], F.explode(F.array(*tables)).alias("x")).select("x.t", "x.key", *names[2:])
    schema = ", ".join(f"{n} long" for n in names)
    met = settle(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda it: _met(it, held, near, tried, least, names), schema))
    edges = met.where("t < 0").select("t", "key", "node")
    large = met.where("t >= 0")
    if not large.isEmpty():
        counts = large.groupBy("t", "key").agg(F.ceil(F.count("*") / held).cast("int").alias("blocks"))
        blocked = large.join(counts, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        edges = edges.unionByName(dealt.groupBy("t", "key", "low", "high").applyInArrow(lambda t: _blocks(t, near, tried, least, names), "t long, key long, node long"))
    return edges.select(F.least("key", "node").alias("a"), F.greatest("key", "node").alias("b"), (F.col("t") == -2).alias("later")).where("a < b").distinct()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_set(t, width).tobytes() for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similarity(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _read(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node), by the texts of their classes' first documents; repeated rows repeat."""
    first = settle(classes.select("node", F.col("at.id").alias("id"), F.col("at.t").alias("own")).join(nodes, "node", "left_semi"))
    near = maybe(texts, "doc_id", first.select("id")).withColumn("t", text_key())
    return near.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("own"))).select("node", "text")


def _sure(texts: DataFrame, classes: DataFrame, edges: DataFrame, width: int, least: float) -> DataFrame:
    """The edges (a, b) whose texts are similar. A class's words are those of its first document."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _read(texts, classes, ends).mapInArrow(lambda it: _sets(it, width), "node long, set binary")
    sets = settle(sets.groupBy("node").agg(F.min("set").alias("set")))
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    pairs = edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return settle(pairs.mapInArrow(lambda it: _verified(it, least), "a long, b long"))


def _listed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_set(t, width).view(np.int64) for t in texts_of(batch.column(1))]
        ends = np.concatenate([[0], np.cumsum([x.size for x in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])


def unshared(texts: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, size, shared): how many shingles a node's document has, and how many of these stand in another node's as well. Shingles are counted before the shuffle."""
    listed = _read(texts, classes, nodes).mapInArrow(lambda it: _listed(it, width), "node long, shingles array<long>")
    once = listed.select("node", F.explode("shingles").alias("h")).distinct()
    places = once.groupBy("h").agg(F.count("*").alias("places"), F.min("node").alias("node"))
    alone = places.where("places = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = once.groupBy("node").agg(F.count("*").alias("size"))
    return sizes.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def groups(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, held: int = HELD, near: int = NEAR) -> DataFrame:
    """(doc_id, t, component_id, first) for each document of `docs` (doc_id, text), which is known by its doc_id, null or not, and `text_key`.

    component_id is the smallest doc_id that chains of verified similarities of `least` or more reach, null if all of them are; `first` marks one document of
    each such component, that of the smallest (doc_id, t). A null doc_id comes after all others. Documents of the same words are one class and never expanded into
    pairs; repeated rows are one document. Null texts are empty; texts without words are alike. An empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = texts.select("doc_id", text_key().alias("t"), "text").mapInArrow(lambda it: _marks(it, width), "doc_id long, t binary, h1 long, h2 long, f1 long, f2 long")
    rows = settle(marks.distinct())
    words = ["h1", "h2", "f1", "f2"]
    own = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "t")
    # A class gets a number of its own, which is settled with it.
    classes = settle(rows.groupBy(*words).agg(F.min(own).alias("at")).withColumn("node", F.monotonically_increasing_id()))
    edges = settle(candidates(classes.select("node", "f1", "f2"), held, near))
    roots = components(_sure(texts, classes, edges, width, least))
    named = settle(classes.select("node", "f1", "f2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tried, left, counts = TRIED, edges, None
    while True:
        # Edges that failed, or are left for later, and still have their ends apart; whatever pair is left starts in the component of such an end.
        ends = [named.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
        apart = left.join(ends[0], "a").join(ends[1], "b").where("root_a != root_b")
        open_ = settle(apart.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct())
        if open_.isEmpty():
            break
        members = named.join(open_, "root", "left_semi")
        # Later rounds have no other documents than the first, so its counts still bound them.
        counts = settle(unshared(texts, classes, members.select("node"), width)) if counts is None else counts
        edges = settle(candidates(members.join(counts, "node").select("node", "f1", "f2", "root", "size", "shared"), held, near, tried, least))
        sure = _sure(texts, classes, edges.where("not later"), width, least)
        joined = components(sure.join(ends[0], "a").join(ends[1], "b").select("root_a", "root_b")).select(F.col("node").alias("root"), F.col("root").alias("lower"))
        named = settle(named.join(joined, "root", "left").withColumn("root", F.coalesce("lower", "root")).drop("lower"))
        tried, left = 4 * tried, edges.where("later")
    rooted = classes.select(*words, "node", "at").join(named.select("node", "root"), "node")
    smallest = rooted.groupBy("root").agg(F.min("at").alias("lowest"))
    of = rooted.join(smallest, "root").select(*words, "lowest")
    return rows.join(of, words).select("doc_id", "t", F.col("lowest.id").alias("component_id"), (own == F.col("lowest")).alias("first"))

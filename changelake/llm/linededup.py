"""Removal of repeated passages of lines, by windows of words and content-defined chunks.

Every run of LONG words or more that stands elsewhere first is the union of its windows: for each line, the shortest runs of LONG words or more that begin
or end with it. A rolling hash over the hashes of neighbouring lines cuts texts into chunks besides, whose boundaries follow the content, so that chunks of
several lines are found even if they have fewer words. Windows, chunks of several lines and whole texts are looked up by hash over the whole corpus; the
first place of each keeps it, and every other place loses it once its bytes have been compared with those of the first.

A document is known by its doc_id, null or not, and 128 bits of its text's SHA-256. Of rows that agree in both, one is that document and the others are its
copies, which lose all that repeats. A hash that stands in more than one of HOT rows may have any number of places: these meet its first place by a broadcast of
at most HOT rows, so no task has all places of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import fresh, maybe, settle, slices, stored, text_key

#: On average every MEAN-th line ends a chunk; LONG words make a window, and a line a chunk of its own; a chunk has MOST lines at most.
WINDOW, MEAN, LONG, MOST = 2, 3, 50, 256
#: Hashes with more than this share of all places, as its reciprocal, are broadcast: there are fewer of them than this.
HOT = 1024
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of all chunks, in order; together they are all lines."""
    return _chunks([xxhash.xxh64_intdigest(x) for x in lines], [len(x.split()) >= LONG for x in lines])


def _chunks(hashes: list[int], long: list[bool]) -> list[tuple[int, int]]:
    out, start = [], 0
    for i in range(len(hashes)):
        roll = 0
        for h in hashes[max(0, i - WINDOW + 1) : i + 1]:
            roll = (roll * FACTOR + h) & MASK
        if long[i] or (i + 1 < len(long) and long[i + 1]) or (i and (roll >> 32) % MEAN == 0) or i + 1 - start == MOST or i + 1 == len(long):
            out.append((start, i + 1))
            start = i + 1
    return out


def windows(words: list[int]) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of LONG words or more from each line and up to each line, by the lines' words.

    Lines without words neither begin nor end one. Any run of LONG words or more is a union of such windows, but for lines without words at its ends.
    """
    filled = [i for i, n in enumerate(words) if n]
    out, first, last, total = set(), 0, 0, 0
    for i in filled:
        while last < len(filled) and total < LONG:
            total += words[filled[last]]
            last += 1
        if total < LONG:
            break
        out.add((i, filled[last - 1] + 1))
        total -= words[i]
    total = 0
    for i in filled:
        total += words[i]
        while total - words[filled[first]] >= LONG:
            total -= words[filled[first]]
            first += 1
        if total >= LONG:
            out.add((filled[first], i + 1))
    return out


def candidates(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, signed hash) of the runs that may be removed: windows, and chunks of several lines and the whole text, with and without the empty lines at its ends, if not all empty."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    words = [len(x.split()) for x in lines]
    found = windows(words)
    filled = [i for i, n in enumerate(words) if n]
    whole = [(0, len(lines)), (filled[0], filled[-1] + 1)] if filled else []
    found.update((a, b) for a, b in [*_chunks(hashes, [n >= LONG for n in words]), *whole] if b - a > 1 and any(words[a:b]))
    packed = np.array(hashes, dtype="<u8").tobytes()
    return [(a, b, xxhash.xxh64_intdigest(packed[8 * a : 8 * b]) - (1 << 63)) for a, b in sorted(found)]


def _lines(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split(b"\n") for t in column.cast(pa.binary()).to_pylist()]


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of no lines for each document, and one for each of its candidates."""
    for batch in slices(batches, "text"):
        rows = []
        for doc, t, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lines(batch.column(2)), strict=True):
            rows.append((doc, t, 0, 0, 0))
            rows += [(doc, t, a, b - a, h) for a, b, h in candidates(lines)]
        yield _batch(rows, id=pa.int64(), t=pa.binary(), line=pa.int32(), n=pa.int32(), h=pa.int64())


def cover(runs: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of few of the runs (first line that goes, line after the last, any), which have all the lines of all: no line is in more than two."""
    order = sorted(range(len(runs)), key=lambda i: runs[i][:2])
    out, end, at = [], -1, 0
    while at < len(order):
        best, limit = order[at], max(end, runs[order[at]][0])
        while at < len(order) and runs[order[at]][0] <= limit:
            best = max(best, order[at], key=lambda i: runs[i][1])
            at += 1
        if runs[best][1] > end:
            out.append(best)
            end = runs[best][1]
    return out


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's repeated runs those that cover all. Where a run overlaps its own first place, the lines of that place stay."""
    for batch in batches:
        rows = []
        for doc, t, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = []
            for r in listed:
                at = r["at"]
                own = at["id"] == doc and at["t"] == t
                start = max(r["line"], at["line"] + r["n"]) if own else r["line"]
                runs.append((start, r["line"] + r["n"], r))
            for i in cover(runs):
                start, _, r = runs[i]
                at = r["at"]
                rows.append((doc, t, r["line"], r["n"], r["h"], start - r["line"], at["id"], at["t"], at["line"]))
        long, int_, key = pa.int64(), pa.int32(), pa.binary()
        yield _batch(rows, id=long, t=key, line=int_, n=int_, h=long, skip=int_, id0=long, t0=key, line0=int_)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed runs of each text."""
    for batch in slices(batches, "text"):
        rows = []
        for doc, t, lines, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lines(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            rows += [(doc, t, r["line"], r["n"], r["h"], r["skip"], b"\n".join(lines[r["line"] : r["line"] + r["n"]])) for r in listed]
        long, int_ = pa.int64(), pa.int32()
        yield _batch(rows, id=long, t=pa.binary(), line=int_, n=int_, h=long, skip=int_, body=pa.binary())


def _met(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of repeated hashes, each with the first place `at`."""
    least = rows.count() // HOT
    first = first.withColumnRenamed("h", "same")
    hot, cold = first.where(F.col("places") > least), first.where(F.col("places") <= least)
    met = F.col("h") == F.col("same")
    return rows.join(F.broadcast(hot), met).unionByName(maybe(rows, "h", cold.select("same")).join(cold, met)).drop("same", "places")


def deduplicate(docs: DataFrame, n_lines: str = "n_lines", removed_lines: str = "removed_lines") -> DataFrame:
    """`docs` (doc_id, text and any other columns) with repeated runs of lines cut from text, and how many lines a text had and lost.

    Of all places of a run, the one with the smallest (doc_id, text's hash, line) stays; null ids come first. Of rows that share a doc_id, null included, and a
    text, any one counts as the first. A run whose hash repeats but whose bytes differ from the first one's stays. Texts without
    repeats are returned unchanged; a null text stays null and has no lines; a text of several lines, or of LONG words, that is repeated as a whole becomes
    empty. All rows come back, an empty table gives an empty one, and columns with the names of the two counts are replaced.
    """
    docs = docs.drop(n_lines, removed_lines)
    key, sum_, nth, other, others, listed = fresh(docs, "key", "sum", "nth", "other", "others", "listed")
    dealt = docs.withColumns({key: F.col("doc_id").cast("long"), sum_: text_key()})
    all_ = settle(dealt.select(F.col(key).alias("id"), F.col(sum_).alias("t"), "text").mapInArrow(_found, "id long, t binary, line int, n int, h long"))
    rows = all_.where("n > 0")
    same = F.col("id").eqNullSafe(F.col("at.id")) & (F.col("t") == F.col("at.t"))
    first = settle(rows.groupBy("h").agg(F.count("*").alias("places"), F.min(F.struct("id", "t", "line")).alias("at")).where("places > 1"))
    marked = _met(rows, first).where(~(same & (F.col("line") == F.col("at.line"))))
    runs = marked.groupBy("id", "t").agg(F.collect_set(F.struct("line", "n", "h", "at")).alias("runs"))
    chosen = settle(runs.mapInArrow(_chosen, "id long, t binary, line int, n int, h long, skip int, id0 long, t0 binary, line0 int"))
    kept_ = chosen.select(F.col("id0").alias("id"), F.col("t0").alias("t"), F.col("line0").alias("line"), "n", "h", F.lit(-1).alias("skip"))
    wanted = chosen.select(*kept_.columns).unionByName(kept_)
    marks = settle(wanted.groupBy(F.col("id").alias(other), F.col("t").alias(others)).agg(F.collect_set(F.struct("line", "n", "h", "skip")).alias(listed)))
    met = F.col(key).eqNullSafe(F.col(other)) & (F.col(sum_) == F.col(others))
    one, copies = _copies(dealt, all_.where("n = 0"), key, sum_, nth, other, others, met)
    having = maybe(one, sum_, marks.select(others)).join(marks, met).select(key, sum_, "text", listed)
    bodies = settle(having.mapInArrow(_bodies, "id long, t binary, line int, n int, h long, skip int, body binary"))
    # A hash has one first place, so it has one body here, and both sides are tables whose hot hashes can be split.
    kept = bodies.where("skip < 0").select("h", "n", F.col("body").alias("kept"))
    equal = bodies.where("skip >= 0").join(kept, ["h", "n"]).where("body = kept")
    cuts = equal.groupBy(F.col("id").alias(other), F.col("t").alias(others)).agg(F.collect_set(F.struct((F.col("line") + F.col("skip")).alias("a"), (F.col("line") + F.col("n")).alias("b"))).alias(listed))
    both = one.join(cuts, met, "left").drop(key, sum_, other, others)
    if copies is not None:
        both = both.unionByName(copies.withColumn(listed, F.array(F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b")))))
    place, where = docs.columns.index("text"), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, counts, removed = [], [], []
            column = batch.column(place)
            for text, cuts_ in zip(column.cast(pa.binary()).to_pylist(), batch.column(where).to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                gone: set[int] = set()
                if cuts_ and text is not None:
                    # A copy of a document loses whatever may be removed at all.
                    for a, b in ((c["a"], c["b"]) for c in cuts_) if cuts_[0]["b"] >= 0 else ((a, b) for a, b, _ in candidates(lines)):
                        gone.update(range(a, b))
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                counts.append(len(lines))
                removed.append(len(gone))
            columns = list(batch.columns[:where])
            columns[place] = pa.array(texts, pa.binary()).cast(column.type)
            names = batch.schema.names[:where]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_lines, removed_lines])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{n_lines}` long, `{removed_lines}` long"
    return both.mapInArrow(cut, out)


def _copies(dealt: DataFrame, found: DataFrame, key: str, sum_: str, nth: str, other: str, others: str, met) -> tuple[DataFrame, DataFrame | None]:
    """One row of each document, and the other rows of documents that have several, if any have."""
    several = settle(found.groupBy(F.col("id").alias(other), F.col("t").alias(others)).agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(other, others))
    if several.isEmpty():
        return dealt, None
    # Only these rows are written once more, each with a number of its own, which the rows themselves lack.
    again = stored(dealt.join(several, met, "left_semi").withColumn(nth, F.monotonically_increasing_id()))
    firsts = settle(again.groupBy(key, sum_).agg(F.min(nth).alias(other)).select(other))
    numbered = F.col(nth) == F.col(other)
    one = dealt.join(several, met, "left_anti").unionByName(again.join(firsts, numbered, "left_semi").drop(nth))
    return one, again.join(firsts, numbered, "left_anti").drop(key, sum_, nth)

"""Helpers that the operators share: durable cuts of lineage, Arrow batches and sorted groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The session's spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a folder of its machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `settle`, for rows with texts: a compressed table in the same folder. Types that Parquet lacks are settled instead."""
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):
        return settle(df)
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """The batch's texts; a null text is empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def release() -> None:
    """Return freed memory to the system: workers outlive their tasks, and an executor's memory is theirs and the JVM's together."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `limit` bytes at most, or one row."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
            start, total = 0, 0
            for i, size in enumerate(sizes):
                if total and total + size > limit:
                    yield batch.slice(start, i - start)
                    start, total = i, 0
                total += int(size)
            yield batch.slice(start)
            del batch, column, sizes
            release()
    finally:
        release()


def sorted_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], values: list[str], most: int, over: Callable[[dict[str, np.ndarray]], None]
) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole groups from batches sorted by `keys`, as (columns, the groups' starts and the end).

    A group of over `most` rows is never held: its rows go to `over`, in chunks, in the order they come.
    """
    names = [*keys, *values]
    held = {n: np.empty(0, dtype=np.int64) for n in names}
    hot: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names}
        if hot is not None:
            same = np.ones(batch.num_rows, dtype=bool)
            for k, v in zip(keys, hot, strict=True):
                same &= columns[k] == v
            n = int(same.sum())
            if n:
                over({k: c[:n] for k, c in columns.items()})
            if n == batch.num_rows:
                continue
            hot = None
            columns = {k: c[n:] for k, c in columns.items()}
        columns = {n: np.concatenate([held[n], columns[n]]) if held[n].size else columns[n] for n in names}
        size = columns[names[0]].size
        change = np.zeros(size - 1, dtype=bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        last = int(starts[-1])
        bounds = np.concatenate([starts[:-1], [last]])
        if last:
            sizes = np.diff(bounds)
            big = np.flatnonzero(sizes > most)
            for g in big:
                over({n: c[bounds[g] : bounds[g + 1]] for n, c in columns.items()})
            if big.size:
                keep = np.ones(last, dtype=bool)
                for g in big:
                    keep[bounds[g] : bounds[g + 1]] = False
                small = sizes[sizes <= most]
                yield {n: c[:last][keep] for n, c in columns.items()}, np.concatenate([[0], np.cumsum(small)])
            else:
                yield {n: c[:last] for n, c in columns.items()}, bounds
        held = {n: c[last:] for n, c in columns.items()}
        if size - last > most:
            hot = tuple(held[k][0] for k in keys)
            over(held)
            held = {n: np.empty(0, dtype=np.int64) for n in names}
    if held[names[0]].size:
        yield held, np.array([0, held[names[0]].size])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: str = "text") -> Column:
    """128 bits of a text's SHA-256; a null text's are those of an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32))


#: Bits of the filter that keeps rows without a partner out of a shuffle, by the power of two: 8 MB, whatever the corpus.
FILTER_LOG2 = 26


def maybe(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key may be among the ids: all that are, and few others while the ids are fewer than the filter's bits.

    The filter is a bit for each hash value, packed into at most 2^FILTER_LOG2 / 64 rows, so it is broadcast at any size of the corpus.
    """
    word, bits = fresh(docs, "word", "bits")
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_LOG2)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{c}`), {64 - FILTER_LOG2}) & 63 as int))")
    (column,) = ids.columns
    packed = ids.groupBy(F.shiftright(place(column), 6).alias(word)).agg(F.bit_or(bit(column)).alias(bits))
    met = (F.shiftright(place(key), 6) == F.col(word)) & (F.col(bits).bitwiseAND(bit(key)) != 0)
    return docs.join(F.broadcast(packed), met, "left_semi")

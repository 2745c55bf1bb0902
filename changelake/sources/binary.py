"""Binary log, value-log and backup files: pure codecs, and readers that cut large files at the borders of their records."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import itertools
import json
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.functions.codec import crc32c, crc32c_all
from changelake.schemas import BACKUP, VLOG, WAL
from changelake.sources import files

#: The longest frame; kinds of records.
LONGEST, PUT, DELETE = 1 << 30, 0, 1


class Corrupt(ValueError):
    """A file that breaks its format."""


def _entry(k: bytes, v: bytes | None, gone: bool) -> bytes:
    v = b"" if gone or v is None else v
    return struct.pack(">I", len(k)) + k + struct.pack(">I", len(v)) + v + bytes([DELETE if gone else PUT])


def _entries(data: bytes, at: int, count: int | None) -> Iterator[tuple[bytes, bytes | None, bool]]:
    n = 0
    while n != count and (count is not None or at < len(data)):
        try:
            (size,) = struct.unpack_from(">I", data, at)
            k = data[at + 4 : at + 4 + size]
            (length,) = struct.unpack_from(">I", data, at + 4 + size)
            start = at + 8 + size
            kind = data[start + length]
        except (struct.error, IndexError):
            raise Corrupt(f"an entry at {at} is cut off") from None
        yield k, None if kind == DELETE else data[start : start + length], kind == DELETE
        at, n = start + length + 1, n + 1
    if count is not None and at != len(data):
        raise Corrupt("a frame is longer than its entries")


def wal_frame(tx: int, op: int, entries: Iterable[tuple[bytes, bytes | None, bool]]) -> bytes:
    """One transaction's frame: length, checksum, numbers, count, entries; entry i has operation op + i."""
    rows = [_entry(*e) for e in entries]
    body = struct.pack(">QQI", tx, op, len(rows)) + b"".join(rows)
    return struct.pack(">II", len(body), crc32c(body)) + body


def _checked(data: bytes, heads: Iterable[tuple[int, int, int, int]], block: int = 8 << 20) -> Iterator[tuple[int, int, bool]]:
    """(place, end, whether the checksum is right) of records (place, first byte that is checked, end, checksum), many of them at a time."""
    held: list[tuple[int, int, int, int]] = []
    total = 0
    for head in heads:
        held.append(head)
        total += head[2] - head[1]
        if total >= block:
            yield from _checked_now(data, held)
            held, total = [], 0
    yield from _checked_now(data, held)


def _checked_now(data: bytes, held: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, bool]]:
    sums = crc32c_all([data[a:end] for _, a, end, _ in held]).tolist()
    for (place, _, end, want), got in zip(held, sums, strict=True):
        yield place, end, got == want


def wal_rows(data: bytes, frame: int = 0, base: int = 0) -> Iterator[tuple[int, int, int, bytes, bytes | None, bool]]:
    """(frame, tx, op, k, v, del) of the frames in `data`, which begins with that frame, at byte `base` of its file. Any damage is fatal: the log is the truth that all else is rebuilt from."""

    def heads() -> Iterator[tuple[int, int, int, int]]:
        at = 0
        while at < len(data):
            if at + 8 > len(data):
                raise Corrupt(f"a frame's head at {base + at} is cut off")
            size, want = struct.unpack_from(">II", data, at)
            if size > LONGEST or size < 20 or at + 8 + size > len(data):
                raise Corrupt(f"the frame at {base + at} has a wrong length")
            yield at, at + 8, at + 8 + size, want
            at += 8 + size

    for number, (at, end, ok) in enumerate(_checked(data, heads()), frame):
        if not ok:
            raise Corrupt(f"the frame at {base + at} has a wrong checksum")
        tx, op, count = struct.unpack_from(">QQI", data, at + 8)
        for i, (k, v, gone) in enumerate(_entries(data[at + 8 : end], 20, count)):
            yield number, tx, op + i, k, v, gone


def vlog_record(tx: int, op: int, k: bytes, v: bytes | None, gone: bool) -> bytes:
    v = b"" if gone or v is None else v
    body = struct.pack(">IIQQB", len(k), len(v), tx, op, DELETE if gone else PUT) + k + v
    return struct.pack(">I", crc32c(body)) + body


def vlog_rows(data: bytes, last: bool = False, base: int = 0) -> Iterator[tuple[int, int, int, bytes, bytes | None, bool, int]]:
    """(offset, tx, op, k, v, del, size) of the records in `data`, which begins at byte `base` of its file. Damage ends the last file, whose tail may be half written, and is fatal in any other."""

    def heads() -> Iterator[tuple[int, int, int, int]]:
        at = 0
        while at + 29 <= len(data):
            want, size, length = struct.unpack_from(">III", data, at)
            end = at + 29 + size + length
            if end > len(data):
                break
            yield at, at + 4, end, want
            at = end
        if at < len(data):
            yield at, at, at, -1  # what is left is no whole record

    for at, end, ok in _checked(data, heads()):
        if not ok:
            if last:
                return
            raise Corrupt(f"the record at {base + at} is damaged")
        size, _, tx, op, kind = struct.unpack_from(">IIQQB", data, at + 4)
        start = at + 29 + size
        yield base + at, tx, op, data[at + 29 : start], None if kind == DELETE else data[start:end], kind == DELETE, end - at


def backup_bytes(rows: Iterable[tuple[bytes, bytes | None, bool]]) -> Iterator[bytes]:
    for k, v, gone in rows:
        yield _entry(k, v, gone)


def backup_rows(data: bytes, pos: int = 0) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """(pos, k, v, del) in the order of the file, which may be gzipped; the first record of `data` has that position."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for n, (k, v, gone) in enumerate(_entries(data, 0, None), pos):
        yield n, k, v, gone


#: How each kind of file is decoded, from (name, bytes, whether it is the folder's last, the number of the first record, its place), and where a record that begins
#: at a place ends, from a file.
DECODERS = {
    "wal": lambda name, data, last, number, base: ((name, *r) for r in wal_rows(data, number, base)),
    "vlog": lambda name, data, last, number, base: ((int(name.split(".")[0]), *r) for r in vlog_rows(data, last, base)),
    "backup": lambda name, data, last, number, base: ((name, *r) for r in backup_rows(data, number)),
}
SCHEMAS = {"wal": WAL, "vlog": VLOG, "backup": BACKUP}
#: Bytes of a task's part of a file.
SPLIT = 64 << 20


def _end(kind: str, f, at: int) -> int | None:
    """The end of the record at a place of an open file; None if its head is cut off."""
    f.seek(at)
    if kind == "wal":
        head = f.read(8)
        return at + 8 + struct.unpack(">I", head[:4])[0] if len(head) == 8 else None
    if kind == "vlog":
        head = f.read(12)
        return at + 29 + sum(struct.unpack(">II", head[4:])) if len(head) == 12 else None
    head = f.read(4)
    if len(head) < 4:
        return None
    middle = at + 4 + struct.unpack(">I", head)[0]
    f.seek(middle)
    head = f.read(4)
    return middle + 5 + struct.unpack(">I", head)[0] if len(head) == 4 else None


def splits(kind: str, f, size: int, split: int = SPLIT) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, number of the first record) of parts of a file that end with a record and have `split` bytes or more, by the heads of its records alone.

    What is damaged is left to a part's reader: the last part goes to the end of the file. A gzipped file is one part.
    """
    start = number = first = at = 0
    if kind == "backup" and f.read(2) == b"\x1f\x8b":
        yield 0, size, 0
        return
    while at < size:
        end = _end(kind, f, at)
        if end is None or end > size:
            break
        at, number = end, number + 1
        if at - start >= split and at < size:
            yield start, at, first
            start, first = at, number
    if start < size:
        yield start, size, first


def _open(path: str):
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


#: Arrow's types of the columns that come out.
TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(found: Iterable[tuple], schema: str, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    typed, found = pa.schema([(name, TYPES[kind]) for name, kind in map(str.split, schema.split(", "))]), iter(found)
    while held := list(itertools.islice(found, chunk)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), typed.types, strict=True)], schema=typed)


def decoded(blobs: DataFrame, kind: str) -> DataFrame:
    """The records of whole files (name, content, last), each decoded where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, last in zip(*map(batch.column, ("name", "content", "last")), strict=True):
                yield from _rows(DECODERS[kind](name.as_py(), content.as_py(), bool(last.as_py()), 0, 0), SCHEMAS[kind])

    return blobs.select("name", "content", "last").mapInArrow(run, SCHEMAS[kind])


def _listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, name, length, last) of a folder's files; their contents are not read."""
    mine = sorted(n for n in files.names(spark, folder) if fnmatch.fnmatch(n, glob))
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", name.alias("name"), "length", (name == (mine[-1] if mine else "")).alias("last"))


def _ranged(path: str) -> bool:
    """Whether parts of files can be read there; elsewhere files are read whole by Spark, 2 GB at most."""
    try:
        pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"/{path}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _read(spark: SparkSession, folder: str, glob: str, kind: str, split: int) -> DataFrame:
    listed = _listed(spark, folder, glob)
    if not _ranged(folder):
        whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
        return decoded(listed.join(whole, "path").select("name", "content", "last"), kind)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name, length, last in pdf.itertuples(index=False):
                with _open(path) as f:
                    rows = [(path, name, a, b, n, bool(last) and b == length) for a, b, n in splits(kind, f, length, split)]
                yield pd.DataFrame(rows, columns=["path", "name", "start", "end", "number", "last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, a, b, number, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as f:
                    f.seek(a)
                    data = f.read(b - a)
                yield from _rows(DECODERS[kind](name, data, last, number, a), SCHEMAS[kind])

    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = listed.mapInPandas(cut, "path string, name string, start long, end long, number long, last boolean")
    # A fixed number of tasks, since the parts' rows are too small for adaptive execution to know what they stand for.
    return parts.repartition(max(1, -(-total // split)), "path", "start").mapInArrow(read, SCHEMAS[kind])


def read_wal(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The entries of all log files of a folder."""
    return _read(spark, folder, "*.wal", "wal", split)


def read_vlog(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of all value-log files (<number>.vlog) of a folder."""
    return _read(spark, folder, "*.vlog", "vlog", split)


def swept(blobs: DataFrame, kind: str = "vlog") -> DataFrame:
    """(name, records, sound) of all files (name, content, last) but the last, which is still written: whether every checksum is right."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                n, sound = 0, True
                try:
                    for _ in DECODERS[kind](name, bytes(content), False, 0, 0):
                        n += 1
                except Corrupt:
                    sound = False
                out.append((name, n, sound))
            yield pd.DataFrame(out, columns=["name", "records", "sound"])

    return blobs.where("not last").mapInPandas(run, "name string, records long, sound boolean")


#: Bytes of records of the files that are a task's together, on average. A task's blobs cross to the decoder in one batch, so this bounds a worker's memory.
TOGETHER = 16 << 20
EMPTY = pa.scalar(b"", pa.large_binary())


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come file by file as tables of whole files."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(c) for c in ("file_id", "tx", "seq")]
        if batch.column("k").null_count or any(c.null_count or pc.min(c).as_py() < 0 for c in numbers):
            raise ValueError("a row without a key, or without a file, transaction or number of 0 or more, has no place in a file")
        files_ = numbers[0].to_numpy()
        start = int(np.searchsorted(files_, files_[-1]))
        if start or held and held[-1].column("file_id")[-1].as_py() != files_[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _binaries(data: pa.Buffer, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in `data`, by the first one's place and the end of each."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), data])


def _number(values: np.ndarray, width: int) -> pa.Array:
    return _binaries(pa.py_buffer(values.astype(f">u{width}")), np.arange(len(values) + 1) * width)


def _sizes(values: pa.Array) -> pa.Array:
    return _number(pc.binary_length(values).to_numpy(), 4)


def _joined(*columns: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*columns, EMPTY)


def _sums(values: pa.Array) -> pa.Array:
    return _number(crc32c_all(values.to_pylist()), 4)


def _runs(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Neighbouring values as one, from each start to the next."""
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    return _binaries(values.buffers()[2], ends[np.append(starts, len(values))])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _parts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(file_id, tx, seq, k, v, kind) of rows; a delete's value and a missing one are empty."""
    k, v, gone = (rows.column(c).combine_chunks() for c in ("k", "v", "gone"))
    gone = pc.fill_null(gone, False)
    v = pc.if_else(gone, EMPTY, pc.fill_null(v.cast(pa.large_binary()), EMPTY))
    return *(rows.column(c).to_numpy() for c in ("file_id", "tx", "seq")), k.cast(pa.large_binary()), v, _number(np.where(gone.to_numpy(zero_copy_only=False), DELETE, PUT), 1)


def wal_frames(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(file of each frame, frames) of rows by file, transaction and number: the bytes of `wal_frame`, for many of them at a time."""
    file_id, tx, seq, k, v, kind = _parts(rows)
    starts = _starts(file_id, tx)
    entries = _runs(_joined(_sizes(k), k, _sizes(v), v, kind), starts)
    body = _joined(_number(tx[starts], 8), _number(seq[starts], 8), _number(np.diff(np.append(starts, len(tx))), 4), entries)
    return file_id[starts], _joined(_sizes(body), _sums(body), body)


def vlog_records(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(file of each record, records) of rows by file and number: the bytes of `vlog_record`, for many of them at a time."""
    file_id, tx, seq, k, v, kind = _parts(rows)
    body = _joined(_sizes(k), _sizes(v), _number(tx, 8), _number(seq, 8), kind, k, v)
    return file_id, _joined(_sums(body), body)


def _blobs(log: DataFrame, order: tuple[str, ...], name: str, encoded: Callable[[pa.Table], tuple[np.ndarray, pa.Array]]) -> DataFrame:
    """(name, content, last): the files of a log, as rows in an order are encoded; one file's rows are a task's.

    A fixed number of tasks by the records' bytes, since adaptive execution would give a task ever more files as the log grows.
    """
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0)) + 29
    last, total = log.agg(F.max("file_id"), F.sum(size.cast("bigint"))).first()
    n = max(log.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            owner, pieces = encoded(rows)
            starts = _starts(owner)
            numbers = owner[starts].tolist()
            yield pa.record_batch([pa.array([name.format(i) for i in numbers]), _runs(pieces, starts).cast(pa.binary()), pa.array([i == last for i in numbers])], names=["name", "content", "last"])

    rows = log.select(*(F.col(c).cast("bigint").alias(c) for c in ("file_id", "tx", "seq")), "k", "v", F.col("del").alias("gone"))
    return rows.repartition(n, "file_id").sortWithinPartitions(*order).mapInArrow(run, "name string, content binary, last boolean")


def wal_blobs(log: DataFrame) -> DataFrame:
    """(name, content, last): the log files of a log (file_id, tx, seq, k, v, del), a frame for each transaction."""
    return _blobs(log, ("file_id", "tx", "seq"), "{:020d}.wal", wal_frames)


def vlog_blobs(log: DataFrame) -> DataFrame:
    """(name, content, last): the value-log files of a log (file_id, tx, seq, k, v, del)."""
    return _blobs(log, ("file_id", "seq"), "{}.vlog", vlog_records)


def backup_blobs(state: DataFrame, parts: int = 8) -> DataFrame:
    """(name, content, last): the records of a state (k, v) in ranges of keys, `parts` or as many more as its bytes ask for; a backup is the ranges one after another."""
    total = state.agg(F.sum((F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0)) + 9).cast("bigint"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = b"".join(block for batch in batches for block in _backup_block(batch))
        number = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([f"basebackup.bin.{number:05d}"]), pa.array([data], pa.binary()), pa.array([False])], names=["name", "content", "last"])

    ranges = state.select("k", "v").repartitionByRange(max(parts, -(-total // TOGETHER)), "k")
    return ranges.sortWithinPartitions("k").mapInArrow(run, "name string, content binary, last boolean")


def _backup_block(rows: pa.RecordBatch) -> Iterator[bytes]:
    k, v = (rows.column(c).cast(pa.large_binary()) for c in ("k", "v"))
    if k.null_count:
        raise ValueError("a row without a key has no place in a backup")
    gone, filled = v.is_null().to_numpy(zero_copy_only=False), pc.fill_null(v, EMPTY)
    if rows.num_rows:
        yield _runs(_joined(_sizes(k), k, _sizes(filled), filled, _number(np.where(gone, DELETE, PUT), 1)), np.array([0]))[0].as_py()


def _digest(spark: SparkSession, folder: str) -> str | None:
    """The SHA-256 of a backup's stored bytes, read in one pass where they are."""
    listed = _listed(spark, folder, "basebackup.bin*")
    if not _ranged(folder):
        row = spark.read.format("binaryFile").option("pathGlobFilter", "basebackup.bin*").load(folder).select(F.sha2("content", 256)).first()
        return row and row[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                sum_ = hashlib.sha256()
                with _open(path) as f:
                    while block := f.read(1 << 20):
                        sum_.update(block)
                out.append(sum_.hexdigest())
            yield pd.DataFrame({"sum": out})

    row = listed.mapInPandas(run, "sum string").first()
    return row and row[0]


def read_backup(spark: SparkSession, folder: str, split: int = SPLIT) -> tuple[DataFrame, dict]:
    """The records of a backup, and its description; Corrupt if the stored bytes are not those it describes."""
    meta = json.loads(files.read_text(spark, f"{folder}/backup.meta"))
    if _digest(spark, folder) != meta["sha256"]:
        raise Corrupt("the backup's checksum is not the described one")
    return _read(spark, folder, "basebackup.bin*", "backup", split), meta


def write_backup(state: DataFrame, folder: str, database: str, timeline: int, tx: int, op: int, stamp: str, compressed: bool = False) -> dict:
    """Write (k, v[, del]) as one backup file and its description.

    The format is one stream with one checksum, so rows pass through the driver, partition by partition, and are written as they come.
    """
    spark = state.sparkSession
    fs, path, jvm = files._fs(spark, f"{folder}/basebackup.bin{'.gz' if compressed else ''}")
    rows = state.select(F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"), (F.coalesce("del", F.lit(False)) if "del" in state.columns else F.lit(False)).alias("del"))
    stream, digest, buffer = fs.create(path, True), hashlib.sha256(), io.BytesIO()
    packer = gzip.GzipFile(fileobj=buffer, mode="wb", mtime=0) if compressed else buffer

    def flush(end: bool = False) -> None:
        if end and compressed:
            packer.close()
        data = buffer.getvalue()
        buffer.seek(0)
        buffer.truncate()
        digest.update(data)
        stream.write(bytearray(data))

    try:
        for n, record in enumerate(backup_bytes((bytes(r.k), None if r.v is None else bytes(r.v), r["del"]) for r in rows.toLocalIterator())):
            packer.write(record)
            if n % 10_000 == 9_999:
                flush()
        flush(end=True)
    finally:
        stream.close()
    meta = {"timestamp": stamp, "database": database, "current_timeline": timeline, "snapshot_tx_id": tx, "snapshot_op_id": op, "compressed": compressed, "sha256": digest.hexdigest()}
    files.write_text(spark, f"{folder}/backup.meta", json.dumps(meta))
    return meta

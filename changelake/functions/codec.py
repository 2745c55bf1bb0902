"""Scalar functions: value formats, checks, sizes, checksums and index keys."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a value-log record's head, an index value, a log frame's head and a batch's head.
SIZES = {"vlog_head": 29, "index_value": 33, "frame_head": 8, "batch_head": 20}
CASTAGNOLI = 0x82F63B78


def value_text(v: Column, form: str) -> Column:
    """A value as a change record has it: text, base64, or JSON where it parses and a JSON string elsewhere."""
    if form == "base64":
        return F.base64(v.cast("binary"))
    if form == "json":
        return F.coalesce(F.to_json(F.try_parse_json(v)), F.get(F.regexp_extract_all(F.to_json(F.array(v)), F.lit(r"(?s)^\[(.*)\]$"), F.lit(1)), F.lit(0)))
    return v.cast("string")


def to_timestamp(ms: Column) -> Column:
    """Milliseconds since the epoch as a timestamp."""
    return F.timestamp_millis(ms)


def is_ascii(x: Column) -> Column:
    """G03"""
    return x.rlike(r"^[\x00-\x7F]+$")


def parse_bytes(x: Column) -> Column:
    """G04: "64MB" and the like as a number of bytes; 0 for nothing, null for anything else."""
    number = F.regexp_extract(F.upper(x), r"^\s*([+-]?[0-9]+)\s*(GB|MB|KB|B)?\s*$", 1)
    unit = F.regexp_extract(F.upper(x), r"^\s*([+-]?[0-9]+)\s*(GB|MB|KB|B)?\s*$", 2)
    factor = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)
    return F.when(F.trim(x) == "", F.lit(0).cast("bigint")).otherwise(F.when(number != "", number.cast("bigint") * factor))


def valid_key(k: Column) -> Column:
    """A key is not empty, of ASCII only, and not of the reserved name space."""
    return (F.length(k) > 0) & is_ascii(k) & ~k.startswith("!sys!")


def counter(v: Column) -> Column:
    """The update count of a JSON value, raised by one; 1 if there is none."""
    return F.coalesce(F.get_json_object(v, "$.update_count").cast("bigint"), F.lit(0)) + 1


def crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


TABLE = crc32c_table()


class Zeros:
    """What further zero bytes make of a register: a linear map, as four tables of its bytes' images, by the power of two of how many bytes."""

    def __init__(self):
        self.table = np.array(TABLE, dtype=np.uint32)
        self.maps: list[np.ndarray] = []

    def map(self, log2: int) -> np.ndarray:
        while len(self.maps) <= log2:
            basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
            basis = self.apply(self.apply(basis, len(self.maps) - 1), len(self.maps) - 1) if self.maps else self.table[basis & 255] ^ (basis >> np.uint32(8))
            tables = np.zeros((4, 256), dtype=np.uint32)
            for bit in range(32):
                tables[bit // 8, (np.arange(256) >> bit % 8 & 1).astype(bool)] ^= basis[bit]
            self.maps.append(tables)
        return self.maps[log2]

    def apply(self, crc: np.ndarray, log2: int) -> np.ndarray:
        t = self.map(log2)
        return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


_ZEROS = Zeros()
#: Bytes that go through the table one after another, the power of two; and bytes that are worked on at a time.
RUN_LOG2, AT_ONCE = 6, 1 << 24


def crc32c_all(values: list[bytes]) -> np.ndarray:
    """The Castagnoli checksums of many values, by numpy.

    Without its start value the checksum is linear, and zeros before a value do not count. So values are cut into runs, after zeros up to a power of two of
    them; the table is applied to all runs at once, and neighbouring runs are joined in pairs. What the start value makes of each length is added at the end.
    """
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    out = np.zeros(len(values), dtype=np.uint32)
    runs = np.maximum(1, -(-sizes >> RUN_LOG2))
    powers = np.ceil(np.log2(runs)).astype(np.int64) if len(values) else runs
    for power in np.unique(powers).tolist():
        mine, width = np.flatnonzero(powers == power), 1 << RUN_LOG2 + power
        step = max(1, AT_ONCE // width)
        for some in (mine[i : i + step] for i in range(0, mine.size, step)):
            data = np.frombuffer(b"".join(values[i].rjust(width, b"\0") for i in some.tolist()), dtype=np.uint8).reshape(-1, 1 << RUN_LOG2)
            crc = np.zeros(len(data), dtype=np.uint32)
            for column in np.ascontiguousarray(data.T):
                crc = _ZEROS.table[(crc ^ column) & 255] ^ (crc >> 8)
            crc = crc.reshape(some.size, -1)
            for level in range(power):
                crc = _ZEROS.apply(crc[:, 0::2], RUN_LOG2 + level) ^ crc[:, 1::2]
            out[some] = crc[:, 0]
    start = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    for log2 in range(int(sizes.max(initial=0)).bit_length()):
        own = (sizes >> log2 & 1).astype(bool)
        start[own] = _ZEROS.apply(start[own], log2)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum."""
    if len(data) > 512:
        return int(crc32c_all([data])[0])
    crc = 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_column(data: Column) -> Column:
    """The checksum of a binary column; no built-in function has this polynomial."""

    def checked(values: pd.Series) -> pd.Series:
        known = values.notna()
        return pd.Series(crc32c_all([bytes(b) for b in values[known]]).astype("int64"), index=values.index[known]).reindex(values.index).astype("Int64")

    return F.pandas_udf(checked, "long")(data)


def index_key(k: bytes, tx: int) -> bytes:
    """The key of a version, newest first among those of its key."""
    return k + b"\0" + struct.pack(">Q", (1 << 64) - 1 - tx)


def index_key_column(k: Column, tx: Column) -> Column:
    """G06 as hexadecimal digits, built in: all 64 bits less a number are the number's bits inverted."""
    return F.concat(F.hex(k), F.lit("00"), F.lpad(F.hex(F.bitwise_not(tx)), 16, "0"))


def index_key_parts(data: bytes) -> tuple[bytes, int]:
    return data[:-9], (1 << 64) - 1 - struct.unpack(">Q", data[-8:])[0]


def index_value(file_id: int, offset: int, length: int, tx: int, op: int, gone: bool) -> bytes:
    return struct.pack(">IqIQQB", file_id, offset, length, tx, op, gone)


def index_value_parts(data: bytes) -> tuple[int, int, int, int, int, bool]:
    *rest, gone = struct.unpack(">IqIQQB", data)
    return (*rest, bool(gone))

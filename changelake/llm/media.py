"""MPEG audio columns: lossless storage of bytes in valid frames, and a reader that resynchronises, checks and indexes a stream.

A stream is an ID3v2 tag, a frame with a variable-bitrate table, and MPEG-1 Layer III mono frames with checksums. Every frame's side information
announces no spectral data, so a player decodes silence; the bytes fill the frames' main data area, which the format leaves to ancillary data.
All frames but the last have the highest bitrate, the last one the lowest that holds the rest.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import slices

#: Fixed values of the format: kbit/s by layer and index for version 1 and for versions 2 and 2.5, and sampling rates by version.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Fixed values of the format: layer II's tables as (subbands, bits of their allocation), the first four for version 1, the last for versions 2 and 2.5.
SUBBANDS = (((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((2, 4), (6, 3)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2)))
#: Fixed values of ID3: encodings of texts by number, and the fields of the 128 bytes at a file's end.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ID3V1 = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))
SIDE, CRC = 17, 2
PREFIX = 4 + CRC + SIDE
UNIT = 64


def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's checksum of the first `bits` bits, or all: polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        crc ^= byte << 8
        for _ in range(min(8, left)):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
        left -= 8
        if left < 0:
            # The last byte's other bits must not count: they are what is left of it in the register.
            return crc ^ (byte << 8 + 8 + left & 0xFFFF)
        if not left:
            break
    return crc


_crc = lru_cache(maxsize=4096)(crc16)


def guarded_bits(frame: bytes, layer: int, side: int) -> int:
    """How many bits after a frame's checksum it covers: the side information, or the allocation of bits, and in layer II which scale factors follow."""
    if layer == 3:
        return 8 * side
    mode, ext = frame[3] >> 6, frame[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    if layer == 1:
        bound = 4 * (ext + 1) if mode == 1 else 32 * (channels - 1)
        return 4 * (32 + bound)
    first, rate = frame[1] >> 3 & 3 == 3, RATES[frame[1] >> 3 & 3][frame[2] >> 2 & 3]
    kbit = KBITS[1 if first else 2, 2][frame[2] >> 4] // channels
    if not first:
        table = 4
    elif 56 <= kbit <= 80 or (rate == 48000 and kbit >= 56):
        table = 0
    elif rate != 48000 and kbit >= 96:
        table = 1
    else:
        table = 3 if rate == 32000 else 2
    widths = [n for count, n in SUBBANDS[table] for _ in range(count)]
    bound = min(len(widths), 4 * (ext + 1)) if mode == 1 else len(widths) * (channels - 1)
    value, total = int.from_bytes(frame[6 : 6 + 64], "big"), 8 * len(frame[6 : 6 + 64])
    at = scales = 0
    for band, width in enumerate(widths):
        # Beyond the bound, or with one channel, one allocation serves all channels.
        for _ in range(2 if band < bound else 1):
            if at + width <= total and value >> total - at - width & (1 << width) - 1:
                scales += 2 * (1 if band < bound else channels)
            at += width
    return at + scales


@lru_cache(maxsize=4096)
def header(data: bytes) -> tuple[int, int, int, int, int, bool, int] | None:
    """(frame length, samples, sampling rate, layer, version, has checksum, side information's length), or None if it is no valid header."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = data[1] >> 3 & 3, 4 - (data[1] >> 1 & 3)
    rate, kbit = data[2] >> 2 & 3, data[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or kbit in (0, 15) or data[3] & 3 == 2:
        return None
    first, hertz, mono = version == 3, RATES[version][rate], data[3] >> 6 == 3
    bits = KBITS[1 if first else 2, layer][kbit] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    pad = data[2] >> 1 & 1
    length = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return length, samples, hertz, layer, version, not data[1] & 1, side


@lru_cache(maxsize=64)
def _prefix(index: int) -> bytes:
    """Header, checksum and silent side information of a frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


def _length(index: int) -> int:
    return header(_prefix(index)[:4])[0]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of user-defined texts."""
    body = b""
    for k, v in values.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that stores `payload`, of whose bytes the first `n_bytes` are content and the rest padding."""
    room = _length(14) - PREFIX
    full, rest = divmod(len(payload), room)
    frames = [_prefix(14) + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        index = next(i for i in range(1, 15) if _length(i) - PREFIX >= rest)
        frames.append((_prefix(index) + payload[full * room :]).ljust(_length(index), b"\0"))
    size = sum(map(len, frames)) + _length(5)
    offset, toc = _length(5), []
    at = [offset]
    for f in frames[:-1]:
        at.append(at[-1] + len(f))
    for p in range(100):
        toc.append(min(255, at[p * len(frames) // 100] * 256 // size) if frames else 0)
    table = b"Xing" + struct.pack(">III", 0xF, len(frames), size) + bytes(toc) + struct.pack(">I", 0)
    tag = _tag({"n_bytes": str(n_bytes), "payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))})
    return tag + (_prefix(5) + table).ljust(_length(5), b"\0") + b"".join(frames)


def _texts(body: bytes) -> list[str]:
    """The texts of a text frame: an encoding's number, and texts with zeros between."""
    if not body or body[0] >= len(ENCODINGS):
        return []
    raw = body[1:]
    kind = "utf-16-le" if body[0] == 1 and raw[:2] == b"\xff\xfe" else "utf-16-be" if body[0] in (1, 2) else ENCODINGS[body[0]]
    return [t.removeprefix("\ufeff") for t in raw.decode(kind, "replace").split("\0")]


def _tag_frames(body: bytes, major: int, whole: bool) -> dict[str, str]:
    """The text frames of a tag's body, after its extended header: user-defined texts by their names, others by the frames'. `whole`: synchronisation was avoided all over."""
    unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    width, head = (3, 6) if major == 2 else (4, 10)
    values, i = {}, 0
    while i + head <= len(body) and body[i : i + width].isalnum():
        name = body[i : i + width].decode("latin-1")
        size = int.from_bytes(body[i + 3 : i + 6], "big") if major == 2 else unsafe(body[i + 4 : i + 8]) if major == 4 else struct.unpack(">I", body[i + 4 : i + 8])[0]
        flags = body[i + 9] if major > 2 else 0
        content = body[i + head : i + head + size]
        i += head + size
        if not name.startswith("T") or flags & (0x0C if major == 4 else 0xC0):
            continue  # no text, or compressed or encrypted
        if major == 4:
            content = content[4:] if flags & 1 else content
            content = content.replace(b"\xff\0", b"\xff") if flags & 2 or whole else content
        texts = _texts(content)
        if name in ("TXXX", "TXX") and texts:
            values[texts[0]] = "".join(texts[1:2])
        elif texts:
            values[name] = "/".join(t for t in texts if t)
    return values


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the ID3v2 tags at the start end, and their texts; a broken tag ends where its size says or at its first bad frame."""
    start, values = 0, {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10 and not any(b & 0x80 for b in data[start + 6 : start + 10]):
        unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        major, flags = data[start + 3], data[start + 5]
        end = min(len(data), start + 10 + unsafe(data[start + 6 : start + 10]))
        body = data[start + 10 : end]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and major > 2 and len(body) >= 4:
            body = body[unsafe(body[:4]) if major == 4 else struct.unpack(">I", body[:4])[0] + 4 :]
        if 2 <= major <= 4 and not (major == 2 and flags & 0x40):
            values |= _tag_frames(body, major, bool(flags & 0x80))
        start = end + (10 if major == 4 and flags & 0x10 else 0)
    return start, values


def _closing_tag(data: bytes) -> dict[str, str]:
    """The fields of the ID3v1 tag at the end, if there is one; a comment that leaves room for it has the track's number."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    out = {name: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip() for name, a, b in ID3V1}
    if not tag[125] and tag[126]:
        out["track"] = str(tag[126])
    return {k: v for k, v in out.items() if v} | {"genre": str(tag[127])}


def _table(frame: bytes, main: bytes) -> dict | None:
    """The variable-bitrate table of a first frame: one after the side information, or one of the other kind 32 bytes after the header."""
    if main[:4] in (b"Xing", b"Info") and len(main) >= 8:
        flags, k, table = struct.unpack(">I", main[4:8])[0], 8, {"kind": main[:4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and len(main) >= k + 4:
                table[name], k = struct.unpack(">I", main[k : k + 4])[0], k + 4
        if flags & 4:
            table["toc"] = list(main[k : k + 100])
        return table
    body = frame[36:]
    if body[:4] != b"VBRI" or len(body) < 26:
        return None
    size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", body[10:26])
    rows = body[26 : 26 + entries * width]
    toc = [scale * int.from_bytes(rows[n : n + width], "big") for n in range(0, len(rows), width)] if width else []
    return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": step}


def _synced(data: bytes, i: int, like: tuple | None) -> int:
    """The next place from i on with a frame that another frame, the end or a closing tag follows; the data's length if none is."""
    while True:
        i = data.find(b"\xff", i)
        if i < 0:
            return len(data)
        found = header(data[i : i + 4])
        if found and i + found[0] <= len(data) and (like is None or found[2:5] == like[2:5]):
            after = i + found[0]
            following = header(data[after : after + 4])
            if after == len(data) or data[after : after + 3] == b"TAG" or following and following[2:5] == found[2:5]:
                return i
        i += 1


def decode(data: bytes) -> dict:
    """What a stream holds: durations, seek offsets, checks and the frames' main data.

    Bytes that belong to no frame are skipped to the next place where two frames follow each other. A frame of any layer whose checksum fails counts as bad and
    its data is kept. Data without any frame gives zeros and an empty payload.
    """
    i, tags = _tags(data)
    offsets, parts, bad, skipped, resyncs, samples, rate, table, lengths = [], [], 0, 0, 0, 0, 0, None, set()
    last = None
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 else len(data)
    first = True
    while i < end:
        at = data[i : i + 4]
        found = header(at)
        if not found or i + found[0] > end or (last and found[2:5] != last[2:5]) or last is None:
            j = min(end, _synced(data[:end] if end < len(data) else data, i, last))
            if j > i:
                skipped, resyncs = skipped + j - i, resyncs + 1
            i = j
            if i >= end:
                break
            found = header(data[i : i + 4])
        last = found
        length, count, rate, layer, _, checked, side = found
        body = i + 4 + (2 if checked else 0)
        if checked:
            bits = guarded_bits(data[i : i + 70] if layer == 2 else data[i : i + 4], layer, side)
            if struct.unpack(">H", data[i + 4 : i + 6])[0] != _crc(data[i + 2 : i + 4] + data[body : body + -(-bits // 8)], 16 + bits):
                bad += 1
        main = data[body + side : i + length]
        if not first or not (table := _table(data[i : i + length], main)):
            offsets.append(i)
            parts.append(main)
            samples += count
            lengths.add(length)
        first = False
        i += length
    payload = b"".join(parts)
    want = tags.get("payload_bytes", "")
    payload = payload[: int(want)] if want.isdigit() else payload
    ok = tags["payload_crc32"] == str(zlib.crc32(payload)) if "payload_crc32" in tags else None
    return {"tags": tags, "closing": _closing_tag(data), "table": table, "offsets": offsets, "samples": samples, "rate": rate, "bad_crc": bad, "skipped": skipped, "resyncs": resyncs, "payload": payload, "payload_ok": ok, "vbr": len(lengths) > 1}


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw = [t if t is not None else b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        media = [encode(padded(t), len(t)) for t in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every row of `docs` (doc_id, text): its text as an MPEG stream. A null text is empty; repeated rows repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, media binary")


ANALYSED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_samples long, "
    "sample_rate int, bad_crc long, skipped_bytes long, resyncs long, payload_ok boolean, vbr_frames long, vbr_bytes long, tags string, seek_offsets array<long>, feature string"
)


def _describe(doc_id: int | None, data: bytes) -> tuple:
    x = decode(data)
    payload, table, g = x["payload"], x["table"] or {}, gcd(x["samples"], x["rate"]) or 1
    n = x["tags"].get("n_bytes", "")
    where = zlib.crc32(struct.pack(f"<{len(x['offsets'])}Q", *x["offsets"]))
    feature = (
        f"rate={x['rate']};frames={len(x['offsets'])};samples={x['samples']};seconds={x['samples'] // g}/{x['rate'] // g};table={table.get('kind', '')}:{table.get('frames', '')}:"
        f"{table.get('bytes', '')};vbr={int(x['vbr'])};bad_crc={x['bad_crc']};resyncs={x['resyncs']};skipped={x['skipped']};seek={where:08x}"
    )
    return (
        doc_id, int(n) if n.isdigit() else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), len(x["offsets"]), x["samples"],
        x["rate"], x["bad_crc"], x["skipped"], x["resyncs"], x["payload_ok"], table.get("frames"), table.get("bytes"), json.dumps(x["tags"] | {f"id3v1.{k}": v for k, v in x["closing"].items()}, ensure_ascii=False, sort_keys=True), x["offsets"], feature,
    )


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        rows = [_describe(i, m if m is not None else b"") for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANALYSED_ARROW, strict=True)], schema=ANALYSED_ARROW)


ANALYSED_ARROW = pa.schema(
    [
        (n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[t])
        for n, t in (c.split() for c in ANALYSED.split(", "))
    ]
)


def analyse(media: DataFrame) -> DataFrame:
    """What the streams of `media` (doc_id, media) hold, one row each: see ANALYSED. `tags` is a JSON object; seek_offsets has each frame's first byte. A null or broken stream has no frames and an empty payload."""
    return media.select("doc_id", "media").mapInArrow(_analyse, ANALYSED)

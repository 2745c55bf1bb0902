"""MPEG streams: exact round trips, and damage of the kinds a reader meets."""

import hashlib
import random
import zlib

from changelake.llm import media


def stream(n, seed=0):
    data = media.padded(random.Random(seed).randbytes(n))
    return data, media.encode(data, n)


def test_crc16_known_value():
    # bit by bit, over a polynomial division written out
    def slow(data):
        reg = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = reg >> 15 ^ byte >> bit & 1
                reg = reg << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return reg

    for n in range(20):
        data = random.Random(n).randbytes(n)
        assert media.crc16(data) == slow(data)


def bitwise(bits):
    reg = 0xFFFF
    for b in bits:
        top = reg >> 15 ^ b
        reg = reg << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return reg


def bits_of(data):
    return [byte >> k & 1 for byte in data for k in range(7, -1, -1)]


def test_crc16_of_some_bits():
    data = random.Random(4).randbytes(12)
    for n in range(97):
        assert media.crc16(data, n) == bitwise(bits_of(data)[:n]), n


def test_checksums_of_layers_one_and_two():
    """Two frames of each kind, whose checksum covers the allocation, and in layer II the selection of scale factors, counted by hand."""
    rng = random.Random(6)
    kinds = [  # second to fourth byte of the header, bits of the allocation by subband and channel
        (0xFE, 0x90, 0xC0, [4] * 32, 1),  # layer I, one channel
        (0xFE, 0x90, 0x00, [4] * 64, 1),  # two channels
        (0xFE, 0x90, 0x50, [4] * (2 * 8 + 24), 1),  # joint from the eighth subband on
        (0xFC, 0xA4, 0x00, [4] * 22 + [3] * 24 + [2] * 8, 2),  # layer II, 48 kHz, 192 kbit/s
        (0xFC, 0xA0, 0xC0, [4] * 11 + [3] * 12 + [2] * 7, 2),  # 44.1 kHz, one channel of 192 kbit/s
        (0xFC, 0x18, 0xC0, [4] * 2 + [3] * 10, 2),  # 32 kHz, 32 kbit/s
        (0xFC, 0x14, 0xC0, [4] * 2 + [3] * 6, 2),  # 48 kHz, 32 kbit/s
        (0xF4, 0x80, 0xC0, [4] * 4 + [3] * 7 + [2] * 19, 2),  # version 2
    ]
    for one, two, three, widths, layer in kinds:
        head = bytes([0xFF, one, two, three])
        length = media.header(head)[0]
        for damage in (False, True):
            frames = b""
            for _ in range(2):
                body = bytearray(rng.randbytes(length - 6))
                flags, at, extra = bits_of(body), 0, 0
                for w in widths:
                    extra += 2 * any(flags[at : at + w]) if layer == 2 else 0
                    at += w
                crc = bitwise(bits_of(head[2:]) + flags[: at + extra])
                if damage:
                    body[(at + extra - 1) // 8] ^= 0x80 >> (at + extra - 1) % 8
                frames += head + crc.to_bytes(2, "big") + bytes(body)
            x = media.decode(frames)
            assert len(x["offsets"]) == 2 and x["bad_crc"] == 2 * damage, (head.hex(), damage)


def test_other_tags_and_tables():
    _, out = stream(4000, 5)
    start, _ = media._tags(out)
    audio = out[start + media._length(5) :]
    frame = lambda name, body, flags=b"\0\0": name + len(body).to_bytes(4, "big") + flags + body
    tag = lambda major, flags, body: b"ID3" + bytes([major, 0, flags]) + media._synchsafe(len(body)) + body
    utf16 = frame(b"TIT2", b"\x01" + "\ufeffé1".encode("utf-16-le")) + frame(b"TXXX", b"\x01" + "\ufeffa\0\ufeffb".encode("utf-16-le"))
    assert media.decode(tag(3, 0, utf16) + audio)["tags"] == {"TIT2": "é1", "a": "b"}
    assert media.decode(tag(3, 0x80, utf16.replace(b"\xff", b"\xff\0")) + audio)["tags"] == {"TIT2": "é1", "a": "b"}
    two = b"TT2" + (4).to_bytes(3, "big") + b"\0abc" + b"TXX" + (4).to_bytes(3, "big") + b"\0k\0v"
    assert media.decode(tag(2, 0, two) + audio)["tags"] == {"TT2": "abc", "k": "v"}
    assert media.decode(tag(4, 0, frame(b"TPE1", b"\x00\xff\x00x", b"\0\2")) + audio)["tags"] == {"TPE1": "\xffx"}
    old = (b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(30, b" ") + bytes(30) + b"1999" + b"words".ljust(28, b"\0") + b"\0\x07\x11")
    x = media.decode(audio + old)
    assert x["closing"] == {"title": "title", "artist": "artist", "year": "1999", "comment": "words", "track": "7", "genre": "17"} and x["skipped"] == 0
    table = b"VBRI" + bytes(6) + (12345).to_bytes(4, "big") + (77).to_bytes(4, "big") + b"\0\3\0\2\0\2\0\5" + b"\0\1\0\2\1\0"
    head = bytes([0xFF, 0xFB, audio[2], audio[3]])
    first = (head + bytes(32) + table).ljust(media.header(head)[0], b"\0")
    x = media.decode(first + audio)
    assert x["table"] == {"kind": "VBRI", "frames": 77, "bytes": 12345, "toc": [2, 4, 512], "frames_per_entry": 5}
    assert len(x["offsets"]) == len(media.decode(audio)["offsets"])


def test_headers():
    assert media.header(bytes([0xFF, 0xFB, 0x90, 0x64]))[:3] == (417, 1152, 44100)
    assert media.header(bytes([0xFF, 0xFB, 0x92, 0x64]))[0] == 418
    assert media.header(bytes([0xFF, 0xF3, 0x80, 0xC0]))[:3] == (208, 576, 22050)
    assert media.header(bytes([0xFF, 0xFF, 0x90, 0xC0]))[1] == 384
    for bad in (b"\xff\xfb\x90", b"\xff\xeb\x90\x64", b"\xff\xfb\xf0\x64", b"\xff\xfb\x9c\x64", b"\xff\xf9\x90\x64", b"\xff\xfb\x90\x66", b"\x00\xfb\x90\x64"):
        assert media.header(bad) is None


def test_round_trip():
    for n in [0, 1, 63, 64, 65, 936, 937, 938, 960, 5000, 200_000]:
        data, out = stream(n)
        x = media.decode(out)
        assert x["payload"] == data and x["payload_ok"] and x["tags"]["n_bytes"] == str(n)
        assert x["bad_crc"] == x["skipped"] == x["resyncs"] == 0
        assert x["table"]["frames"] == len(x["offsets"]) and x["samples"] == 1152 * len(x["offsets"])
        assert all(out[o : o + 2] == b"\xff\xfa" for o in x["offsets"])
        assert len(x["table"]["toc"]) == 100 and x["table"]["toc"] == sorted(x["table"]["toc"])


def test_payload_full_of_false_headers():
    data = media.padded(b"\xff\xfa\xe4\xc0" * 3000)
    assert media.decode(media.encode(data, 12000))["payload"] == data


def test_garbage_between_frames():
    data, out = stream(6000, 3)
    cut = media.decode(out)["offsets"][2]
    x = media.decode(out[:cut] + b"\xff\xfb junk" * 5 + out[cut:])
    assert x["payload"] == data and x["resyncs"] == 1 and x["skipped"] == 35


def test_damage():
    data, out = stream(6000, 4)
    at = media.decode(out)["offsets"][1]
    flipped = bytearray(out)
    flipped[at + 7] ^= 1
    x = media.decode(bytes(flipped))
    assert x["bad_crc"] == 1 and x["payload"] == data
    flipped = bytearray(out)
    flipped[at] = 0
    x = media.decode(bytes(flipped))
    assert x["resyncs"] >= 1 and len(x["offsets"]) == len(media.decode(out)["offsets"]) - 1 and x["payload_ok"] is False
    x = media.decode(out[:-10])
    assert x["skipped"] > 0 and x["payload"] == data[: len(x["payload"])]
    x = media.decode(out + b"TAG" + bytes(125))
    assert x["payload"] == data and x["skipped"] == 0
    for junk in (b"", b"ID3", b"\xff" * 500, b"no audio at all"):
        assert media.decode(junk)["payload"] == b""


def test_columns(spark):
    texts = [None, "", "a", "é" * 700, "same", "same", "long text " * 20_000]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "null id", "x", "x"), (4, "same", "x", "x")]
    got = media.analyse(media.store(spark.createDataFrame(rows, "doc_id long, text string, media string, feature string"))).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        t = "null id" if r.doc_id != r.doc_id else texts[int(r.doc_id)] or ""
        p = t.encode() + b"\0" * (-len(t.encode()) % 64) if t else bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-64:]) and r.payload_ok
    same = got[got.doc_id.isin([4, 5])]
    assert same.media_sha256.nunique() == same.feature.nunique() == 1
    assert media.analyse(spark.createDataFrame([(1, None), (2, b"xx")], "doc_id long, media binary")).where("n_frames = 0 and payload_bytes = 0").count() == 2
    assert media.analyse(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0

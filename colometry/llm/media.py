"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton over all magic bytes runs once over the value; each hit is a guess that a
format's validator confirms by structure and length. The confirmed format at offset 0 corrects the
declared type; confirmed formats at other offsets are embedded media, carved by offset and length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, mapped

#: Magic bytes, their place in the file, and the media type they announce.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
)


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return "image/png", pos - at
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def skip(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return "image/gif", pos + 1 - at
        if b[pos] == 0x21:
            pos = skip(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos = skip(pos + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xD9:
            return "image/jpeg", pos + 2 - at
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            pos += 2
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if kind < 0xC0 or size < 2 or pos + 2 + size > len(b):
            return None
        pos += 2 + size
        if kind == 0xDA:  # entropy-coded data runs to the next real marker
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return ("image/jpeg", pos + 2 - at) if b[pos : pos + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    size, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if ok and 14 + header <= data <= size <= len(b) - at else None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kinds = {b"WAVE": ("audio/wav", {b"fmt ", b"data"}), b"WEBP": ("image/webp", set()), b"AVI ": ("video/avi", set())}
    end = at + 8 + size
    if form not in kinds or end > len(b):
        return None
    pos, found = at + 12, set()
    while pos + 8 <= end:
        name, length = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + length > end:
            return None
        found.add(name)
        pos += 8 + length + (length & 1)
    kind, needed = kinds[form]
    return (kind, 8 + size) if pos >= end and found and needed <= found else None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    if b[at + 5 : at + 6] not in (b"1", b"2") or b[at + 6 : at + 7] != b".":
        return None
    stop = b.find(b"%%EOF", at)
    return ("application/pdf", stop + 5 - at) if stop > 0 and b.find(b"startxref", at, stop) > 0 else None


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, where, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + where + size == end and (not size or b[at + where : at + where + 4] == b"PK\x01\x02")
    return ("application/zip", end + 22 + note - at) if ok and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    step = zlib.decompressobj(31)
    try:
        rest = b[at:]
        while rest and not step.eof:
            step.decompress(rest, 1 << 20)
            rest = step.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(b) - at - len(step.unused_data)) if step.eof else None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    pos, found = at, []
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        if size < 8 or pos + size > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"uuid", b"moof", b"mfra", b"sidx", b"meta"):
            break
        found.append(kind)
        pos += size
    return ("video/mp4", pos - at) if found[:1] == [b"ftyp"] and {b"moov", b"moof"} & set(found) else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        head, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (head & 127 or size != 34) or pos + 4 + size > len(b):
            return None
        pos, first = pos + 4 + size, False
        if head & 128:
            return ("audio/flac", len(b) - at) if b[pos : pos + 1] == b"\xff" else None
    return None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 + b[pos + 26] <= len(b):
        laced = b[pos + 27 : pos + 27 + b[pos + 26]]
        size = 27 + len(laced) + sum(laced)
        if pos + size > len(b):
            return None
        last = b[pos + 5] & 4
        pos += size
        if last:
            return "audio/ogg", pos - at
    return None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4, "audio/flac": _flac, "audio/ogg": _ogg,
}

_AUTOMATON: list = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for magic, place, kind in MAGIC:
            made.add_word(magic.decode("latin-1"), (len(magic) + place, kind))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed format, by offset; what lies inside a found one counts too.

    A format that can't be confirmed to its last byte is none. Of two at one offset the longer counts.
    """
    found: dict[int, tuple[str, int]] = {}
    for end, (back, kind) in _automaton().iter(value.decode("latin-1")):
        at = end + 1 - back
        if at >= 0 and (hit := VALIDATORS[kind](value, at)) and hit[1] > found.get(at, ("", 0))[1]:
            found[at] = hit
    return [(kind, at, size) for at, (kind, size) in sorted(found.items())]


SNIFFED = "declared string, media_type string, corrected boolean, embedded array<struct<type:string,offset:bigint,length:bigint>>"


def sniff_media(df: DataFrame, key: str, media: str, declared: str) -> DataFrame:
    """key, then SNIFFED: the confirmed type at offset 0 (else application/octet-stream), whether that
    differs from the declared one, and the embedded media. A null value is empty: octet-stream, nothing
    embedded. A null declared type counts as differing."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value, said in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = sniff(value.as_py() or b"")
                whole = next((x[0] for x in found if x[1] == 0), "application/octet-stream")
                rows.append((said, whole, whole != said, [dict(zip(("type", "offset", "length"), x, strict=True)) for x in found if x[1]]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], inner)], names=[key, "declared", "media_type", "corrected", "embedded"])

    return mapped(df.select(key, media, declared), run, f"`{key}` {kind}, {SNIFFED}")


# ---------------------------------------------------------------- texts as samples

_RATE, _PAD = 8000, 64


def to_wav(samples: bytes) -> bytes:
    """8-bit mono PCM; a RIFF length holds at most 2**32 - 1 bytes, more than a Spark value can."""
    odd = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, _RATE, _RATE, 1, 8)
    body = b"WAVE" + head + struct.pack("<4sI", b"data", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(stored: bytes) -> bytes:
    """The samples of the first data chunk; the structure must be confirmed before."""
    pos = 12
    while True:
        name, size = struct.unpack_from("<4sI", stored, pos)
        if name == b"data":
            return stored[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)


def feature(kind: str, embedded: int, samples: bytes) -> str:
    """Integers only, so equal samples give equal strings: type, embedded media, mean, mean square, crossings of 128."""
    x = np.frombuffer(samples, dtype=np.uint8)
    high = x >= 128
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum()) if len(x) < 1 << 22 else sum(int(np.square(x[i : i + (1 << 22)], dtype=np.int64).sum()) for i in range(0, len(x), 1 << 22))
    return f"type={kind};embedded={embedded};mean={total // len(x)};ms={square // len(x)};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


TEXT_MEDIA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, declared string, media_type string"


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as 8-bit samples under a wrong declared type, then sniffs and reads it back.

    Payload: the UTF-8 bytes, then bytes 0 up to a positive multiple of 64 (null or empty: 64 bytes 0).
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in TEXT_MEDIA.split(", "))]

    def one(raw: bytes) -> tuple:
        payload = raw + b"\0" * (-len(raw) % _PAD if raw else _PAD)
        stored = to_wav(payload)
        found = sniff(stored)
        whole = next(x for x in found if x[1] == 0)
        if whole[0] != "audio/wav" or whole[2] != len(stored):
            raise ValueError("the stored form isn't what was written")
        back = from_wav(stored)
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-_PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(whole[0], len(found) - 1, back), "text/plain", whole[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in chunks(batches, text):
            whole = data.tobytes()
            cols = list(zip(*(one(whole[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return mapped(df.select(key, text), run, f"`{key}` {kind}, {TEXT_MEDIA}")

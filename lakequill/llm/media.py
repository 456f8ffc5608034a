"""Media columns by signature sniffing: one Aho-Corasick pass finds magic bytes, validators confirm the formats.

Magic bytes alone say little: a text may hold any of them. Each hit is therefore followed by the walk of
its format's own structure (chunk lengths and checksums, directory offsets, page sequences), which also
gives the length. A blob's type is what is valid at its start, whatever was declared; what is valid
further on, and not inside something already found, is carved out as embedded media.

Defined cases: a null blob counts as empty and is of no type (``application/octet-stream``); a hit whose
structure does not hold is ignored; overlapping finds go to the one that starts first; blobs of any
length are scanned whole; repeated rows give repeated results; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNKNOWN = "application/octet-stream"
ROW = 192

# Magic bytes, their distance from the start of the file, and the validator's name.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"RIFF", 0, "riff"),
    (b"OggS", 0, "ogg"),
    (b"fLaC", 0, "flac"),
    (b"ftyp", 4, "mp4"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"P5\n", 0, "pnm"),
    (b"P6\n", 0, "pnm"),
]


def png(b: bytes, at: int) -> tuple[str, int] | None:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n = int.from_bytes(b[pos : pos + 4], "big")
        kind, end = b[pos + 4 : pos + 8], pos + 12 + n
        if end > len(b) or first and kind != b"IHDR" or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """Marker segments by their lengths, then scan data up to the end marker."""
    pos, frame = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        m = b[pos + 1]
        if m == 0xD9:
            return ("image/jpeg", pos + 2 - at) if frame else None
        n = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if m < 0xC0 or n < 2 or pos + 2 + n > len(b):
            return None
        frame = frame or 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if m == 0xDA:
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return ("image/jpeg", pos + 2 - at) if frame and b[pos : pos + 2] == b"\xff\xd9" else None


def gif(b: bytes, at: int) -> tuple[str, int] | None:
    """Screen descriptor, then blocks of sub-blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return "image/gif", pos + 1 - at
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def bmp(b: bytes, at: int) -> tuple[str, int] | None:
    """Header sizes that agree with each other, the palette and the rows of samples."""
    if at + 54 > len(b):
        return None
    size, _, off, head, w, h, planes, bits, packed, _, _, _, used, _ = struct.unpack_from("<IIIIiiHHIIiiII", b, at + 2)
    if head != 40 or planes != 1 or packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        return None
    colours = (used or 1 << bits) * 4 if bits <= 8 else 0
    whole = off + (w * bits + 31) // 32 * 4 * abs(h)
    return ("image/bmp", size) if off >= 54 + colours and size >= whole and size - whole < 4 and at + size <= len(b) else None


def riff(b: bytes, at: int) -> tuple[str, int] | None:
    """Form type, and sub-chunks that fill the declared length exactly."""
    kinds = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = kinds.get(b[at + 8 : at + 12])
    pos = at + 12
    if not kind or end > len(b) or pos >= end:
        return None
    while pos + 8 <= end:
        n = int.from_bytes(b[pos + 4 : pos + 8], "little")
        pos += 8 + n + (n & 1)
    return (kind, end - at) if pos == end else None


def ogg(b: bytes, at: int) -> tuple[str, int] | None:
    """Pages by their segment tables, up to one that ends the stream."""
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b):
            return None
        if b[pos + 5] & 4:
            return "audio/ogg", end - at
        pos = end
    return None


def flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, the first of them the stream's; frames run to the end of the blob."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, n = b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind, n) != (0, 34) or pos + 4 + n > len(b):
            return None
        last, pos, first = b[pos] & 0x80, pos + 4 + n, False
        if last:
            return ("audio/flac", len(b) - at) if b[pos : pos + 1] == b"\xff" else None
    return None


def mp4(b: bytes, at: int) -> tuple[str, int] | None:
    """Boxes by their lengths; a movie box must be among them."""
    pos, seen = at, set()
    while pos + 8 <= len(b):
        n, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if n < 8 or pos + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"udta", b"moof", b"mfra", b"uuid"):
            break
        seen.add(kind)
        pos += n
    return ("video/mp4", pos - at) if b"moov" in seen else None


def pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """The last end-of-file mark that follows a cross-reference offset, before any other file's head."""
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    return ("application/pdf", end + 5 - at) if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


def zipped(b: bytes, at: int) -> tuple[str, int] | None:
    """An end record whose directory sizes lead back to this first entry."""
    end = b.find(b"PK\x05\x06", at)
    while 0 <= end <= len(b) - 22:
        size, off, note = struct.unpack_from("<IIH", b, end + 12)
        if off + size == end - at and b[at + off : at + off + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            return "application/zip", end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 1)
    return None


def pnm(b: bytes, at: int) -> tuple[str, int] | None:
    """Width, height and depth in decimal, and as many samples."""
    fields = b[at + 3 : at + 64].split(b"\n", 2)
    size = fields[0].split(b" ")
    if len(fields) < 3 or len(size) != 2 or not all(x.isdigit() for x in (*size, fields[1])) or fields[1] != b"255":
        return None
    n = 3 + len(fields[0]) + len(fields[1]) + 2 + int(size[0]) * int(size[1]) * (3 if b[at + 1] == 54 else 1)
    kind = "image/x-portable-pixmap" if b[at + 1] == 54 else "image/x-portable-graymap"
    return (kind, n) if int(size[0]) and at + n <= len(b) else None


VALIDATORS = {"png": png, "jpeg": jpeg, "gif": gif, "bmp": bmp, "riff": riff, "ogg": ogg, "flac": flac, "mp4": mp4, "pdf": pdf, "zip": zipped, "pnm": pnm}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, off, name in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + off, name))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of all media of the blob that lie side by side, in order."""
    hits = sorted((end - back, name) for end, (back, name) in _automaton().iter(blob.decode("latin-1")) if end >= back)
    out, free = [], 0
    for at, name in hits:
        if at >= free and (got := VALIDATORS[name](blob, at)):
            out.append((at, got[1], got[0]))
            free = at + got[1]
    return out


def as_bitmap(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit grey bitmap, ``ROW`` in a row, top row first."""
    rows = len(payload) // ROW
    palette = b"".join(bytes((g, g, g, 0)) for g in range(256))
    off = 54 + len(palette)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", off + len(payload), 0, off, 40, ROW, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload


def bitmap_samples(b: bytes) -> bytes:
    """The samples of an 8-bit bitmap, rows from the top."""
    off, w, h = struct.unpack_from("<I", b, 10)[0], *struct.unpack_from("<ii", b, 18)
    stride = (w + 3) // 4 * 4
    rows = np.frombuffer(b, np.uint8, stride * abs(h), off).reshape(abs(h), stride)[:, :w]
    return (rows if h < 0 else rows[::-1]).tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes filled up with spaces to a positive multiple of ``ROW``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % ROW if raw else ROW)


def store_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, declared)``: each text stored as a bitmap; its type is declared unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                held = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in held], pa.int64()), pa.array([as_bitmap(p) for _, p in held], pa.binary()), pa.array([UNKNOWN] * len(held))],
                    names=["doc_id", "n_bytes", "media", "declared"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


def sniffed(blobs: DataFrame, key: str = "doc_id", blob: str = "media", declared: str = "declared") -> DataFrame:
    """``(key, declared, type, corrected, found array<struct<start, length, type, data>>)`` of every blob; ``data`` is the carved media."""
    schema = f"{key} long, declared string, type string, corrected boolean, found array<struct<start: long, length: long, type: string, data: binary>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, types = [], []
            for x in b.column(1).to_pylist():
                x = x or b""
                got = sniff(x)
                found.append([{"start": at, "length": n, "type": t, "data": x[at : at + n]} for at, n, t in got])
                types.append(got[0][2] if got and got[0][0] == 0 else UNKNOWN)
            said = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(types, pa.string()), pa.array([t != d for t, d in zip(types, said, strict=True)]), pa.array(found, kind)],
                names=[key, "declared", "type", "corrected", "found"],
            )

    return blobs.select(key, blob, declared).mapInArrow(run, schema)


def digest(blobs: DataFrame) -> DataFrame:
    """Features of stored texts, all from the bytes that are carved out and read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, n, blob, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = sniff(blob or b"")
                if not got:
                    rows.append((key, n, None, None, None, 0, None, f"{said}>{UNKNOWN}"))
                    continue
                at, length, kind = got[0]
                media = blob[at : at + length]
                payload = bitmap_samples(media)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                feature = f"{said}>{kind};{ROW}x{len(payload) // ROW};{len(got)};sum={int((counts * np.arange(256)).sum())};kinds={int((counts > 0).sum())}"
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, hashlib.sha256(media).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.split()[1] == "string" else pa.int64()) for c, k in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    return blobs.select("doc_id", "n_bytes", "media", "declared").mapInArrow(run, schema)

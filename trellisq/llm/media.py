"""Media columns: what bytes really are, by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass. At each place a validator walks the
format's structure (chunks, segments, checksums, length fields) and says where the file ends, or that none is there. A
file at offset 0 that spans all bytes corrects a wrong declared type; files found further inside are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from .common import add_columns, fields, tuned

#: Fixed values of the formats: magic bytes, their offset from the file's start, and the media type.
MAGIC = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
)
RATE, HEADER = 8000, 44
#: Bytes that one gzip stream may inflate to while it's validated, a piece at a time.
PIECE = 1 << 16


def wav_end(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return None
    end, p, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    while p + 8 <= min(end, len(b)):
        name, n = struct.unpack_from("<4sI", b, p)
        seen.add(name)
        p += 8 + n + (n & 1)
    return end if end <= len(b) and p == end and {b"fmt ", b"data"} <= seen else None


def png_end(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p
    return None


def gif_end(b: bytes, at: int) -> int | None:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return None
    return None


def jpeg_end(b: bytes, at: int) -> int | None:
    p, scanned = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if mark < 0xC0 or n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if mark == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] not in (0, *range(0xD0, 0xD8)):
                    break
                p += 2
            scanned = True
            if p < 0:
                return None
    return p + 2 if scanned and b[p : p + 2] == b"\xff\xd9" else None


def bmp_end(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, zero, start, dib = struct.unpack_from("<IIII", b, at + 2)
    return at + size if zero == 0 and dib in (12, 40, 52, 56, 108, 124) and 14 + dib <= start <= size and at + size <= len(b) else None


class Marks:
    """Where the ends of PDF and ZIP files are in some bytes: looked up once, whatever the number of beginnings."""

    def __init__(self, b: bytes):
        self.b = b

    @cached_property
    def last_eof(self) -> int:
        return self.b.rfind(b"%%EOF")

    @cached_property
    def last_startxref(self) -> int:
        return self.b.rfind(b"startxref", 0, max(0, self.last_eof))

    def pdf_end(self, at: int) -> int | None:
        return self.last_eof + 5 if self.b[at + 5 : at + 6].isdigit() and self.last_startxref >= at else None

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """The end of each ZIP file by its start, as its directory's end record tells."""
        b, out, p = self.b, {}, 0
        while (p := b.find(b"PK\x05\x06", p)) >= 0 and p + 22 <= len(b):
            size, offset, note = struct.unpack_from("<IIH", b, p + 12)
            at = p - offset - size
            if at >= 0 and b[at + offset : at + offset + 4] == b"PK\x01\x02" and p + 22 + note <= len(b):
                out.setdefault(at, p + 22 + note)
            p += 4
        return out


def pdf_end(b: bytes, at: int, marks: Marks) -> int | None:
    return marks.pdf_end(at)


def zip_end(b: bytes, at: int, marks: Marks) -> int | None:
    return marks.zip_ends.get(at)


def gzip_end(b: bytes, at: int) -> int | None:
    z, p = zlib.decompressobj(31), at
    try:
        while not z.eof and p < len(b):
            rest = b[p : p + PIECE]
            while rest and not z.eof:
                z.decompress(rest, PIECE)
                rest = z.unconsumed_tail
            p += PIECE
    except zlib.error:
        return None
    return min(p, len(b)) - len(z.unused_data) if z.eof else None


ENDS = {
    "audio/wav": wav_end, "image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end, "application/gzip": gzip_end,
}
MARKED_ENDS = {"application/pdf": pdf_end, "application/zip": zip_end}


def sniffer():
    """A function from bytes to [(type, start, end)] of valid files, by start; those inside an earlier one are left out."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for k, (magic, offset, kind) in enumerate(MAGIC):
        finder.add_word(magic.decode("latin-1"), (k, len(magic) - 1 + offset, kind))
    finder.make_automaton()

    def sniff(b: bytes) -> list[tuple[str, int, int]]:
        found, until, marks = [], 0, Marks(b)
        for last, (_, back, kind) in finder.iter(b.decode("latin-1")):
            start = last - back
            if start < until:
                continue
            end = ENDS[kind](b, start) if kind in ENDS else MARKED_ENDS[kind](b, start, marks)
            if end is not None:
                found.append((kind, start, end))
                until = end
        return found

    return sniff


def pack(payload: bytes) -> bytes:
    """A WAV file, one channel of 8-bit samples: each byte of the payload is a sample."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def unpack(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no samples")


def padded(text: str) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = text.encode("utf-8", "replace")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def store_texts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Stores each whole text as 8-bit samples, reads the stored bytes back and sniffs them.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature: the sniffed type,
    sample count, sum of the samples, and the types and places of the files carved out of the samples. All values
    depend on the text alone; null and empty texts are stored as 64 zeros.
    """

    def make():
        sniff = sniffer()

        def compute(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for t in texts:
                payload, n = padded(t)
                media = pack(payload)
                back = unpack(media)
                found = sniff(media)  # the file itself; then what its samples hold
                kind = next((k for k, at, end in found if at == 0 and end == len(media)), "application/octet-stream")
                inner = ",".join(f"{kind}@{a}+{z - a}" for kind, a, z in sniff(back))
                feature = f"{kind};rate={RATE};samples={len(back)};sum={sum(back)};carved={inner}"
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            return out

        return compute

    added = fields(n_bytes=LongType(), payload_bytes=LongType(), payload_sha256=StringType(), tail_crc32=LongType(), media_bytes=LongType(), media_sha256=StringType(), feature=StringType())
    return add_columns(docs, "text", added, make, keep)


def inspect(df: DataFrame, bytes_col: str = "media", declared_col: str = "media_type") -> DataFrame:
    """df with actual_type, corrected and carved.

    actual_type: the type of a valid file that begins at offset 0, else the declared type if it isn't a known format,
    else application/octet-stream; null bytes: null. corrected: it differs from the declared one. carved:
    array<struct<type, start, length>> of the valid files further inside.
    """
    tuned(df.sparkSession)
    types = {kind for *_, kind in MAGIC}
    added = StructType.fromDDL("actual_type string, corrected boolean, carved array<struct<type: string, start: long, length: long>>")
    kept = [c for c in df.columns if c not in added.names]
    schema = StructType([df.schema[c] for c in kept] + list(added.fields))
    arrow = to_arrow_schema(added)

    def run(batches):
        sniff = sniffer()
        for b in batches:
            rows = []
            for raw, declared in zip(b.column(bytes_col).to_pylist(), b.column(declared_col).to_pylist(), strict=True):
                found = sniff(raw) if raw is not None else []
                actual = found[0][0] if found and found[0][1] == 0 else None if raw is None else "application/octet-stream" if declared is None or declared in types else declared
                rows.append((actual, None if raw is None else actual != declared, [{"type": k, "start": a, "length": z - a} for k, a, z in found if a]))
            cols = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + cols, names=[*kept, *arrow.names])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)

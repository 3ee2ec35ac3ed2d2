"""Media columns: signature sniffing, format validation, carving, lossless storage.

An Aho-Corasick automaton finds the magic bytes of all formats in one scan of a
value. Each hit is only believed after the format's validator has followed its
structure and lengths to the end; the hit at offset 0 corrects the declared type,
validated hits further in are embedded media that can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, texts

#: Bytes of an image row; payloads are padded to a positive multiple of it.
ROW = 192
SAMPLE_RATE = 8_000
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PGM_MAGIC = b"P5\n"


@dataclass(frozen=True)
class Found:
    kind: str
    offset: int
    length: int
    samples: tuple[int, int]  # where the stored samples lie, relative to offset; PNG: none
    detail: str


def write_wav(data: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(data))
    return head + data


def write_bmp(data: bytes) -> bytes:
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(data), 0, 0, start, 40, ROW, len(data) // ROW, 1, 8, 0, len(data), 2835, 2835, 256, 0) + palette + data


def write_pgm(data: bytes) -> bytes:
    return PGM_MAGIC + b"%d %d\n255\n" % (ROW, len(data) // ROW) + data


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(data: bytes) -> bytes:
    lines = np.zeros((len(data) // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


WRITERS = {"audio/wav": write_wav, "image/bmp": write_bmp, "image/x-portable-graymap": write_pgm, "image/png": write_png}
KINDS = list(WRITERS)


def check_wav(b: bytes, at: int) -> Found | None:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return None
    total, = struct.unpack_from("<I", b, at + 4)
    form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", b, at + 20)
    end, pos = at + 8 + total, at + 20 + struct.unpack_from("<I", b, at + 16)[0]
    if end > len(b) or form != 1 or not channels or not rate or bits not in (8, 16, 24, 32):
        return None
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if name == b"data":
            return Found("audio/wav", at, 8 + total, (pos + 8 - at, size), f"{rate}Hz{bits}b{channels}c")
        pos += 8 + size + size % 2
    return None


def check_bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    size, r1, r2, start, head, width, height, planes, bits, packed, held = struct.unpack_from("<IHHIIiiHHII", b, at + 2)
    if r1 or r2 or head != 40 or planes != 1 or bits != 8 or packed or width <= 0 or not height:
        return None
    samples = (width + 3) // 4 * 4 * abs(height)
    if held not in (0, samples) or start < 54 or size != start + samples or at + size > len(b):
        return None
    return Found("image/bmp", at, size, (start, samples), f"{width}x{abs(height)}")


def check_pgm(b: bytes, at: int) -> Found | None:
    head = b[at : at + 40].split(b"\n", 3)
    if len(head) < 4 or head[2] != b"255":
        return None
    sides = head[1].split(b" ")
    if len(sides) != 2 or not all(s.isdigit() and len(s) < 10 and s[:1] != b"0" for s in sides):
        return None
    start, samples = sum(map(len, head[:3])) + 3, int(sides[0]) * int(sides[1])
    if at + start + samples > len(b):
        return None
    return Found("image/x-portable-graymap", at, start + samples, (start, samples), f"{int(sides[0])}x{int(sides[1])}")


def check_png(b: bytes, at: int) -> Found | None:
    pos, size, detail = at + 8, len(b), ""
    while pos + 12 <= size:
        n, = struct.unpack_from(">I", b, pos)
        if pos + 12 + n > size or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        kind = b[pos + 4 : pos + 8]
        if (kind == b"IHDR") != (pos == at + 8):
            return None
        if kind == b"IHDR":
            detail = "{}x{}".format(*struct.unpack_from(">II", b, pos + 8))
        pos += 12 + n
        if kind == b"IEND":
            return Found("image/png", at, pos - at, (0, 0), detail)
    return None


CHECKS = {b"RIFF": check_wav, b"BM": check_bmp, PGM_MAGIC: check_pgm, PNG_MAGIC: check_png}


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 strings, in which each character is one byte."""
    out = ahocorasick.Automaton()
    for magic in CHECKS:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(content: bytes, signatures: ahocorasick.Automaton) -> list[Found]:
    """Validated media in ``content`` by offset, the outer before what it embeds."""
    hits = ((end - len(magic) + 1, magic) for end, magic in signatures.iter(content.decode("latin-1")))
    return [f for at, magic in hits if (f := CHECKS[magic](content, at))]


def stored_samples(content: bytes, found: Found) -> bytes:
    """The samples of a media value that ``sniff`` found."""
    if found.kind != "image/png":
        start = found.offset + found.samples[0]
        return content[start : start + found.samples[1]]
    body, pos = [], found.offset + 8
    while content[pos + 4 : pos + 8] != b"IEND":
        n, = struct.unpack_from(">I", content, pos)
        if content[pos + 4 : pos + 8] == b"IHDR":
            width, _, bits, colour, _, _, lace = struct.unpack_from(">IIBBBBB", content, pos + 8)
        elif content[pos + 4 : pos + 8] == b"IDAT":
            body.append(content[pos + 8 : pos + 8 + n])
        pos += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if (bits, colour, lace) != (8, 0, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey PNG samples are read")
    return lines[:, 1:].tobytes()


def feature_of(found: Found, samples: bytes) -> str:
    """Format, dimensions, mean and deviation of the samples, and a 16-bin histogram in 1/255 of its peak."""
    values = np.frombuffer(samples, np.uint8)
    bins = np.bincount(values >> 4, minlength=16)
    scaled = (bins * 255 // max(int(bins.max()), 1)).astype(np.uint8)
    return f"{found.kind};{found.detail};mean={values.mean():.4f};sd={values.std():.4f};hist={scaled.tobytes().hex()}"


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, declared, media``: each text as 8-bit samples of a sound or image.

    The text's UTF-8 (null: empty) is padded with spaces to a positive multiple of
    192 bytes. Its CRC-32 picks the format, so equal texts give equal media; one in
    four is declared as another type, for ``read_media`` to correct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, declared, media = [], [], []
                for text in texts(part.column("text")):
                    data = text + b" " * (-len(text) % ROW or (0 if text else ROW))
                    pick = zlib.crc32(data)
                    sizes.append(len(text))
                    media.append(WRITERS[KINDS[pick % 4]](data))
                    declared.append(KINDS[(pick + (pick >> 2 & 3 == 0)) % 4])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Sniff and decode ``stored(doc_id, n_bytes, declared, media)``.

    Gives the samples' length, SHA-256 and CRC-32 of the last 16, the stored form's
    length and SHA-256, a feature, the detected type, whether it corrects the
    declared one, and how many media are embedded. A null or unrecognised value
    has null type, samples and feature. Repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected", "embedded"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for content, declared in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True):
                    content = content or b""
                    found = sniff(content, signatures)
                    own = found[0] if found and found[0].offset == 0 else None
                    samples = stored_samples(content, own) if own else None
                    sums = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:])) if own else (None, None, None)
                    rows.append((*sums, len(content), hashlib.sha256(content).hexdigest(), feature_of(own, samples) if own else None, own and own.kind, bool(own and own.kind != declared), len(found) - bool(own)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean, embedded int"
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def carve(stored: DataFrame) -> DataFrame:
    """One row per validated media inside another value: doc_id, kind, offset, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        for batch in batches:
            for part in slices(batch, "media"):
                for doc_id, content in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                    inner = [f for f in sniff(content or b"", signatures) if f.offset]
                    if inner:
                        columns = [[doc_id] * len(inner), [f.kind for f in inner], [f.offset for f in inner], [content[f.offset : f.offset + f.length] for f in inner]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "kind", "offset", "content"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, kind string, offset long, content binary")


def media_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store the media in the shared folder, then read the stored bytes back."""
    media = store_media(docs)
    path = new_folder(spark, "media")
    media.write.option("compression", "zstd").parquet(path)
    return read_media(spark.read.schema(media.schema).parquet(path))

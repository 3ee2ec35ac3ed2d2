"""Document fingerprints: quartile bucket digests.

Byte triplets drawn from a sliding window of four bytes are hashed into buckets
and counted. A digest holds, for each bucket, in which quartile of the document's
bucket counts it lies (two bits), and the logarithm of the length. Digests are
compared by a difference that is bounded and scaled to a likeness of 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices

BUCKETS = 256
#: Offsets of the triplets inside a window, each with its own hash multiplier.
TRIPLETS = ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA6B), (0, 2, 3, 0xC2B2AE35))
#: Mean difference of two-bit codes that have nothing in common.
CHANCE = 1.25
LENGTH_STEPS = 12
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def bucket_counts(docs: list[bytes]) -> np.ndarray:
    """(documents, BUCKETS) counts of hashed triplets; all documents in one pass over their joined bytes."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.frombuffer(b"".join(docs) + b"\0\0\0", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(docs)) * BUCKETS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))
    counts = np.zeros(len(docs) * BUCKETS, np.int64)
    n = len(owner)
    for a, b, c, factor in TRIPLETS:
        mixed = (flat[a : a + n] << np.uint32(16) | flat[b : b + n] << np.uint32(8) | flat[c : c + n]) * np.uint32(factor)
        slot = owner + ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(24))
        counts += np.bincount(slot[left > c], minlength=len(counts))
    return counts.reshape(len(docs), BUCKETS)


def quartile_codes(docs: list[bytes]) -> np.ndarray:
    """(documents, BUCKETS + 1): codes 0 to 3 by quartile, then the length code."""
    if not docs:
        return np.empty((0, BUCKETS + 1), np.uint8)
    counts = bucket_counts(docs)
    ordered = np.sort(counts, axis=1)
    codes = np.zeros(counts.shape, np.uint8)
    for q in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
        codes += counts > ordered[:, q : q + 1]
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    return np.concatenate([codes, np.minimum(np.rint(LENGTH_STEPS * np.log2(lengths + 1)), 255).astype(np.uint8)[:, None]], axis=1)


def write_digest(codes: np.ndarray) -> str:
    """Two hexadecimal digits of length, then four codes a byte."""
    c = codes[:BUCKETS].reshape(-1, 4)
    return f"{codes[BUCKETS]:02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes().hex()


def read_digest(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1)
    return np.append(codes, np.uint8(int(digest[:2], 16)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, towards 0 as codes and lengths differ; row by row."""
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    score = gap[..., :BUCKETS].sum(-1) / (CHANCE * BUCKETS) + np.minimum(gap[..., BUCKETS], 8 * LENGTH_STEPS) / (32.0 * LENGTH_STEPS)
    return 1.0 - np.minimum(score, 1.0)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as many code points of ``following``, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare(ids: list, docs: list[str], following: list[str], codes: np.ndarray, next_codes: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b).encode() for a, b in zip(docs, following, strict=True)]
    changed_codes = quartile_codes(changed)
    columns = [
        ids, [len(x) for x in docs], [hashlib.sha256(x).hexdigest() for x in changed],
        [write_digest(c) for c in codes], [write_digest(c) for c in changed_codes],
        likeness(codes, changed_codes), likeness(codes, next_codes),
    ]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for all rows of a sorted partition but the last, and its first and last text, with the partition's number, for the seams."""
    number = TaskContext.get().partitionId()
    held: tuple | None = None  # id, text, code of the row before
    for batch in batches:
        for part in slices(batch, "text"):
            ids = part.column("doc_id").to_pylist()
            docs = [x or "" for x in part.column("text").to_pylist()]
            codes = quartile_codes([x.encode() for x in docs])
            if held is None:
                yield seam(ids[0], docs[0], 0, number)
            else:
                ids, docs, codes = [held[0], *ids], [held[1], *docs], np.concatenate([held[2], codes])
            held = (ids[-1], docs[-1], codes[-1:])
            if len(ids) > 1:
                rows = compare(ids[:-1], docs[:-1], docs[1:], codes[:-1], codes[1:])
                extra = [pa.nulls(rows.num_rows, t) for t in (pa.string(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, "text", "side", "range"])
    if held is not None:
        yield seam(held[0], held[1], 1, number)


def seam(doc_id: int | None, text: str, side: int, number: int) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
    values = [doc_id, None, None, None, None, None, None, text, side, number]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text", "side", "range"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def across_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            docs, following = ([x or "" for x in part.column(c).to_pylist()] for c in ("text", "following"))
            yield compare(part.column("doc_id").to_pylist(), docs, following, *(quartile_codes([x.encode() for x in y]) for y in (docs, following)))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Digest of each text, of its edited text, and their likeness to it and to the next document's.

    The next document is the one after it in descending doc_id; after the last
    comes the first; a single row is its own next. Equal ids are taken in the
    order of their texts' hashes, null ids come last. A null text counts as
    empty; equal texts have equal digests; an empty text has all codes 0. An
    empty table gives no rows.

    The texts are dealt once by range of doc_id, and pairs inside a range are
    compared as they stream by. Only the first and last row of each range, two
    rows a partition, are kept for a second step that joins the ranges' ends by number.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(in_order, RESULT + ", text string, side int, range int"), "digests")
    seams = found.where("side is not null")
    line = Window.orderBy("range")  # one number a partition, without texts
    first = F.first("range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = seams.where("side = 0").select("range").withColumn("next", F.coalesce(F.lead("range").over(line), first))
    heads = seams.where("side = 0").select(F.col("range").alias("next"), F.col("text").alias("following"))
    pairs = seams.where("side = 1").join(after, "range").join(heads, "next")
    ends = pairs.select("doc_id", "text", "following").mapInArrow(across_seams, RESULT)
    return found.where("side is null").drop("text", "side", "range").unionByName(ends)


def fingerprint_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``fingerprint_with_edits`` of all documents; its docstring states what null, empty and repeated rows give."""
    return fingerprint_with_edits(docs)

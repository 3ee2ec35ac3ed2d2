"""Suffix-array dedup over bytes, with a logarithmic family of levels.

The suffix array of a batch is sparse: it holds the suffixes that start at
content-defined places (see ``segments``), sorted by the hash of the bytes that
follow, which groups equal beginnings just as text order does and needs 16 bytes
instead of 200. A new batch's array is merge-scanned against the existing levels
for long matches, and levels of equal size merge before the next batch, so each
entry is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .repeats import Rule, bounded, describe_removals
from .segments import BYTE_VALUES
from .substrings import in_batches

MATCH = 200
BATCHES = 3
STEPS = (128, 8)


def byte_units(held: list[bytes]) -> list[np.ndarray]:
    return [BYTE_VALUES[np.frombuffer(x, np.uint8)] for x in held]


def dedup_bytes(docs: DataFrame, batches: int = BATCHES, match: int = MATCH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs(doc_id, text)``.

    A byte of a text's UTF-8 goes if a ``match``-byte string that covers it also
    starts anywhere else, in the same text included; strings are judged on the
    input and lie within one text. A null text counts as empty. Rows
    that repeat a doc_id count as separate texts, and so do rows with a null doc_id: while
    the index is made these have a hash of their text for an id.
    """

    def describe(text, gone):
        if gone is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unnamed = slim.where("doc_id IS NULL")
    some = not unnamed.isEmpty()
    if some:
        own = F.xxhash64(F.lit("unnamed"), "text")
        slim = slim.withColumn("doc_id", F.coalesce("doc_id", own))
    found = describe_removals(slim, in_batches(slim, batches), Rule(byte_units, match, anywhere=True, steps=STEPS), 2, describe, schema)
    if not some:
        return found
    names = bounded(materialize(unnamed.select(own.alias("doc_id")).distinct().withColumn("_packlens_unnamed", F.lit(True)), "unnamed"))
    return found.join(names, "doc_id", "left").withColumn("doc_id", F.when(F.col("_packlens_unnamed").isNull(), F.col("doc_id"))).drop("_packlens_unnamed")


def suffix_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``dedup_bytes`` of all documents; its docstring states what null, empty and repeated rows give."""
    return dedup_bytes(docs)

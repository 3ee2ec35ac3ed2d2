"""Substring dedup over words: a log-structured index of window fingerprints.

Batches of documents, in order of doc_id, become sorted immutable runs of window
hashes (see ``segments``: a run holds one hash per group of windows). Each new
batch is merge-joined with the historical runs, what matches is verified on exact
spans or windows, and runs of equal weight are compacted.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Rule, describe_removals, rewrite_texts
from .segments import BYTE_VALUES, Rolling

WINDOW = 50
BATCHES = 3
FANOUT = 2
STEPS = (18,)
#: Bytes whose words are hashed at once; a longer word is hashed whole.
HASHED_BYTES = 1 << 20
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_units(held: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text, by differences of prefix sums over the joined bytes."""
    values = np.frombuffer(b" ".join(held), np.uint8)
    space = np.concatenate(([True], SPACE[values], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    groups = np.append(np.flatnonzero(np.diff(starts // HASHED_BYTES, prepend=-1)), len(starts))
    for lo, hi in zip(groups[:-1], groups[1:], strict=True):
        at = starts[lo]
        out[lo:hi] = Rolling(BYTE_VALUES[values[at : ends[hi - 1]]], 0).runs(starts[lo:hi] - at, ends[lo:hi] - at)
    return np.split(out, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held[:-1]], dtype=np.int64))) if held else []


def kept_words(text: bytes, gone: np.ndarray | None) -> list[bytes]:
    words = text.split()
    return words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` cut into ``batches`` ranges of doc_id with about as many rows each."""
    if batches == 1:
        return [docs]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    edges = [None, *sorted(set(cuts or [])), None]
    return [docs.where((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def rule_of(window: int = WINDOW) -> Rule:
    return Rule(word_units, window, anywhere=False, steps=STEPS)


def dedup_words(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input.
    Null and empty texts have no words. Rows with a null doc_id come before none
    and lose nothing; rows that repeat a doc_id don't take from each other.
    """

    def describe(text, gone):
        kept = kept_words(text, gone)
        removed = 0 if gone is None else int(gone.sum())
        return len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()

    return describe_removals(docs, in_batches(docs, batches), rule_of(window), fanout, describe, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the words that ``dedup_words`` removes cut out of ``text``.

    The kept words of a text that loses some are joined by one space; other texts,
    null included, and all other columns stay as they are. No row goes.
    """
    return rewrite_texts(docs, in_batches(docs, batches), rule_of(window), fanout, lambda text, gone: b" ".join(kept_words(text, gone)))


def substring_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``dedup_words`` of all documents; its docstring states what null, empty and repeated rows give."""
    return dedup_words(docs)

"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct new words of a batch lie in one flat symbol array. In each round the
adjacent pairs of all words are looked up by binary search over the sorted pair
keys, every word merges its lowest-ranked pair wherever it occurs (left to right),
and words without a mergeable pair leave the array. A round costs as much as the
array, and a word takes as many rounds as it has ranks to merge, so the few words of
over LONG bytes make the same merges one by one from a queue instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: how byte-level BPE of this family cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of a word from which on its pairs wait in a queue.
LONG = 2_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts`` with ``lengths``, one after another."""
    skipped = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - skipped, lengths) + np.arange(int(lengths.sum()))]


class Codec:
    """A byte-level BPE vocabulary from the JSON of the tokenizers library."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbol], np.int64)
        back = {s: b for b, s in enumerate(symbol)}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.pairs = dict(zip(keys.tolist(), zip(range(len(made)), made.tolist(), strict=True), strict=True))
        self.words = regex.compile(WORDS)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = self.other_classes(content)
        self.forget()

    def other_classes(self, content: bytes) -> dict[int, int]:
        """Characters that the regex module's newer Unicode tables class as letter or number but the tokenizer's don't.

        Only characters on which two Unicode versions disagree are probed. They are
        mapped to a symbol before cutting, so that they fall in the tokenizer's class.
        """
        from tokenizers import Tokenizer

        pre = Tokenizer.from_str(content.decode()).pre_tokenizer
        every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
        odd = {}
        for kind, probe in (("L", "a"), ("N", "1")):
            for c in regex.findall(rf"\p{{{kind}}}", every):
                if unicodedata.category(c)[0] != kind and len(pre.pre_tokenize_str(probe + c)) != 1:
                    odd[ord(c)] = 0x2603
        return odd

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        if not text.isascii() and not self.odd.keys().isdisjoint(map(ord, set(text))):
            return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.odd))]
        return self.words.findall(text)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Symbols of one word after merging: always the leftmost pair of least rank, from a queue; a merge costs the logarithm of the length."""
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, known = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if pair := known.get(symbols[i] << 32 | symbols[i + 1]):
                queue.append(pair[0] << 32 | i)
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), 1 << 32)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            pair = known.get(symbols[i] << 32 | symbols[j])
            if pair is None or pair[0] != rank:
                continue
            symbols[i], symbols[j] = pair[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if pair := known.get(symbols[i] << 32 | symbols[k]):
                    heapq.heappush(queue, pair[0] << 32 | i)
            if (h := before[i]) >= 0 and (pair := known.get(symbols[h] << 32 | symbols[i])):
                heapq.heappush(queue, pair[0] << 32 | h)
        return np.array([x for x in symbols if x >= 0], np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all ``words`` after merging, flat, and how many each has."""
        if long := {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG}:
            flat, counts = self.merge_rounds([w for i, w in enumerate(words) if i not in long])
            rest = iter(np.split(flat, np.cumsum(counts)[:-1])) if len(counts) else iter(())
            parts = [long[i] if i in long else next(rest) for i in range(len(words))]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return self.merge_rounds(words)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` in rounds over the symbols of all words at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            at = np.minimum(np.searchsorted(self.keys, symbols[:-1] << 32 | symbols[1:]), len(self.keys) - 1)
            found = (self.keys[at] == (symbols[:-1] << 32 | symbols[1:])) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            alive = np.repeat(least != NO_RANK, sizes)
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_owner.append(owner[~alive])
            hit = (rank == np.repeat(least, sizes)) & alive
            # of overlapping hits (runs of one symbol) every second one is merged, from the left
            run_start = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(run_start, place, -1))) % 2 == 0
            where = np.nonzero(hit)[0]
            symbols = symbols.copy()
            symbols[where] = self.made[at[where]]
            keep = alive.copy()
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all ``docs``, flat, and how many each has."""
        words: list[str] = []
        per_doc = []
        for text in docs:
            before = len(words)
            parts = self.cuts.split(text) if self.cuts and any(s in text for s in self.special) else [text]
            for i, part in enumerate(parts):
                if i % 2:
                    words.append("\0" + part)  # never the look of a cut word with more behind it
                elif part:
                    words.extend(self.split(part))
            per_doc.append(len(words) - before)
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            special = [self.special.get(w[1:]) if w[:1] == "\0" else None for w in fresh]
            flat, lengths = self.merge([w.encode() if s is None else b"!" for w, s in zip(fresh, special, strict=True)])
            ends = np.cumsum(lengths)
            for i, s in enumerate(special):
                if s is not None:
                    flat[ends[i] - 1] = s
            self.known.update(zip(fresh, range(len(self.starts), len(self.starts) + len(fresh)), strict=True))
            self.starts = np.append(self.starts, len(self.flat) + ends - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, flat)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[codes]
        sums = np.append(0, np.cumsum(lengths))
        ends = np.cumsum(per_doc, dtype=np.int64)
        return gather(self.flat, self.starts[codes], lengths), sums[ends] - sums[ends - per_doc]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(content: bytes) -> Codec:
    """A worker's codec for this vocabulary, kept between tasks."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast the vocabulary file; its size is a property of the tokenizer, not of the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: token ids of each row of ``docs(doc_id, text)``; a null text is empty, an empty one has no ids."""
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = codec.encode([x or "" for x in part.column("text").to_pylist()])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the decoded text.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows stay
    repeated, a null doc_id stays null, an empty table gives no rows.
    """
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = codec.encode([x or "" for x in part.column("text").to_pylist()])
                each = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                of_ids = [hashlib.sha256(x.tobytes()).hexdigest() for x in each]
                of_text = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in each]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bpe_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decodes`` of each row of ``docs(doc_id, text)``; ``decodes``: the ids decode to the text again."""
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                held = [x or "" for x in part.column("text").to_pylist()]
                ids, counts = codec.encode(held)
                ends = np.append(0, np.cumsum(counts))
                same = [codec.decode(ids[a:b]) == x for a, b, x in zip(ends[:-1], ends[1:], held, strict=True)]
                arrays = [part.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decodes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decodes boolean")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``bpe_round_trip`` with the default vocabulary; its docstring states what null, empty and repeated rows give."""
    return bpe_round_trip(docs, default_vocabulary())

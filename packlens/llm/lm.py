"""Language-model scoring with a weighted backoff automaton.

States are the n-grams of up to ORDER - 1 words that occur at least twice; an arc
(state, word) is an n-gram that occurs and has its smoothed log-probability, and a
failure arc leads from a state to the one without its first word at the cost of a
backoff weight. Reading a text from left to right carries the longest state that is
a suffix of what was read and adds up arcs and failures.

The automaton is never held in one place. Texts lie in blocks; each block asks for
the counts of its own distinct n-grams, questions meet by range of the n-grams'
hashes, and the answers go back to the blocks, which score with them. What one task
holds is a block or a range of hashes, whatever the corpus; no n-gram is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, new_folder, shuffle_partitions, slices, texts
from .segments import Rolling, mixed

ORDER = 3
#: How strongly the model of one word less is held to, by order from 2: a state seen n times trusts its own counts by (n - 1) / (n - 1 + HELD).
HELD = (64.0, 4.0)
#: Bytes of text of a block, and n-grams that a range of hashes is made for.
BLOCK_BYTES, RANGE_KEYS = 8_000_000, 1_000_000
#: Hashes of longer n-grams keep so many bits more than it takes to number the corpus' bytes: one n-gram in a million or fewer shares its hash, whatever the size.
SPARE_BITS = 18
#: The end of a text, counted as a token; stands among the words' hashes.
END = np.uint64(xxhash.xxh64_intdigest(b""))
#: A text is read in pieces of so many bytes.
PIECE_BYTES = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
NEXT = np.uint64(0x9E3779B97F4A7C15)


def read_tokens(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words and ends of the texts, one after another, and how many each text has.

    All words are hashed at once by differences of prefix sums over the joined bytes.
    """
    joined = np.frombuffer((b"\n".join(held) + b"\n").lower(), np.uint8)
    space = SPACE[joined]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.append(0, turns)
    starts, ends = turns[::2], turns[1::2]  # the last byte is white space
    hashes = Rolling(BYTE_VALUES[joined], 0).runs(starts, ends)
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    words = np.diff(np.searchsorted(starts, np.cumsum(lengths + 1)), prepend=0)
    sizes = words + 1
    out = np.full(int(sizes.sum()), END)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = hashes
    return out, sizes


def pieces(held: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in groups of about PIECE_BYTES, one text at least."""
    group, size = [], 0
    for text in held:
        if group and size + len(text) > PIECE_BYTES:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 7; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``read_tokens`` of all texts of a block, piece by piece."""
    read = [read_tokens(group) for group in pieces(held)]
    return np.concatenate([hashes for hashes, _ in read]), np.concatenate([sizes for _, sizes in read])


def places_of(sizes: np.ndarray) -> np.ndarray:
    """How many tokens of its text come before each token."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def longer(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at each token, one word longer than ``keys``; what crosses texts is for the caller to leave out."""
    return mixed(np.append(np.uint64(0), keys[:-1]) * NEXT + hashes)


def planes(values: np.ndarray) -> bytes:
    """Values byte by byte, all lowest bytes first, as far as the largest needs, and compressed; the first byte says how many bytes a value has."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    each = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + each.T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    """The values of ``planes`` as unsigned 64-bit integers."""
    data = zstandard.ZstdDecompressor().decompress(data)
    width = data[0]
    each = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((each.shape[1], 8), np.uint8)
    out[:, :width] = each.T
    return out.view("<u8").reshape(-1)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """In which of ``ranges`` equal ranges of hashes each key lies."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, texts binary"


def blocks_of(rows: DataFrame, block_bytes: int) -> DataFrame:
    """BLOCK rows of ``rows(doc_id, held_out, text)``: the texts of a task in turn, about ``block_bytes`` in each (one text at least), compressed.

    A block is named by its task and place, so a task that runs again makes the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first = 0, TaskContext.get().partitionId() << 32
        ids, out, held, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(held))
            values = [[first + number], [ids], [out], [[len(x) for x in held]], [packed]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "doc_ids", "held_out", "sizes", "texts"])

        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                for doc_id, apart, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts(part.column("text")), strict=True):
                    if held and size + len(text) > block_bytes:
                        yield closed()
                        number, ids, out, held, size = number + 1, [], [], [], 0
                    ids.append(doc_id)
                    out.append(apart)
                    held.append(text)
                    size += len(text)
        if held:
            yield closed()

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, BLOCK)


def unpacked(sizes: list[int], packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(sum(sizes), 1))
    ends = np.cumsum(sizes)
    return [data[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]


def cut_bits(size: int, order: int) -> int:
    """Low bits of a hash that n-grams of a corpus of ``size`` bytes do without; those of single words keep all."""
    return 0 if order == 1 else max(0, 64 - SPARE_BITS - int(size * ORDER).bit_length())


def distinct_grams(hashes: np.ndarray, place: np.ndarray, order: int, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order from 1: which tokens end an n-gram, the sorted distinct keys of these, and the place of each among them."""
    keys = hashes
    for n in range(1, order + 1):
        keys = keys if n == 1 else longer(keys, hashes)
        inside = place >= n - 1
        yield inside, *np.unique(keys[inside] >> np.uint64(cuts[n - 1]) << np.uint64(cuts[n - 1]), return_inverse=True)


QUESTION = "range long, block long, order_ int, keys binary, seen binary"
ANSWER = "range long, block long, order_ int, seen binary, total long, types long"


def questions(blocks: DataFrame, order: int, ranges: int, cuts: list[int]) -> DataFrame:
    """QUESTION rows: the sorted distinct n-grams of a block in each range of hashes, and how often its training texts have each."""

    def ask(table: pa.Table) -> pa.Table:
        block, apart, lengths, packed = (table.column(c)[0].as_py() for c in ("block", "held_out", "sizes", "texts"))
        hashes, sizes = tokens_of(unpacked(lengths, packed))
        place, taught = places_of(sizes), np.repeat(~np.array(apart, bool), sizes)
        out = []
        for n, (inside, found, code) in enumerate(distinct_grams(hashes, place, order, cuts), 1):
            seen = np.bincount(code[taught[inside]], minlength=len(found))
            edges = np.searchsorted(range_of(found, ranges), np.arange(ranges + 1))
            at = np.nonzero(np.diff(edges))[0]
            steps = np.diff(found, prepend=np.uint64(0))
            steps[edges[at]] = found[edges[at]]
            steps >>= np.uint64(cuts[n - 1])
            ends = [(edges[i], edges[i + 1]) for i in at.tolist()]
            columns = [at, [block] * len(at), [n] * len(at), [planes(steps[a:b]) for a, b in ends], [planes(seen[a:b]) for a, b in ends]]
            out.append(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "order_", "keys", "seen"]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").applyInArrow(ask, QUESTION)


def answers(asked: DataFrame, cuts: list[int]) -> DataFrame:
    """ANSWER rows: for each question how often all training texts have its n-grams, in their order.

    The first row of a range also tells its words' occurrences and number; other rows tell 0.
    """

    def answer(asked: pa.Table) -> pa.Table:
        of = np.asarray(asked.column("order_"))
        told: list[bytes] = [b""] * len(of)
        total = types = 0
        for n in np.unique(of).tolist():
            rows = np.nonzero(of == n)[0].tolist()
            keys = [np.cumsum(from_planes(asked.column("keys")[i].as_py()) << np.uint64(cuts[n - 1])) for i in rows]
            seen = np.concatenate([from_planes(asked.column("seen")[i].as_py()) for i in rows])
            _, code = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(code, seen).astype(np.int64)
            if n == 1:
                total, types = int(counts.sum()), int((counts > 0).sum())
            ends = np.cumsum([len(k) for k in keys])
            for i, k, e in zip(rows, keys, ends.tolist(), strict=True):
                told[i] = planes(counts[code[e - len(k) : e]])
        once = lambda x: pa.array([x] + [0] * (len(of) - 1), pa.int64())
        return pa.table({"range": asked.column("range"), "block": asked.column("block"), "order_": asked.column("order_"), "seen": pa.array(told, pa.binary()), "total": once(total), "types": once(types)})

    return asked.groupBy("range").applyInArrow(answer, ANSWER)


def probabilities(counts: list[np.ndarray], place: np.ndarray, total: int, types: int, held: tuple[float, ...] = HELD) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by the words alone and by the automaton.

    ``counts[n - 1]`` has for each token how often the n-gram that ends with it
    occurs. From the state of order n - 1 before a token an arc is an n-gram that
    occurs; its weight holds the share of the shorter state's, and a failure costs
    what the state leaves to that one. Reading all tokens at once order by order
    gives what a walk gives, since a state is told by the last words alone.
    """
    base = (counts[0] + 1.0) / (total + types + 1.0)
    full = base
    for order in range(2, len(counts) + 1):
        before = np.append(0, counts[order - 2][:-1])
        at = np.nonzero((place >= order - 1) & (before > 1))[0]
        trust = (before[at] - 1) / (before[at] - 1 + held[order - 2])
        full = full.copy()
        full[at] = trust * counts[order - 1][at] / before[at] + (1 - trust) * full[at]
    return base, full


def score_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS, held: tuple[float, ...] = HELD) -> DataFrame:
    """Train on the documents that aren't held out and score each row of ``docs(doc_id, text)``.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score. A null or empty text is its end token only. A null doc_id
    counts as training; repeated rows count as often as they come. With nothing to
    train on, every token has probability 1 under both models. An empty table
    gives no rows.

    The blocks are written once, bucketed by their names, so that no text is
    shuffled. A range of hashes holds about ``range_keys`` n-grams, of which one
    that is very common comes once a block. Only three numbers reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts, cuts = shuffle_partitions(spark), [cut_bits(size, n) for n in range(1, order + 1)]
    blocks = bucketed(blocks_of(rows, block_bytes), new_folder(spark, "blocks"), max(parts, -(-size // block_bytes)), ["block"])
    ranges = max(parts, -(-size * order // 6 // range_keys))  # a word and the space behind it have six bytes or so
    told = materialize(answers(questions(blocks, order, ranges, cuts).repartition(ranges, "range"), cuts), "answers")
    total, types = (x or 0 for x in told.agg(F.sum("total"), F.sum("types")).first())

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        ids, apart, lengths, packed = (block.column(c)[0].as_py() for c in ("doc_ids", "held_out", "sizes", "texts"))
        hashes, sizes = tokens_of(unpacked(lengths, packed))
        told = told.sort_by([("order_", "ascending"), ("range", "ascending")])
        of, place, counts = np.asarray(told.column("order_")), places_of(sizes), []
        for n, (inside, _, code) in enumerate(distinct_grams(hashes, place, order, cuts), 1):
            counts.append(np.zeros(len(hashes), np.int64))
            if len(code):
                known = [from_planes(told.column("seen")[i].as_py()) for i in np.nonzero(of == n)[0].tolist()]
                counts[-1][inside] = np.concatenate(known).astype(np.int64)[code]
        base, full = probabilities(counts, place, total, types, held)
        starts = np.cumsum(sizes) - sizes
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), starts)
        columns = [pa.array(ids, pa.int64()), pa.array(apart, pa.bool_()), *(pa.array(x, pa.int64()) for x in (sizes, known, np.full(len(sizes), total))), *(pa.array(np.add.reduceat(np.log10(p), starts)) for p in (base, full))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.select("block", "order_", "range", "seen").groupBy("block")).applyInArrow(score, schema)


def lm_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``score_documents`` of all documents; its docstring states what null, empty, repeated and long texts give."""
    return score_documents(docs)

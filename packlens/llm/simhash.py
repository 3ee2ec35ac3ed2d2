"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of a group are stored as vertical bit planes (plane i holds bit i of
64 documents in each word). A query's differing bits are added to two-bit
carry-save counters for all documents at once, and a block of 64 documents is left
as soon as all of its counters have passed the radius for all queries at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices, texts
from .graph import connected_components
from .repeats import bounded

SEED = 42
#: Rows of a comparison block; queries are taken in strips of STRIP.
BLOCK, STRIP = 16_384, 64


def shingle_hashes(text: bytes, words: int, lower: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z lower-cased; fewer words: of the whole sequence; none: empty."""
    held = (text.lower() if lower else text).split()
    if not held:
        return np.empty(0, "<u8")
    joined = b" ".join(held)
    if len(held) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = len(held) - words + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[words - 1 :].tolist(), strict=True)), "<u8", count)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit j of word k in plane i is bit i of fingerprint 64 k + j."""
    padded = np.zeros(-(-len(prints) // 64) * 64, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int, looked_at: list[int] | None = None) -> np.ndarray:
    """For each query a row of words whose bits mark the documents at ``radius`` or fewer differing bits.

    The counters are bit-sliced: ``width`` words count up to 2**width - 1 and
    start at 2**width - 1 - radius, so that a carry out of the top one marks a
    document beyond the radius for good. Blocks, columns of ``planes``, all of whose
    documents are beyond it for all queries are abandoned after every eighth plane.
    ``looked_at`` gets how many blocks each plane was compared in.
    """
    width = max(1, int(radius).bit_length())
    ones = ~np.uint64(0)
    start = (1 << width) - 1 - radius
    left = np.arange(planes.shape[1])
    shape = (len(queries), len(left))
    counters = [np.full(shape, ones if start >> i & 1 else np.uint64(0)) for i in range(width)]
    beyond = np.zeros(shape, np.uint64)
    for i in range(64):
        if looked_at is not None:
            looked_at.append(len(left))
        flip = np.where(queries >> np.uint64(i) & np.uint64(1), ones, np.uint64(0))
        carry = planes[i][left][None, :] ^ flip[:, None]
        for c in counters:
            c ^= carry
            carry &= ~c
        beyond |= carry
        if i % 8 == 7:
            near = (beyond != ones).any(axis=0)
            if not near.all():
                left, beyond, counters = left[near], beyond[:, near], [c[:, near] for c in counters]
                if not len(left):
                    break
    out = np.zeros(shape, np.uint64)
    out[:, left] = ~beyond
    return out


def links_within(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (index, least index of its group) of the graph that links ``prints`` at ``radius`` or fewer bits.

    All prints are compared: a strip of 64 with itself bit by bit, and with what
    comes after it bit-sliced, so that its own distance of 0 keeps no block alive.
    Groups are merged on the fly, so at most one link a print is returned whatever
    the number of close pairs.
    """
    n = len(prints)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def link(rows: np.ndarray, cols: np.ndarray) -> None:
        for x, y in zip(rows.tolist(), cols.tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)

    for q in range(0, n, STRIP):
        strip = prints[q : q + STRIP]
        rows, cols = np.nonzero(np.bitwise_count(strip[:, None] ^ strip[None, :]) <= radius)
        link(q + rows[rows < cols], q + cols[rows < cols])
    for at in range(0, n, BLOCK):
        block = prints[at : at + BLOCK]
        planes = planes_of(block)
        for q in range(0, min(at + BLOCK, n) - STRIP, STRIP):
            first = max(0, (q - at) // STRIP + 1)  # words of the block that come after the strip
            bits = within_radius(prints[q : q + STRIP], planes[:, first:], radius)
            if bits.any():
                rows, cols = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(block) - first * STRIP])
                link(q + rows, at + first * STRIP + cols)
    stars = np.array([find(i) for i in range(n)], dtype=np.int64)
    other = np.nonzero(stars != np.arange(n))[0]
    return other, stars[other]


def bucket_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (k, key, id, print) sorted by (k, key): star links a, b inside each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(k, key, ids, prints):
            same = np.concatenate(([True], (k[1:] != k[:-1]) | (key[1:] != key[:-1]), [True]))
            edges = np.nonzero(same)[0]
            out_a, out_b = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo == 2:
                    if bin(int(prints[lo]) ^ int(prints[lo + 1])).count("1") <= radius:
                        out_a.append(ids[lo : lo + 1]), out_b.append(ids[lo + 1 : hi])
                elif hi - lo > 2:
                    x, y = links_within(prints[lo:hi], radius)
                    out_a.append(ids[lo:hi][x]), out_b.append(ids[lo:hi][y])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            cols[3] = cols[3].astype(np.int64).view(np.uint64)
            if not len(cols[0]):
                continue
            if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield from links(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            change = np.nonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))[0]
            last = int(change[-1]) + 1 if len(change) else 0
            if last:
                yield from links(*map(np.concatenate, zip(*held, tuple(c[:last] for c in cols), strict=True)))
                held = []
            held.append(tuple(c[last:].copy() for c in cols))
        if held:
            yield from links(*map(np.concatenate, zip(*held, strict=True)))

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, print`` (signed 64-bit SimHash over ``words``-word shingles) of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = np.array([fingerprint(shingle_hashes(x, words)) for x in texts(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def byte_keys(radius: int) -> list[int]:
    """Masks over whole bytes such that two prints within ``radius`` agree under at least one (pigeonhole)."""
    if not 0 <= radius <= 4:
        raise ValueError("exact byte keys are made for a radius of 0 to 4")
    masks = []
    for kept in combinations(range(8), 8 - radius):
        mask = sum(0xFF << 8 * i for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def linked_prints(prints: DataFrame, radius: int) -> DataFrame:
    """``print, component`` of those of the distinct ``prints(print)`` that are linked with another, compared bit-sliced within their buckets."""
    masks = F.array(*[F.lit(m).cast("long") for m in byte_keys(radius)])
    keyed = prints.select(F.posexplode(masks).alias("k", "mask"), "print").select("k", F.col("print").bitwiseAND(F.col("mask")).alias("key"), F.col("print").alias("id"), "print")
    spread = keyed.repartition(shuffle_partitions(prints.sparkSession), "k", "key").sortWithinPartitions("k", "key")
    return connected_components(spread.mapInArrow(bucket_links(radius), "a long, b long")).withColumnRenamed("node", "print")


def print_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``print, component_id`` for the distinct values of ``prints(doc_id, print)``.

    Links join fingerprints at ``radius`` or fewer differing bits; equal
    fingerprints are one node with its least doc_id. Two prints within the radius
    agree in 8 - radius whole bytes, so each node goes to one bucket per choice of
    bytes; with radius 2 a bucket fixes 48 bits and has 65,536 nodes at most.
    """
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    grouped = nodes.join(linked_prints(nodes, radius), "print", "left").select("print", "first_id", F.coalesce("component", "print").alias("component"))
    return with_least(grouped).select("print", "component_id")


def with_least(grouped: DataFrame) -> DataFrame:
    """``grouped(component, first_id)`` with the least first_id of each component as ``component_id``.

    Components of one row, most of them, have their own. Of the others the least are
    written before they are joined, so that a large component can be split.
    """
    grouped = materialize(grouped, "components")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").select("component", "component_id")
    return grouped.join(materialize(least, "leasts"), "component", "left").withColumn("component_id", F.coalesce("component_id", "first_id"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, print, component_id`` of each row of ``docs(doc_id, text)``.

    Null and white-space texts have fingerprint 0 and link like any other. Rows
    with a null doc_id get the component's least doc_id, null if it has none.
    Repeated rows stay repeated. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words), "simhash")
    return prints.join(print_components(prints, radius), "print").select("doc_id", "print", "component_id")


#: Near duplicates: shingle words and least Jaccard similarity.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Differing bits at which fingerprints make two sets candidates, by the comparison of ``print_components``.
NEAR_RADIUS = 2
#: Block keys for sets whose fingerprints lie further apart: BANDS keys, each of ROWS least hashes; a pair at 0.8 shares none with probability 3e-5.
BANDS, ROWS = 20, 4
#: Texts, and shingles of theirs, that are compared in one task, and central texts that every part of a larger group gets.
PART, PART_SHINGLES, HUBS = 2_000, 2_000_000, 32
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set; sets at a high Jaccard similarity share some."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(FACTORS, shingles[at : at + 2048]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a shingle set, signed; ``shingles`` are distinct and sorted."""
    name = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return name - (1 << 64) if name >> 63 else name


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, node, print, shingles, keys`` of each row of ``docs(doc_id, text)``; all but the first depend on the shingle set only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, prints, sizes, keys = [], [], [], []
                for text in texts(part.column("text")):
                    distinct = np.unique(shingle_hashes(text, words))
                    nodes.append(node_of(distinct))
                    prints.append(fingerprint(distinct))
                    sizes.append(len(distinct))
                    keys.append(block_keys(distinct))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], ["doc_id", "node", "print", "shingles", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, print long, shingles long, keys array<long>")


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links (index, least index of its group) of the graph that links sets at ``similarity`` or more.

    Intersections of one set with all come from an inverted index, exactly.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, posting = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    starts = np.nonzero(new)[0]
    lengths = np.diff(np.append(starts, len(flat)))
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(new) - 1
    edges = np.append(0, np.cumsum(sizes))
    root = np.arange(n)
    for i in range(n):
        own = code[edges[i] : edges[i + 1]]
        skipped = np.cumsum(lengths[own]) - lengths[own]
        hits = posting[np.repeat(starts[own] - skipped, lengths[own]) + np.arange(int(lengths[own].sum()))]
        shared = np.bincount(hits, minlength=n)
        linked = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
        linked[i] = True
        near = np.unique(root[linked])
        if len(near) > 1:
            root[np.isin(root, near)] = near[0]
    other = np.nonzero(root != np.arange(n))[0]
    return other, root[other]


def salt(parts: str) -> Column:
    """The part, of as many as column ``parts`` says, that a node is in."""
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


#: The set of a text, distinct and sorted; star links (index, least index of its group) of some sets.
Sets = Callable[[bytes], np.ndarray]
Links = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class SetRule:
    """What a text's set is, and which of some sets are linked.

    ``banded``: keys of two sets count as shared only at the same place of their lists.
    """

    sets: Sets
    links: Links
    banded: bool = True
    #: How to link the nodes of each key, given ``k, key, node`` rows; None: ``bucket_stars``.
    stars: Callable[[DataFrame], DataFrame] | None = None

    def keyed(self, nodes: DataFrame, *columns: str) -> DataFrame:
        """A row for each key of each node: k, key, and ``columns``."""
        if self.banded:
            return nodes.select(*columns, F.posexplode("keys").alias("k", "key"))
        return nodes.select(*columns, F.lit(0).alias("k"), F.explode("keys").alias("key"))


def word_rule(words: int, similarity: float) -> SetRule:
    return SetRule(lambda text: np.unique(shingle_hashes(text, words)), lambda sets: similar_links(sets, similarity))


def links_of_texts(docs: DataFrame, members: DataFrame, task: list[str], sets: Sets, links: Links) -> DataFrame:
    """Star links ``a, b`` among the nodes of each ``task`` of ``members(first_id, node, *task)``, checked on the shingle sets."""
    held = materialize(members.select("first_id", "node", *task), "members")
    rows = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(bounded(held), "first_id")

    def check(table: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        wanted = set(table.column("node").to_pylist())
        for text in texts(table.column("text").combine_chunks()):
            distinct = sets(text)
            if (node := node_of(distinct)) in wanted:
                found[node] = distinct
        names = np.array(sorted(found), np.int64)
        x, y = links([found[i] for i in names.tolist()]) if len(names) > 1 else ((), ())
        return pa.table({"a": pa.array(names[list(x)] if len(x) else [], pa.int64()), "b": pa.array(names[list(y)] if len(y) else [], pa.int64())})

    return rows.select(*task, "node", "text").groupBy(*task).applyInArrow(check, "a long, b long")


def in_buckets(sized: DataFrame, nodes: DataFrame, rule: SetRule) -> DataFrame:
    """``component, node, first_id, shingles, parts`` of the nodes of ``sized`` in each of their buckets, which ``component`` names."""
    held = rule.keyed(sized.select("node").join(nodes, "node"), "node", "first_id", "shingles")
    held = materialize(held.select(F.xxhash64("k", "key").alias("component"), "node", "first_id", "shingles"), "bucketed")
    counts = held.groupBy("component").agg(F.count("*").alias("size"), F.sum("shingles").alias("held")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / F.lit(PART)), F.ceil(F.col("held") / F.lit(PART_SHINGLES)), F.lit(1)).cast("int")
    return held.join(materialize(counts.select("component", parts.alias("parts")), "buckets"), "component")


def links_across(docs: DataFrame, split: DataFrame, linked: DataFrame, rule: SetRule) -> DataFrame:
    """Links ``a, b`` that the buckets ``split`` still lack, given the clusters ``linked`` found in the parts of their groups.

    Where a node has many keys, a bucket is the whole group, so that a text is sent once
    and not once a key. A missing link joins two clusters of a bucket, so one of its ends lies outside
    the bucket's largest cluster. These nodes, the rest, are compared in blocks
    with all nodes of the bucket. Usually the hubs leave few of them.
    """
    clusters = split.join(linked.select("node", F.col("component").alias("cluster")), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    clusters = materialize(clusters.select("component", "cluster", "node", "first_id", "shingles", "parts"), "clusters")
    sizes = clusters.groupBy("component", "cluster").agg(F.count("*").alias("size"))
    largest = materialize(sizes.groupBy("component").agg(F.max(F.struct("size", "cluster")).getField("cluster").alias("largest")), "largest")
    told = materialize(clusters.join(largest, "component").withColumn("rest", F.col("cluster") != F.col("largest")), "rest")
    counts = told.where("rest").groupBy("component").agg(F.count("*").alias("size"), F.sum("shingles").alias("held"))
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(PART)), F.ceil(F.col("held") / F.lit(PART_SHINGLES)), F.lit(1)).cast("int")
    dealt = told.join(materialize(counts.select("component", blocks.alias("blocks")), "blocks"), "component")
    every = dealt.select("component", "first_id", "node", salt("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rest = dealt.where("rest").select("component", "first_id", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt("blocks").alias("block"))
    return links_of_texts(docs, every.union(rest).distinct(), ["component", "part", "block"], rule.sets, rule.links)


def bucket_stars(keyed: DataFrame) -> DataFrame:
    """Star links ``a, b`` that join all nodes of each bucket of ``keyed(k, key, node)``; a bucket is never gathered in one task."""
    least = keyed.groupBy("k", "key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(materialize(least.select("k", "key", "least"), "buckets"), ["k", "key"]).select(F.col("node").alias("a"), F.col("least").alias("b"))


def near_duplicate_groups(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of each row of ``docs(doc_id, text)``: groups linked by Jaccard similarity of shingle sets.

    Rows with one shingle set are one node. Nodes with linked fingerprints and nodes that share a block key are
    candidates, all of which are checked on the shingle sets themselves: by group
    of nodes linked by these. Groups above PART nodes or PART_SHINGLES
    shingles are checked in parts, each with the group's HUBS nodes nearest to its majority fingerprint;
    ``links_across`` then finds the links that this leaves out, bucket by bucket.
    Texts without words have an empty set and form one group. A null doc_id has
    no group of its own: its component is null or its equals'. Rows that repeat a
    doc_id are in one group if their texts are.
    """
    rows = materialize(signatures(docs, words), "signatures")
    nodes = with_print_keys(nodes_of(rows))
    return linked_groups(docs, rows, word_rule(words, similarity), nodes).select("doc_id", "component_id")


def with_print_keys(nodes: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """``nodes`` with one more key: the component of their fingerprint, linked at ``radius`` or fewer bits."""
    prints = materialize(nodes.select("print").distinct(), "prints")
    held = nodes.join(linked_prints(prints, radius), "print", "left")
    return materialize(held.withColumn("keys", F.concat("keys", F.array(F.coalesce("component", "print")))).drop("component"), "keyed")


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each set of ``rows(doc_id, node, print, shingles, keys)``, with the least doc_id that has it."""
    return materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("print").alias("print"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys")), "nodes")


def linked_groups(docs: DataFrame, rows: DataFrame, rule: SetRule, nodes: DataFrame | None = None) -> DataFrame:
    """``doc_id, shingles, component_id`` of ``rows(doc_id, node, print, shingles, keys)``, what ``docs(doc_id, text)`` have as sets.

    ``near_duplicate_groups`` says how; sets that ``rule`` links must share a key. With
    ``nodes``, as ``nodes_of`` makes them, ``rows`` needs doc_id, node and shingles only.
    """
    nodes = nodes_of(rows) if nodes is None else nodes
    groups = connected_components((rule.stars or bucket_stars)(rule.keyed(nodes, "node")))
    held = materialize(nodes.join(groups, "node").select("node", "first_id", "print", "shingles", "component"), "grouped")
    majority = held.groupBy("component").agg(*[F.sum(F.shiftright("print", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)], F.count("*").alias("size"), F.sum("shingles").alias("held"))
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("size"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middles = materialize(majority.select("component", "size", "held", middle.alias("middle")), "middles")
    sized = held.join(middles, "component")
    parts = F.greatest(F.ceil(F.col("size") / F.lit(PART)), F.ceil(F.col("held") / F.lit(PART_SHINGLES)), F.lit(1)).cast("int")
    sized = materialize(sized.withColumn("parts", parts).withColumn("far", F.bit_count(F.col("print").bitwiseXOR(F.col("middle")))), "candidates")
    marked = sized.join(top_nodes(sized.where("parts > 1")), ["component", "node"], "left")
    part = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(salt("parts")))
    linked = connected_components(links_of_texts(docs, marked.withColumn("part", F.explode(part)), ["component", "part"], rule.sets, rule.links))
    if not sized.where("parts > 1").isEmpty():
        large = sized.where("parts > 1")
        across = links_across(docs, in_buckets(large, nodes, rule) if rule.banded else large, linked, rule)
        linked = connected_components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across))
    grouped = nodes.select("node", "first_id").join(linked, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    named = with_least(grouped).select("node", "component_id")
    return rows.select("doc_id", "node", "shingles").join(named, "node").select("doc_id", "shingles", "component_id")


def top_nodes(rows: DataFrame) -> DataFrame:
    """``component, node, hub``: the HUBS nodes of each component with the least ``far``; ranked within salted parts first."""
    parts = Window.partitionBy("component", F.pmod(F.xxhash64("node"), F.col("parts"))).orderBy("far", "node")
    some = rows.withColumn("_rank", F.row_number().over(parts)).where(F.col("_rank") <= HUBS)
    whole = Window.partitionBy("component").orderBy("far", "node")
    return some.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= HUBS).select("component", "node", F.lit(True).alias("hub"))


def drop_near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``docs`` with the document of least doc_id of each group; rows with a null doc_id stay, rows that repeat a doc_id stay or go together."""
    groups = near_duplicate_groups(docs, words, similarity)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_packlens_id")).distinct()
    return docs.join(others.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("_packlens_id"), "left_anti")


def simhash_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``simhash_components`` of all documents; its docstring states what null, empty and repeated rows give."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

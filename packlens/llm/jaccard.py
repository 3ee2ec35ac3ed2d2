"""Exact join of documents by the Jaccard similarity of their word shingles, by set relations.

A set is cut into segments by its shingles' hashes. Two sets of the asked similarity
differ in few shingles, so one of the largest segments of both is the same; sets
that share one are candidates, and groups of candidates are checked in bounded parts. There

* index lists of prefix shingles consist of blocks with one set size and one position;
  by these two numbers whole blocks are skipped that can't hold a partner, and
* a set that is very much like one whose partners are known gets its own partners from
  those: overlaps change only by the few shingles in which the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialize, slices, texts
from .repeats import bounded
from .segments import mixed
from .simhash import SetRule, fingerprint, linked_groups, node_of, nodes_of
from .substrings import word_units

#: Sets of fewer shingles than ``2**SEGMENTED`` are not cut: some shingles together make a key.
SEGMENTED = 6
#: Shingles that make such a key, and keys of a set, at most.
TOGETHER, TOGETHER_KEYS = 6, 40
#: How many shingles the smallest set of a level must have for each segment.
LEAST_SHARE = 2.5


@dataclass(frozen=True)
class Jaccard:
    """Sets of distinct shingles of ``words`` words; two link at ``percent`` of their union or more.

    A set's partners are derived from those of a set with at most ``slack`` percent
    distance, which are looked up down to ``percent - slack`` for that. ``spare`` is how
    many segments there are for each that two similar sets may differ in.
    """

    words: int = 3
    percent: int = 90
    slack: int = 5
    spare: float = 1.45

    def __post_init__(self) -> None:
        if not (0 <= self.slack < self.percent <= 100 and self.words > 0):
            raise ValueError("slack must be below percent, and percent at most 100")

    def sets(self, held: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text as sorted 64-bit hashes; fewer words make one, none make none."""
        out = []
        for hashes in word_units([t.lower() for t in held]):
            n = min(self.words, len(hashes))
            if not n:
                out.append(hashes)
                continue
            keys = np.full(len(hashes) - n + 1, np.uint64(n))
            for i in range(n):
                keys = mixed(keys ^ hashes[i : len(hashes) - n + 1 + i])
            out.append(np.unique(keys))
        return out

    def differences(self, size: int) -> int:
        """The most shingles in which a set of ``size`` and one of the asked similarity can differ."""
        return (size + 100 * size // self.percent) * (100 - self.percent) // (100 + self.percent)

    def segments(self, level: int) -> int:
        """Segments of sets of ``2**level`` to below ``2**(level + 1)`` shingles."""
        return int(self.spare * (self.differences((2 << level) - 1) + 1)) + 1

    def level(self, size: int, cut: bool = True) -> int:
        """The level of a size, from SEGMENTED on; else how many shingles make a key, negative, 0 for all."""
        level = size.bit_length() - 1
        if level >= SEGMENTED:
            return level if cut and (1 << level) >= LEAST_SHARE * self.segments(level) else -1
        differ = self.differences(size)
        if not differ:
            return 0
        return -max(1, *(k for k in range(TOGETHER + 1) if k <= size - differ and comb(differ + k, k) <= TOGETHER_KEYS))

    def levels(self, low: int, high: int, cut: bool) -> list[int]:
        """The levels of all sizes from ``low`` to ``high``, which are less than twice ``low``."""
        small = range(low, min(high, (1 << SEGMENTED) - 1) + 1)
        return sorted({self.level(n, cut) for n in (*small, high, max(low, min(high, 1 << SEGMENTED)), low)})

    def prefix(self, sizes: np.ndarray, percent: int | None = None) -> np.ndarray:
        """Of how many first shingles two sets of ``percent`` similarity share one at least."""
        return sizes + (-(percent or self.percent) * sizes) // 100 + np.minimum(sizes, 1)


@lru_cache(maxsize=1000)
def choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64)


def segment_keys(shingles: np.ndarray, rule: Jaccard, cut: bool = True) -> tuple[np.ndarray, bool]:
    """Keys of a set such that two sets of the rule's similarity share one, and whether all it takes for that are there.

    Sets of about one size (a level) have as many segments, by hash. If two sets differ in d
    shingles, they differ in d segments at most. Each gives keys to its d + 1 largest segments
    (ties: in order). Of the segments that both have, let s be the first in that order: at most d
    come before it in either set, since these differ; so both give it a key. Small sets aren't cut: among
    the first d + k shingles by hash are k that both have, so all choices of k make the keys. A set
    gives the keys of each level that a smaller partner may have. In the rare case that hashes
    leave a set fewer segments than it takes, ``cut=False`` leaves all sets uncut.
    """
    n = len(shingles)
    if not n:
        return np.empty(0, np.uint64), True
    most, found, enough = rule.differences(n), [], True
    for level in rule.levels(-(-rule.percent * n // 100), n, cut):
        if level < 0:  # uncut, of -level shingles; 0 stands for all
            k = min(-level, n)
            first = mixed(np.partition(shingles, min(most + k, n) - 1)[: most + k])
            first.sort()
            found.append(mixed(first[choices(len(first), k)].sum(axis=1) ^ np.uint64(k)))
            continue
        if not level:
            found.append(mixed(shingles.sum(keepdims=True)))
            continue
        segment = shingles % np.uint64(rule.segments(level))
        order = np.argsort(segment, kind="stable")
        ordered = segment[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        enough &= len(at) > most
        content = np.add.reduceat(mixed(shingles[order]), at)
        largest = np.argsort(-np.diff(np.append(at, n)), kind="stable")[: most + 1]
        found.append(mixed(content[largest] ^ mixed(ordered[at[largest]] + np.uint64(level << 32))))
    return np.concatenate(found), enough


def keyed_rows(docs: DataFrame, rule: Jaccard, cut: bool = True) -> DataFrame:
    """``doc_id, node, print, shingles, keys, enough`` of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = rule.sets(texts(part.column("text")))
                keys, enough = zip(*[segment_keys(s, rule, cut) for s in sets], strict=True)
                ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
                columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array(enough)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "node", "print", "shingles", "keys", "enough"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, print long, shingles long, keys array<long>, enough boolean")


def segment_stars(keyed: DataFrame) -> DataFrame:
    """Star links ``a, b`` that join all nodes of each key of ``keyed(k, key, node)``; no key is gathered in a task.

    Most shared keys have two nodes, the least and the greatest, and are linked by the
    aggregation itself. The others are joined once more, by a broadcast if they are few.
    """
    ends = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).where("size > 1")
    ends = materialize(ends, "shared")
    more = keyed.join(bounded(ends.where("size > 2").select("key", "least")), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return ends.select(F.col("most").alias("a"), F.col("least").alias("b")).unionByName(more)


class SetIndex:
    """Sets by number, as ascending shingle numbers (rare ones first), with all lists and blocked prefix lists of shingles."""

    def __init__(self, sets: list[np.ndarray], rule: Jaccard) -> None:
        self.rule, self.sizes = rule, np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        by_count = np.empty(len(count), np.int64)
        by_count[np.argsort(count, kind="stable")] = np.arange(len(count))
        code = by_count[code]
        code = code[np.lexsort((code, owner))]
        self.code, self.edges = code, np.append(0, np.cumsum(self.sizes))
        self.mark = np.zeros(len(count), bool)
        order = np.argsort(code, kind="stable")
        self.lists, self.list_edges = owner[order], np.searchsorted(code[order], np.arange(len(count) + 1))
        place = np.arange(len(code)) - self.edges[owner]
        held = np.flatnonzero(place < rule.prefix(self.sizes, rule.percent - rule.slack)[owner])
        held = held[np.lexsort((place[held], self.sizes[owner[held]], code[held]))]
        self.entries = owner[held]
        keys = np.stack((code[held], self.sizes[self.entries], place[held]))
        self.blocks = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(held) else np.empty(0, np.int64)
        self.block_token, self.block_size, self.block_place = keys[:, self.blocks]
        self.block_edges = np.append(self.blocks, len(held))
        self.token_blocks = np.searchsorted(self.block_token, np.arange(len(count) + 1))

    def tokens(self, i: int) -> np.ndarray:
        return self.code[self.edges[i] : self.edges[i + 1]]

    def linked(self, shared: np.ndarray, size: int, others: np.ndarray, percent: int) -> np.ndarray:
        return 100 * shared >= percent * (size + self.sizes[others] - shared)

    def candidates(self, i: int, percent: int, skipped: list[int] | None = None) -> np.ndarray:
        """The sets that may have ``percent`` similarity with set ``i``: those in blocks whose size and position allow it."""
        size = int(self.sizes[i])
        first = self.tokens(i)[: int(self.rule.prefix(np.int64(size), percent))]
        low, high = self.token_blocks[first], self.token_blocks[first + 1]
        at = np.repeat(np.arange(len(first)), high - low)
        block = spans(low, high)
        other, place = self.block_size[block], self.block_place[block]
        needed = -(-percent * (size + other) // (100 + percent))
        fits = (100 * other >= percent * size) & (100 * size >= percent * other) & (1 + np.minimum(size - at - 1, other - place - 1) >= needed)
        if skipped is not None:
            skipped.append(int((~fits).sum()))
        block = block[fits]
        found = np.unique(self.entries[spans(self.block_edges[block], self.block_edges[block + 1])])
        return found[found != i]

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles of set ``i`` each of ``others`` has."""
        self.mark[self.tokens(i)] = True
        hits = self.mark[self.code[spans(self.edges[others], self.edges[others + 1])]]
        self.mark[self.tokens(i)] = False
        ends = np.cumsum(self.sizes[others])
        sums = np.append(0, np.cumsum(hits))
        return sums[ends] - sums[ends - self.sizes[others]]

    def shifted(self, i: int, j: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The overlaps of ``j`` with ``others``, given those of ``i``: only lists of shingles that one of the two lacks are read."""
        a, b = self.tokens(i), self.tokens(j)
        self.mark[a] = True
        inside = self.mark[b]
        self.mark[b] = False
        lost = a[self.mark[a]]
        self.mark[a] = False
        change = np.zeros(len(self.sizes), np.int64)
        for tokens, sign in ((b[~inside], 1), (lost, -1)):
            change += sign * np.bincount(self.lists[spans(self.list_edges[tokens], self.list_edges[tokens + 1])], minlength=len(change))
        return shared + change[others]


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` to below each ``high``, one after another."""
    sizes = high - low
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)


def linked_sets(sets: list[np.ndarray], rule: Jaccard, derived: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star links (index, least index of its group) of the graph that links ``sets`` at the rule's similarity.

    The Jaccard distance obeys the triangle inequality. So all partners of a set j within
    ``slack`` of a set i are among the sets within the wider distance of i, and
    their overlaps with j follow from those with i. ``derived`` gets the sets so answered.
    """
    n = len(sets)
    root = np.arange(n)
    if sum(map(len, sets)):
        index = SetIndex(sets, rule)
        done = index.sizes == 0

        def link(i: int, others: np.ndarray) -> None:
            near = np.unique(root[np.append(others, i)])
            if len(near) > 1:
                root[np.isin(root, near)] = near[0]

        for i in range(n):
            if done[i]:
                continue
            wide = index.candidates(i, rule.percent - rule.slack)
            if not len(wide):
                continue
            size = int(index.sizes[i])
            shared = index.overlaps(i, wide)
            kept = index.linked(shared, size, wide, rule.percent - rule.slack)
            wide, shared = wide[kept], shared[kept]
            link(i, wide[index.linked(shared, size, wide, rule.percent)])
            everyone, overlaps = np.append(wide, i), np.append(shared, size)
            for j in wide[index.linked(shared, size, wide, 100 - rule.slack) & ~done[wide]].tolist():
                found = index.shifted(i, j, everyone, overlaps)
                link(j, everyone[index.linked(found, int(index.sizes[j]), everyone, rule.percent)])
                done[j] = True
                if derived is not None:
                    derived.append(j)
    other = np.flatnonzero(root != np.arange(n))
    return other, root[other]


def jaccard_groups(docs: DataFrame, rule: Jaccard = Jaccard()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``; other columns are ignored.

    Texts link whose sets of distinct shingles (A-Z lower-cased) have the rule's
    Jaccard similarity; ``component_id`` is the smallest doc_id reachable. A text
    with fewer words than a shingle has one, the whole sequence; null, empty and
    white-space texts have an empty set and are linked with nothing. Equal sets are
    one node, so copies cost nothing further. Rows that repeat a doc_id each keep
    their own set. A null doc_id is no component's name: such a row gets its
    equals' component, or null. An empty table gives no rows. Sets are compared by
    64-bit hashes of their shingles.
    """
    with_keys = materialize(keyed_rows(docs, rule), "keys")
    if not with_keys.where("NOT enough").isEmpty():
        with_keys = materialize(keyed_rows(docs, rule, cut=False), "keys")
    nodes = nodes_of(with_keys)
    rows = materialize(with_keys.select("doc_id", "node", "shingles"), "sets")
    free(with_keys)
    one = lambda text: rule.sets([text])[0]
    found = linked_groups(docs, rows, SetRule(one, lambda sets: linked_sets(sets, rule), banded=False, stars=segment_stars), nodes)
    own = F.when(F.col("shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("shingles").alias("n_shingles"), own.alias("component_id"))


def jaccard_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``jaccard_groups`` of all documents; its docstring states what null, empty and repeated rows give."""
    return jaccard_groups(docs)

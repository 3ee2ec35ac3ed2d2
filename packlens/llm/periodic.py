"""Runs of periodically repeated words, by leftmost squares and a suffix tree's vocabulary of squares.

A square is a sequence of words written twice. Each text is cut into LZ blocks;
common extensions around the blocks' borders give squares of which every kind of
square in the text is a rotation (Gusfield and Stoye's leftmost-covering set). Walks
along suffix links turn these through their rotations, wherever these occur, until
the vocabulary is complete; all places of its members are located in the suffix
order and extended to the maximal runs that hold them.

The suffix tree is kept as arrays: names of all substrings of 1, 2, 4, ... words
(equal names, equal substrings) and the sorted suffixes, of which a node is an
interval. Texts are independent of each other, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts
from .segments import mixed

#: Pairs of places that are compared at once.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Wanted:
    """Runs of ``periods`` whole periods and of ``length`` words at least."""

    length: int = 6
    periods: int = 4

    def __post_init__(self) -> None:
        if self.periods < 2 or self.length < 2:
            raise ValueError("a run has two periods and two words at least")

    @property
    def gram(self) -> int:
        """The most words of which each sequence inside a wanted run also stands one period before or after, in the run."""
        return max(1, min(max(self.length, self.periods * q) - 2 * q + 1 for q in range(1, self.length + 1)))


class SuffixTree:
    """The suffix tree of ``symbols``, as sorted suffixes and names of substrings. No two parts of equal symbols may meet the end."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, n = symbols, len(symbols)
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        first = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), np.arange(n), 0))
        name = np.empty(n, np.int32)
        name[order] = first
        levels, width = [name], 1
        open_ = np.arange(n)
        while True:
            open_ = open_[np.bincount(name, minlength=n)[name[open_]] > 1]
            if not len(open_):
                break
            after = np.where(open_ + width < n, name[np.minimum(open_ + width, n - 1)], -1).astype(np.int64)
            key = name[open_].astype(np.int64) * (n + 1) + after + 1
            sort = np.argsort(key, kind="stable")
            key, old = key[sort], name[open_[sort]]
            place = np.arange(len(sort))
            begins = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
            classes = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
            name = name.copy()
            name[open_[sort]] = old + begins - classes
            levels.append(name)
            width *= 2
        self.names = np.stack(levels)  # row k: what 2**k symbols from a place on are called; the last row tells all places apart
        self.rank = name
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[name] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and from ``b`` on are equal; the two differ."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - begin

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` and before ``b`` are equal; the two differ."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            step = ((x >= 0) & (y >= 0) & (self.names[k][np.maximum(x, 0)] == self.names[k][np.maximum(y, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return begin - a

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` symbols, one at least, from each ``a`` and ``b`` on are equal: two names, that overlap, say so."""
        k = np.minimum(np.frexp(length)[1] - 1, len(self.names) - 1)
        rest = length - (1 << k)
        x, y = np.minimum(a + rest, len(self.symbols) - 1), np.minimum(b + rest, len(self.symbols) - 1)
        return (a == b) | (self.names[k, a] == self.names[k, b]) & (self.names[k, x] == self.names[k, y])

    def node(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in suffix order of those that begin with the ``length`` symbols at ``at``."""
        low, high = self.rank[at].astype(np.int64), self.rank[at].astype(np.int64)
        top = len(self.symbols) - 1
        for k in range(top.bit_length(), -1, -1):
            x = low - (1 << k)
            low = np.where((x >= 0) & self.equal(self.suffixes[np.maximum(x, 0)], at, length), x, low)
            x = high + (1 << k)
            high = np.where((x <= top) & self.equal(self.suffixes[np.minimum(x, top)], at, length), x, high)
        return low, high

    def child(self, at: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place where the ``length`` symbols at ``at`` are followed by ``symbol``; -1 for none."""
        low, high = self.node(at, length)
        top = len(self.symbols) - 1
        before = low - 1
        for k in range(top.bit_length(), -1, -1):
            x = before + (1 << k)
            next_ = self.symbols[np.minimum(self.suffixes[np.clip(x, 0, top)] + length, top)]
            before = np.where((x <= high) & (next_ < symbol), x, before)
        found = self.suffixes[np.minimum(before + 1, top)]
        return np.where((before < high) & (self.symbols[np.minimum(found + length, top)] == symbol), found, -1)

    def block_starts(self) -> np.ndarray:
        """Where LZ blocks begin: a block is the longest sequence that also begins earlier, or one new symbol."""
        n = len(self.symbols)
        order = self.suffixes.tolist()
        left, right, stack = [-1] * n, [-1] * n, []
        for at in order:  # the nearest suffixes on either side, in suffix order, that begin earlier
            while stack and stack[-1] > at:
                right[stack.pop()] = at
            left[at] = stack[-1] if stack else -1
            stack.append(at)
        here = np.arange(n)
        longest = np.zeros(n, np.int64)
        for other in (np.array(left), np.array(right)):
            some = other >= 0
            longest[some] = np.maximum(longest[some], self.ahead(here[some], other[some]))
        steps, starts, at = np.maximum(longest, 1).tolist(), [], 0
        while at < n:
            starts.append(at)
            at += steps[at]
        return np.array(starts, np.int64)

    def run_of(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch with ``period`` around the ``2 * period`` symbols at ``at``."""
        return at - self.behind(at, at + period), at + period + self.ahead(at, at + period)


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``sizes`` its number, so often as it says, and 1, 2, ... up to it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def leftmost_squares(tree: SuffixTree, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of squares that cover, up to rotations to the right, the leftmost one of each kind; ``most`` bounds periods by place.

    A leftmost square whose middle lies in a block begins in or before the block and
    ends in it or in the next one. So it has its period on both sides of the next
    block's begin, or else of its own block's begin; extensions from there find it.
    """
    starts = tree.block_starts()
    ends = np.append(starts[1:], len(tree.symbols))
    sizes = ends - starts
    bound = most[starts]
    out = []
    for own in (False, True):
        widths = np.minimum(sizes + np.append(sizes[1:], 0), bound) if own else np.minimum(sizes, bound)
        if not own:
            widths = np.where(ends < len(tree.symbols), widths, 0)
        done = np.append(0, np.cumsum(widths))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
            block, period = counted(widths[at:to])
            block += at
            if own:
                a = starts[block]
                b = a + period
                fits = b < len(tree.symbols)
                block, period, a, b = block[fits], period[fits], a[fits], b[fits]
                forth, back = tree.ahead(a, b), tree.behind(a, b)
                begin = np.maximum(a - back, a - period + 1)
                good = (forth + back >= period) & (forth > 0) & (back > 0) & (begin + period <= ends[block])
            else:
                b = ends[block]
                a = b - period
                forth, back = tree.ahead(a, b), tree.behind(a, b)
                begin = np.maximum(a - back, a - period + 1)
                good = (forth + back >= period) & (forth > 0)
            out.append((begin[good], period[good]))
            at = to
    begin, period = map(np.concatenate, zip(*out, strict=True))
    primitive = np.ones(len(begin), bool)
    left = period.copy()
    while (prime := smallest_factors(left)) is not None:
        open_ = np.nonzero(prime > 1)[0]
        part = period[open_] // prime[open_]
        primitive[open_] &= ~tree.equal(begin[open_], begin[open_] + part, 2 * period[open_] - part)
        left[open_] //= prime[open_]
    return begin[primitive], period[primitive]


def smallest_factors(numbers: np.ndarray) -> np.ndarray | None:
    """The least prime factor of each number, 1 for 1; None if all are 1."""
    if not len(numbers) or numbers.max() == 1:
        return None
    out = np.where(numbers > 1, numbers, 1)
    open_ = numbers > 1
    for p in range(2, int(numbers.max() ** 0.5) + 1):
        hit = open_ & (numbers % p == 0)
        out[hit] = p
        open_ &= ~hit & (numbers >= p * p)
        if not open_.any():
            break
    return out


def new_runs(tree: SuffixTree, at: np.ndarray, period: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs around squares that aren't ``known``: start, end, period; and the names of all that are known now."""
    start, end = tree.run_of(at, period)
    name = start * len(tree.symbols) + period
    fresh, first = np.unique(name, return_index=True)
    first = first[~np.isin(fresh, known)]
    return start[first], end[first], period[first], np.concatenate((known, name[first]))


def square_vocabulary(tree: SuffixTree, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of runs that hold, together, every kind of square with a root that is none itself.

    A walk starts at each leftmost square. While the text goes on with the period,
    the next rotation stands one place further, so the walk jumps to the last square
    of the run. From there the suffix link drops the first word, and the child by
    that word, if there is one, is the next rotation, in another place.
    """
    at, period = leftmost_squares(tree, most)
    known, out = np.empty(0, np.int64), []
    while len(at):
        start, end, period, known = new_runs(tree, at, period, known)
        out.append((start, end, period))
        last = end - 2 * period
        found = tree.child(last + 1, 2 * period - 1, tree.symbols[last])
        at, period = found[found >= 0], period[found >= 0]
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64),) * 3


def all_runs(tree: SuffixTree, most: np.ndarray, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all maximal runs of ``periods`` periods or more; the period is the smallest."""
    start, end, period = square_vocabulary(tree, most)
    # a run of three periods holds all rotations of its square, so that one of them finds all of its kind
    turns = np.minimum(end - start - 2 * period + 1, 1 if periods > 2 else period)
    run, turn = counted(turns)
    at, period = start[run] + turn - 1, period[run]
    low, high = tree.node(at, 2 * period)
    _, first = np.unique(low * len(tree.symbols) + period, return_index=True)
    run, place = counted((high - low + 1)[first])
    start, end, period, _ = new_runs(tree, tree.suffixes[low[first][run] + place - 1], period[first][run], np.empty(0, np.int64))
    good = end - start >= periods * period
    return start[good], end[good], period[good]


def repeated_parts(values: np.ndarray, part: np.ndarray, wanted: Wanted) -> np.ndarray:
    """Places, in order, that may lie in a wanted run of their ``part``, by the words around them.

    Each sequence of ``wanted.gram`` words inside a wanted run also stands elsewhere
    in it. So places that no repeated sequence of its part covers are left out, and
    what is cut into shorter parts by that is looked at again.
    """
    n = wanted.gram
    places = np.arange(len(values))
    while len(places) >= n:
        hashes = np.zeros(len(places) - n + 1, np.uint64)
        for i in range(n):
            hashes = mixed(hashes + values[i : len(values) - n + 1 + i].astype(np.uint64) + np.uint64(1))
        hashes = mixed(hashes ^ mixed(part[: len(hashes)].astype(np.uint64)))
        whole = np.nonzero(part[: len(hashes)] == part[n - 1 :])[0]
        order = np.argsort(hashes[whole], kind="stable")
        ordered = hashes[whole[order]]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(hashes) + n, np.int64)
        seen = whole[order[np.append(same, False) | np.append(False, same)]]
        again[seen] += 1
        again[seen + n] -= 1
        kept = np.cumsum(again)[: len(places)] > 0
        cut = np.append(True, (part[1:] != part[:-1]) | ~kept[:-1] | ~kept[1:])
        stretch = np.cumsum(cut)
        kept &= (np.bincount(stretch, minlength=2)[stretch] >= wanted.length)
        if kept.all():
            break
        places, values, part = places[kept], values[kept], stretch[kept]
    return places if len(places) >= n else places[:0]


def runs_of(values: np.ndarray, owner: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of the wanted runs in ``values``, numbers of words of several texts; ``owner`` ascends by text.

    Stretches that may hold runs follow each other with a symbol of its own after
    each, so all are worked on at once and none meets another.
    """
    places = repeated_parts(values, owner, wanted)
    if not len(places):
        return (np.empty(0, np.int64),) * 3
    ends_here = np.append((places[1:] != places[:-1] + 1) | (owner[places[1:]] != owner[places[:-1]]), True)
    stretch = np.cumsum(ends_here) - ends_here
    sizes = np.bincount(stretch)
    where = np.arange(len(places)) + stretch  # one symbol more after each stretch
    key = np.zeros(len(places) + len(sizes), np.int64)
    _, numbers = np.unique(values[places], return_inverse=True)
    width = int(numbers.max()) + 2
    key[where] = stretch * width + numbers + 1
    key[np.cumsum(sizes + 1) - 1] = np.arange(len(sizes)) * width
    most = np.zeros(len(key), np.int64)
    most[where] = (sizes // wanted.periods)[stretch]
    start, end, period = all_runs(SuffixTree(np.unique(key, return_inverse=True)[1]), most, wanted.periods)
    good = end - start >= wanted.length
    origin = np.full(len(key) + 1, -1, np.int64)
    origin[where] = places
    start, end, period = start[good], end[good], period[good]
    return origin[start], origin[end - 1] + 1, period


class Numbers(dict):
    """A number for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


#: Words of a document, given its id and its words.
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def collapse_runs(docs: DataFrame, wanted: Wanted = Wanted(), prepare: Prepare | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs(doc_id, text)``; other columns are ignored.

    Words are what ASCII white space parts. ``runs`` are (start, length, period), by
    start, then period: stretches of words with smallest period ``period`` that no
    neighbouring word extends, of the ``wanted`` length. ``collapsed`` has the words, joined by one space,
    that no run contains after its first period. ``prepare`` may change the words first.
    Null, empty and white-space texts have no words, no runs and an empty ``collapsed``. A
    null doc_id is kept. Rows that repeat a doc_id are worked on each on its own. A text is
    looked at as a whole whatever its length. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                number = Numbers()
                words = [t.split() for t in texts(part.column("text"))]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(part.column("doc_id").to_pylist(), words, strict=True)]
                sizes = np.array([len(w) for w in words], np.int64)
                before = np.append(0, np.cumsum(sizes))
                values = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(before[-1]))
                owner = np.repeat(np.arange(len(words)), sizes)
                start, end, period = runs_of(values, owner, wanted)
                order = np.lexsort((period, start))
                start, end, period = start[order], end[order], period[order]
                gone = np.zeros(len(values) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                gone = np.cumsum(gone)[:-1] > 0
                texts_left = []
                runs_in = np.bincount(owner[start], minlength=len(words)) if len(words) else np.empty(0, np.int64)
                for i, ws in enumerate(words):
                    if runs_in[i]:
                        ws = [w for w, g in zip(ws, gone[before[i] : before[i + 1]].tolist(), strict=True) if not g]
                    texts_left.append(b" ".join(ws))
                found = pa.StructArray.from_arrays([pa.array(start - before[owner[start]]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs_in)).astype(np.int32)), found)
                kind = pa.large_string() if sum(map(len, texts_left)) >= 1 << 31 else pa.string()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists, pa.array(texts_left, pa.binary()).cast(kind)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query has them: in a tenth of the documents, by doc_id, the words from some place on repeat with a period. A null doc_id leaves them."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // p))[: n - a]


def periodic_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``collapse_runs`` of all documents, with periods as ``with_periods`` makes them; its docstring states what null, empty and repeated rows give."""
    found = collapse_runs(docs, prepare=with_periods)
    # the greatest length / period, by cross products; runs come by start, then period, so the first one stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length DIV _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

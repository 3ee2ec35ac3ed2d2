"""Exact removal of long repeats, over an index of segments that takes batches.

``SegmentIndex`` keeps the segments of all documents it has seen as immutable runs:
the distinct segments, bucketed and sorted by (core, span), and the distinct cores,
bucketed and sorted by core. A new batch becomes such a run and is merge-joined with
the older ones bucket by bucket, so that only the batch is shuffled: equal spans
settle whole segments, and where a core has several spans the segments are verified
window by window on the texts. Each row of a run is one of its kind, so no key is
hot there, however many documents have it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, free, materialize, new_folder, reopened, shuffle_partitions, slices, texts
from .segments import Rolling, Segments, mixed, segments, segments_by_steps

#: The unit values of each text of a list.
Units = Callable[[list[bytes]], list[np.ndarray]]
#: Texts are taken in pieces of so many bytes: a unit of text has some hundred bytes of arrays while it is worked on.
PIECE_BYTES = 500_000


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``length`` units of a text.

    ``anywhere``: a window goes if it also starts anywhere else, in the same text
    or another. Otherwise it goes if it also starts in a document with a smaller id.
    """

    units: Units
    length: int
    anywhere: bool
    steps: tuple[int, ...]  # widths of the segments' offset classes, each a multiple of the next


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unsigned(x: pa.Array) -> np.ndarray:
    return np.asarray(x).astype(np.int64).view(np.uint64)


#: Columns of segments; ``head`` is 1 for one segment of each core of a text and 0 for the others.
SEGMENT = "core long, span long, doc_id long, head byte"


def segment_batch(core: np.ndarray, span: np.ndarray, ids: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"core": signed(core), "span": signed(span), "doc_id": pa.array(ids), "head": pa.array(head.astype(np.int8))})


def distinct_segments(owner: np.ndarray, core: np.ndarray, span: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """SEGMENT rows of the distinct (owner, core, span); ``ids`` has the owners' doc_ids."""
    order = np.lexsort((span, core, owner))
    owner, core, span = owner[order], core[order], span[order]
    head = np.append(True, (owner[1:] != owner[:-1]) | (core[1:] != core[:-1]))[: len(owner)]
    new = head.copy()
    new[1:] |= span[1:] != span[:-1]
    return segment_batch(core[new], span[new], ids[owner[new]], head[new])


def in_several(rule: Rule, texts: Column, least: Column, last: Column) -> Column:
    """Whether something is in several texts, which ``texts`` counts; where ids decide, in several doc_ids from ``least`` to ``last``."""
    return texts > 1 if rule.anywhere else least < last


def segment_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """SEGMENT rows: the distinct segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                s = segments(rule.units(texts(part.column("text"))), rule.length, rule.steps[0])
                if len(s.owner):
                    yield distinct_segments(s.owner, s.core, s.span, np.asarray(part.column("doc_id")))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENT)


#: What a run knows of a segment, or of a core: the least and last doc_id with it, how many texts have it, and how many have it as the first of its core.
SPANS = "core long, span long, least long, last long, texts long, heads long"
CORES = "core long, low long, high long, least long, last long, heads long"


def summed(rows: DataFrame) -> DataFrame:
    """SPANS rows with those of one segment made one; tasks add up before they send."""
    return rows.groupBy("core", "span").agg(F.min("least").alias("least"), F.max("last").alias("last"), F.sum("texts").alias("texts"), F.sum("heads").alias("heads"))


def spans_of(rows: DataFrame) -> DataFrame:
    """SPANS rows of SEGMENT rows."""
    each = rows.select("core", "span", F.col("doc_id").alias("least"), F.col("doc_id").alias("last"), F.lit(1).cast("long").alias("texts"), F.col("head").cast("long").alias("heads"))
    return summed(each)


def cores_of(spans: DataFrame) -> DataFrame:
    """CORES rows of SPANS rows: the least and greatest span of each core, and the sums."""
    return spans.groupBy("core").agg(F.min("span").alias("low"), F.max("span").alias("high"), F.min("least").alias("least"), F.max("last").alias("last"), F.sum("heads").alias("heads"))


@dataclass
class Run:
    """An immutable run of the index: SPANS bucketed and sorted by (core, span), CORES by core; ``weight``: batches that it stands for."""

    spans: DataFrame
    cores: DataFrame
    weight: int
    name: str


#: Cores or segments up to this number (8 to 24 bytes each) are broadcast to pick rows by; more are joined by shuffling.
BROADCAST_KEYS = 500_000


def bounded(keys: DataFrame) -> DataFrame:
    """``keys``, a written table, to be broadcast if it has few enough rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


@dataclass
class SegmentIndex:
    """Segments of all batches so far, as runs whose weights form a log-structured family.

    ``fanout`` runs of equal weight are merged into one before the next batch is
    added, so a segment is rewritten a logarithmic number of times. The runs lie in
    ``folder``; ``open`` takes an index up again, in another session as well.
    """

    spark: SparkSession
    rule: Rule
    fanout: int = 2
    folder: str = ""
    buckets: int = 0
    runs: list[Run] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder = self.folder or new_folder(self.spark, "index")
        self.buckets = self.buckets or shuffle_partitions(self.spark)

    @classmethod
    def open(cls, spark: SparkSession, rule: Rule, folder: str, fanout: int = 2) -> SegmentIndex:
        """The index that was last saved in ``folder``."""
        listed = spark.read.parquet(f"{folder}/listing").collect()  # a row a run
        index = cls(spark, rule, fanout, folder, listed[0].buckets)
        for name, weight, buckets in listed:
            spans = reopened(spark, f"{folder}/{name}-spans", SPANS, buckets, ["core", "span"])
            cores = reopened(spark, f"{folder}/{name}-cores", CORES, buckets, ["core"])
            index.runs.append(Run(spans, cores, weight, name))
        return index

    def save(self) -> None:
        """List the runs in ``folder``, one row each, so that ``open`` finds them."""
        rows = [(r.name, r.weight, self.buckets) for r in self.runs]
        self.spark.createDataFrame(rows, "name string, weight int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/listing")

    def written(self, spans: DataFrame, weight: int) -> Run:
        name = f"run-{uuid.uuid4().hex}"
        kept = bucketed(spans, f"{self.folder}/{name}-spans", self.buckets, ["core", "span"], sort=True)
        return Run(kept, bucketed(cores_of(kept), f"{self.folder}/{name}-cores", self.buckets, ["core"], sort=True), weight, name)

    def compact(self) -> None:
        """Merge ``fanout`` runs of equal weight while there are such; rows of one segment become one."""
        while True:
            for weight in sorted({r.weight for r in self.runs}):
                same = [r for r in self.runs if r.weight == weight]
                if len(same) >= self.fanout:
                    break
            else:
                return
            rows = same[0].spans
            for r in same[1:]:
                rows = rows.unionByName(r.spans)
            merged = self.written(summed(rows), weight * len(same))
            self.runs = [r for r in self.runs if r.weight != weight] + [merged]
            for r in same:
                free(r.spans, r.cores)

    def drop(self) -> None:
        """Delete the index."""
        for r in self.runs:
            free(r.spans, r.cores)
        self.runs = []

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch; returns what it settles, by the batch alone and against each older run.

        Only repeats between texts count here. First ``doc_id, core, span`` of
        segments that go as a whole, then the same of segments to be verified: one
        document for each span of a core that has several. With the smaller-id
        rule, batches must come in order of doc_id.
        """
        self.compact()
        rows = materialize(segment_rows(docs, self.rule), "segments")
        new = self.written(spans_of(rows), 1)
        met = new.spans.select("core", "span", "least", "last", "texts", F.lit(None).cast("long").alias("before"))
        for r in self.runs:
            old = r.spans.select("core", "span", F.col("least").alias("_least"))
            met = met.join(old, ["core", "span"], "left").withColumn("before", F.least("before", "_least")).drop("_least")
        goes = F.col("before").isNotNull() | in_several(self.rule, F.col("texts"), F.col("least"), F.col("last"))
        goes = materialize(met.where(goes).select("core", "span", F.least("before", "least").alias("first")), "goes")
        whole = rows.join(bounded(goes), ["core", "span"])
        whole = (whole if self.rule.anywhere else whole.where(F.col("first") < F.col("doc_id"))).select("doc_id", "core", "span")
        for r in self.runs if self.rule.anywhere else []:  # a segment that only one older text has goes there as well
            whole = whole.unionByName(r.spans.where("texts = 1").join(new.spans.select("core", "span"), ["core", "span"]).select(F.col("least").alias("doc_id"), "core", "span"))
        both = new.cores
        for r in self.runs:
            old = r.cores.select("core", *[F.col(c).alias(f"_{c}") for c in ("low", "high", "least", "last", "heads")])
            both = both.join(old, "core", "left").select(
                "core", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"), F.least("least", "_least").alias("least"),
                F.greatest("last", "_last").alias("last"), (F.col("heads") + F.coalesce("_heads", F.lit(0))).alias("heads"))
        several = in_several(self.rule, F.col("heads"), F.col("least"), F.col("last"))
        open_ = materialize(both.where(several & (F.col("low") < F.col("high"))).select("core"), "open-cores")
        verify = new.spans
        for r in self.runs:
            verify = verify.unionByName(r.spans)
        verify = verify.join(bounded(open_), "core", "left_semi").select(F.col("least").alias("doc_id"), "core", "span")
        whole, verify = materialize(whole, "whole"), materialize(verify, "verify")
        free(rows, goes, open_)
        self.runs.append(new)
        return whole, verify


def settle(pool: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of SEGMENT rows: those that go as a whole, and those left open.

    Rows that repeat a doc_id are texts of their own where ``rule.anywhere``. What is
    aggregated is written before it is joined, so that a hot core can be split.
    """
    spans = materialize(spans_of(pool), "spans")
    cores = cores_of(spans).where(in_several(rule, F.col("heads"), F.col("least"), F.col("last")) & (F.col("low") < F.col("high")))
    open_ = materialize(cores.select("core"), "open-cores")
    verify = materialize(spans.join(bounded(open_), "core").select(F.col("least").alias("doc_id"), "core", "span"), "verify")
    goes = materialize(spans.where(in_several(rule, F.col("texts"), F.col("least"), F.col("last"))).select("core", "span", F.col("least").alias("first")), "goes")
    whole = pool.join(bounded(goes), ["core", "span"])
    whole = materialize((whole if rule.anywhere else whole.where(F.col("first") < F.col("doc_id"))).select("doc_id", "core", "span"), "whole")
    free(spans, open_, goes)
    return whole, verify


#: Ids up to this number (8 bytes each) are broadcast to pick texts by; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose doc_id is (left_semi) or isn't (left_anti) among ``ids(doc_id)``; ids are counted before they are broadcast."""
    ids = ids.select(F.col("doc_id").alias("_packlens_id")).distinct()
    hinted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(hinted, docs["doc_id"].cast("long") == F.col("_packlens_id"), how)


#: Bits of a hash by which most values that aren't among some keys are told.
SIEVE_BITS = 20


def member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``values`` occur in ``keys``; both are 64-bit hashes."""
    out = np.zeros(len(values), bool)
    if len(keys) and len(values):
        sieve, low = np.zeros(1 << SIEVE_BITS, bool), np.uint64((1 << SIEVE_BITS) - 1)
        sieve[(keys & low).astype(np.int64)] = True
        at = np.nonzero(sieve[(values & low).astype(np.int64)])[0]
        out[at] = np.isin(values[at], keys)
    return out


def joint(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, of the text with index ``owner``."""
    return a * np.uint64(0x9E3779B97F4A7C15) ^ b ^ mixed(owner.astype(np.uint64) + np.uint64(1))


#: Pairs of hashes that a piece's texts list: indexes of the texts, first and second hashes.
Listed = tuple[np.ndarray, np.ndarray, np.ndarray]


def listed(column: pa.Array) -> Listed:
    """The structs of two fields in a list column; a null list is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    first, second = column.flatten().flatten()
    return np.repeat(np.arange(len(sizes)), sizes), unsigned(first), unsigned(second)


def marked(s: Segments, keys: Listed) -> np.ndarray:
    """Indexes of the segments that their texts list."""
    return np.nonzero(member(joint(*keys), joint(s.owner, s.core, s.span)))[0]


class Piece:
    """The units of some texts, joined; windows are named by their start among all units."""

    def __init__(self, units: list[np.ndarray], rule: Rule) -> None:
        self.rule, self.held = rule, units
        self.edges = np.append(0, np.cumsum([len(u) for u in units], dtype=np.int64))
        self.units = np.concatenate(units) if units else np.empty(0, np.uint64)

    def segments(self, *steps: int) -> list[Segments]:
        return segments_by_steps(self.held, self.rule.length, steps)

    def windows(self, s: Segments, at: np.ndarray) -> np.ndarray:
        """Starts of the windows in the segments with indexes ``at``."""
        return window_starts(self.edges[s.owner[at]] + s.first[at], s.count[at])

    def owners(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, starts, "right") - 1

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows at ``starts``."""
        ends = starts + self.rule.length
        return Rolling(self.units, 0).runs(starts, ends), Rolling(self.units, 1).runs(starts, ends)

    def all_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of all windows."""
        length = self.rule.length
        starts = window_starts(self.edges[:-1], np.maximum(np.diff(self.edges) - length + 1, 0))
        return starts, *(Rolling(self.units, base).sliding(length)[starts] for base in (0, 1))

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which units the windows at ``starts`` cover."""
        n = len(self.units) + 1
        return np.cumsum((np.bincount(starts, minlength=n) - np.bincount(starts + self.rule.length, minlength=n))[:-1]) > 0


def finer_rows(held: DataFrame, rule: Rule, level: int) -> DataFrame:
    """SEGMENT rows: segments of width ``steps[level]`` of the windows that the width before left open in ``held(doc_id, text, keys)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                piece = Piece(rule.units(texts(part.column("text"))), rule)
                coarse, s = piece.segments(rule.steps[level - 1], rule.steps[level])
                inside = np.zeros(len(piece.units) + 1, bool)
                inside[piece.windows(coarse, marked(coarse, listed(part.column("keys"))))] = True
                at = np.nonzero(inside[piece.edges[s.owner] + s.first])[0]
                yield distinct_segments(s.owner[at], s.core[at], s.span[at], np.asarray(part.column("doc_id")))

    return held.mapInArrow(run, SEGMENT)


def window_rows(held: DataFrame, rule: Rule) -> DataFrame:
    """``first_hash, second_hash, doc_id`` of the distinct windows that the last width left open in ``held(doc_id, text, keys)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                piece = Piece(rule.units(texts(part.column("text"))), rule)
                (s,) = piece.segments(rule.steps[-1])
                starts = piece.windows(s, marked(s, listed(part.column("keys"))))
                a, b = piece.hashes(starts)
                owner = piece.owners(starts)
                _, index = np.unique(joint(owner, a, b), return_index=True)
                yield pa.RecordBatch.from_arrays([signed(a[index]), signed(b[index]), pa.array(np.asarray(part.column("doc_id"))[owner[index]])], ["first_hash", "second_hash", "doc_id"])

    return held.mapInArrow(run, "first_hash long, second_hash long, doc_id long")


def with_keys(docs: DataFrame, verify: DataFrame) -> DataFrame:
    """``doc_id, text, keys``: the texts with open segments, and these."""
    keys = verify.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("core", "span")).alias("keys"))
    return by_ids(docs, verify, "left_semi").join(keys.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "keys")


def window_starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every start in the runs (first, count)."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def removed_windows(piece: Piece, whole: Listed, windows: Listed) -> np.ndarray:
    """Starts of the windows that go, given the settled segments and verified windows that the texts list."""
    rule, found = piece.rule, []
    by_step = piece.segments(*rule.steps)
    found += [piece.windows(s, marked(s, whole)) for s in by_step]
    if rule.anywhere:
        at = repeating(by_step[0])
        if len(at):  # only windows whose core comes twice in the text can themselves come twice
            starts = piece.windows(by_step[0], at)
            _, code, copies = np.unique(joint(piece.owners(starts), *piece.hashes(starts)), return_inverse=True, return_counts=True)
            found.append(starts[copies[code] > 1])
    if len(windows[0]):
        with_some = np.unique(windows[0])
        part = Piece([piece.held[i] for i in with_some], rule)
        starts, a, b = part.all_hashes()
        owner = part.owners(starts)
        gone = member(joint(*windows), joint(with_some[owner], a, b))
        found.append((starts - part.edges[owner] + piece.edges[with_some[owner]])[gone])
    return np.concatenate(found)


def verified(windows: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, first_hash, second_hash`` of the windows that go; ``windows`` has each window of a text once."""
    keys = ["first_hash", "second_hash"]
    seen = windows.groupBy(*keys).agg(F.min("doc_id").alias("least"), in_several(rule, F.count("*"), F.min("doc_id"), F.max("doc_id")).alias("several")).where("several").select(*keys, "least")
    found = windows.join(materialize(seen, "repeated"), keys)
    return (found if rule.anywhere else found.where("least < doc_id")).select("doc_id", *keys)


def removals(docs: DataFrame, whole: DataFrame, verify: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, whole, windows``: per document with something to remove, lists of the settled segments and verified windows."""
    segment = F.struct(F.col("core").alias("a"), F.col("span").alias("b"))
    window = F.struct(F.col("first_hash").alias("a"), F.col("second_hash").alias("b"))
    held = materialize(with_keys(docs, verify), "open")
    for level in range(1, len(rule.steps)):
        rows = materialize(finer_rows(held, rule, level), "finer")
        finer, verify = settle(rows, rule)
        whole = whole.unionByName(finer)
        narrower = materialize(with_keys(held.drop("keys"), verify), "open")
        free(rows, verify, held)
        held = narrower
    rows = materialize(window_rows(held, rule), "windows")
    windows = materialize(verified(rows, rule), "verified")
    free(rows, held)
    none = F.lit(None).cast("struct<a:long,b:long>")
    both = whole.distinct().select("doc_id", segment.alias("whole"), none.alias("window")).unionByName(windows.select("doc_id", none.alias("whole"), window.alias("window")))
    return both.groupBy("doc_id").agg(F.collect_list("whole").alias("whole"), F.collect_list("window").alias("windows"))


def found_removals(docs: DataFrame, batches: list[DataFrame], rule: Rule, fanout: int) -> DataFrame:
    """Index ``batches`` one after another; ``doc_id, whole, windows`` of the rows of ``docs(doc_id, text)`` that lose something."""
    index, told = SegmentIndex(docs.sparkSession, rule, fanout), []
    for batch in batches:
        told.append(index.add(batch))
    index.drop()
    whole, verify = told[0]
    for more_whole, more_verify in told[1:]:
        whole, verify = whole.unionByName(more_whole), verify.unionByName(more_verify)
    found = materialize(removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), whole, verify, rule), "removals")
    free(*(table for pair in told for table in pair))
    return found


def gone_units(part: pa.RecordBatch, rule: Rule) -> Iterator[tuple[bytes, np.ndarray | None]]:
    """Each text of a batch with ``_packlens_whole`` and ``_packlens_windows``, and which of its units go (None: nothing)."""
    whole, windows = listed(part.column("_packlens_whole")), listed(part.column("_packlens_windows"))
    held = texts(part.column("text"))
    wanted = np.arange(len(held)) if rule.anywhere else np.union1d(whole[0], windows[0])
    piece = Piece(rule.units([held[i] for i in wanted]), rule)
    renumbered = [(np.searchsorted(wanted, owner), a, b) for owner, a, b in (whole, windows)]
    starts = removed_windows(piece, *renumbered)
    losing = np.zeros(len(held), bool)
    losing[wanted[piece.owners(starts)]] = True
    gone = piece.covered(starts)
    for i, text in enumerate(held):
        if losing[i]:
            lo, hi = piece.edges[np.searchsorted(wanted, i) + np.arange(2)]
            yield text, gone[lo:hi]
        else:
            yield text, None


def repeating(s: Segments) -> np.ndarray:
    """Indexes of the segments whose core comes twice in their text; the other segments hold no window twice there."""
    order = np.lexsort((s.core, s.owner))
    owner, core = s.owner[order], s.core[order]
    same = np.append(False, (owner[1:] == owner[:-1]) & (core[1:] == core[:-1]))[: len(order)]
    return order[same | np.append(same[1:], False)[: len(order)]]


def with_removals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``_packlens_whole, _packlens_windows``; only texts that lose something are shuffled to their lists."""
    lists = found.select(F.col("doc_id").alias("_packlens_id"), F.col("whole").alias("_packlens_whole"), F.col("windows").alias("_packlens_windows"))
    others = by_ids(docs, found, "left_anti")
    for name in ("_packlens_whole", "_packlens_windows"):
        others = others.withColumn(name, F.lit(None).cast(lists.schema[name].dataType))
    losing = by_ids(docs, found, "left_semi")
    return losing.join(lists.hint("shuffle_hash"), losing["doc_id"].cast("long") == F.col("_packlens_id")).drop("_packlens_id").unionByName(others)


def describe_removals(docs: DataFrame, batches: list[DataFrame], rule: Rule, fanout: int, describe: Callable, schema: str) -> DataFrame:
    """``doc_id`` and ``describe(text, gone)`` of each row of ``docs``; ``schema`` names and types all columns."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                rows = zip(*(describe(*x) for x in gone_units(part, rule)), strict=True)
                columns = [pa.array(c, t) for c, t in zip(rows, types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], list(names))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_removals(slim, found_removals(slim, batches, rule, fanout)).mapInArrow(run, schema)


def rewrite_texts(docs: DataFrame, batches: list[DataFrame], rule: Rule, fanout: int, rewrite: Callable) -> DataFrame:
    """``docs`` with ``rewrite(text, gone)`` for each text that loses something; all other columns and texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                old = part.column("text").to_pylist()
                new = [x if gone is None or not gone.any() else rewrite(text, gone).decode() for x, (text, gone) in zip(old, gone_units(part, rule), strict=True)]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type)).drop_columns(["_packlens_whole", "_packlens_windows"])

    return with_removals(docs, found_removals(docs, batches, rule, fanout)).mapInArrow(run, docs.schema)

"""Boosting of the additive model by distributed histograms.

The rows stay where they are, as bin numbers. In each round every task recomputes its
rows' scores from the weights so far and adds up gradients, curvatures and counts by
(bag, bin) of all features at once; Spark sums these, and the driver, which holds no
more than one number a bin, makes the round's small trees. Pairs of features follow
in the same way: all are screened in one pass by two-dimensional histograms of what
the features leave unexplained, the best are boosted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .model import AdditiveModel, PairTerm


@dataclass(frozen=True)
class Boosting:
    """How a model is trained: ``bags`` models, each on ``share`` percent of the rows by hash, are averaged."""

    bins: int = 256
    rounds: int = 30
    rate: float = 0.2
    bags: int = 8
    share: int = 85
    least_leaf: int = 2
    damping: float = 1.0
    pairs: int = 10
    pair_bins: int = 8
    pair_rounds: int = 8


def binned(rows: DataFrame, cuts: dict[str, list[float]], how: Boosting) -> DataFrame:
    """``y, bags, bins``: label, a bit for each bag that the row is in, and its bin by feature."""
    held = [F.col(f) for f in cuts]
    bag = F.lit(0)
    for b in range(how.bags):
        bag = bag + F.when(F.pmod(F.xxhash64(F.lit(b), *held, F.col("label")), F.lit(100)) < how.share, 1 << b).otherwise(0)
    places = [np.array(cuts[f]) for f in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((batch.num_rows, len(places)), np.int32)
            for i, at in enumerate(places):  # as ``bin_expression`` has them
                values = batch.column(2 + i).to_numpy(zero_copy_only=False)
                bins[:, i] = np.where(np.isnan(values), len(at) + 1, np.searchsorted(at, values))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(places)), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["y", "bags", "bins"])

    numbers = [c.cast("double").alias(f"_{i}") for i, c in enumerate(held)]
    return rows.select(F.col("label").cast("double").alias("y"), bag.cast("int").alias("bags"), *numbers).mapInArrow(run, "y double, bags int, bins array<int>")


class Layout:
    """Where the bins of all features (or cells of pairs) lie in one long array."""

    def __init__(self, sizes: list[int]) -> None:
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.total = int(self.starts[-1])

    def of(self, i: int) -> slice:
        return slice(int(self.starts[i]), int(self.starts[i + 1]))


def read(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.asarray(batch.column("bins").flatten()).reshape(-1, n_features)
    return np.asarray(batch.column("y")), np.asarray(batch.column("bags")), bins


#: Places of a row in the long array, given its bins.
Places = Callable[[np.ndarray], np.ndarray]


def histograms(table: DataFrame, n_features: int, size: int, groups: int, places: Places, score: Callable[[np.ndarray], np.ndarray], in_group: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, curvature and count by (group, place), an array of shape (3, groups, size), and the loss by group.

    ``score`` gives the rows' scores by group, ``in_group`` whether they count there. At
    most ``groups * size`` sums a task are shuffled, and as many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loss = np.zeros((3, groups, size)), np.zeros(groups)
        for batch in batches:
            y, bags, bins = read(batch, n_features)
            odds = score(bins)
            inside = in_group(bags)
            shrunk = np.exp(-np.abs(odds))
            p = np.where(odds < 0, shrunk, 1.0) / (1 + shrunk)
            loss += ((np.log1p(shrunk) + np.maximum(odds, 0) - y[:, None] * odds) * inside).sum(axis=0)
            where = places(bins)
            for g in range(groups):
                for k, x in enumerate(((y - p[:, g]) * inside[:, g], p[:, g] * (1 - p[:, g]) * inside[:, g], inside[:, g].astype(float))):
                    held[k, g] += np.bincount(where.ravel(), weights=np.repeat(x, where.shape[1]), minlength=size)
        g, at = np.nonzero(held[2])
        g, at = np.append(np.arange(groups), g).astype(np.int32), np.append(np.full(groups, -1), at).astype(np.int32)  # -1: the loss
        columns = [np.append(loss if k == 0 else np.zeros(groups), held[k, g[groups:], at[groups:]]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (g, at, *columns)], ["g", "at", "s", "h", "n"])

    sums = table.mapInArrow(run, "g int, at int, s double, h double, n double").groupBy("g", "at").agg(*[F.sum(c).alias(c) for c in ("s", "h", "n")]).toArrow()
    out = np.zeros((3, groups, size + 1))
    out[:, np.asarray(sums.column("g")), np.asarray(sums.column("at"))] = np.stack([np.asarray(sums.column(c)) for c in ("s", "h", "n")])
    return out[:, :, :size], out[0, :, size]


def descended(state: np.ndarray, passed: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], step: Callable[[np.ndarray], np.ndarray], rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of ``state + rate * step(histograms)`` by bag, and the last histograms.

    All features move at once, so features that say the same may go too far together: a bag
    whose loss has risen goes back and halves its rate.
    """
    rates = np.full(len(state), rate)
    found, loss = passed(state)
    for _ in range(rounds):
        trial = state + rates[:, None] * step(found)
        new, new_loss = passed(trial)
        better = new_loss <= loss * (1 + 1e-12)
        state = np.where(better[:, None], trial, state)
        found = np.where(better[None, :, None], new, found)
        loss, rates = np.where(better, new_loss, loss), np.where(better, rates, rates / 2)
    return state, found


def three_leaves(s: np.ndarray, h: np.ndarray, n: np.ndarray, how: Boosting) -> np.ndarray:
    """What a tree of up to three leaves over ordered bins adds to each; the last bin, unknown values, is a leaf of its own."""
    known = len(s) - 1
    out = np.zeros(len(s))
    if n[-1] >= how.least_leaf:
        out[-1] = s[-1] / (h[-1] + how.damping)
    cs, ch, cn = (np.append(0, np.cumsum(x[:-1])) for x in (s, h, n))
    value = lambda a, b: (cs[b] - cs[a]) ** 2 / (ch[b] - ch[a] + how.damping)
    fits = lambda a, b: cn[b] - cn[a] >= how.least_leaf
    i, j = np.triu_indices(known + 1)  # cuts at i and j; i == j or j at an end makes two leaves
    inner = (i > 0) & (i < known)
    i, j = i[inner], j[inner]
    good = fits(0, i) & np.where(i < j, fits(i, j), True) & np.where(j < known, fits(j, known), True)
    if not good.any():
        return out
    i, j = i[good], j[good]
    last = np.where((i == j) | (j == known), known, j)
    gain = value(0, i) + value(i, last) + np.where(last < known, value(np.minimum(last, known), known), 0.0)
    best = int(np.argmax(gain))
    edges = sorted({0, int(i[best]), int(last[best]), known})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cs[b] - cs[a]) / (ch[b] - ch[a] + how.damping)
    return out


def four_leaves(s: np.ndarray, h: np.ndarray, n: np.ndarray, how: Boosting) -> tuple[float, np.ndarray]:
    """The gain of the best cut of a table by row and column into quarters, and what each cell gets."""
    cum = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (s, h, n)]
    rows, cols = np.arange(1, s.shape[0]), np.arange(1, s.shape[1])
    if not len(rows) or not len(cols):
        return 0.0, np.zeros_like(s)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        at = c[np.ix_(rows, cols)]
        top, left, whole = c[rows, -1][:, None], c[-1, cols][None, :], c[-1, -1]
        return [at, top - at, left - at, whole - top - left + at]

    gs, hs, ns = map(quarters, cum)
    gain = sum(a * a / (b + how.damping) for a, b in zip(gs, hs, strict=True)) - cum[0][-1, -1] ** 2 / (cum[1][-1, -1] + how.damping)
    gain = np.where(np.minimum.reduce(ns) >= how.least_leaf, gain, -np.inf)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not np.isfinite(gain[r, c]):
        return 0.0, np.zeros_like(s)
    out = np.empty_like(s)
    a, b, d, e = (g[r, c] / (x[r, c] + how.damping) for g, x in zip(gs, hs, strict=True))
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = a, b, d, e
    return float(gain[r, c]), out


def coarse_edges(counts: np.ndarray, most: int) -> np.ndarray:
    """First bins of at most ``most`` groups of known bins with about as many rows each."""
    known = len(counts) - 1
    if known <= most:
        return np.arange(known)
    share = np.append(0, np.cumsum(counts[:-1]))[:-1] / max(counts[:-1].sum(), 1)
    return np.unique(np.searchsorted(share, np.arange(most) / most))[:most].clip(0, known - 1)


def boost(rows: DataFrame, cuts: dict[str, list[float]], how: Boosting) -> AdditiveModel:
    """Train on ``rows(features, label)`` with given cut points; see ``model.fit``."""
    names = list(cuts)
    table = written(binned(rows, cuts, how), "bins")
    layout = Layout([len(cuts[f]) + 2 for f in names])
    starts = layout.starts[:-1]
    weights = np.zeros((how.bags, layout.total))
    base = np.zeros(how.bags)
    powers = 1 << np.arange(how.bags)
    in_bags = lambda bags: (bags[:, None] & powers[None, :]) > 0
    places = lambda bins: bins + starts[None, :]

    def passed(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return histograms(table, len(names), layout.total, how.bags, places, lambda bins: w[:, places(bins)].sum(axis=2).T + b[None, :], in_bags)

    def trees(found: np.ndarray) -> np.ndarray:
        out = np.zeros((how.bags, layout.total))
        for i in range(len(names)):
            at = layout.of(i)
            for b in range(how.bags):
                out[b, at] = three_leaves(*(found[k, b, at] for k in range(3)), how)
        return out

    found, _ = passed(weights, base)
    one = layout.of(0)
    counts, sums = found[2, :, one].sum(axis=1), found[0, :, one].sum(axis=1)
    share = np.clip((sums + counts / 2) / np.maximum(counts, 1), 1e-6, 1 - 1e-6)
    base = np.where(counts > 0, np.log(share / (1 - share)), 0.0)
    weights, found = descended(weights, lambda w: passed(w, base), trees, how.rounds, how.rate)
    terms = boosted_pairs(table, names, cuts, layout, found[2].sum(axis=0), weights, base, how) if how.pairs and len(names) > 1 else []
    model = AdditiveModel(cuts, {}, float(base.mean()), terms)
    held = found[2].sum(axis=0)
    for i, f in enumerate(names):
        at = layout.of(i)
        mean = weights[:, at].mean(axis=0)
        middle = float((mean * held[at]).sum() / max(held[at].sum(), 1))
        model.weights[f] = (mean - middle).tolist()
        model.intercept += middle
    return model


def boosted_pairs(table: DataFrame, names: list[str], cuts: dict[str, list[float]], layout: Layout, counts: np.ndarray, weights: np.ndarray, base: np.ndarray, how: Boosting) -> list[PairTerm]:
    """The ``how.pairs`` pairs that explain most of what the features leave, boosted."""
    edges = [coarse_edges(counts[layout.of(i)], how.pair_bins) for i in range(len(names))]
    sizes = [len(e) + 1 for e in edges]
    lookup = np.zeros(layout.total, np.int64)  # bin to coarse bin; unknown values have the last one
    for i, e in enumerate(edges):
        at = layout.of(i)
        lookup[at] = np.append(np.searchsorted(e, np.arange(layout.sizes[i] - 1), side="right") - 1, len(e))
    starts, n = layout.starts[:-1], len(names)

    def cells_of(pairs: list[tuple[int, int]]) -> tuple[Layout, Places]:
        cells = Layout([sizes[a] * sizes[b] for a, b in pairs])
        first, second = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        width, begin = np.array([sizes[b] for _, b in pairs]), cells.starts[:-1]

        def places(bins: np.ndarray) -> np.ndarray:
            coarse = lookup[bins + starts[None, :]]
            return coarse[:, first] * width + coarse[:, second] + begin

        return cells, places

    every = list(combinations(range(n), 2))
    cells, places = cells_of(every)
    mean, middle = weights.mean(axis=0), base.mean()
    found, _ = histograms(table, n, cells.total, 1, places, lambda bins: mean[bins + starts[None, :]].sum(axis=1)[:, None] + middle, lambda bags: np.ones((len(bags), 1), bool))
    gains = [four_leaves(*(found[k, 0, cells.of(i)].reshape(sizes[a], sizes[b]) for k in range(3)), how)[0] for i, (a, b) in enumerate(every)]
    chosen = [every[i] for i in sorted(range(len(every)), key=lambda i: (-gains[i], every[i]))[: how.pairs] if gains[i] > 0]
    if not chosen:
        return []
    cells, places = cells_of(chosen)
    powers = 1 << np.arange(how.bags)

    def passed(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = lambda bins: weights[:, bins + starts[None, :]].sum(axis=2).T + t[:, places(bins)].sum(axis=2).T + base[None, :]
        return histograms(table, n, cells.total, how.bags, places, score, lambda bags: (bags[:, None] & powers[None, :]) > 0)

    def trees(found: np.ndarray) -> np.ndarray:
        out = np.zeros((how.bags, cells.total))
        for i, (a, b) in enumerate(chosen):
            at = cells.of(i)
            for g in range(how.bags):
                out[g, at] = four_leaves(*(found[k, g, at].reshape(sizes[a], sizes[b]) for k in range(3)), how)[1].ravel()
        return out

    terms, _ = descended(np.zeros((how.bags, cells.total)), passed, trees, how.pair_rounds, how.rate)
    values = terms.mean(axis=0)
    coarse = [[cuts[names[i]][e - 1] for e in edges[i].tolist() if e > 0] for i in range(n)]
    return [PairTerm(names[a], names[b], coarse[a], coarse[b], values[cells.of(i)].tolist()) for i, (a, b) in enumerate(chosen)]

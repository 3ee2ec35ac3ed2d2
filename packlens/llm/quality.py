"""Quality classifier: document evidence combined with host and path posteriors.

A document's probability of being bad (of low quality, or toxic) comes from two
logistic models over text statistics and over the weight of words and word
beginnings, learnt from a bounded sample of labelled rows. Hosts and their paths
get posterior rates of bad documents by hierarchical empirical Bayes over all
documents: a path is shrunk towards its host, a host towards the whole corpus, the
more so the fewer documents it has. A document's odds are multiplied by how far
its path's posterior rate, taken without the document, lies from the corpus rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, texts

#: Labelled rows that are learnt from: half give word weights, half the logistic models.
SAMPLE = 24_000
#: Words and word beginnings with a weight: those in SUPPORT documents at least, the WEIGHTED most telling.
SUPPORT, WEIGHTED = 8, 50_000
BEGINNINGS = (4, 5, 6)
RIDGE = 1.0
#: Documents that a site's prior is worth at most, and at least.
PRIOR_RANGE = (5.0, 1e6)
HEADS = ("low", "toxic")

#: Byte classes of the text statistics: lower case, upper case, digit, white space, other ASCII, end of line, beyond ASCII.
CLASSES = np.full(256, 6, np.uint8)
CLASSES[:128] = 4
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 3, 5


def statistics(text: bytes, words: list[bytes], distinct: Counter) -> list[float]:
    """Numbers about a text that don't depend on its language."""
    n, m = max(len(text), 1), max(len(words), 1)
    shares = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=7) / n
    lines = text.split(b"\n")
    repeated = sum(a == b for a, b in zip(words[:-1], words[1:], strict=False)) / m
    marked = sum(k for w, k in distinct.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1] in b".,"))
    doubled = sum(k for w, k in distinct.items() if len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum() and w[-1] < 128)
    bare = sum(k for w, k in distinct.items() if len(w) == 1 and not w.isalnum() and w[0] < 128)
    top = max(distinct.values(), default=0) / m
    return [
        np.log1p(len(words)), shares[1], shares[2], shares[4], shares[5] * 10, shares[6], len(text) / m / 10,
        len(distinct) / m, repeated, top, marked / m, doubled / m, bare / m, 1 - len(set(lines)) / len(lines),
        float(shares[1] > 0.4), float(len(words) < 10),
    ]


def traits(distinct: Counter) -> set[bytes]:
    """The words of a text in lower case, and the beginnings of longer words."""
    out = set()
    for w in {w.lower().strip(b".,;:!?\"'()") for w in distinct}:
        out.add(w)
        for n in BEGINNINGS:
            if len(w) > n:
                out.add(w[:n] + b"*")
    return out


def evidence(found: set[bytes], weights: dict[bytes, tuple[float, float]]) -> list[float]:
    """For each head: sum of the five strongest weights, how many exceed 2, and their share."""
    held = [weights[t] for t in found if t in weights]
    out = []
    for head in range(len(HEADS)):
        strong = sorted((h[head] for h in held), reverse=True)[:5]
        many = sum(h[head] > 2 for h in held)
        out += [sum(x for x in strong if x > 0), np.log1p(many), 10 * many / max(len(found), 1)]
    return out


def row_of(text: bytes, weights: dict[bytes, tuple[float, float]]) -> list[float]:
    words = text.split()
    distinct = Counter(words)
    return [*statistics(text, words, distinct), *evidence(traits(distinct), weights)]


@dataclass
class Model:
    weights: dict[bytes, tuple[float, float]]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # (heads, 1 + columns)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[:, :1] + self.coefficients[:, 1:] @ x.T, -30, 30))).T


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's steps; with nothing to learn from, the odds of (hits + 0.5) / (n + 1) alone."""
    hits = float(y.sum())
    beta = np.zeros(x.shape[1] + 1)
    beta[0] = np.log((hits + 0.5) / (len(y) - hits + 0.5))
    if not 0 < hits < len(y):
        return beta
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    penalty = np.diag([0.0] + [RIDGE] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled_sample(labels: DataFrame, size: int) -> DataFrame:
    """``doc_id, low, toxic, half`` of at most ``size`` labelled documents, picked by hash of the id; several labels: the worst."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.min("quality") < 1, F.lit(False)).cast("int").alias("low"), F.coalesce(F.max("toxic") > 0, F.lit(False)).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return picked.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))


def trait_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``trait, low, toxic, n``: in how many documents of each kind a trait occurs, added up by batch."""
    for batch in batches:
        for part in slices(batch, "text"):
            counts: dict[bytes, list[int]] = {}
            for text, low, toxic in zip(texts(part.column("text")), part.column("low").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for t in traits(Counter(text.split())):
                    c = counts.setdefault(t, [0, 0, 0])
                    c[0] += low
                    c[1] += toxic
                    c[2] += 1
            if counts:
                columns = list(zip(*counts.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], ["trait", "low", "toxic", "n"])


def trait_weights(sample: DataFrame) -> dict[bytes, tuple[float, float]]:
    """Log-odds of each telling trait for both heads, from the first half of the sample."""
    first = sample.where("half = 0")
    n, low, toxic = first.agg(F.count("*"), F.sum("low"), F.sum("toxic")).first()
    if not n:
        return {}
    counted = first.select("text", "low", "toxic").mapInArrow(trait_rows, "trait binary, low long, toxic long, n long").groupBy("trait").agg(*[F.sum(c).alias(c) for c in ("low", "toxic", "n")])

    def odds(hits: Column, of: int) -> Column:
        return F.log((hits + 0.5) / (of + 1)) - F.log((F.col("n") - hits + 0.5) / (n - of + 1))

    rated = counted.where(F.col("n") >= SUPPORT).select("trait", odds(F.col("low"), low).alias("a"), odds(F.col("toxic"), toxic).alias("b"), "n")
    best = rated.orderBy((F.greatest("a", "b") * F.sqrt("n")).desc(), "trait").limit(WEIGHTED).toPandas()
    return {bytes(t): (a, b) for t, a, b in zip(best["trait"], best["a"], best["b"], strict=True)}


def train_quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learn from at most ``size`` labelled documents; the sample is small by that bound and so is broadcast and collected as numbers."""
    chosen = F.broadcast(labelled_sample(labels, size))
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id"), "labelled")
    weights = trait_weights(sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [row_of(x, shared.value) for x in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column("low"), part.column("toxic")], ["x", "low", "toxic"])

    learnt = sample.where("half = 1").select("text", "low", "toxic").mapInArrow(run, "x array<double>, low int, toxic int").toPandas()
    width = len(row_of(b"", {}))
    x = np.array(learnt["x"].tolist(), float).reshape(-1, width)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(width), np.ones(width))
    z = np.clip((x - mean) / scale, -8, 8)
    return Model(weights, mean, scale, np.stack([logistic(z, learnt[h].to_numpy(float)) for h in HEADS]))


def with_document_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_p_low, _p_toxic``; a text without words counts as of low quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = texts(part.column("text"))
                p = shared.value.probabilities(np.array([row_of(x, shared.value.weights) for x in held]))
                p[[not x.strip(b" \t\n\x0b\f\r") for x in held], 0] = 1 - 1e-9
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], [*part.schema.names, "_p_low", "_p_toxic"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + ", _p_low double, _p_toxic double")


def bad(low: str = "_p_low", toxic: str = "_p_toxic") -> Column:
    return 1 - (1 - F.col(low)) * (1 - F.col(toxic))


def prior_worth(rates: DataFrame, rate: str, n: str, centre: Column) -> float:
    """Documents that the prior of a level is worth, by the method of moments over its sites."""
    spread = F.col(rate) - centre
    of, noise, between = rates.agg(F.sum(n), F.sum(F.col(n) * centre * (1 - centre) / F.col(n)), F.sum(F.col(n) * spread * spread)).first()
    if not of:
        return PRIOR_RANGE[1]
    variance = max((between - noise) / of, 1e-12)
    typical = noise / max(rates.count(), 1)  # mean of centre * (1 - centre)
    return float(np.clip(typical / variance - 1, *PRIOR_RANGE))


def site_posteriors(scored: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """For each path of ``scored(_p_low, _p_toxic)`` ``host, path, site_rate``, the sums and prior weights behind it, and the corpus rate.

    Documents are summed by (host, path) before the shuffle; hosts are sums of
    their paths. Null hosts and paths are sites of their own.
    """
    paths = materialize(scored.groupBy(host.alias("host"), path.alias("path")).agg(F.count("*").alias("n"), F.sum(bad()).alias("bad")), "paths")
    total, hits = paths.agg(F.sum("n"), F.sum("bad")).first()
    corpus = float((hits + 0.5) / (total + 1)) if total else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad")).withColumn("raw", F.col("host_bad") / F.col("host_n"))
    worth = prior_worth(hosts, "raw", "host_n", F.lit(corpus))
    hosts = materialize(hosts.withColumn("host_worth", F.lit(worth)).withColumn("host_rate", (F.col("host_bad") + worth * corpus) / (F.col("host_n") + worth)), "hosts")
    joined = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h.host_n", "h.host_bad", "h.host_worth", "h.host_rate").withColumn("raw", F.col("bad") / F.col("n"))
    worth = prior_worth(joined, "raw", "n", F.col("host_rate"))
    rate = (F.col("bad") + worth * F.col("host_rate")) / (F.col("n") + worth)
    return joined.select("host", "path", rate.alias("site_rate"), "n", "bad", F.lit(worth).alias("worth"), "host_n", "host_bad", "host_worth"), corpus


def rate_of_others(own: Column, corpus: float) -> Column:
    """The posterior rate of a document's path without the document itself, so that its evidence counts once."""
    s = lambda name: F.col(f"s.{name}")
    host = (F.greatest(s("host_bad") - own, F.lit(0.0)) + s("host_worth") * corpus) / (s("host_n") - 1 + s("host_worth"))
    return (F.greatest(s("bad") - own, F.lit(0.0)) + s("worth") * host) / (s("n") - 1 + s("worth"))


def log_odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(bounded / (1 - bounded))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep_below: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and ``_p_low, _p_toxic, _site_rate, _p_bad, _keep``.

    ``docs`` has doc_id and text, ``labels`` doc_id, quality (0: low) and toxic
    (1: toxic). Unlabelled corpora keep everything that has words. Null and
    white-space texts go. Repeated rows are judged alike; an empty table gives no
    rows. ``keep_below`` bounds the probability of being bad of what stays.
    """
    model = train_quality(docs, labels)
    if not model.weights and not model.coefficients[:, 1:].any():
        model.coefficients[:, 0] = -30.0
    scored = materialize(with_document_evidence(docs, model), "scored")
    sites, corpus = site_posteriors(scored, host, path)
    sites = materialize(sites, "sites").alias("s")
    own = bad("d._p_low", "d._p_toxic")
    others = rate_of_others(own, corpus)
    odds = log_odds(own) + log_odds(others) - log_odds(F.lit(corpus))
    p = 1 / (1 + F.exp(-odds))
    held = scored.withColumns({"_packlens_host": host, "_packlens_path": path}).alias("d")
    joined = held.join(sites, F.col("d._packlens_host").eqNullSafe(F.col("s.host")) & F.col("d._packlens_path").eqNullSafe(F.col("s.path")))
    return joined.select("d.*", others.alias("_site_rate"), p.alias("_p_bad"), (p < keep_below).alias("_keep")).drop("_packlens_host", "_packlens_path")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths their languages."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = judge(docs.select("doc_id", "source", "lang", "text"), labels, F.col("source"), F.col("lang"))
    return found.select("doc_id", "source", "lang", F.col("_p_low").alias("p_low"), F.col("_p_toxic").alias("p_toxic"), F.col("_site_rate").alias("site_rate"), (1 - F.col("_p_bad")).alias("quality_score"), F.col("_keep").alias("keep"))

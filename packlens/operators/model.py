"""An additive model of compliance: a weight for each bin of each feature, and for each cell of some pairs.

Features are cut at quantiles of the training rows, unknown values have a bin of
their own. ``boosting`` finds the weights; scoring is a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import bound
from ..sources.shared import written
from .packages import synthetic_label

#: Names of pair terms join their features by this.
AND = " & "


def drawn(key: str, name: str, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the row's key, a name and the seed only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def smallest_share(rows: DataFrame, key: str, name: str, seed: int, share: float) -> DataFrame:
    """``key`` of exactly ``floor(share * n)`` rows, those with the smallest hash; rows with equal hashes by key.

    Counts by the hash's first digits say where the last one lies; only rows with these digits are sorted.
    """
    hashed = rows.select(key, F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")).cast("binary")).alias("_hash"))
    hashed = hashed.withColumn("_digits", F.substring("_hash", 1, 4))
    counts = hashed.groupBy("_digits").agg(F.count("*").alias("_n"))
    run = counts.select("_digits", (F.sum("_n").over(Window.orderBy("_digits")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.orderBy("_digits")).alias("_up_to"), F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) * F.lit(share)).alias("_wanted"))  # 65,536 rows at most
    some = hashed.join(F.broadcast(run.where("_before < _wanted")), "_digits")
    number = F.row_number().over(Window.partitionBy("_digits").orderBy("_hash", key))
    split = some.where("_up_to > _wanted").withColumn("_no", number).where("_before + _no <= _wanted").select(key)
    return some.where("_up_to <= _wanted").select(key).unionByName(split)


def synthetic_rows(keys: DataFrame, key: str, seed: int = 42, noise: float = 0.1) -> DataFrame:
    """A feature row with a label by rule for each ``key``, which must be distinct; values follow their distributions and depend on the key only. Of the labels the share ``noise``, rounded down to whole rows, is flipped."""

    def u(name: str) -> Column:
        return drawn("row_id", name, seed)

    rows = keys.select(F.col(key).alias("row_id")).repartition("row_id")  # the keys may lie in a few files, the draws shouldn't
    bits = [*fixed.PRESENCE_FEATURES, "is_imported"]
    rows = rows.withColumns({b: (u(b) < 0.7).cast("int") for b in bits})
    rows = rows.withColumn("has_english", F.when((F.col("has_hindi") == 0) & (F.col("has_english") == 0), (u("language") < 0.9).cast("int")).otherwise(F.col("has_english")))
    ranges = fixed.SYNTHETIC_RANGES
    rows = rows.withColumns({f: low + (high - low) * u(f) for f, (low, high) in ranges.items()})
    rows = rows.withColumn("min_font_height_mm", F.least("mrp_font_height_mm", "net_qty_font_height_mm"))
    total = F.lit(2)
    for b in fixed.PRESENCE_FEATURES[:10]:
        total = total + F.col(b)
    rows = rows.withColumn("num_declarations_found", total)
    rows = rows.withColumns({f: F.when(u(f + " known") >= 0.1, F.col(f)) for f in ("mrp_font_height_mm", "net_qty_font_height_mm", "mrp_contrast_ratio")})
    flipped = smallest_share(rows, "row_id", "flip", seed, noise).withColumn("flip", F.lit(True))
    rows = rows.withColumn("label", synthetic_label(rows)).join(flipped, "row_id", "left")
    return rows.withColumn("label", F.when(F.col("flip"), 1 - F.col("label")).otherwise(F.col("label"))).select("row_id", *fixed.FEATURES, "label")


def bin_expression(value: Column, cuts: list[float]) -> Column:
    """The bin of a value: how many cuts lie below it; one more than there are for unknown values.

    The value is worked out once, not once a cut; many cuts are searched in two steps.
    """

    value = value.cast("double")

    def below(cuts: Column, value: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < value))

    def searched(value: Column) -> Column:
        width = math.isqrt(len(cuts))
        groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        held, lasts = F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.array(*[F.lit(g[-1]) for g in groups])
        return bound(lambda whole: F.when(whole == len(groups), len(cuts)).otherwise(whole * width + below(F.get(held, whole), value)), below(lasts, value))

    found = bound(searched, value) if len(cuts) > 8 else sum(((value > cut).cast("int") for cut in cuts), F.lit(0))
    return F.when(value.isNull() | F.isnan(value), len(cuts) + 1).otherwise(found)


@dataclass
class PairTerm:
    a: str
    b: str
    cuts_a: list[float]
    cuts_b: list[float]
    weights: list[float]  # by bin of a, then of b; the last bin of each is for unknown values

    @property
    def name(self) -> str:
        return self.a + AND + self.b


@dataclass
class AdditiveModel:
    cuts: dict[str, list[float]]
    weights: dict[str, list[float]]  # by bin; the last bin is for unknown values
    intercept: float
    pairs: list[PairTerm] = field(default_factory=list)

    def bin_of(self, feature: str) -> Column:
        return bin_expression(F.col(feature), self.cuts[feature])

    def contributions(self) -> Column:
        """Map from feature, or pair of features, to what it adds to the log-odds."""
        names = [*self.cuts, *[p.name for p in self.pairs]]
        values = [F.get(F.array(*map(F.lit, self.weights[f])), self.bin_of(f)) for f in self.cuts]
        for p in self.pairs:
            cell = bin_expression(F.col(p.a), p.cuts_a) * (len(p.cuts_b) + 2) + bin_expression(F.col(p.b), p.cuts_b)
            values.append(F.get(F.array(*map(F.lit, p.weights)), cell))
        return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))

    def probability(self, contributions: Column) -> Column:
        odds = F.aggregate(F.map_values(contributions), F.lit(self.intercept), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))


def save(spark: SparkSession, model: AdditiveModel, path: str) -> None:
    """Keep a model as a table: one row a number."""
    rows = [("intercept", 0, "", "", 0, model.intercept)]

    def add(kind: str, no: int, a: str, b: str, numbers: list[float]) -> None:
        rows.append((kind, no, a, b, -1, float(len(numbers))))
        rows.extend((kind, no, a, b, i, float(x)) for i, x in enumerate(numbers))

    for no, f in enumerate(model.cuts):
        add("cuts", no, f, "", model.cuts[f])
        add("weights", no, f, "", model.weights[f])
    for no, p in enumerate(model.pairs):
        for kind, numbers in (("pair cuts a", p.cuts_a), ("pair cuts b", p.cuts_b), ("pair weights", p.weights)):
            add(kind, no, p.a, p.b, numbers)
    spark.createDataFrame(rows, "kind string, no int, a string, b string, at int, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> AdditiveModel:
    held: dict[tuple, list[float]] = {}
    model = AdditiveModel({}, {}, 0.0)
    for r in spark.read.parquet(path).orderBy("kind", "no", "at").collect():
        if r.kind == "intercept":
            model.intercept = r.value
        elif r.at < 0:
            held[r.kind, r.no, r.a, r.b] = []
        else:
            held[r.kind, r.no, r.a, r.b].append(r.value)
    for (kind, no, a, b), numbers in held.items():
        if kind == "cuts":
            model.cuts[a], model.weights[a] = numbers, held["weights", no, a, b]
        elif kind == "pair weights":
            model.pairs.append(PairTerm(a, b, held["pair cuts a", no, a, b], held["pair cuts b", no, a, b], numbers))
    return model


def cut_points(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Quantiles of each feature as cuts, at most ``bins - 1``; none at a feature's largest value, which would leave a bin empty."""
    quantiles = [i / bins for i in range(1, bins)]
    known = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    found = rows.agg(*[F.percentile_approx(known[f], quantiles, 100 * bins).alias(f) for f in features], *[F.max(known[f]).alias(f"_max_{f}") for f in features]).first()
    return {f: sorted({x for x in (found[f] or []) if x < found[f"_max_{f}"]}) for f in features}


def fit(rows: DataFrame, features: list[str] | None = None, how: "Boosting | None" = None) -> AdditiveModel:  # noqa: UP037
    """Train on ``rows(features, label)``. Histograms of bins, cut points and weights are all that reaches the driver; without rows all weights are 0."""
    from . import boosting  # which builds on this module

    how, features = how or boosting.Boosting(), features or fixed.FEATURES
    rows = written(rows.select(*features, "label"), "training")  # what the rows come from is worked out once
    return boosting.boost(rows, cut_points(rows, features, how.bins), how)


def predicted(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds ``contributions, probability, predicted, risk_factors`` (the five features that push most against compliance)."""
    held = rows.withColumn("contributions", model.contributions())
    held = held.withColumn("probability", model.probability(F.col("contributions"))).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    against = F.filter(F.map_entries("contributions"), lambda e: e["value"] < 0)
    ranked = F.array_sort(F.transform(against, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return held.withColumn("risk_factors", F.transform(F.slice(ranked, 1, 5), lambda e: e["k"]))


def importances(scored: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature or pair."""
    values = scored.select(F.explode_outer("contributions").alias("feature", "value")).where("feature IS NOT NULL")  # the plain one would be guessed to be empty, and the guess checked by working all out again beneath the joins
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def top_importances(scored: DataFrame, n: int = 10, width: int = 20) -> DataFrame:
    """The ``n`` greatest importances, each with a bar of up to ``width`` marks relative to the greatest."""
    top = importances(scored).orderBy(F.col("importance").desc(), "feature").limit(n)
    most = F.max("importance").over(Window.partitionBy(F.lit(0)))  # n rows
    return top.withColumn("bar", F.repeat(F.lit("#"), F.when(most > 0, F.round(F.col("importance") / most * width)).otherwise(0).cast("int")))


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))

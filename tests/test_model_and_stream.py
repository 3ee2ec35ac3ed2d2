"""The additive model, and scan streams against the same computation on a table."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from packlens.operators import boosting, model
from packlens.sources import sinks
from packlens.streaming import scans, sessions


def test_contributions_add_up_and_the_model_learns(spark):
    names = ["has_mrp", "has_mfg_date", "mrp_font_height_mm"]
    rows = spark.range(3000).select(
        (F.rand(1) < 0.7).cast("int").alias("has_mrp"), (F.rand(2) < 0.7).cast("int").alias("has_mfg_date"), F.when(F.rand(3) > 0.1, F.rand(4) * 8).alias("mrp_font_height_mm"))
    rows = rows.withColumn("label", ((F.col("has_mrp") == 1) & F.coalesce(F.col("mrp_font_height_mm") > 1, F.lit(False))).cast("int")).cache()
    fitted = model.fit(rows, names)
    scored = model.predicted(rows, fitted)
    assert model.accuracy(scored).first().accuracy > 0.95
    r = scored.first()
    assert 1 / (1 + 2.718281828459045 ** -(fitted.intercept + sum(r.contributions.values()))) == pytest.approx(r.probability)
    assert set(r.risk_factors) == {k for k, v in r.contributions.items() if v < 0}
    top = model.importances(scored).orderBy(F.col("importance").desc()).first().feature
    assert top in ("has_mrp", "mrp_font_height_mm")


def test_importances_work_contributions_out_once(spark):
    made = model.AdditiveModel({"row_id": [float(i) for i in range(40)]}, {"row_id": [i / 7 for i in range(42)]}, 0.0)
    scored = model.predicted(model.synthetic_rows(spark.range(50), "id"), made)
    plan = model.importances(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays(") == 1


def test_bins_of_training_are_those_of_scoring(spark):
    values = [None, math.nan, -math.inf, math.inf, -1.0, 0.0, 0.5, 1.0, 8.0, 8.5, 16.0, 17.0, 18.0, 18.5]
    for n in (0, 1, 8, 9, 10, 16, 19, 255):
        cuts = [float(i) for i in range(n)]
        rows = spark.createDataFrame([(v, 1) for v in values], "f double, label int")
        got = sorted(r.bins[0] for r in boosting.binned(rows, {"f": cuts}, boosting.Boosting(bags=1)).collect())
        want = sorted(n + 1 if v is None or math.isnan(v) else sum(c < v for c in cuts) for v in values)
        assert got == want == sorted(r.b for r in rows.select(model.bin_expression(F.col("f"), cuts).alias("b")).collect())


def plain_boost(bins, sizes, y, bags, pair, how):
    """The same boosting, row by row and cut by cut, on lists."""
    def leaf(rows, g, h):
        return sum(g[r] for r in rows) / (sum(h[r] for r in rows) + how.damping)

    def worth(rows, g, h):
        return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + how.damping)

    def grow(parts, g, h, best):
        parts = [p for p in parts if p is not None]
        if all(len(p) >= how.least_leaf for p in parts):
            gain = sum(worth(p, g, h) for p in parts)
            if gain > best[0] + 1e-12:
                return gain, parts
        return best

    weights, pairs, bases = [], [], []
    for bag in bags:
        inside = [r for r in range(len(y)) if bag[r]]
        share = sum(y[r] for r in inside) / len(inside)
        base = math.log(share / (1 - share))
        w, t = [[0.0] * s for s in sizes], {}

        def gradients(w, t, base=base):
            out = []
            for r in range(len(y)):
                p = 1 / (1 + math.exp(-(base + sum(w[f][bins[r][f]] for f in range(len(sizes))) + (t.get((bins[r][pair[0]], bins[r][pair[1]]), 0.0) if pair else 0.0))))
                out.append((y[r] - p, p * (1 - p)))
            return [g for g, _ in out], [h for _, h in out]

        for _ in range(how.rounds):
            g, h = gradients(w, t)
            for f, size in enumerate(sizes):
                of = {b: [r for r in inside if bins[r][f] == b] for b in range(size)}
                span = lambda a, b, of=of: [r for k in range(a, b) for r in of[k]]
                best = (-1.0, [])
                for i in range(1, size - 1):
                    for j in range(i, size - 1):
                        best = grow([span(0, i), span(i, j), span(j, size - 1)] if i < j else [span(0, i), span(i, size - 1)], g, h, best)
                for part in best[1]:
                    for b in {bins[r][f] for r in part}:
                        w[f][b] += how.rate * leaf(part, g, h)
                if len(of[size - 1]) >= how.least_leaf:
                    w[f][size - 1] += how.rate * leaf(of[size - 1], g, h)
        for _ in range(how.pair_rounds if pair else 0):
            g, h = gradients(w, t)
            a, b = pair
            best = (-1.0, [])
            for i in range(1, sizes[a]):
                for j in range(1, sizes[b]):
                    quarters = [[r for r in inside if (bins[r][a] < i) == x and (bins[r][b] < j) == z] for x in (True, False) for z in (True, False)]
                    best = grow(quarters, g, h, best) if all(quarters) else best
            for part in best[1]:
                for c in {(bins[r][a], bins[r][b]) for r in part}:
                    t[c] = t.get(c, 0.0) + how.rate * leaf(part, g, h)
        weights.append(w), pairs.append(t), bases.append(base)
    return weights, pairs, bases


def test_boosting_is_that_of_lists(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a, b, c = rng.randrange(2), rng.choice([None, *range(5)]), rng.random()
        rows.append((a, b, c, int((a == 1) != ((b or 0) > 2) if c > 0.3 else rng.random() < 0.3)))
    how = boosting.Boosting(rounds=3, bags=2, share=70, pairs=1, pair_rounds=2, rate=0.3)
    cuts = {"a": [0.0], "b": [0.0, 1.0, 2.0, 3.0], "c": [0.2, 0.4, 0.6, 0.8]}
    table = spark.createDataFrame(rows, "a int, b int, c double, label int").repartition(3)
    got = boosting.boost(table, cuts, how)
    held = boosting.binned(table, cuts, how).collect()
    bags = [[r.bags >> b & 1 for r in held] for b in range(how.bags)]
    assert 0.5 < sum(map(sum, bags)) / 800 < 0.9
    weights, pairs, bases = plain_boost([r.bins for r in held], [3, 6, 6], [r.y for r in held], bags, (0, 1), how)
    assert [p.name for p in got.pairs] == ["a & b"]
    flat = {(i, j): got.pairs[0].weights[i * 6 + j] for i in range(3) for j in range(6)}
    for cell, value in flat.items():
        if any(cell in t for t in pairs):
            assert value == pytest.approx(sum(t.get(cell, 0.0) for t in pairs) / 2)
    middle = 0.0
    for f, name in enumerate(cuts):
        mean = [sum(w[f][b] for w in weights) / 2 for b in range(len(cuts[name]) + 2)]
        count = [sum(bag[i] for bag in bags for i, r in enumerate(held) if r.bins[f] == b) for b in range(len(mean))]
        shift = sum(m * n for m, n in zip(mean, count, strict=True)) / sum(count)
        middle += shift
        assert got.weights[name] == pytest.approx([m - shift for m in mean])
    assert got.intercept == pytest.approx(sum(bases) / 2 + middle)
    scored = model.predicted(table, got)
    assert model.accuracy(scored).first().accuracy > model.accuracy(model.predicted(table, model.AdditiveModel(got.cuts, got.weights, got.intercept))).first().accuracy
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString().split("Scan")[0]


def test_exact_share_of_rows(spark):
    rows = spark.range(997).withColumnRenamed("id", "k")
    for share in (0.0, 0.1, 0.5, 1.0):
        got = [r.k for r in model.smallest_share(rows, "k", "x", 1, share).collect()]
        want = sorted(range(997), key=lambda k: (hashlib.md5(f"1:x:{k}".encode()).hexdigest(), k))[: int(997 * share)]
        assert sorted(got) == sorted(want)


def test_no_rows_no_weights(spark):
    fitted = model.fit(spark.createDataFrame([], "a double, b int, label int"), ["a", "b"], boosting.Boosting(rounds=1, pair_rounds=1))
    assert fitted.intercept == 0 and not any(w for ws in fitted.weights.values() for w in ws)


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [(i, 1 + i % 2, f"2024-01-01 00:0{i // 4}:{(i * 3) % 60:02d}", '{"k": %d}' % (i % 3)) for i in range(24)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, props string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = run(scans.verified_scans(scans.scans_of(stream)).select("event_id", "gtin.is_valid"), "facts", "append")
    want = scans.verified_scans(scans.scans_of(events)).select("event_id", "gtin.is_valid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    first = run(scans.first_scans(scans.scans_of(stream)).select("device", "code"), "first", "append")
    assert first.count() == scans.first_scans(scans.scans_of(events)).count()
    minutes = run(scans.scans_per_minute(scans.scans_of(stream)), "minutes", "complete")
    assert sum(r.scans for r in minutes.collect()) == 24


def test_models_are_kept_as_tables(spark, tmp_path):
    held = model.AdditiveModel({"a": [1.0, 2.5], "b": []}, {"a": [0.1, -0.2, 0.3, 0.0], "b": [0.5, -0.5]}, 0.25, [model.PairTerm("a", "b", [1.0], [], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])])
    model.save(spark, held, str(tmp_path / "m"))
    assert model.load(spark, str(tmp_path / "m")) == held


def test_sessions_and_late_scans_over_a_restart(spark, tmp_path):
    """Out-of-order batches, the query stopped and started again between them: the same as on a table of all of them."""
    rng = random.Random(2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STATE_STORE)
    base, rows = 1_704_067_200, []
    for i in range(120):
        at = base + i * 20 - rng.choice([0, 0, 0, 25, 45, 200])
        rows.append((i, i % 3, at + rng.random(), '{"k": %d}' % (i % 5)))
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts double, props string").withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    source, spots = tmp_path / "in", [(0, 40), (40, 41), (41, 90), (90, 120)]
    schema = events.schema
    source.mkdir()

    def run(name, made, mode):
        stream = scans.scans_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        q = made(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for low, high in spots:
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(str(source))
        run("late", sessions.late_scans, "append")
        run("sessions", lambda s: sessions.device_sessions(s, "1 minute", "10 minutes"), "append")
    got = spark.read.parquet(str(tmp_path / "late")).select("event_id", "device", "behind", "late").collect()
    want = sessions.late_scans(scans.scans_of(events)).select("event_id", "device", "behind", "late").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.late for r in got) > 3
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "sessions")).select("device", "start", "end", "scans").collect()}
    whole = {tuple(r) for r in sessions.device_sessions(scans.scans_of(events), "1 minute").select("device", "start", "end", "scans").collect()}
    assert closed and closed <= whole


def test_replayed_batches_leave_one_copy(spark, tmp_path):
    rows = spark.createDataFrame([(1, "{\n  1\n}"), (2, "{\n}"), (3, None)], "n int, report string")
    folder = str(tmp_path / "out")
    write = sinks.document_writer(folder)
    write(rows, 0)
    write(rows.where("n = 2"), 7)
    write(rows.where("n = 1"), 7)
    write(rows.where("n = 1"), 7)
    assert sorted(map(tuple, sinks.read_documents(spark, folder).collect())) == [(0, "{\n  1\n}"), (0, "{\n}"), (7, "{\n  1\n}")]

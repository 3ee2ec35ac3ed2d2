"""Operators 6, 7 and 8."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import lm, mixing, quality

from . import samples


def water(sizes, weights):
    targets, total = dict.fromkeys(sizes, 0.0), sum(sizes.values())
    open_, left = set(sizes), float(total)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weights[s]}
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
        open_ -= full
    return targets


def test_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, samples.prose(rng, rng.randrange(0, 30)), rng.choice(["a", "a", "a", "a", "a", "Z", "é", None, "b"])) for i in range(3000)] + [(9999, "tiny", "zz"), (9998, None, "none")]
    got = mixing.mix_query(spark, samples.frame(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    source = {i: s for i, _, s in rows}
    texts = {i: t for i, t, _ in rows}
    taken = Counter()
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(want[s] - taken[s]) <= 10, s
    again = mixing.mix_query(spark, samples.frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    copies = mixing.apply_mix(samples.frame(spark, rows, extra=True))
    assert copies.count() == sum(r.copies for r in got) and copies.columns == samples.frame(spark, rows, extra=True).columns
    assert mixing.mix_query(spark, samples.empty(spark)).count() == 0
    assert mixing.mix_query(spark, samples.frame(spark, [(1, None, None), (2, "", "a")])).count() == 2


def test_mixing_runs_no_python(spark):
    plan = mixing.mix_query(spark, samples.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_language_model(spark):
    rows = samples.documents()
    got = lm.score_documents(samples.frame(spark, extra=True)).collect()
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter()
    for i, t, _ in rows:
        if i not in out:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    texts = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in out, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_documents(samples.empty(spark)).count() == 0


def automaton(texts, held=lm.HELD):
    """States, arcs and failures as dictionaries over tuples of words, from the definition."""
    order = len(held) + 1
    grams = [Counter() for _ in range(order)]
    for words in texts:
        for n in range(1, order + 1):
            grams[n - 1].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    total, types = sum(grams[0].values()), len(grams[0])
    states = {g: n for of in grams[:-1] for g, n in of.items() if n > 1 and None not in g}
    trust = {s: (n - 1) / (n - 1 + held[len(s) - 1]) for s, n in states.items()}

    def probability(state, word):
        if not state:
            return (grams[0][(word,)] + 1) / (total + types + 1)
        shorter = probability(state[1:], word)
        return shorter if state not in states else trust[state] * grams[len(state)][(*state, word)] / states[state] + (1 - trust[state]) * shorter

    arcs = {s: {} for s in states}
    for of in grams[1:]:
        for g in of:
            if g[:-1] in states:
                arcs[g[:-1]][g[-1]] = math.log10(probability(g[:-1], g[-1]))
    return states, arcs, {s: math.log10(1 - t) for s, t in trust.items()}, probability, grams[0]


def walked(words, states, arcs, failures, probability, order=lm.ORDER):
    """One traversal from left to right: from the state by an arc, or by failures to a state that has one."""
    state, score = (), 0.0
    for word in words:
        at = state
        while at and word not in arcs[at]:
            score += failures[at]
            at = at[1:]
            while at and at not in states:
                at = at[1:]
        score += arcs[at][word] if at else math.log10(probability((), word))
        state = (*state, word)[-(order - 1) :]
        while state and state not in states:
            state = state[1:]
    return score


@pytest.mark.parametrize("block_bytes, range_keys", [(16_000_000, 2_000_000), (3_000, 500)])
def test_scores_are_those_of_a_walk(spark, block_bytes, range_keys):
    """A walk along arcs and failures, over the states that the training texts have, gives each text's score, however the work is cut."""
    rows = samples.documents()
    words = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    model = automaton([words[i] for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    *parts, vocabulary = model
    for state in [(), *list(parts[0])[:60]]:
        assert sum(parts[3](state, *w) for w in vocabulary) + parts[3](state, b"never seen") == pytest.approx(1.0, abs=1e-9)
    got = lm.score_documents(samples.frame(spark), block_bytes=block_bytes, range_keys=range_keys).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(walked(words[r.doc_id], *parts), rel=1e-9, abs=1e-9)


def test_what_occurs_twice_scores_apart(spark):
    """A text whose copy is learnt from scores above its like, and rows without an id are learnt from."""
    rng = random.Random(5)
    rows = [(i, samples.prose(rng, 120, 30_000), None) for i in range(300)]
    rows += [(1000 + i, rows[i][1], None) for i in range(40)] + [(None, rows[0][1], None)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_documents(samples.frame(spark, rows)).collect()}
    taught = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2 != zlib.crc32(str(1000 + i).encode()) % 7]
    once = sorted(got[i] for i in range(40, 300))
    assert len(taught) > 20 and all(got[i] > once[-26] for i in taught)


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        kind = i % 6
        text = samples.prose(rng, 120)
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1:
            words = text.split()
            for at in rng.sample(range(120), 6):
                words[at] = f"vile{rng.choice('abcdef')}{rng.randrange(30)}"
            text = " ".join(words)
        docs.append((i, text, f"host{i % 4}"))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(random.Random(4), 1200)
    known = [x for x in labels if x[0] % 3]
    table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    df = samples.frame(spark, [*docs, (5000, None, "host0"), (5001, " \n", None)], extra=True)
    got = {r.doc_id: r for r in quality.judge(df, table, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 1202 and not got[5000]._keep and not got[5001]._keep
    unseen = [x for x in labels if not x[0] % 3]
    right = sum(got[i]._keep == (q == 1 and t == 0) for i, q, t in unseen)
    assert right / len(unseen) > 0.97


def test_sparse_sites_shrink_to_the_corpus_rate(spark):
    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.9)] + [("good", "a", 0.05)] * 300 + [("new", "a", 0.9)]
    df = spark.createDataFrame([(h, p, x, 0.0) for h, p, x in rows], "h string, p string, _p_low double, _p_toxic double")
    sites, corpus = quality.site_posteriors(df, F.col("h"), F.col("p"))
    rate = {(r.host, r.path): r.site_rate for r in sites.collect()}
    assert rate["big", "a"] > 0.85 and rate["good", "a"] < 0.1
    assert corpus < rate["new", "a"] < rate["big", "a"]
    assert abs(rate["big", "b"] - rate["big", "a"]) < 0.05


def worth(rates, centres, sizes):
    """Documents that a prior is worth, by the method of moments."""
    noise, between = sum(c * (1 - c) for c in centres), sum(n * (r - c) ** 2 for r, c, n in zip(rates, centres, sizes, strict=True))
    variance = max((between - noise) / sum(sizes), 1e-12)
    return min(max(noise / len(rates) / variance - 1, 5.0), 1e6)


def test_posteriors_by_brute_force(spark):
    """From the document probabilities on, recomputed site by site with each document left out of its own site's rate."""
    docs, labels = labelled(random.Random(6), 500)
    docs += [(5001, "one more text of few words", None), (5002, docs[0][1], "rare")]
    table = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = quality.judge(samples.frame(spark, docs, extra=True).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")), table, F.col("source"), F.col("lang")).collect()
    own = {r.doc_id: 1 - (1 - r._p_low) * (1 - r._p_toxic) for r in got}
    site = {r.doc_id: (r.source, r.lang) for r in got}
    corpus = (sum(own.values()) + 0.5) / (len(own) + 1)
    hosts, paths = {}, {}
    for i, (h, p) in site.items():
        hosts.setdefault(h, []).append(own[i])
        paths.setdefault((h, p), []).append(own[i])
    by_host = worth([sum(x) / len(x) for x in hosts.values()], [corpus] * len(hosts), [len(x) for x in hosts.values()])
    rate = {h: (sum(x) + by_host * corpus) / (len(x) + by_host) for h, x in hosts.items()}
    by_path = worth([sum(x) / len(x) for x in paths.values()], [rate[h] for h, _ in paths], [len(x) for x in paths.values()])
    odds = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r in got:
        h, x = hosts[r.source], paths[site[r.doc_id]]
        host = (max(sum(h) - own[r.doc_id], 0) + by_host * corpus) / (len(h) - 1 + by_host)
        want = (max(sum(x) - own[r.doc_id], 0) + by_path * host) / (len(x) - 1 + by_path)
        assert r._site_rate == pytest.approx(want, rel=1e-6)
        assert r._p_bad == pytest.approx(1 / (1 + math.exp(-(odds(own[r.doc_id]) + odds(want) - odds(corpus)))), rel=1e-6, abs=1e-12)
        assert r._keep == (r._p_bad < 0.5)


def test_logistic_fit_is_where_its_gradient_vanishes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0, 0.5, 0.1] - 0.3)))).astype(float)
    beta = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert abs((y - p).sum()) < 1e-4 and np.abs(x.T @ (y - p) - quality.RIDGE * beta[1:]).max() < 1e-4


def test_small_sources_come_as_near_as_one_document_brings_them(spark):
    """A source of few documents misses its target by no more than without its nearest further document."""
    rng = random.Random(12)
    rows = [(i, samples.prose(rng, rng.randrange(20, 200)), f"src{i % 12}") for i in range(120)] + [(7, "same " * 30, "src1")] * 2
    got = mixing.mix_sources(samples.frame(spark, rows, extra=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size
    misses = []
    for of in by.values():
        taken, target = sum(r.taken for r in of), of[0].target
        misses.append(abs(taken - target) / target)
        least = min(r.copies for r in of)
        for r in of:
            if r.copies == least and target > taken and least < 3:
                assert r.size >= 2 * (target - taken) - 1e-6 or r.doc_id == 7 or abs(taken + r.size - target) >= target - taken - 1e-6
    assert sum(misses) / len(misses) < 0.05


def test_small_sources_come_as_near_as_any_choice(spark):
    """Up to twelve documents: no set of them comes nearer to what is left of the target; doc_ids that repeat go together."""
    rng = random.Random(13)
    rows = [(i, samples.prose(rng, rng.choice([1, 5, 60, 400, 3000])), f"src{i % 9}") for i in range(9 * 11)] + [(9, "again " * 50, "src0")] * 3 + [(1000, None, "src1"), (1001, "", None), (1002, "one two three", None)]
    got = mixing.mix_sources(samples.frame(spark, rows, extra=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for of in by.values():
        target, whole, units = of[0].target, of[0].source_size, Counter()
        for r in of:
            units[r.doc_id] += r.size
        sizes = [n for n in units.values() if n]
        repeats = min(int(target / whole), 3) if whole else 0
        left = max(target - repeats * whole, 0)
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        best = min(abs(left - x) for x in sums) if left else 0
        assert len(sizes) <= 12 and abs(sum(r.taken for r in of) - target) == pytest.approx(best, abs=1e-6)


def test_without_labels_all_words_stay(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(samples.frame(spark), none, F.col("source"), F.col("lang")).collect()
    texts = {i: t for i, t, _ in samples.documents()}
    assert all(r._keep == bool((texts[r.doc_id] or "").strip(" \t\n")) for r in got)
    assert quality.judge(samples.empty(spark), none, F.col("source"), F.col("lang")).count() == 0


def test_planes_come_back():
    rng = np.random.default_rng(3)
    for values in (np.empty(0, np.int64), np.zeros(5, np.int64), np.array([2**64 - 1, 0, 7], np.uint64), rng.integers(0, 1 << 40, 1000), rng.integers(0, 3, 1000)):
        assert np.array_equal(lm.from_planes(lm.planes(values)), values.astype(np.uint64))

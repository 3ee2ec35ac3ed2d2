"""Operator 11 against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from packlens.llm import resample

from . import samples


def plain(rows, target, low, high, buckets=10_000, percent=10, least=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    found = [features(t) for _, t, _ in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for (i, _, _), (n, f) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is not None, x[1] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 10), (1, 2, 40), (2, 3, 100)])
def test_against_plain(spark, low, high, percent):
    rows = [*samples.documents(), (None, "null id " * 30, "s")]
    target = [rows[3][1], rows[8][1].upper(), None, ""]
    asked = resample.Features(low, high)
    goal = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, item_id long")
    got = resample.resample(samples.frame(spark, rows, extra=True), goal, asked, percent).collect()
    want, drawn = plain(rows, target, low, high, percent=percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[1:] for x in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(x[4], x[1]) for x in drawn]


def test_one_id_for_many_rows(spark):
    rows = [(5, samples.prose(random.Random(i), 25), "s") for i in range(40)] + [(i, "few words " * 15, "s") for i in range(100, 160)]
    got = resample.resample(samples.frame(spark, rows), samples.frame(spark, rows[:3]), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101))
    order = [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order, key=lambda x: (-x[0], x[1]))


def test_nothing_to_draw(spark):
    assert resample.resample(samples.empty(spark), samples.frame(spark)).count() == 0
    got = resample.resample(samples.frame(spark, [(1, None, None), (2, "a few words", "s")]), samples.empty(spark)).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in got} == {(1, 0, None), (2, 3, None)}

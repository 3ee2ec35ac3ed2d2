"""Operator 13 against all pairs of sets."""

import random

import numpy as np
import pytest

from packlens.llm import jaccard, simhash

from . import samples


def plain_sets(text, words=3):
    held = (text or "").encode().lower().split()
    n = min(words, len(held))
    return {tuple(held[i : i + n]) for i in range(len(held) - n + 1)} if n else set()


def components(rows, percent, words=3):
    sets = [plain_sets(t, words) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r) if s else i) for (i, _, _), s, r in zip(rows, sets, root, strict=True)]


def families(seed, n=40):
    """Near copies at all distances around the limit."""
    rng, rows = random.Random(seed), []
    for f in range(n):
        text = samples.prose(rng, rng.randrange(5, 300), 5000)
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):
            rows.append((len(rows) + 50_000 + f, samples.changed(rng, text, share), "s"))
    return rows


@pytest.mark.parametrize(("percent", "slack", "words"), [(90, 5, 3), (90, 0, 3), (60, 30, 2), (100, 0, 1), (80, 8, 3)])
def test_linked_sets(percent, slack, words):
    rng = random.Random(percent + slack)
    rule = jaccard.Jaccard(words, percent, slack)
    base = [rng.randrange(60) for _ in range(80)]
    texts = [" ".join(map(str, (rng.randrange(60) if rng.random() < share else w for w in base))) for share in (0, 0.01, 0.02, 0.05, 0.1, 0.3) for _ in range(20)]
    texts += [" ".join(map(str, base[: rng.randrange(1, 80)])) for _ in range(60)] + [samples.prose(rng, rng.randrange(3), 3) for _ in range(9)]
    sets = rule.sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(plain_sets(t, words)) for t in texts]
    derived, index = [], jaccard.SetIndex(sets, rule)
    got = list(range(len(sets)))
    for a, b in zip(*jaccard.linked_sets(sets, rule, derived), strict=True):
        got[a] = int(b)
    want = [i if c is None else c for i, c in enumerate(c for _, _, c in components([(i, t, "s") for i, t in enumerate(texts)], percent, words))]
    assert got == want
    assert derived
    skipped = []
    for i in range(len(sets)):
        found = index.candidates(i, percent, skipped)
        shared = np.array([len(np.intersect1d(sets[i], s)) for s in sets])
        partners = np.flatnonzero((100 * shared >= percent * (len(sets[i]) + index.sizes - shared)) & (shared > 0))
        assert set(partners.tolist()) - {i} <= set(found.tolist())
    assert sum(skipped)


def test_groups(spark):
    rows = samples.documents() + families(5) + [(None, samples.documents()[3][1], "s"), (None, "alone here now", "s"), (3, "Upper CASE words", "s"), (2, "upper case\twords", "s")]
    got = jaccard.jaccard_groups(samples.frame(spark, rows, extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(components(rows, 90), key=str)
    assert jaccard.jaccard_groups(samples.empty(spark)).count() == 0


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 25)
    monkeypatch.setattr(simhash, "HUBS", 3)
    rng = random.Random(4)
    text = samples.prose(rng, 150, 5000)
    rows = [(i, samples.changed(rng, text, rng.choice((0.005, 0.01, 0.03))), "s") for i in range(200)]
    got = jaccard.jaccard_groups(samples.frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(components(rows, 90))


@pytest.mark.parametrize(("percent", "cut"), [(90, True), (90, False), (60, True), (97, True), (100, True)])
def test_similar_sets_share_a_key(percent, cut):
    """Pairs at the limit, with as many differences as there may be, on either side of the levels' borders."""
    rng = np.random.default_rng(percent)
    rule, shared, unrelated = jaccard.Jaccard(3, percent, 0), 0, 0
    for size in [*range(1, 40), 63, 64, 65, 70, 71, 100, 127, 128, 140, 142, 143, 255, 256, 280, 284, 285, 1000, 1024, 1100, 5000]:
        whole = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for lost in {0, *(size * (100 - percent) // 100 * k // 4 for k in range(1, 5))}:
            gained = 0
            while 100 * (size - lost) >= percent * (size + gained + 1):
                gained += 1
            for extra in {0, gained // 2, gained} if 100 * (size - lost) >= percent * size and size > lost else ():
                other = np.unique(np.append(rng.permutation(whole)[lost:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)))
                a, b = (jaccard.segment_keys(x, rule, cut) for x in (whole, other))
                if a[1] and b[1]:
                    assert np.intersect1d(a[0], b[0]).size, (size, lost, extra)
                    shared += 1
        stranger = np.append(whole[: size // 5], rng.integers(0, 1 << 63, size - size // 5, dtype=np.uint64))
        unrelated += size >= 64 and bool(np.intersect1d(jaccard.segment_keys(np.unique(stranger), rule, cut)[0], jaccard.segment_keys(whole, rule, cut)[0]).size)
    assert shared > 50 and (unrelated < 6 or not cut or percent < 90)


def test_sets_without_enough_segments(spark):
    """If hashes leave a set too few segments, every shingle becomes one, for all sets."""
    rows, rule = families(9, 12), jaccard.Jaccard(spare=0.5)
    assert jaccard.keyed_rows(samples.frame(spark, rows), rule).where("NOT enough").count()
    assert sorted(map(tuple, jaccard.jaccard_groups(samples.frame(spark, rows), rule).collect())) == sorted(components(rows, 90))

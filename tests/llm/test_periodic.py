"""Operator 12 against all stretches and periods, tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from packlens.llm import periodic

from . import samples


def plain_runs(words, wanted):
    """Each stretch that no neighbour extends, with its smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // wanted.periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(wanted.length, wanted.periods * q):
                found.setdefault((i, j + q), q)  # periods ascend, so the smallest one stays
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items())


def strings():
    rng = random.Random(3)
    for letters in (1, 2, 3, 5):
        for n in (0, 1, 2, 5, 6, 7, 12, 30, 70):
            yield [rng.randrange(letters) for _ in range(n)]
    yield [0, 1] * 20 + [2] + [1, 0, 1] * 9 + [0] * 8 + [0, 1] * 3
    fib = [[0], [0, 1]]
    while len(fib) < 10:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            parts += (root * 8)[: rng.randrange(1, 8 * len(root))] + [rng.randrange(9) for _ in range(rng.randrange(4))]
        yield parts


@pytest.mark.parametrize("wanted", [periodic.Wanted(), periodic.Wanted(2, 2), periodic.Wanted(6, 3), periodic.Wanted(20, 2)])
def test_runs_of_arrays(wanted):
    held = list(strings())
    values = np.array([v for s in held for v in s], np.int64)
    owner = np.repeat(np.arange(len(held)), [len(s) for s in held])
    start, end, period = periodic.runs_of(values, owner, wanted)
    before = np.append(0, np.cumsum([len(s) for s in held]))
    got = sorted((int(owner[s]), int(s - before[owner[s]]), int(e - s), int(p)) for s, e, p in zip(start, end, period, strict=True))
    assert got == [(i, *r) for i, s in enumerate(held) for r in plain_runs(s, wanted)]


def test_block_starts():
    for s in strings():
        if not s:
            continue
        got = periodic.SuffixTree(np.array([*s, 10])).block_starts().tolist()
        want, at, full = [], 0, [*s, 10]
        while at < len(full):
            want.append(at)
            k = 0
            while any(full[j : j + k + 1] == full[at : at + k + 1] for j in range(at)):
                k += 1
            at += max(k, 1)
        assert got == want


def test_query(spark):
    rng = random.Random(8)
    line = samples.prose(rng, 7)
    rows = samples.documents() + [(20_000 + i, samples.prose(rng, rng.randrange(1, 200), 6), "s") for i in range(60)]
    rows += [(30_001, f"{line} " * 9 + "end " * 7, "s"), (None, f"{line} " * 5, "s"), (30_002, "a b " * 8 + "\x1c \x1c \x1c \x1c \x1c \x1c", "s"), (30_003, "w " * 30_000, None)]
    got = periodic.periodic_query(spark, samples.frame(spark, rows, extra=True)).collect()
    want = []
    for i, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(words, periodic.Wanted()) if len(set(words)) > 1 else [(0, len(words), 1)] if len(words) > 5 else []
        gone = {x for s, n, p in runs for x in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(w for x, w in enumerate(words) if x not in gone))]
        want.append((i, len(runs), *best, milli, *hashes))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs > 0 for r in got) > 10
    assert periodic.periodic_query(spark, samples.empty(spark)).count() == 0


def test_bad_rules():
    for length, periods in ((6, 1), (1, 4)):
        with pytest.raises(ValueError):
            periodic.Wanted(length, periods)

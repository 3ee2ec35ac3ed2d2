"""Operator 9 and near duplicates against brute force."""

import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packlens.llm import simhash
from packlens.llm.graph import connected_components

from . import samples


def groups(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))] if w else []


def slow_print(text):
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def test_components_as_by_brute_force(spark):
    rows = samples.documents()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_query(spark, samples.frame(spark, extra=True)).collect()}
    prints = {i: slow_print(t) for i, t, _ in rows}
    want = groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in want.items()}
    assert simhash.simhash_components(samples.frame(spark)).count() == len(rows)
    assert simhash.simhash_components(samples.empty(spark)).count() == 0


def test_near_duplicates_as_by_brute_force(spark):
    rows = samples.documents()
    sets = {i: set(shingles(t, 5)) for i, t, _ in rows}
    want = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(samples.frame(spark, extra=True)).collect()}
    assert got == want
    df = samples.frame(spark, extra=True)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    assert simhash.drop_near_duplicates(samples.empty(spark)).count() == 0


def test_large_groups_are_checked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 10)
    rng = random.Random(3)
    base = samples.prose(rng, 400)
    rows = [(i, samples.changed(rng, base, 0.004), "s") for i in range(45)] + [(100 + i, samples.prose(rng, 300), "s") for i in range(5)]
    got = simhash.near_duplicate_groups(samples.frame(spark, rows)).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 100)


def test_links_between_parts_are_found(spark, monkeypatch):
    """Two chains of texts that drift apart: few are near the group's middle, and neighbours mostly fall into different parts."""
    monkeypatch.setattr(simhash, "PART", 5)
    monkeypatch.setattr(simhash, "HUBS", 1)
    rng = random.Random(11)
    rows = []
    for chain in range(2):
        words = samples.prose(rng, 300).split()
        for i in range(30):
            rows.append((100 * chain + i, " ".join(words), "s"))
            at = 10 * (i % 30)
            words[at : at + 10] = [f"new{chain}x{i}x{j}" for j in range(10)]
    sets = {i: set(shingles(t, 5)) for i, t, _ in rows}
    want = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) == 2
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(samples.frame(spark, rows)).collect()} == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 20), st.integers(0, 40))
def test_bit_sliced_distances(prints, radius, flips):
    rng = random.Random(flips)
    prints = prints + [prints[0] ^ sum(1 << b for b in rng.sample(range(64), flips))]
    values = np.array(prints, np.uint64)
    hits = np.unpackbits(simhash.within_radius(values, simhash.planes_of(values), radius).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    for i, a in enumerate(prints):
        assert hits[i].tolist() == [int(bin(a ^ b).count("1") <= radius) for b in prints]
    other, root = simhash.links_within(values, radius)
    want = groups(range(len(prints)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= radius)
    assert dict(zip(other.tolist(), root.tolist(), strict=True)) == {k: v for k, v in want.items() if k != v}


def test_keys_leave_out_no_close_pair():
    masks = [m % 2**64 for m in simhash.byte_keys(2)]
    for a, b in itertools.combinations(range(64), 2):
        flip = 1 << a | 1 << b
        assert any(not flip & m for m in masks)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 300)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[0], names[0])]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_repeated_differently_keep_texts_near(spark):
    """Texts with nearly one set, in which a line comes once and 60 times; over all shingles, repeats included, fingerprints are over 20 bits apart."""
    rng, rows = random.Random(23), []
    while len(rows) < 12:
        base, line = samples.prose(rng, 200, 10**6), samples.prose(rng, 20, 10**6)
        pair = f"{base} {line}", f"{base} {' '.join([line] * 60)}"
        a, b = (simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for t in pair)
        if (a ^ b).bit_count() > 20:
            rows += [(len(rows) + j, t, "s") for j, t in enumerate(pair)]
    sets = {i: set(shingles(t, 5)) for i, t, _ in rows}
    assert all(0.8 * len(sets[i] | sets[i + 1]) <= len(sets[i] & sets[i + 1]) < len(sets[i] | sets[i + 1]) for i in range(0, 12, 2))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(samples.frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_short_texts_far_apart_in_fingerprints_are_compared(spark):
    """Four of five shingles in common, and more than 20 bits between the fingerprints of the sets."""
    rng, rows = random.Random(29), []
    while len(rows) < 20:
        text = samples.prose(rng, 9, 10**6)
        pair = text, text.rpartition(" ")[0]
        a, b = (simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), 5))) for t in pair)
        if (a ^ b).bit_count() > 20:
            rows += [(len(rows) + j, t, "s") for j, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(samples.frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(20)}


def test_large_groups_are_searched_by_bucket(spark, monkeypatch):
    """A chain of texts that drift apart is one group; its second pass compares only texts that share a block key, and finds all links."""
    monkeypatch.setattr(simhash, "PART", 5)
    monkeypatch.setattr(simhash, "HUBS", 1)
    seen, check = [], simhash.links_of_texts

    def spy(docs, members, task, words, similarity):
        if "block" in task:
            seen.extend(members.groupBy("component").agg(F.collect_set("node").alias("nodes")).collect())
        return check(docs, members, task, words, similarity)

    monkeypatch.setattr(simhash, "links_of_texts", spy)
    rng = random.Random(13)
    rows, words, keys = [], samples.prose(rng, 300).split(), {}
    for i in range(30):
        rows.append((i, " ".join(words), "s"))
        held = np.unique(simhash.shingle_hashes(rows[-1][1].encode(), 5))
        keys[simhash.node_of(held)] = set(enumerate(simhash.block_keys(held).tolist()))
        words[10 * i : 10 * i + 10] = [f"new{i}x{j}" for j in range(10)]
    got = simhash.near_duplicate_groups(samples.frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert seen and all(set.intersection(*[keys[n] for n in r.nodes]) for r in seen)
    assert "InArrow" not in simhash.bucket_stars(spark.createDataFrame([(0, 1, 2)], "k int, key long, node long"))._jdf.queryExecution().toString()


def test_blocks_are_abandoned_without_losing_a_pair():
    """Of unrelated prints few blocks are compared in all planes, and links are those of all pairs."""
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    prints[700:760] = prints[:60] ^ np.uint64(1 << 17) ^ np.uint64(1 << 40)
    prints[1499] = prints[63]
    looked_at = []
    simhash.within_radius(prints[:64], simhash.planes_of(prints[64:]), 2, looked_at)
    assert len(looked_at) == 64 and looked_at[0] == 23 and looked_at[40] <= 3
    looked_at.clear()
    simhash.within_radius(prints[128:192], simhash.planes_of(prints[192:640]), 2, looked_at)
    assert len(looked_at) < 64
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    want = groups(range(1500), lambda a, b: near[a, b])
    x, y = simhash.links_within(prints, 2)
    assert dict(zip(x.tolist(), y.tolist(), strict=True)) == {i: g for i, g in want.items() if i != g}


def test_near_fingerprints_make_candidates_without_a_shared_block_key(spark):
    rng = random.Random(23)
    prints = lambda t: simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), 5)))
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    edited = [" ".join([*base[:-1], f"x{i}"]) for i in range(50)]
    near = next(t for t in edited if 0 < (prints(t) ^ prints(" ".join(base))).bit_count() <= simhash.NEAR_RADIUS)
    held = [(1, " ".join(base)), (2, near), (3, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(200)))]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    rows = simhash.signatures(docs, 5).withColumn("keys", F.array("node")).cache()
    nodes = simhash.with_print_keys(simhash.nodes_of(rows))
    found = simhash.linked_groups(docs, rows, simhash.word_rule(5, 0.8), nodes)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 3}

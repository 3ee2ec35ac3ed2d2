"""Operators 4 and 10 against brute force over all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packlens.llm import repeats, segments, substrings, suffixes

from . import samples


def words_left(rows, window):
    first = {}
    for i, t in sorted(((i, t) for i, t, _ in rows if i is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def bytes_left(rows, length):
    seen = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("batches, fanout", [(1, 4), (3, 2), (5, 2)])
def test_words_as_by_brute_force(spark, batches, fanout):
    rows = [*samples.documents(), (None, samples.documents()[0][1], None)]
    got = substrings.dedup_words(samples.frame(spark, rows, extra=True), batches=batches, fanout=fanout)
    want = ordered(words_left(rows, 50))
    assert ordered(got.collect()) == want
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("batches", [1, 4])
def test_bytes_as_by_brute_force(spark, batches):
    rows = samples.documents()
    got = suffixes.dedup_bytes(samples.frame(spark, rows, extra=True), batches=batches)
    want = ordered(bytes_left(rows, 200))
    assert ordered(got.collect()) == want
    assert sum(r[2] for r in want) > 5000


@pytest.mark.parametrize("batches", [1, 3])
def test_bytes_of_rows_that_repeat_an_id(spark, batches):
    """Rows with one doc_id are separate texts: whole copies, a shared passage, and a passage that comes twice in one of them only."""
    rng = random.Random(17)
    passage, twice = samples.prose(rng, 120, 10**6), samples.prose(rng, 80, 10**6)
    own = [samples.prose(rng, 90, 10**6) for _ in range(6)]
    rows = [*samples.documents(), (20_001, own[0], "s"), (20_001, own[0], "s"), (20_002, f"{own[1]} {passage} {own[2]}", "s"), (20_002, f"{own[3]} {passage}", "s"), (20_003, f"{twice} {own[4]} {twice}", "s"), (20_003, own[5], "s")]
    got = suffixes.dedup_bytes(samples.frame(spark, rows, extra=True), batches=batches)
    assert ordered(got.collect()) == ordered(bytes_left(rows, 200))


def test_bytes_of_rows_without_an_id(spark):
    """They are separate texts as well: what repeats within one, between two and with a named one goes on all sides; copies of one another too."""
    rng = random.Random(23)
    shared, other, alone = (samples.prose(rng, 90, 10**6) for _ in range(3))
    rows = [(None, f"{shared} {shared}", "s"), (None, f"x {other} y", "s"), (1, f"z {other}", "s"), (None, alone, "s"), (None, alone, "s"), (2, samples.prose(rng, 90, 10**6), "s"), (None, None, "s"), (None, samples.prose(rng, 50, 10**6), "s")]
    got = suffixes.dedup_bytes(samples.frame(spark, rows, extra=True))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(bytes_left(rows, 200), key=str)
    assert got.where("doc_id IS NULL").count() == 6 and got.where("n_removed > 0").count() == 5


@pytest.mark.parametrize("at_once", [3, 40, substrings.HASHED_BYTES])
def test_words_have_equal_hashes_exactly_if_equal(monkeypatch, at_once):
    monkeypatch.setattr(substrings, "HASHED_BYTES", at_once)
    held = [*((t or "").encode() for _, t, _ in samples.documents()), b" ", b"a", b" a", b"a ", b"", b"a\x0bb\x0cc\rd\x1ce\xc2\xa0f", b""]
    kinds, seen = {}, {}
    for text, units in zip(held, substrings.word_units(held), strict=True):
        words = text.split()
        assert len(words) == len(units)
        for w, u in zip(words, units.tolist(), strict=True):
            assert kinds.setdefault(w, u) == u and seen.setdefault(u, w) == w
    assert substrings.word_units([]) == []


def test_ids_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    rows = samples.documents()
    assert ordered(substrings.dedup_words(samples.frame(spark, rows)).collect()) == ordered(words_left(rows, 50))


def batch(spark, i, more=""):
    return samples.frame(spark, [(i, f"{samples.prose(random.Random(i), 120)} {more}", None)])


def test_runs_merge_geometrically(spark):
    index = repeats.SegmentIndex(spark, substrings.rule_of(), fanout=2)
    for i in range(7):
        index.add(batch(spark, i))
    assert sorted(r.weight for r in index.runs) == [1, 2, 4]
    rows = index.runs[0].spans.unionByName(index.runs[1].spans).unionByName(index.runs[2].spans)
    assert rows.selectExpr("count(distinct least) AS n").first().n == 7
    assert rows.groupBy("core", "span").count().where("count > 1").isEmpty()


def test_an_index_is_taken_up_in_another_session(spark):
    rule, passage = substrings.rule_of(), samples.prose(random.Random(99), 80)
    index = repeats.SegmentIndex(spark, rule, fanout=2)
    for i in range(3):
        index.add(batch(spark, i, passage if i == 1 else ""))
    index.save()
    other = repeats.SegmentIndex.open(spark.newSession(), rule, index.folder)
    assert sorted(r.weight for r in other.runs) == [1, 2]
    whole, verify = other.add(batch(other.spark, 3, passage))
    assert {r.doc_id for r in whole.collect()} == {3} and {r.doc_id for r in verify.collect()} == {1, 3}
    other.save()
    assert sorted(r.weight for r in repeats.SegmentIndex.open(spark, rule, index.folder).runs) == [1, 1, 2]


def test_older_runs_are_not_shuffled(spark):
    """Joining a batch's run with an older one exchanges and sorts neither."""
    index = repeats.SegmentIndex(spark, substrings.rule_of(), fanout=9)
    index.add(batch(spark, 0)), index.add(batch(spark, 1))
    old, new = index.runs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (new.spans.join(old.spans, ["core", "span"], "left"), new.cores.join(old.cores, "core", "left")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_keep_columns_and_untouched_rows(spark):
    rows = samples.documents()
    df = samples.frame(spark, rows, extra=True)
    got = substrings.dedup_texts(df)
    assert got.columns == df.columns
    left = {(i, n, r, h) for i, n, r, h in words_left(rows, 50)}
    texts = {i: t for i, t, _ in rows}
    for r in got.collect():
        n = len((texts[r.doc_id] or "").encode().split())
        assert (r.doc_id, n, n - len((r.text or "").encode().split()), hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) in left
        if r.text != texts[r.doc_id]:
            assert len(r.text or "") < len(texts[r.doc_id])


def test_empty_tables(spark):
    assert substrings.dedup_words(samples.empty(spark)).count() == 0
    assert suffixes.dedup_bytes(samples.empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=150), min_size=1, max_size=6), st.sampled_from([(20, 2), (20, 5), (33, 9), (17, 1)]))
def test_equal_windows_share_core_and_equal_segments_have_equal_windows(docs, sizes):
    length, step = sizes
    sequences = [segments.mixed(np.array(d, np.uint64) + np.uint64(1)) if d else np.empty(0, np.uint64) for d in docs]
    s = segments.segments(sequences, length, step)
    core_of, windows_of = {}, {}
    for o, f, n, c, p in zip(s.owner, s.first, s.count, s.core, s.span, strict=True):
        own = [tuple(docs[o][f + i : f + i + length]) for i in range(n)]
        for w in own:
            assert core_of.setdefault(w, c) == c
        assert windows_of.setdefault((c, p), own) == own
    assert sum(s.count) == sum(max(len(d) - length + 1, 0) for d in docs)


def test_long_sequences_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_UNITS", 64)
    rng = np.random.default_rng(1)
    units = segments.mixed(rng.integers(1, 5, 1000).astype(np.uint64))
    s = segments.segments([units, units[:10], units[100:300]], 30, 5)
    starts = np.concatenate([np.arange(f, f + n) for o, f, n in zip(s.owner, s.first, s.count, strict=True) if o == 0])
    assert sorted(starts.tolist()) == list(range(971))


def test_widths_share_the_picked_grams():
    rng = random.Random(3)
    sequences = suffixes.byte_units([rng.randbytes(n) for n in (900, 199, 200, 0, 1500)] + [b"ab" * 400])
    for step, got in zip((128, 8), segments.segments_by_steps(sequences, 200, (128, 8)), strict=True):
        want = segments.segments(sequences, 200, step)
        for name in ("owner", "first", "count", "core", "span"):
            assert np.array_equal(getattr(got, name), getattr(want, name))


def test_texts_of_a_piece_are_worked_on_together(monkeypatch):
    """The passes over a piece don't grow in number with its texts; what goes is what goes text by text."""
    rng = random.Random(4)
    twice = rng.randbytes(300).hex()
    held = [f"{twice} {rng.randbytes(150).hex()} {twice if i % 3 == 0 else ''}" for i in range(60)]
    rule, s = repeats.Rule(suffixes.byte_units, 200, anywhere=True, steps=(128, 8)), []
    for text in held:
        (units,) = suffixes.byte_units([text.encode()])
        found = segments.segments([units], 200, 128)
        starts = np.arange(0, 100)
        a, b = (segments.Rolling(units, base).runs(starts, starts + 200) for base in (0, 1))
        s.append((list(zip(found.core[:1].view(np.int64).tolist(), found.span[:1].view(np.int64).tolist(), strict=True)), list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)), int(found.count[0])))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    whole, windows = ([None if i % k else [dict(a=a, b=b) for a, b in x[place]] for i, x in enumerate(s)] for k, place in ((2, 0), (5, 1)))
    part = pa.RecordBatch.from_arrays([pa.array(held), pa.array(whole, kind), pa.array(windows, kind)], ["text", "_packlens_whole", "_packlens_windows"])
    passes, made = [], segments.Rolling.__init__
    monkeypatch.setattr(segments.Rolling, "__init__", lambda self, *args: passes.append(1) or made(self, *args))
    got = list(repeats.gone_units(part, rule))
    assert len(passes) < 12
    for i, (text, gone) in enumerate(got):
        want = np.zeros(len(text), bool)
        if i % 2 == 0:
            want[: s[i][2] + 199] = True
        if i % 5 == 0:
            want[:299] = True
        if i % 3 == 0:
            want[:600] = want[-600:] = True
        assert text == held[i].encode() and np.array_equal(want, np.zeros(len(text), bool) if gone is None else gone), i

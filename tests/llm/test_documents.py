"""Operators 1, 2 and 5: one result per row, checked row by row."""

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from packlens.llm import bpe, digests, media

from . import samples


def test_edited_texts_and_digests(spark):
    got = digests.fingerprint_with_edits(samples.frame(spark, extra=True)).toPandas()
    rows = samples.documents()
    once = sorted({r[:2] for r in rows if r[0] != 10_001}, key=lambda r: -r[0])
    last = next(r for r in rows if r[0] == 10_001)
    order = [last, last, *once]
    want = []
    for (i, a, *_), (_, b, *_) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        want.append((i, len(a), hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()))
    assert sorted(want) == sorted(zip(got.doc_id, got.n_chars, got.edited_sha256, strict=True))
    assert got[["near_edited", "near_next"]].min().min() >= 0 and got[["near_edited", "near_next"]].max().max() <= 1
    by_text = {}
    for i, f in zip(got.doc_id, got.fingerprint, strict=True):
        assert by_text.setdefault(next(r[1] or "" for r in rows if r[0] == i), f) == f
    assert (got.near_next[got.doc_id == 10_001] == 1.0).any()
    apart = got[(got.doc_id < 120) & (got.n_chars > 200)]  # texts that have nothing to do with their next one
    assert (apart.near_edited > apart.near_next).mean() > 0.95


def slow_codes(text):
    """Quartile codes and length code of a text, from the definition."""
    data = text.encode()
    counts = [0] * 256
    for a, b, c, factor in digests.TRIPLETS:
        for i in range(len(data) - c):
            x = (data[i + a] << 16 | data[i + b] << 8 | data[i + c]) * factor % 2**32
            counts[(x ^ x >> 15) * 0x2C1B3C6D % 2**32 >> 24] += 1
    ordered = sorted(counts)
    return [sum(n > ordered[q] for q in (63, 127, 191)) for n in counts], min(255, round(12 * math.log2(len(data) + 1)))


def slow_digest(codes, length):
    return f"{length:02x}" + "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 256, 4))


def slow_likeness(a, b):
    return 1 - min(1, sum(abs(x - y) for x, y in zip(a[0], b[0], strict=True)) / (1.25 * 256) + min(abs(a[1] - b[1]), 96) / (32 * 12))


def test_digests_and_likeness_by_brute_force(spark):
    """Also with as many ranges as rows, where every pair meets at a seam."""
    rows = [r[:2] for r in samples.documents() if r[0] < 10_000 and len(r[1] or "") < 3000]
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        new = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y, z = slow_codes(a), slow_codes(new), slow_codes(b)
        want[i] = (slow_digest(*x), slow_digest(*y), pytest.approx(slow_likeness(x, y)), pytest.approx(slow_likeness(x, z)))
    df = samples.frame(spark, [(i, t, None) for i, t in rows])
    for parts in ("8", "150"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = digests.fingerprint_with_edits(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want


def test_digest_of_few_rows(spark):
    assert digests.fingerprint_with_edits(samples.empty(spark)).count() == 0
    one = digests.fingerprint_with_edits(samples.frame(spark, [(5, "abcdef", None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_triplet_counts_by_hand():
    docs = [b"abcabcabd", b"", b"xy", b"zzzz"]
    got = digests.bucket_counts(docs)
    for row, d in zip(got, docs, strict=True):
        want = Counter()
        for a, b, c, factor in digests.TRIPLETS:
            for i in range(len(d) - c):
                x = (d[i + a] << 16 | d[i + b] << 8 | d[i + c]) * factor % 2**32
                want[(x ^ x >> 15) * 0x2C1B3C6D % 2**32 >> 24] += 1
        assert {i: n for i, n in enumerate(row.tolist()) if n} == dict(want)
    codes = digests.quartile_codes([b"hello world, hello"])[0]
    assert (digests.read_digest(digests.write_digest(codes)) == codes).all()


def test_bpe_agrees_with_the_tokenizers_library(spark):
    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    got = Counter(map(tuple, bpe.bpe_round_trip(samples.frame(spark, extra=True), path).collect()))
    want = Counter()
    for i, t, _ in samples.documents():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    ids = {r.doc_id: r for r in bpe.bpe_tokens(samples.frame(spark), path).collect()}
    assert all(r.decodes and len(r.ids) == r.n_tokens for r in ids.values())
    assert bpe.bpe_round_trip(samples.empty(spark), path).count() == 0


def test_bpe_on_odd_characters():
    import random

    path = bpe.default_vocabulary()
    codec, library = bpe.Codec(open(path, "rb").read()), Tokenizer.from_file(path)
    rng = random.Random(1)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    docs = ["".join(chr(c) + rng.choice([" ", "a", "1", "'s", ""]) for c in rng.sample(every, 40)) for _ in range(300)]
    docs += ["".join(map(chr, list(codec.odd)[i : i + 50])) for i in range(0, 500, 50)]
    ids, counts = codec.encode(docs)
    for t, own in zip(docs, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(t, add_special_tokens=False).ids


def test_long_unbroken_words():
    """As the library has them, in a time that follows the length."""
    import random

    path = bpe.default_vocabulary()
    codec, library = bpe.Codec(open(path, "rb").read()), Tokenizer.from_file(path)
    rng = random.Random(2)
    words = ["".join(rng.choices(letters, k=n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 200_000), ("ab", 5_000), ("a", 4_001), ("etaoin", 2_001), ("äöé", 3_000))]
    words += [w[:1_990] for w in words]
    began = time.perf_counter()
    ids, counts = codec.encode(["x ".join([*words[:3], "short"]), *words])
    assert time.perf_counter() - began < 20
    for text, own in zip(["x ".join([*words[:3], "short"]), *words], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids


def test_media_hold_the_texts(spark):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_query(spark, samples.frame(spark, extra=True)).collect())
    want = Counter()
    for i, t, _ in samples.documents():
        data = (t or "").encode()
        n = len(data)
        while not data or len(data) % 192:
            data += b" "
        want[(i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))] += 1
    assert got == want
    assert media.media_query(spark, samples.empty(spark)).count() == 0


@pytest.mark.parametrize("kind", media.KINDS)
def test_sniffing_finds_corrects_and_carves(spark, kind):
    inner = media.WRITERS[kind](bytes(range(192)) * 2)
    outer = media.write_wav(b"BM P5\n RIFF" + inner + b"\x89PNG\r\n\x1a\n" * 20)
    broken = inner[:-1] if kind != "image/png" else inner[:-20] + b"x" * 20
    stored = spark.createDataFrame([(1, 0, "image/gif", bytearray(outer)), (2, 0, kind, bytearray(broken)), (3, 0, "x", None)], "doc_id long, n_bytes long, declared string, media binary")
    rows = {r.doc_id: r for r in media.read_media(stored).collect()}
    assert (rows[1].detected, rows[1].corrected, rows[1].embedded) == ("audio/wav", True, 1)
    assert rows[2].detected is None and rows[2].payload_bytes is None and rows[3].detected is None
    carved = [r for r in media.carve(stored).collect() if r.doc_id == 1]
    assert [(r.kind, bytes(r.content)) for r in carved] == [(kind, inner)]

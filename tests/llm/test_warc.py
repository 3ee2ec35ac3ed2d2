"""Operator 3: round trip, and salvage of damaged archives."""

import base64
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packlens.llm import warc
from packlens.llm.common import new_folder

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://a/5", "WARC/1.1\r\n\r\n" * 9), (6, "http://a/6", "é" * 70_000), (7, "http://a/7", "<p>x</p>"), (8, "http://a/8", "\x1f�\x08")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, path string")
    got = {r.page_id: tuple(r)[1:] for r in warc.archive_round_trip(pages.repartition(3)).collect()}
    first, want = {}, {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        origin = first.setdefault(data, i)
        want[i] = (len(data), digest, "response" if origin == i else "revisit", None if origin == i else origin)
    assert got == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_pages_without_an_id_and_with_one_id(spark, monkeypatch):
    """Every page has a row; both ways to join give the same."""
    rows = [(None, "u", "<p>x</p>"), (None, "u", "alone"), (None, "v", "alone"), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (4, "u", "other"), (9, "u", "<p>x</p>"), (9, "u", "other"), (9, "u", None), (None, "u", "")]
    want = sorted([(None, 8, "revisit", 4), (None, 5, "response", None), (None, 5, "response", None), (4, 8, "response", None), (4, 8, "response", None), (4, 5, "response", None), (9, 8, "revisit", 4), (9, 5, "revisit", 4), (9, 0, "response", None), (None, 0, "revisit", 9)], key=str)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for bound in (warc.BROADCAST_PAGES, 0):
        monkeypatch.setattr(warc, "BROADCAST_PAGES", bound)
        got = warc.archive_round_trip(pages).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want


def test_an_archive_that_lost_a_record_fails_the_round_trip(spark):
    folder = new_folder(spark, "short")
    listing = warc.write_archives(warc.original_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string")).coalesce(1), folder)
    told = spark.createDataFrame([(r.path, r.records + 1, r.bytes) for r in listing.collect()], "path string, records long, bytes long")
    with pytest.raises(Exception, match="of 9 records and 0 gaps"):
        warc.read_archives(told, folder, whole=True).collect()


def members(n=40):
    return [warc.member_of(warc.write_record(i, f"http://x/{i}", b"page %d " % i * (i * 17 % 400), None)) for i in range(n)]


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    return [x["page_id"] for k, x in found if k == "record"], [x for k, x in found if k == "gap"]


def test_later_records_survive_damage_and_gaps_are_logged():
    m = members()
    broken = list(m)
    broken[5] = broken[5][:30] + bytes(8) + broken[5][38:]
    broken[9] = broken[9][: len(broken[9]) // 2]
    broken[20] = b"junk" + broken[20]
    ids, gaps = read(b"".join(broken) + b"\x1f\x8b\x08 tail")
    assert ids == [i for i in range(40) if i not in (5, 9)]
    at = sum(map(len, broken[:5]))
    assert gaps[0] == (at, len(broken[5])) and gaps[-1][1] == 8
    assert sum(n for _, n in gaps) == len(broken[5]) + len(broken[9]) + 4 + 8


def test_plain_records_with_a_changed_byte():
    records = [warc.write_record(i, "u", b"x" * 10 * i, None) for i in range(12)]
    records[7] = records[7].replace(b"xxxx", b"xyxx", 1)
    ids, gaps = read(b"".join(records))
    assert ids == [i for i in range(12) if i != 7] and [n for _, n in gaps] == [len(records[7])]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_any_damage_costs_only_what_it_touches(data):
    m = members(12)
    whole = bytearray(b"".join(m))
    at = data.draw(st.integers(0, len(whole) - 1))
    whole[at] ^= data.draw(st.integers(1, 255))
    ends = [sum(map(len, m[: i + 1])) for i in range(12)]
    hurt = next(i for i, e in enumerate(ends) if at < e)
    ids, _ = read(bytes(whole))
    assert set(range(12)) - set(ids) <= {hurt} and ids == sorted(ids)


def test_gaps_come_out_of_the_reader(spark, tmp_path):
    folder = new_folder(spark, "damaged")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    listing = warc.write_archives(warc.original_pages(pages).coalesce(1), folder).collect()
    path = f"{folder.removeprefix('file://')}/{listing[0].path}"
    with open(path, "r+b") as f:
        f.seek(40)
        f.write(b"\0\0\0\0\0\0")
    rows = warc.read_archives(spark.createDataFrame([(listing[0].path,)], "path string"), folder).collect()
    assert sum(r.gap_bytes is None for r in rows) == len(PAGES) - 1
    assert [r.gap_offset for r in rows if r.gap_bytes] == [0]


def test_bad_lengths_are_no_records():
    assert warc.read_record(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") is None
    assert warc.read_record(b"WARC/1.1\r\n\r\n") is None


def test_records_of_a_shared_member_survive_damage_of_others():
    """Three records in a member: each in turn is damaged before it is packed, the first included."""
    for hurt in range(3):
        records = [warc.write_record(i, "u", b"payload %d " % i * 50, None) for i in range(3)]
        records[hurt] = records[hurt].replace(b"payload", b"paylord", 1)
        damaged, after = warc.member_of(b"".join(records)), warc.member_of(warc.write_record(9, "u", b"x", None))
        ids, gaps = read(damaged + after)
        assert ids == [i for i in range(3) if i != hurt] + [9] and gaps == [(0, len(damaged))]


def test_records_before_a_deflate_error_are_kept():
    rng = random.Random(1)
    member = bytearray(warc.member_of(b"".join(warc.write_record(i, "u", rng.randbytes(30_000), None) for i in range(6))))
    at = len(member) * 3 // 4
    for broken in (bytes(member[:at]), bytes(member[:at]) + b"\xff" * 3000, bytes(member[:-8]) + bytes(8)):
        ids, gaps = read(broken)
        assert ids[:4] == [0, 1, 2, 3] and ids == sorted(set(ids)) and gaps == [(0, len(broken))]


def record(kind, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + warc.END + block + warc.END


def test_records_of_other_writers_are_read():
    """No page ids, digests or HTTP lengths; a digest that is there still counts."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    wrong = f"WARC-Block-Digest: sha1:{warc.digest_of(b'other')}"
    data = [record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
            record("response", http, "X-Page-ID: none"), record("response", http, wrong), record("response", http, "WARC-Block-Digest: sha256:abc")]
    want = [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", b"<p>x</p>"), ("response", b"<p>x</p>")]
    for whole in (b"".join(data), b"".join(map(warc.member_of, data)), warc.member_of(b"".join(data))):
        found = [x for k, x in warc.salvage(io.BytesIO(whole)) if k == "record"]
        assert [(x["record_type"], x["payload"]) for x in found] == want
        assert all(x["page_id"] is None and x["payload_bytes"] == len(x["payload"]) and x["payload_digest"] == warc.digest_of(x["payload"]) for x in found)

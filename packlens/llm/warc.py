"""WARC archives: writing with revisits, and a salvage reader.

Pages are written as gzip members of ``.warc.gz`` archives in a shared folder.
The reader streams an archive member by member. Where a member or a record fails
its checks, it searches for the next valid gzip member or WARC version line, goes
on from there, and logs the bytes in between as a quarantined gap. In a member with
several records it searches the unpacked bytes, also of a member that is damaged
further on; places there are none in the archive, so the gap is the whole member,
even if it gave records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, slices, texts

#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 32_000_000
READ_BYTES = 1_000_000
#: Compressed bytes that are unpacked at once; of a damaged piece, what comes before the damage is unpacked again.
FEED_BYTES = 65_536
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
#: The last header of this writer's records: a digest of those before it, which a block's digest doesn't cover.
HEAD_DIGEST = b"\r\nX-Head-Digest: sha1:"
#: Profile of a revisit, and how record ids are named.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload: bytes = b"") -> str:
    """The name of a page's record; without an id it is told by the payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}' if page_id is not None else f'payload:{digest_of(payload)}')}>"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: the whole payload as a response, or a revisit of ``refers_to`` with HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, payload)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {one_line(url or 'urn:none')}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        block = http
    head += [f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    lines = "\r\n".join(head).encode()
    return lines + HEAD_DIGEST + digest_of(lines).encode() + END + block + END


def member_of(record: bytes) -> bytes:
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def number(value: str | None) -> int | None:
    """``value`` as a 64-bit integer; None if it is none."""
    return n if value and re.fullmatch(r"-?[0-9]{1,19}", value) and -(1 << 63) <= (n := int(value)) < 1 << 63 else None


def sha1_of(value: str | None) -> str | None:
    """The base 32 digits of a header's SHA-1; None without the header or for other digests, which aren't checked."""
    kind, _, digits = (value or "").partition(":")
    return digits.upper() if kind.lower() == "sha1" and len(digits) == 32 else None


def read_record(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """The record at ``at`` and where it ends; None if its version, lengths, digests or the headers that all records have don't hold.

    Digests, HTTP lengths and page ids are optional: what is absent isn't checked, and is null where it can't be told.
    """
    if data[at : at + len(VERSION)] != VERSION or (split := data.find(END, at)) < 0:
        return None
    lines, told, digits = data[at:split].partition(HEAD_DIGEST)
    if told and digits != digest_of(lines).encode():
        return None
    head = headers(lines)
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit() or not head.get("warc-type") or not head.get("warc-record-id"):
        return None
    start = split + len(END)
    end = start + int(length)
    if data[end : end + len(END)] != END:
        return None
    block, kind = data[start:end], head["warc-type"]
    block_digest = sha1_of(head.get("warc-block-digest"))
    if block_digest and block_digest != digest_of(block):
        return None
    http, payload, fields = b"", block, {}
    if head.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/"):
        http, _, payload = block.partition(END)
        fields = headers(http)
    size, digest = number(fields.get("content-length")), sha1_of(head.get("warc-payload-digest"))
    if kind == "response" and not {"transfer-encoding", "content-encoding"} & fields.keys() and "warc-truncated" not in head:
        if digest and digest != digest_of(payload) or not block_digest and size is not None and size != len(payload):
            return None
    whole = kind != "revisit"
    digest = digest or (head.get("warc-payload-digest") if not whole else digest_of(payload))
    return {"page_id": number(head.get("x-page-id")), "payload_bytes": len(payload) if whole else size, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("x-refers-to-page-id")), "payload": payload if whole else None}, end + len(END)


def records_of(data: bytes) -> tuple[list[dict], bool]:
    """The records in the unpacked bytes of a member, and whether all bytes are theirs; after damage it goes on at the next version line."""
    records, at, sound = [], 0, True
    while 0 <= at < len(data):
        if found := read_record(data, at):
            records.append(found[0])
            at = found[1]
        else:
            sound, at = False, data.find(VERSION, at + 1)
    return records, sound


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a folder, and its path there; Hadoop's name for S3 is understood."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class Window:
    """A forward view of a stream: ``data`` from ``start`` on is not yet consumed; ``at`` says where that is in the stream."""

    def __init__(self, stream) -> None:
        self.stream, self.data, self.start, self.at, self.done = stream, b"", 0, 0, False

    def __len__(self) -> int:
        return len(self.data) - self.start

    def more(self) -> bool:
        block = b"" if self.done else self.stream.read(READ_BYTES)
        self.done = not block
        if block:
            self.data, self.start = self.data[self.start :] + block, 0
        return bool(block)

    def drop(self, n: int) -> None:
        self.start, self.at = self.start + n, self.at + n

    def begins(self, mark: bytes) -> bool:
        return self.data.startswith(mark, self.start)

    def find(self, mark: bytes, skip: int = 0) -> int:
        """How far ahead ``mark`` is, at ``skip`` or later; -1 if it isn't in view."""
        return max(self.data.find(mark, self.start + skip) - self.start, -1)


def inflate(window: Window) -> tuple[bytes, int]:
    """What the gzip member at the window's start unpacks to, and its length; the length is 0 if it is damaged or cut off."""
    unpacker, out, fed = zlib.decompressobj(31), [], 0
    while True:
        while fed < len(window) and not unpacker.eof:
            at = window.start + fed
            part = window.data[at : at + FEED_BYTES]
            before = unpacker.copy()
            try:
                out.append(unpacker.decompress(part))
            except zlib.error:  # byte by byte up to the damage
                with contextlib.suppress(zlib.error):
                    for i in range(len(part)):
                        out.append(before.decompress(part[i : i + 1]))
                return b"".join(out), 0
            fed += len(part)
        if unpacker.eof:
            return b"".join(out), fed - len(unpacker.unused_data)
        if not window.more():
            return b"".join(out), 0


def plain(window: Window) -> tuple[dict, int] | None:
    """The uncompressed record at the window's start, and its length."""
    while True:
        if (found := read_record(window.data, window.start)) is not None:
            return found[0], found[1] - window.start
        split = window.find(END)
        length = headers(window.data[window.start : window.start + split]).get("content-length", "") if split >= 0 else ""
        if split >= 0 and (not length.isdigit() or len(window) >= split + 2 * len(END) + int(length)):
            return None
        if split < 0 and len(window) > READ_BYTES or not window.more():
            return None


def salvage(stream) -> Iterator[tuple[str, object]]:
    """("record", fields) and ("gap", (offset, bytes)) of a possibly damaged archive, in order."""
    window, bad_from = Window(stream), None

    def gap():
        nonlocal bad_from
        if bad_from is not None and window.at > bad_from:
            yield "gap", (bad_from, window.at - bad_from)
        bad_from = None

    while len(window) or window.more():
        if len(window) < len(VERSION):
            window.more()
        records, used = [], 0
        if window.begins(MEMBER):
            data, used = inflate(window)
            records, sound = records_of(data)
            if records and not (used and sound):
                yield from gap()
                yield from (("record", r) for r in records)
            if not (used and sound):
                bad_from = window.at if bad_from is None else bad_from
            if used and not sound:
                window.drop(used)
                continue
        elif window.begins(VERSION) and (found := plain(window)):
            records, used = [found[0]], found[1]
        if used:
            yield from gap()
            yield from (("record", r) for r in records)
            window.drop(used)
            continue
        if bad_from is None:
            bad_from = window.at
        skip = 1
        while True:
            hits = [i for i in (window.find(MEMBER, skip), window.find(VERSION, skip)) if i >= 0]
            if hits:
                window.drop(min(hits))
                break
            window.drop(max(skip, len(window) - len(VERSION) + 1) if len(window) >= len(VERSION) else 0)
            skip = 0
            if not window.more():
                window.drop(len(window))
                break
    yield from gap()


#: Pages that refer to others are broadcast up to this number (16 bytes each and their digest); more are joined by shuffling.
BROADCAST_PAGES = 500_000


def original_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``refers_to``: the least page_id of an equal payload, null for that page itself.

    Payloads are compared by SHA-1. The least ids are found on ids and digests
    alone; the pages themselves meet only what refers to others, by page_id, so a
    payload that very many pages have makes no task larger. A page without id
    refers to the least id of its payload; if there is none, it is itself a response.
    """
    payload = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    slim = materialize(pages.select(F.col("page_id").cast("long").alias("_id"), payload.alias("_key")), "page-keys")
    least = slim.groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_pages")).where("_pages > 1 and _first is not null").select("_key", "_first")
    least = materialize(least, "page-firsts")
    others = materialize(slim.join(least, "_key").where("_id is null or _id <> _first").distinct(), "page-references")
    if others.count() <= BROADCAST_PAGES:
        others = F.broadcast(others)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", payload.alias("_digest"))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_key"))
    return keyed.join(others, same, "left").select("page_id", "url", "html", F.col("_first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to)`` as archives in ``folder``; ``path, records, bytes`` of each.

    An archive gets its name only when it is complete, and only archives that a
    finished task reports are read; a task that runs again writes other files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root)
        path, sink, records, size = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            store.move(path + ".open", path)
            return pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for part in slices(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
                for page_id, url, refers_to, html in zip(*columns, texts(part.column("html")), strict=True):
                    if sink is None:
                        path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = store.open_output_stream(path + ".open", compression=None)
                    member = member_of(write_record(page_id, url, html, refers_to))
                    sink.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        sink = None
        if sink is not None:
            yield closed()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True, whole: bool = False) -> DataFrame:
    """Records and gaps of ``archives(path)`` in ``folder``: RECORD columns, path, gap_offset and gap_bytes.

    A row is a record (gap columns null) or a quarantined gap (record columns null).
    Archives are streamed in blocks, so memory is bounded by the largest record.
    ``whole``: each archive must give as many records as column ``records`` says,
    without a gap; otherwise the job fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*names, "path", "gap_offset", "gap_bytes"])

        for batch in batches:
            wanted = batch.column("records").to_pylist() if whole else [None] * batch.num_rows
            for path, expected in zip(batch.column("path").to_pylist(), wanted, strict=True):
                rows, held, read, gaps = [], 0, 0, 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for kind, x in salvage(stream):
                        read, gaps = read + (kind == "record"), gaps + (kind == "gap")
                        if kind == "gap":
                            rows.append((None,) * 6 + (path, *x))
                        else:
                            rows.append((*(x[n] for n in names[:5]), x["payload"] if payloads else None, path, None, None))
                            held += len(rows[-1][5] or b"")
                        if len(rows) >= 2000 or held > READ_BYTES:
                            yield rows_of(rows)
                            rows, held = [], 0
                if rows:
                    yield rows_of(rows)
                if whole and (gaps or read != expected):
                    raise ValueError(f"{path}: {read} of {expected} records and {gaps} gaps")

    return archives.select("path", *["records"] * whole).mapInArrow(run, RECORD + ", path string, gap_offset long, gap_bytes long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` as WARC records in the shared folder and read the archives back.

    Gives page_id, payload_bytes, payload_digest (of the full payload), record_type
    and refers_to, a row for each page. A null html is an empty payload; empty
    payloads equal each other. A page without page_id has a record without one, a
    revisit if a page with an id has its payload. Rows that repeat a page_id are
    each written; of one payload they are responses alike if theirs is the least
    id. An empty table gives no rows. A record that doesn't come back fails the job.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    listing = f"{folder}/_listing"
    write_archives(original_pages(pages), folder).write.parquet(listing)
    archives = spark.read.schema("path string, records long, bytes long").parquet(listing)
    spread = archives.repartition(spark.sparkContext.defaultParallelism * 4)
    return read_archives(spread, folder, payloads=False, whole=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``archive_round_trip`` of all pages; its docstring states what null, empty and repeated rows give."""
    return archive_round_trip(pages)

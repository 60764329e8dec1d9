"""WARC archives with a two-level capture index.

Pages are written as WARC 1.1 records, each its own gzip member. Of equal payloads
of at least ``least`` bytes the one with the largest page_id is stored as a response
and the others as revisits, whose block is the HTTP head alone.

The index: captures sorted by their reversed-host key are cut into blocks, each
compressed on its own. Behind its blocks an index file has its part of the sparse
directory, a line a block (first and last key, and where it lies), and the table that
``write_index`` returns has a row for each part. A lookup searches these rows, then
reads a part's range and searches it, then reads a block's range and searches that, and
reads the records' ranges. ``archive_report`` reads every page back that way.

At scale: archives and index files are written by the tasks, into the shared folder, in
files named by task attempt; only what a committed task reported is ever read, so lost
executors and repeated tasks leave no wrong rows. Equal payloads meet by digest (no
payload is shuffled unless Spark must join very many groups). The index is sorted by
range on (key, page_id), so a URL captured very often is split over blocks and files.
There are ``MOST_RANGES`` index files at most, whatever the input, so that the rows a
task searches first are as few. Looked-up URLs are sorted by key, so that tasks read a
stretch of the directory, and what they find is dealt by block: no task reads all the
captures of a URL.

Defined cases: a null html is an empty payload; a null url has the key of the empty
string; a null page_id is written as null, and is a revisit if its payload has a
response with an id; rows that share the largest page_id of a group are all
responses; an empty table gives an empty table; further columns are ignored. URLs are
stored as they are, but for characters that a URI can't have, which are escaped; a
record's id is made of its page_id, URL and payload, so equal rows have equal ids. Pages
have no time of capture: all records bear ``DATE``.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, small_batches, small_side, written

LEAST = 1000
BLOCK_LINES = 1000
LEVEL = 3
BROADCAST_GROUPS = 100_000
#: Captures to one range of the sorted index, and how many ranges there are at most.
RANGE_ROWS = 250_000
MOST_RANGES = 20_000
#: Parts of the directory that a task holds at a time.
HELD_PARTS = 64
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://a.example.org/x -> org,example,a)/x. White space and controls are escaped."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = ",".join(reversed(rest[:cut].lower().split("."))) if rest[:cut] else ""
    return stored_uri(f"{host}){rest[cut:]}" if url else "")


def stored_uri(url: str | None) -> str:
    """The URL with what a URI can't have escaped; escapes stay as they are."""
    return quote(url or "", safe="!$&'()*+,-./:;=?@_~#[]%")


def _name(page_id: int | None, url: str | None, digest: bytes) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{hashlib.sha1(stored_uri(url).encode() + digest).hexdigest()[:16]}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC record, not compressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_name(page_id, url, digest)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", stored_uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[3:3] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_name(refers_to, refers_url, digest)}>"),
            ("WARC-Refers-To-Target-URI", stored_uri(refers_url)),
            ("WARC-Refers-To-Date", DATE),
        ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (lower-case names), and the payload that is stored."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def _page_id(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _task_file(kind: str) -> str:
    at = TaskContext.get()
    return f"{kind}-{at.partitionId():06d}-{at.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, and for revisits the page_id and url that they refer to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(payload)))
    groups = written(rows.where("digest is not null").groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(small_side(groups, BROADCAST_GROUPS), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("target.page_id")), F.col("target"))
    return joined.select("page_id", "url", "html", refers["page_id"].alias("refers_to"), refers["url"].alias("refers_url"))


def write_archives(pages: DataFrame, uri: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the archives under ``uri``; the captures: key, page_id, file, offset, length."""
    root = (uri or shared_dir(pages.sparkSession)).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _folder(root)
        system.create_dir(folder, recursive=True)
        name, out, at = _task_file("archive") + ".warc.gz", None, 0
        for batch in small_batches(batches, 2):
            rows = []
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = html.encode()
                data = gzip.compress(record_bytes(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to, refers_url), LEVEL, mtime=0)
                out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                rows.append((url_key(url), page_id, f"{root}/{name}", at, len(data)))
                at += len(data)
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return written(marked(pages, least).mapInArrow(run, "key string, page_id long, file string, offset long, length long"))


def _packed(lines: list[tuple]) -> bytes:
    return zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)


def write_index(captures: DataFrame, uri: str | None = None, block_lines: int = BLOCK_LINES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write blocks and directory; a row for each part of the directory: first, last (keys), file, offset, length, blocks, lines."""
    root = (uri or shared_dir(captures.sparkSession)).rstrip("/")
    ranges = min(MOST_RANGES, max(-(-captures.count() // range_rows), int(captures.sparkSession.sparkContext.defaultParallelism)))
    ordered = captures.repartitionByRange(ranges, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _folder(root)
        system.create_dir(folder, recursive=True)
        name, out, at, lines, blocks, n = _task_file("index") + ".cdx.z", None, 0, [], [], 0

        def flush() -> None:
            nonlocal out, at, lines, n
            data = _packed(lines)
            out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
            out.write(data)
            blocks.append((lines[0][0], lines[-1][0], at, len(data)))
            at, n, lines = at + len(data), n + len(lines), []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                lines.append(row)
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        rows = []
        if out:
            part = _packed(blocks)
            out.write(part)
            out.close()
            rows = [(blocks[0][0], blocks[-1][1], f"{root}/{name}", at, len(part), len(blocks), n)]
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["first", "last", "file", "offset", "length", "blocks", "lines"])

    return written(ordered.mapInArrow(run, "first string, last string, file string, offset long, length long, blocks long, lines long"))


class Reader:
    """Range reads from files of the shared folder."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= 64:
                self.open.popitem()[1].close()
            system, path = _folder(uri)
            self.open[uri] = system.open_input_file(path)
        return self.open[uri].read_at(length, offset)

    def directory(self, file: str, offset: int, length: int) -> list[tuple[str, str, int, int]]:
        """first and last key, offset, length of a file's blocks."""
        rows = (x.split("\t") for x in zlib.decompress(self.read(file, offset, length)).decode().split("\n"))
        return [(a, b, int(o), int(n)) for a, b, o, n in rows]

    def block(self, file: str, offset: int, length: int) -> list[tuple[str, str, str, int, int]]:
        """key, page_id, file, offset, length of a block's captures."""
        rows = (x.split("\t") for x in zlib.decompress(self.read(file, offset, length)).decode().split("\n"))
        return [(k, p, f, int(o), int(n)) for k, p, f, o, n in rows]

    def record(self, file: str, offset: int, length: int):
        return parse_record(zlib.decompress(self.read(file, offset, length), 31))


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _row(fields: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError("a payload doesn't match its digest")
    refers_to = _page_id(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page_id(fields["warc-record-id"]), fields["warc-target-uri"], int(http["content-length"]), digest.hex(), kind, refers_to


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _RECORD.split(", ")])


def _found_blocks(uris: DataFrame, directory: DataFrame) -> DataFrame:
    """(file, offset, length, key, uri): the index blocks that may hold a URI's captures, by binary search."""
    spark: SparkSession = uris.sparkSession
    parts = sorted(tuple(r) for r in directory.select("first", "last", "file", "offset", "length").collect())  # MOST_RANGES at most
    shared = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tops = Reader(), shared.value
        lasts = [p[1] for p in tops]
        held: dict[int, tuple[list, list]] = {}

        def blocks_of(number: int) -> tuple[list, list]:
            if number not in held:
                if len(held) >= HELD_PARTS:
                    held.pop(next(iter(held)))
                own = reader.directory(*tops[number][2:])
                held[number] = own, [b[1] for b in own]
            return held[number]

        for batch in batches:
            out = []
            for key, uri in zip(*(batch.column(i).to_pylist() for i in range(2))):
                part = bisect.bisect_left(lasts, key)
                while part < len(tops) and tops[part][0] <= key:
                    blocks, ends = blocks_of(part)
                    at = bisect.bisect_left(ends, key)
                    while at < len(blocks) and blocks[at][0] <= key:
                        out.append((tops[part][2], blocks[at][2], blocks[at][3], key, uri))
                        at += 1
                    part += 1
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "offset", "length", "key", "uri"])

    return uris.mapInArrow(run, "file string, offset long, length long, key string, uri string")


def lookup(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """Every capture of each distinct ``url``: page_id, url (as stored), payload_bytes, payload_digest, record_type, refers_to."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, own), pa.string()), pa.array(map(stored_uri, own), pa.string())], names=["key", "uri"])

    tasks = max(1, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = urls.select("url").distinct().mapInArrow(keyed, "key string, uri string").distinct()
    ordered = distinct.repartitionByRange(tasks, "key", "uri").sortWithinPartitions("key", "uri")
    dealt = _found_blocks(ordered, directory).repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, captures, keys = Reader(), None, [], []
        for batch in batches:
            wanted: list[tuple] = []
            for file, offset, length, key, uri in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (file, offset) != last:
                    last, captures = (file, offset), reader.block(file, offset, length)
                    keys = [c[0] for c in captures]
                wanted += [(*c[2:], uri) for c in captures[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            wanted.sort()
            for a in range(0, len(wanted), 1000):
                read = ((_row(*reader.record(file, offset, length)), uri) for file, offset, length, uri in wanted[a : a + 1000])
                yield _batch([row for row, uri in read if row[1] == uri])

    return dealt.mapInArrow(run, _RECORD)


def archive_report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, index, and look every page's URL up: a row for each page."""
    directory = write_index(write_archives(pages, least=least))
    return lookup(pages, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

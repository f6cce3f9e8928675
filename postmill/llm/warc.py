"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.batches import pieces
from postmill.llm.shipping import ship
from postmill.session import shared_dir

# Bytes of an archive after which a task starts the next one.
ARCHIVE_BYTES = 1 << 30
# Captures per compressed index block.
BLOCK_LINES = 2000
# Neighbouring records are read together up to this size.
READ_BYTES = 4 << 20
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Store:
    """Files below one folder that all machines see: written whole, read by ranges."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.open_files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def create(self, name: str) -> pa.NativeFile:
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(path, compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.open_files.pop(name, None) or self.fs.open_input_file(f"{self.root}/{name}")
        self.open_files[name] = file
        if len(self.open_files) > 32:
            self.open_files.popitem(last=False)[1].close()
        return file.read_at(length, offset)


def clean(url: str) -> str:
    """The url with blanks and control characters percent-encoded, so that it fits a header line and an index line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def key_of(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``. Null and urls without ``://`` keep their text."""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", clean(url or ""))
    if not m:
        return clean(url or "")
    host = m[1].rpartition("@")[2].lower()
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'page:{page}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str] | None, date: str) -> bytes:
    """One record as a gzip member of its own; ``refers_to`` is the page_id and url of the response with this payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}"]
    if page_id is None:
        head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    else:
        head += [f"WARC-Record-ID: {record_id(str(page_id))}", f"X-Page-ID: {page_id}"]
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
             "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to[0]))}",
                 f"X-Refers-To-Page-ID: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder, and one line per index file.

    A line has the first and the last (key, page) of the file, its name, and the place and size of its directory.
    """

    root: str
    files: tuple[tuple[str, int, str, int, str, int, int], ...]


# The page of a capture without a page_id in the order of captures.
NO_PAGE = -1 << 63


def place_of(capture: list | tuple) -> tuple[str, int]:
    """(key, page) of an index line, by which captures are sorted."""
    return capture[0], NO_PAGE if capture[1] is None else capture[1]


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and for revisits the page_id and url of the response with the same payload.

    Of rows with equal payloads of ``least_bytes`` or more the one with the smallest page_id is the response. Only hashes
    and ids are grouped; payloads that occur once meet no partner, and the runtime splits the rows of a frequent one.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2(F.col("html"), 256))
    big = F.octet_length("html") >= least_bytes
    firsts = rows.filter(big & F.col("page_id").isNotNull()) \
        .groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    # A group of one can hold further rows only if their page_id is null.
    joined = rows.join(firsts.select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
                       "sha", "left")
    revisit = big & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("first_id"),
                         F.when(revisit, F.coalesce("first_url", F.lit(""))).alias("first_url"))


def write(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
          archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Writes a record per row of ``pages`` and the index of all records below ``root``, a folder all machines see.

    Tasks write archives under names of their own and report their records; only the reports of finished tasks
    count, so that a lost or repeated task leaves a file that nothing refers to. The reports are sorted by
    key into one index file per range: compressed blocks of ``block_lines`` captures, then the file's directory, a line
    per block. The driver learns one line per index file. Null html is an empty payload; null urls have the key "".
    """
    spark = pages.sparkSession
    ship(spark)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = Store(root), None, "", 0
        for part in pieces(batches, "html"):
            rows = []
            for page_id, url, html, first_id, first_url in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.create(name)
                refers = None if first_id is None else (first_id, clean(first_url))
                data = record(page_id, url, html.encode(), refers, date)
                out.write(data)
                rows.append((key_of(url), page_id, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
        if out:
            out.close()

    captures = f"{root}/captures"
    decided(pages, least_bytes).mapInArrow(archives, SCHEMA).write.parquet(captures)
    table = spark.read.schema(SCHEMA).parquet(captures)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = Store(root), None, f"index/{uuid.uuid4().hex}.idx", 0
        held: list[tuple] = []
        directory: list[list] = []

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
            directory.append([*place_of(held[0]), *place_of(held[-1]), at, len(data)])
            out.write(data)
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store.create(name)
                held.append(row)
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if out:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(FILE_NAMES, (*directory[0][:2], *directory[-1][2:4], name, at, len(data)),
                                                       strict=True))])

    # By page within a key, and by place within a page, so that one key with many captures is spread over ranges.
    order = ["key", "page_id", "archive", "at"]
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ranged.mapInArrow(index, FILE)
    parts = f"{root}/files"
    found.write.parquet(parts)
    rows = spark.read.schema(found.schema).parquet(parts).collect()
    return Archive(root, tuple(sorted(tuple(r) for r in rows)))


SCHEMA = "key string, page_id long, archive string, at long, size long"
NAMES = ["key", "page_id", "archive", "at", "size"]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
FILE = "first string, first_page long, last string, last_page long, name string, at long, size long"
FILE_NAMES = [column.split()[0] for column in FILE.split(", ")]


class Reader:
    """Finds captures by key and page: the index file, its block and the line by binary search, then ranges are read."""

    def __init__(self, archive: Archive) -> None:
        self.store, self.files = Store(archive.root), archive.files
        self.lasts = [f[2:4] for f in archive.files]
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.blocks: OrderedDict[tuple, list] = OrderedDict()

    def directory(self, name: str, at: int, size: int) -> list:
        if name not in self.directories:
            self.directories[name] = json.loads(zlib.decompress(self.store.read(name, at, size)))
            if len(self.directories) > 16:
                self.directories.popitem(last=False)
        return self.directories[name]

    def block(self, name: str, at: int, size: int) -> list:
        if (name, at) not in self.blocks:
            self.blocks[name, at] = [json.loads(line) for line in zlib.decompress(self.store.read(name, at, size)).split(b"\n")]
            if len(self.blocks) > 16:
                self.blocks.popitem(last=False)
        return self.blocks[name, at]

    def find(self, key: str, page: int | None = None) -> Iterator[list]:
        """All captures of ``key``, or those of the page alone, over as many blocks and index files as they fill."""
        low, high = (key, NO_PAGE if page is None else page), (key, math.inf if page is None else page)
        for first, first_page, _, _, name, at, size in self.files[bisect.bisect_left(self.lasts, low):]:
            if (first, first_page) > high:
                return
            directory = self.directory(name, at, size)
            for *ends, offset, length in directory[bisect.bisect_left(directory, low, key=lambda d: (d[2], d[3])):]:
                if (ends[0], ends[1]) > high:
                    break
                lines = self.block(name, offset, length)
                for line in lines[bisect.bisect_left(lines, low, key=place_of):]:
                    if place_of(line) > high:
                        break
                    yield line

    def record(self, capture: list) -> tuple[dict[str, str], bytes]:
        return parse(self.store.read(*capture[2:5]))


def captures(spark: SparkSession, archive: Archive) -> DataFrame:
    """All captures (SCHEMA), read from the blocks of the index files."""
    ship(spark)
    rows = spark.createDataFrame(archive.files, FILE)
    rows = rows.repartition(max(1, len(archive.files)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for batch in batches:
            for row in batch.to_pylist():
                for *_, at, size in reader.directory(row["name"], row["at"], row["size"]):
                    lines = reader.block(row["name"], at, size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*lines, strict=True), KINDS, strict=True)], NAMES)

    return rows.mapInArrow(run, SCHEMA)


READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary")


def read(spark: SparkSession, archive: Archive, payloads: bool = True) -> DataFrame:
    """READ per record of the archive, in no order; payload is null unless asked for.

    Captures come from the index and are put into the order of the archives, so that neighbours are read with one range.
    A revisit's payload is that of the record it refers to, which is looked up by its url and page; both the size and the digest
    are those of the bytes read. A record whose payload does not have the digest of its header ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        originals: OrderedDict[str, bytes] = OrderedDict()

        def original(headers: dict[str, str]) -> bytes:
            wanted = headers["warc-refers-to"]
            if wanted not in originals:
                # Equal page_ids may stand on one url, of which one is the response.
                for capture in reader.find(key_of(headers["warc-refers-to-target-uri"]), int(headers["x-refers-to-page-id"])):
                    found, payload = reader.record(capture)
                    if found["warc-type"] == "response" and found["warc-payload-digest"] == headers["warc-payload-digest"]:
                        originals[wanted] = payload
                        break
                if len(originals) > 64:
                    originals.popitem(last=False)
            return originals[wanted]

        def rows(group: list[tuple[str, int, int]]) -> Iterator[tuple]:
            if not group:
                return
            name, start, _ = group[0]
            data = reader.store.read(name, start, group[-1][1] + group[-1][2] - start)
            for _, at, size in group:
                headers, payload = parse(data[at - start:at - start + size])
                revisit = headers["warc-type"] == "revisit"
                payload = original(headers) if revisit else payload
                digest = digest_of(payload)
                if headers["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                yield (None if page is None else int(page), headers.get("warc-target-uri"), len(payload), digest,
                       headers["warc-type"], None if refers is None else int(refers), payload if payloads else None)

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), READ_KINDS, strict=True)],
                                              READ_NAMES)

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for capture in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "size")), strict=True):
                if group and (capture[0] != group[0][0] or capture[1] != group[-1][1] + group[-1][2]
                              or capture[1] + capture[2] - group[0][1] > READ_BYTES):
                    yield out(list(rows(group)))
                    group = []
                group.append(capture)
        if group:
            yield out(list(rows(group)))

    ordered = captures(spark, archive).repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    return ordered.mapInArrow(run, READ)


READ_NAMES = [column.split()[0] for column in READ.split(", ")]
READ_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def lookup(urls: DataFrame, archive: Archive) -> DataFrame:
    """(url, page_id, archive, at, size) of all captures of each url of ``urls``; urls without a capture give no row."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for batch in batches:
            found = [(url, *capture[1:]) for url in batch.column("url").to_pylist() for capture in reader.find(key_of(url))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), KINDS, strict=True)], ["url", *NAMES[1:]])

    return urls.select("url").mapInArrow(run, "url string, page_id long, archive string, at long, size long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written to a new archive in the session's shared folder and read back, without the payloads."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    return read(spark, write(pages, root, least_bytes), payloads=False).drop("payload", "url")

"""Token ids as length-delimited binary records with an offset index.

A data file is a row of frames: payload length (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of
the payload (u32), all little-endian. A payload is flags (1: has a doc_id, 2: wide ids), the doc_id (i64) and the ids (u16
each, or u32 if the vocabulary has more ids than that). The index file beside it has sixteen bytes per record: the frame's offset and the ids before it in the file.
``dataset.json`` names the files in order, with the ids before each.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.batches import pieces, texts
from postmill.llm.shipping import ship
from postmill.llm.warc import Store
from postmill.session import shared_dir, shuffle_width

# Bytes of a data file after which a task starts the next one; records that a reading task takes at a time.
FILE_BYTES = 256 << 20
SLICE = 2048
# Neighbouring frames are read together up to this size.
READ_BYTES = 4 << 20
# Chunks whose ids a worker remembers, and their greatest size; beyond the number it keeps those of the texts at hand.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64
# What special tokens of the vocabulary begin with.
SPECIAL = b"<|"
# Marks behind a letter or digit that are a pre-token of their own.
MARKS = b".,;:!?)\""
# Chunks that the library gets as one text, and the token that is put between them.
TOGETHER = 512
BETWEEN = b"\x01"
# Bytes of texts that are encoded together.
PIECE_BYTES = 8 << 20
# Bytes of a text that are cut into chunks at a time.
PART_BYTES = 1 << 20
END_ID = 2

_HEAD, _ENTRY, _ID = struct.Struct("<QI"), struct.Struct("<QQ"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted by a constant, so that data that hold their own checksums are safe to sum."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """A record of ids of ``width`` bytes each."""
    payload = _ID.pack((doc_id is not None) | (2 if width == 4 else 0), doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def entry(offset: int, before: int) -> bytes:
    return _ENTRY.pack(offset, before)


def widened(ids: bytes | memoryview, width: int) -> bytes:
    """Ids of ``width`` bytes as little-endian u32."""
    return bytes(ids) if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def unframe(data: memoryview, at: int = 0) -> tuple[int | None, bytes, int]:
    """(doc_id, ids as u32, place after the frame); a wrong checksum or a cut frame raises."""
    size, check = _HEAD.unpack_from(data, at)
    if masked(data[at:at + 8]) != check:
        raise ValueError(f"length of the record at {at} does not have its checksum")
    body = data[at + _HEAD.size:at + _HEAD.size + size]
    end = at + _HEAD.size + size + 4
    if end > len(data) or masked(body) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError(f"record at {at} does not have its checksum")
    flags, doc_id = _ID.unpack_from(body)
    return doc_id if flags & 1 else None, widened(body[_ID.size:], 4 if flags & 2 else 2), end


def stem_of(chunk: bytes) -> tuple[bytes, bytes]:
    """(stem, marks) whose ids one after another are those of the chunk.

    Marks behind an ASCII letter or digit start a pre-token. Chunks that may hold a special token stay as they are.
    """
    stem = chunk.rstrip(MARKS)
    if SPECIAL in chunk or not stem[-1:].isalnum():
        return chunk, b""
    return stem, chunk[len(stem):]


class Encoder:
    """Text -> ids by the tokenizers library, as little-endian numbers of ``width`` bytes.

    The vocabulary drops white space and no token spans it, so that what stands between ASCII blanks is encoded by
    itself, and frequent chunks once per worker. New stems go to the library many at a time, as one text with a token
    between them that none of them holds.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        (self.between,) = self.whole(BETWEEN)

    def whole(self, raw: bytes) -> list[int]:
        return self.library.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids

    def learn(self, chunks: set[bytes]) -> list[bytes]:
        """Puts the ids of all ``chunks``, and of their stems and marks, into ``known``; the new ones too long to be kept."""
        if len(self.known) > REMEMBERED:
            self.known = {c: self.known[c] for c in chunks.intersection(self.known)}
        known, made = self.known, []
        new, wanted = chunks.difference(known), set()
        for chunk in new:
            if not chunk.isalpha():
                stem, marks = stem_of(chunk)
                if stem != chunk:
                    made.append(chunk)
                    wanted.add(marks)
                    wanted.add(stem)
                    continue
            wanted.add(chunk)
        asked = wanted.difference(known)
        self.ask(list(asked))
        for chunk in made:
            stem, marks = stem_of(chunk)
            known[chunk] = known[stem] + known[marks]
        return [c for c in new | asked if len(c) > REMEMBERED_BYTES]

    def ask(self, chunks: list[bytes]) -> None:
        odd = [c for c in chunks if BETWEEN in c]
        for chunk in odd:
            self.known[chunk] = np.array(self.whole(chunk), dtype=self.kind).tobytes()
        plain = [c for c in chunks if BETWEEN not in c] if odd else chunks
        for at in range(0, len(plain), TOGETHER):
            some = plain[at:at + TOGETHER]
            ids = np.array(self.whole((b" " + BETWEEN + b" ").join(some)), dtype=self.kind)
            ends = np.append(np.nonzero(ids == self.between)[0], len(ids)) * self.width
            data = ids.tobytes()
            start = 0
            for chunk, end in zip(some, ends.tolist(), strict=True):
                self.known[chunk] = data[start:end]
                start = end + self.width

    def ids(self, raws: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, the texts being small together."""
        # The vocabulary lower-cases; a special token, which is known as it is written, has a mark that few texts hold.
        split = [(raw if SPECIAL in raw else raw.lower()).split() for raw in raws]
        long = self.learn(set(itertools.chain.from_iterable(split)))
        for parts in split:
            yield b"".join(map(self.known.__getitem__, parts))
        for chunk in long:
            del self.known[chunk]

    def encode(self, raws: list[bytes]) -> Iterator[bytes]:
        """As ``ids``, but long texts are taken part by part, cut where a blank stands."""
        short: list[bytes] = []
        for raw in raws:
            if len(raw) <= PART_BYTES:
                short.append(raw)
                continue
            yield from self.ids(short)
            short = []
            yield b"".join(i for part in _parts(raw) for i in self.ids([part]))
        yield from self.ids(short)


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        if end < len(raw):
            found = [p for p in (raw.find(bytes([b]), end) for b in b" \t\n\r\x0b\x0c") if p >= 0]
            end = min(found, default=len(raw))
        yield raw[at:end]
        at = end


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it remembers chunks from task to task."""
    return Encoder(path)


@dataclass(frozen=True)
class Dataset:
    """Written records: their folder, and per data file, in order: name, records, ids, bytes, ids in the files before."""

    root: str
    files: tuple[tuple[str, int, int, int, int], ...]


REPORT = "part int, number int, name string, records long, ids long, bytes long"


def write(docs: DataFrame, root: str, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> Dataset:
    """Encodes ``docs`` (doc_id, text) and writes a record per row below ``root``, a folder all machines see.

    Records ascend by doc_id over all files; rows without one come first, equal doc_ids are ordered by their texts'
    hashes. A task sorts a range of doc_ids and writes files under names of its own; only files that a finished task reports
    are part of the dataset. ``end_id`` closes each record's ids; a null text has no other.
    """
    spark = docs.sparkSession
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, encode, part = Store(root), encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encode.kind).tobytes()
        done: list[dict] = []
        out = index = None
        n = ids = at = 0

        def close() -> None:
            nonlocal out, index, n, ids, at
            if out:
                out.close()
                index.close()
                done.append({"part": part, "number": len(done), "name": name, "records": n, "ids": ids, "bytes": at})
            out, n, ids, at = None, 0, 0, 0

        for some in pieces(batches, "text", PIECE_BYTES):
            raws = [(t or "").encode() for t in some.column("text").to_pylist()]
            for doc_id, found in zip(some.column("doc_id").to_pylist(), encode.encode(raws), strict=True):
                if out and at >= file_bytes:
                    close()
                if not out:
                    name = uuid.uuid4().hex
                    out, index = store.create(f"data/{name}.rec"), store.create(f"data/{name}.idx")
                found += end
                data = frame(doc_id, found, encode.width)
                out.write(data)
                index.write(entry(at, ids))
                n, ids, at = n + 1, ids + len(found) // encode.width, at + len(data)
        close()
        yield pa.RecordBatch.from_pylist(done, REPORT_SCHEMA)

    # Equal texts of one doc_id are the same record; the salt lets very many of them fill several ranges.
    keys = ["doc_id", "_hash", "_salt"]
    rows = texts(docs).withColumn("_hash", F.xxhash64("text")).withColumn("_salt", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    reports = f"{root}/reports"
    ranged.mapInArrow(run, REPORT).write.parquet(reports)
    # One row per file.
    files, before = [], 0
    for r in spark.read.schema(REPORT).parquet(reports).orderBy("part", "number").collect():
        files.append((r["name"], r["records"], r["ids"], r["bytes"], before))
        before += r["ids"]
    with Store(root).create("dataset.json") as out:
        out.write(json.dumps(files).encode())
    return Dataset(root, tuple(files))


REPORT_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("records", pa.int64()),
                           ("ids", pa.int64()), ("bytes", pa.int64())])


def opened(root: str) -> Dataset:
    """A dataset that was written below ``root``."""
    store = Store(root)
    size = store.fs.get_file_info(f"{store.root}/dataset.json").size
    return Dataset(root, tuple(map(tuple, json.loads(store.read("dataset.json", 0, size)))))


class Reader:
    """Reads frames of a dataset's files by the places in their index."""

    def __init__(self, root: str) -> None:
        self.store = Store(root)

    def entries(self, name: str, low: int, high: int, records: int, size: int) -> list[tuple[int, int]]:
        """(offset, ids before it in the file) of the records low to high, and the offset after the last."""
        data = self.store.read(f"data/{name}.idx", low * _ENTRY.size, (min(high + 1, records) - low) * _ENTRY.size)
        return [*_ENTRY.iter_unpack(data), *([(size, 0)] if high == records else [])]

    def records(self, name: str, entries: list[tuple[int, int]]) -> Iterator[tuple[int | None, bytes, int]]:
        """(doc_id, ids, ids before it in the file) of each entry but the last, neighbours read together."""
        first = 0
        while first < len(entries) - 1:
            last = first + 1
            while last < len(entries) - 1 and entries[last + 1][0] - entries[first][0] <= READ_BYTES:
                last += 1
            data = memoryview(self.store.read(f"data/{name}.rec", entries[first][0], entries[last][0] - entries[first][0]))
            at = 0
            for offset, before in entries[first:last]:
                if offset - entries[first][0] != at:
                    raise ValueError(f"index of {name} does not fit its records")
                doc_id, ids, at = unframe(data, at)
                yield doc_id, ids, before
            first = last


SLICES = "name string, records long, ids long, bytes long, before long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                         ("ids", pa.binary())])


def _slices(spark: SparkSession, data: Dataset, size: int) -> DataFrame:
    files = spark.createDataFrame(data.files, SLICES)
    return files.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(size).cast("long")))) \
        .withColumn("high", F.least(F.col("low") + size, "records"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ_SCHEMA.types, strict=True)], schema=READ_SCHEMA)


def _reading(root: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root)
        for batch in batches:
            for s in batch.to_pylist():
                entries = reader.entries(s["name"], s["low"], s["high"], s["records"], s["bytes"])
                rows, held = [], 0
                for doc_id, ids, before in reader.records(s["name"], entries):
                    rows.append((doc_id, s["before"] + before, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    held += len(ids) if with_ids else 0
                    if held > READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def read(spark: SparkSession, data: Dataset, with_ids: bool = True) -> DataFrame:
    """READ per record: its doc_id, the ids of all records before it, its number of ids, their CRC-32, and the ids.

    Files are read in slices of records, so that one large file keeps many tasks busy. Checksums that do not fit end the job.
    """
    ship(spark)
    slices = _slices(spark, data, SLICE)
    return slices.repartition(shuffle_width(spark), "name", "low").mapInArrow(_reading(data.root, with_ids), READ)


def shuffled(spark: SparkSession, data: Dataset, seed: int) -> DataFrame:
    """READ per record in an order that ``seed`` draws; only places are shuffled, and each record is read by its offset."""
    ship(spark)
    places = _slices(spark, data, 1).withColumn("_order", F.xxhash64(F.lit(seed), "name", "low"))
    keys = ["_order", "name", "low"]
    ordered = places.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).drop("_order")
    return ordered.mapInArrow(_reading(data.root, True), READ)


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per row of ``docs``, read back from records written to the shared folder.

    start counts the ids of all documents before it, n_tokens the document's own with ``end_id``; ids_crc32 is over all of them.
    Null and empty texts have ``end_id`` alone. Rows without a doc_id come first; rows that repeat a doc_id stand side by
    side, ordered by their texts' hashes. An empty table gives an empty dataset.
    """
    spark = docs.sparkSession
    data = write(docs, shared_dir(spark, "records"), path, end_id, file_bytes)
    return read(spark, data, with_ids=False).drop("ids")

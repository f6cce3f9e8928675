"""Byte-level BPE by rank files: encoding with a segment tree of pair ranks, and decoding."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import pieces, texts

# Blank space as the rank files' pattern means it; the ASCII separators 1C to 1F are not part of it.
BLANK = r"\t-\r \x85\xa0  -     　"
# Longer pre-tokens are merged one by one, shorter ones many at a time; the tree is the same.
MANY_AT_ONCE = 256
# Pre-tokens a worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 300_000
# Texts above this many characters are cut into pre-tokens step by step.
WHOLE_TEXT = 1 << 20
STEP = 1 << 16
NONE = np.int64(1) << 60


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with its classes of blank space written out."""
    out = pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]")
    return regex.compile(out, regex.V0)


class Ranks:
    """A rank file: tokens by id, and the id that a pair of ids merges to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
        self.base = max(self.ids.values(), default=0) + 1
        self.tokens: list[bytes] = [b""] * self.base
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {(self.ids[t[:k]] * self.base + self.ids[t[k:]]): rank for t, rank in self.ids.items()
                 for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NONE)
        self.pairs = pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges to, NONE where it does not merge."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """The ids of one pre-token, merged with a segment tree over its byte positions.

    Leaf i holds (rank, i) of the pair that starts at position i; a node holds the least of its children, which is
    the leftmost pair of least rank. A merge changes the leaves of the merged position, of its live left
    neighbour and of the position that went, and the nodes above these three.
    """
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids = [int(ranks.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = 1 << 60
    base, pairs = ranks.base, ranks.pairs

    def key(i: int) -> int:
        j = after[i]
        rank = pairs.get(ids[i] * base + ids[j]) if j < n else None
        return none if rank is None else rank * size + i

    tree = [none] * (2 * size)
    tree[size:size + n] = [key(i) for i in range(n)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node //= 2
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        gone = after[i]
        ids[i], after[i] = rank, after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_many(batch: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """merge_one for many pre-tokens of at least two bytes: one tree per row, one merge per row and round."""
    sizes = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch))
    size = 1 << int(sizes.max() - 1).bit_length()
    n = len(batch)
    raw = np.zeros((n, size), dtype=np.uint8)
    raw[np.arange(size) < sizes[:, None]] = np.frombuffer(b"".join(batch), dtype=np.uint8)
    ids = ranks.byte_ids[raw]
    at = np.arange(size)
    after = np.broadcast_to(at + 1, (n, size)).copy()
    before = np.broadcast_to(at - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), NONE, dtype=np.int64)
    rows, cols = np.nonzero(at[:-1] < (sizes - 1)[:, None])
    rank = ranks.rank(ids[rows, cols], ids[rows, cols + 1])
    tree[rows, size + cols] = np.where(rank < NONE, rank * size + cols, NONE)
    width = size // 2
    while width:
        tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
        width //= 2
    live = np.arange(n)
    while True:
        least = tree[live, 1]
        going = least < NONE
        live, least = live[going], least[going]
        if not len(live):
            break
        pos, ends = least % size, sizes[live]
        gone = after[live, pos]
        following, left = after[live, gone], before[live, pos]
        ids[live, pos] = least // size
        after[live, pos] = following
        inside = following < ends
        before[live[inside], following[inside]] = pos[inside]
        tree[live, size + gone] = NONE
        new = np.full(len(live), NONE)
        rank = ranks.rank(ids[live[inside], pos[inside]], ids[live[inside], following[inside]])
        new[inside] = np.where(rank < NONE, rank * size + pos[inside], NONE)
        tree[live, size + pos] = new
        has = left >= 0
        rank = ranks.rank(ids[live[has], left[has]], ids[live[has], pos[has]])
        tree[live[has], size + left[has]] = np.where(rank < NONE, rank * size + left[has], NONE)
        who = np.concatenate([live, live, live[has]])
        node = size + np.concatenate([gone, pos, left[has]])
        while node[0] > 1:  # all nodes are of one level
            node = node // 2
            tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
    alive = np.zeros((n, size), dtype=bool)
    cursor, who = np.zeros(n, dtype=np.int64), np.arange(n)
    while len(who):
        alive[who, cursor] = True
        cursor = after[who, cursor]
        inside = cursor < sizes[who]
        who, cursor = who[inside], cursor[inside]
    return np.split(ids[alive], np.cumsum(alive.sum(1))[:-1])


class Encoder:
    """Texts to ids. Pre-tokens met before are looked up; new ones are merged together, by length."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks(path)
        self.split = compiled(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, tokens: Iterable[str]) -> None:
        """Puts the ids of all ``tokens`` into ``known``, as packed 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for token in set(tokens).difference(self.known):
            raw = token.encode()
            if raw in self.ranks.ids:
                self.known[token] = np.int32(self.ranks.ids[raw]).tobytes()
            elif len(raw) > MANY_AT_ONCE:
                self.known[token] = np.array(merge_one(raw, self.ranks), dtype=np.int32).tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((token, raw))
        for bits, found in by_size.items():
            step = max(1, (1 << 17) >> bits)
            for at in range(0, len(found), step):
                part = found[at:at + step]
                for (token, _), ids in zip(part, merge_many([raw for _, raw in part], self.ranks), strict=True):
                    self.known[token] = ids.astype(np.int32).tobytes()

    def encode_all(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text; together the texts are of bounded size, or one text is alone."""
        if len(batch) == 1 and len(batch[0]) > WHOLE_TEXT:
            return [self._stepwise(batch[0])]
        tokens = [self.split.findall(text) for text in batch]
        self.learn(itertools.chain.from_iterable(tokens))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, found)), dtype=np.int32) for found in tokens]

    def _stepwise(self, text: str) -> np.ndarray:
        found, out = (m[0] for m in self.split.finditer(text)), []
        while part := list(itertools.islice(found, STEP)):
            self.learn(part)
            out.append(b"".join(map(self.known.__getitem__, part)))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids of its whole text by the rank file at ``path``.

    Each match of ``pattern`` is encoded by itself, without special tokens. Null and empty texts give no ids;
    null and repeated doc_ids are passed through. The file must be readable by every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in pieces(batches, "text", 2 << 20):
            ids = coder.encode_all([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))],
                ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with ``decoded``, the bytes their ids stand for (null ids: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("ids")
                decoded = [coder.decode(lists[i].values.to_numpy().tolist() if lists[i].is_valid else ())
                           for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.binary())],
                                                 ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


# Rows that are decoded before they are handed on.
ROWS = 256


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) per row of ``docs``: ``encode`` and then ``decode`` of its ids, in one pass and worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in pieces(batches, "text", 2 << 20):
            ids = coder.encode_all([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                 pa.array([coder.decode(i.tolist()) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

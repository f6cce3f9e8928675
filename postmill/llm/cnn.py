"""Quality by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import held_out, one_row_each, pieces, texts

THRESHOLD = 0.7
STRIDE = 8            # a filter sees 16 bytes and moves by 8
BLOCK = 128           # pooled first; a chunk is two neighbouring blocks, so chunks overlap by half
GRAM = 8              # bytes that count as a repetition
NEAR = (16, 64, 256, 1024)  # distances to the last equal gram that are told apart
WIDTH, FILTERS, HIDDEN = 8, 16, 16
# Blocks of a text that are held at a time; longer texts are read in such runs.
RUN_BLOCKS = 2048


@dataclass(frozen=True)
class Sample:
    """Bounds of what the network is fitted on: documents of least hashed id, and their greatest size in bytes."""

    documents: int = 3000
    most_bytes: int = 16384
    epochs: int = 5
    least_steps: int = 400  # small samples are gone over more often
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Packed:
    """Texts laid end to end, each padded with zero bytes to whole blocks (eight at least)."""

    codes: np.ndarray   # byte + 256 * distance class, per byte
    first: np.ndarray   # first block of each text
    after: np.ndarray   # for each block the next one of its text, or itself

    @property
    def last(self) -> np.ndarray:
        """The last eight bytes of each text, which are padding, as a row of eight."""
        return (self.first + self.counts) * (BLOCK // STRIDE) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.after)))


def pack(raws: list[bytes]) -> Packed:
    sizes = np.array([blocks_of(len(r)) for r in raws])
    ends = np.cumsum(sizes)
    first = ends - sizes
    data = np.zeros(int(ends[-1]) * BLOCK, dtype=np.uint8)
    for raw, at in zip(raws, (first * BLOCK).tolist(), strict=True):
        data[at:at + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    after = np.minimum(np.arange(ends[-1]) + 1, np.repeat(ends - 1, sizes))
    codes = data.astype(np.int32)
    codes += 256 * _distances(data, np.repeat(first * BLOCK, sizes * BLOCK).astype(np.int32))
    return Packed(codes, first, after)


def blocks_of(size: int) -> int:
    return -(-(size + STRIDE) // BLOCK)


def _distances(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0, or 1 to 4 by the distance to the last equal run of GRAM bytes in the same text."""
    n = len(data) - GRAM + 1
    out = np.zeros(len(data), dtype=np.int32)
    wide = data.astype(np.uint64)
    grams = wide[:n].copy()
    for k in range(1, GRAM):
        grams |= wide[k:k + n] << np.uint64(8 * k)
    order = np.argsort(((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_grams = grams[order]
    here, last = order[1:], order[:-1]
    same = (sorted_grams[1:] == sorted_grams[:-1]) & (last >= starts[here]) & (data[here] > 0)
    here, last = here[same], last[same]
    classes = 1 + np.searchsorted(NEAR, here - last, "left")
    out[here] = np.where(classes > len(NEAR), 0, classes)
    return out


class Network:
    """Byte and distance embeddings, filters, chunk pooling, a hidden layer per chunk, and pooling over all chunks."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        make = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"table": make(0.3, 256 * (len(NEAR) + 1), WIDTH), "a": make(0.12, STRIDE * WIDTH, FILTERS),
                  "b": make(0.12, STRIDE * WIDTH, FILTERS), "c": np.zeros(FILTERS, np.float32),
                  "v": make(0.2, 2 * FILTERS, HIDDEN), "w": np.zeros(HIDDEN, np.float32),
                  "u": make(0.2, 2 * HIDDEN), "z": np.zeros(1, np.float32)}
        # A repetition class starts as the byte's own row with a shift common to the class.
        shift = make(0.5, len(NEAR) + 1, WIDTH)
        shift[0] = 0
        self.p["table"] = (np.tile(self.p["table"][:256], (len(NEAR) + 1, 1)) + np.repeat(shift, 256, axis=0)).astype(np.float32)

    def forward(self, packed: Packed) -> dict:
        p = self.p
        rows = p["table"][packed.codes].reshape(-1, STRIDE * WIDTH)
        following = np.vstack([rows[1:], rows[-1:]])
        following[packed.last] = rows[packed.last]  # padding; a filter does not reach into the next text
        conv = np.maximum(rows @ p["a"] + following @ p["b"] + p["c"], 0)
        per = conv.reshape(-1, BLOCK // STRIDE, FILTERS)
        top, mean = per.max(1), per.mean(1)
        nxt = packed.after
        chunk = np.hstack([np.maximum(top, top[nxt]), (mean + mean[nxt]) / 2])
        hidden = np.maximum(chunk @ p["v"] + p["w"], 0)
        best = np.maximum.reduceat(hidden, packed.first)
        average = np.add.reduceat(hidden, packed.first) / packed.counts[:, None]
        logit = np.hstack([best, average]) @ p["u"] + p["z"]
        return {"rows": rows, "following": following, "conv": conv, "per": per, "top": top, "mean": mean, "chunk": chunk,
                "hidden": hidden, "best": best, "average": average, "logit": logit}

    def hidden(self, raw: bytes, first: int, after: int) -> np.ndarray:
        """The hidden layer of a text's chunks from block ``first`` to before ``after``.

        Read are those blocks, the one that the last chunk ends in with the bytes its filters reach into, and before
        them the bytes in which a repetition is near enough to count.
        """
        total = blocks_of(len(raw))
        low, high = max(0, first * BLOCK - (max(NEAR) + GRAM)), min(total, after + 2) * BLOCK
        data = np.zeros(high - low, dtype=np.uint8)
        here = np.frombuffer(raw, dtype=np.uint8)[low:high]
        data[:len(here)] = here
        codes = (data.astype(np.int32) + 256 * _distances(data, np.zeros(len(data), np.int32)))[first * BLOCK - low:]
        p = self.p
        rows = p["table"][codes].reshape(-1, STRIDE * WIDTH)
        conv = np.maximum(rows @ p["a"] + np.vstack([rows[1:], rows[-1:]]) @ p["b"] + p["c"], 0)
        per = conv.reshape(-1, BLOCK // STRIDE, FILTERS)
        top, mean = per.max(1), per.mean(1)
        here = np.arange(after - first)
        nxt = np.minimum(here + 1, total - 1 - first)
        chunk = np.hstack([np.maximum(top[here], top[nxt]), (mean[here] + mean[nxt]) / 2])
        return np.maximum(chunk @ p["v"] + p["w"], 0)

    def long_logit(self, raw: bytes) -> float:
        """The logit of one text, run of blocks by run of blocks, keeping a maximum and a sum."""
        total = blocks_of(len(raw))
        best, mass = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN)
        for first in range(0, total, RUN_BLOCKS):
            hidden = self.hidden(raw, first, min(total, first + RUN_BLOCKS))
            best, mass = np.maximum(best, hidden.max(0)), mass + hidden.sum(0, dtype=np.float64)
        return float(np.hstack([best, (mass / total).astype(np.float32)]) @ self.p["u"] + self.p["z"][0])

    def score(self, raws: list[bytes]) -> np.ndarray:
        logits = np.empty(len(raws))
        short = [k for k, raw in enumerate(raws) if blocks_of(len(raw)) <= RUN_BLOCKS]
        if short:
            logits[short] = self.forward(pack([raws[k] for k in short]))["logit"]
        for k in set(range(len(raws))).difference(short):
            logits[k] = self.long_logit(raws[k])
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def gradients(self, packed: Packed, y: np.ndarray) -> tuple[float, dict]:
        p, s = self.p, self.forward(packed)
        prob = 1 / (1 + np.exp(-np.clip(s["logit"], -40, 40)))
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g = {"u": np.hstack([s["best"], s["average"]]).T @ d_logit, "z": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["u"][None, :]
        owner = np.repeat(np.arange(len(y)), packed.counts)
        at_best = s["hidden"] == s["best"][owner]
        ties = np.add.reduceat(at_best.astype(np.float32), packed.first)
        d_hidden = at_best * (d_pool[:, :HIDDEN] / ties)[owner] + (d_pool[:, HIDDEN:] / packed.counts[:, None])[owner]
        d_hidden = d_hidden.astype(np.float32) * (s["hidden"] > 0)
        g["v"], g["w"] = s["chunk"].T @ d_hidden, d_hidden.sum(0)
        d_chunk = d_hidden @ p["v"].T
        nxt = packed.after
        left = s["top"] >= s["top"][nxt]
        d_top = np.where(left, d_chunk[:, :FILTERS], 0)
        np.add.at(d_top, nxt, np.where(left, 0, d_chunk[:, :FILTERS]))
        d_mean = d_chunk[:, FILTERS:] / 2
        d_mean = d_mean + _scattered(nxt, d_mean)
        first_top = s["per"].argmax(1)
        d_per = np.repeat(d_mean[:, None, :] / (BLOCK // STRIDE), BLOCK // STRIDE, axis=1)
        i, k = np.indices(first_top.shape)
        d_per[i, first_top, k] += d_top
        d_conv = (d_per.reshape(-1, FILTERS) * (s["conv"] > 0)).astype(np.float32)
        g["a"], g["b"], g["c"] = s["rows"].T @ d_conv, s["following"].T @ d_conv, d_conv.sum(0)
        d_rows = d_conv @ p["a"].T
        d_following = d_conv @ p["b"].T
        d_rows[packed.last] += d_following[packed.last]
        d_following[packed.last] = 0
        d_rows[1:] += d_following[:-1]
        d_rows = d_rows.reshape(-1, WIDTH)
        g["table"] = np.stack([np.bincount(packed.codes, weights=d_rows[:, k], minlength=len(p["table"]))
                               for k in range(WIDTH)], axis=1)
        loss = float(np.mean(np.logaddexp(0, s["logit"]) - y * s["logit"]))
        return loss, g


def _scattered(to: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    np.add.at(out, to, values)
    return out


def fit(raws: list[bytes], y: np.ndarray, sample: Sample) -> Network | None:
    """Adam over minibatches; None if one of the two labels is missing."""
    if len(set(y.tolist())) < 2:
        return None
    net, r = Network(sample.seed), np.random.default_rng(sample.seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    batches = -(-len(raws) // sample.batch)
    epochs = max(sample.epochs, -(-sample.least_steps // batches))
    steps, total = 0, epochs * batches
    for _ in range(epochs):
        order = r.permutation(len(raws))
        for at in range(0, len(order), sample.batch):
            chosen = order[at:at + sample.batch]
            _, g = net.gradients(pack([raws[i] for i in chosen]), y[chosen].astype(np.float32))
            steps += 1
            rate = sample.rate * (1 - 0.9 * steps / total)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: Sample) -> tuple[Network | None, float]:
    """The network, and the share of good texts among the rows it was fitted on (the score if there is no network)."""
    marks = labels.filter(~held_out(labels["doc_id"])).select("doc_id", "quality").dropna() \
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = texts(docs).filter(F.octet_length("text") <= sample.most_bytes)
    known = marks.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample.documents)
    # The sample's size bounds the side that is broadcast and, with one row for each of its ids, what comes back.
    got = one_row_each(rows.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality").orderBy("doc_id").toArrow()
    y = np.array(got.column("quality").to_pylist(), dtype=np.int64)
    return fit([t.encode() for t in got.column("text").to_pylist()], y, sample), float(y.mean()) if len(y) else 0.5


def scored(docs: DataFrame, labels: DataFrame, sample: Sample | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; predicted is 1 at a score of THRESHOLD or more.

    The network is fitted on a bounded sample of labelled rows that are not held out (see Sample) and reads every byte of
    every text. Null and empty texts are one block of padding and are scored like any other. With one label only, or
    none, every score is the share of good texts in the sample (0.5 without any). Rows without a doc_id are scored and are
    not held out. Repeated rows give repeated rows; labels that contradict each other count as bad quality.
    """
    net, share = learn(docs, labels, sample or Sample())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 1 << 19):
            raws = [(t or "").encode() for t in part.column("text").to_pylist()]
            score = net.score(raws) if net else np.full(len(raws), share)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

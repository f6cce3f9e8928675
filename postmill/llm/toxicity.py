"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import held_out, one_row_each, pieces, rowwise, texts

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
# Words whose weight a task remembers; beyond it forgets all and starts anew.
REMEMBERED = 200_000
THRESHOLD = 0.3
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words: runs of letters a-z and characters beyond ASCII, as UTF-8."""
    return set((text or "").lower().encode().translate(_LETTERS).split())


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a word and of its first bytes, by which forms of a word that was not seen are known."""
    return (zlib.crc32(word) % BUCKETS,
            *(zlib.crc32(word[:k], k) % BUCKETS for k in PREFIXES if len(word) > k))


@dataclass(frozen=True)
class Sample:
    """Bounds of what the model is fitted on: the documents of least hashed id of each kind."""

    positives: int = 3000
    unlabelled: int = 6000


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    def word(self, word: bytes) -> float:
        return sum(self.weights.get(b, 0.0) for b in buckets_of(word))

    def scorer(self):
        """text -> probability, remembering the weights of words."""
        known: dict[bytes, float] = {}

        def score(text: str | None) -> float:
            words = words_of(text)
            if len(known) > REMEMBERED:
                known.clear()
            for word in words.difference(known):
                known[word] = self.word(word)
            total = self.bias + sum(map(known.__getitem__, words))
            return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

        return score


def _first(frame: DataFrame, n: int) -> DataFrame:
    return frame.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def training_rows(docs: DataFrame, labels: DataFrame, sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(is_positive per text, buckets of all texts end to end, number of buckets per text, class prior).

    All come from rows that are not held out; of rows that share a doc_id the one with the least hash of its text counts. Positives are documents with a confirmed label; the unlabelled ones are taken from all documents, whatever
    their label. The prior is the share of toxic ones among the labelled documents.
    """
    marks = labels.filter(~held_out(labels["doc_id"])).select("doc_id", "toxic").dropna() \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    prior = marks.agg(F.avg("toxic")).first()[0] or 0.0
    rows = texts(docs)
    rows = rows.filter(~held_out(rows["doc_id"]) & rows["doc_id"].isNotNull())
    known = rows.select("doc_id").join(marks.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    chosen = _first(known, sample.positives).withColumn("positive", F.lit(True)).unionByName(
        _first(rows, sample.unlabelled).withColumn("positive", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = [sorted({b for w in words_of(t) for b in buckets_of(w)}) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"),
                                              pa.array(found, pa.list_(pa.int32()))], ["doc_id", "positive", "buckets"])

    # The sample's size bounds the side that is broadcast and, with one row for each of its ids, what comes back.
    picked = one_row_each(rows.join(F.broadcast(chosen), "doc_id"), "doc_id", "positive").mapInArrow(run, "doc_id long, positive boolean, buckets array<int>")
    got = picked.orderBy("doc_id", "positive").toArrow()
    lists = got.column("buckets").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return got.column("positive").to_numpy(), lists.flatten().to_numpy(), sizes, prior


def risk(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(value, slope by logit) of the non-negative PU risk of the logits ``f``.

    Where the unlabelled part falls below zero, the slope is that of its negative alone, so that a step goes against it.
    """
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # slope of loss(f, -); that of loss(f, +) is up - 1
    loss_neg = np.logaddexp(0, f)
    rest = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
    slope_rest = np.where(positive, -prior * up / n_pos, up / n_unl)
    slope = np.where(positive, prior * (up - 1) / n_pos, 0.0) + slope_rest if rest >= 0 else -slope_rest
    return float(prior * (loss_neg[positive] - f[positive]).mean() + max(0.0, rest)), slope


def fit(positive: np.ndarray, bucket: np.ndarray, sizes: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-3, least_z: float = 5.0) -> Model:
    """Logistic weights of the least non-negative PU risk.

    With positives P, unlabelled U and the class prior p the risk is p*loss(P, +) + max(0, loss(U, -) - p*loss(P, -)).
    Where the second part falls below zero, a step goes against it, as the estimator asks. Buckets
    are those over three times as frequent in P as in U, by ``least_z`` standard errors at least. The prior is lowered to the part of U that holds such buckets over that of P,
    should the labels not be a fair sample. Without positives the model scores 0 everywhere.
    """
    positive = positive.astype(bool)
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_unl or prior <= 0:
        return Model({}, -40.0)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    in_pos = np.bincount(bucket[positive[doc]], minlength=BUCKETS)
    in_unl = np.bincount(bucket[~positive[doc]], minlength=BUCKETS)
    share = (in_unl + 1) / (n_unl + 2)
    use = np.nonzero((in_pos >= 2) & (in_pos / n_pos > 3 * share)
                     & (in_pos / n_pos - share > least_z * np.sqrt(share * (1 - share) / n_pos)))[0]
    if not len(use):
        return Model({}, -40.0)
    at = np.full(BUCKETS, -1, dtype=np.int32)
    at[use] = np.arange(len(use))
    col = at[bucket]
    doc, col = doc[col >= 0], col[col >= 0]
    hit = np.bincount(doc, minlength=len(sizes)) > 0
    prior = min(prior, hit[~positive].mean() / hit[positive].mean())
    theta, bias = np.zeros(len(use)), 0.0
    m, v = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    for step in range(1, steps + 1):
        f = bias + np.bincount(doc, weights=theta[col], minlength=len(sizes))
        _, slope = risk(f, positive, prior)
        grad = np.append(np.bincount(col, weights=slope[doc], minlength=len(use)) + l2 * theta, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model({int(b): float(w) for b, w in zip(use, theta, strict=True)}, float(bias))


def learn(docs: DataFrame, labels: DataFrame, sample: Sample | None = None) -> Model:
    return fit(*training_rows(docs, labels, sample or Sample()))


def scored(docs: DataFrame, labels: DataFrame, sample: Sample | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; predicted is 1 at a score of THRESHOLD or more.

    The model is fitted on a bounded sample of rows that are not held out (see Sample) and applied to every whole text.
    Null and empty texts have no words and get the score of the bias alone. Rows without a doc_id are scored, are
    not held out and are never learned from. Repeated rows give repeated rows; labels that contradict
    each other count as toxic; labels without a document and null labels are left out.
    """
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(score, part.column("text").to_pylist()),
                                                                             pa.float64())], ["doc_id", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: Sample | None = None) -> DataFrame:
    """The rows of ``docs`` whose score stays below THRESHOLD, with the columns of ``docs``."""
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in pieces(batches, "text"):
            yield part.filter(pa.array([score(t) < THRESHOLD for t in part.column("text").to_pylist()], pa.bool_()))

    return rowwise(docs, run)

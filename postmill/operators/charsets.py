"""Charset choice for text bytes, from byte pairs learned on a corpus.

Bytes with a mark of their encoding, with the zero bytes of two-byte text, or that are valid UTF-8 are known for sure. The
rest is told apart by how likely its pairs of bytes are in each charset; pairs of two ASCII bytes say nothing and are left
out. How many pairs tell is learned too and counts once: a lone accent in ASCII text is likelier in a charset whose texts
have few. Nearly all content is valid UTF-8 and is decoded in the JVM; only the rest goes through Arrow.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.files import decode_text

CHARSETS = ("windows-1252", "iso-8859-2", "koi8-r", "shift_jis")
# Python's names where they are others.
CODECS = {"windows-1252": "cp1252"}
LEAST_CONFIDENCE = 0.7  # fixed value
# Counts that every pair has before any is seen, and the bytes of a content whose pairs are counted at a time.
PRIOR = 0.02
PART = 1 << 20
# Classes of the share of pairs that tell, by halves, and the count that each has before any is seen.
SHARES = 16
SHARE_PRIOR = 0.5
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def codec_of(charset: str) -> str:
    return CODECS.get(charset, charset)


def telling_pairs(data: bytes) -> np.ndarray:
    """How often each pair of bytes occurs, pairs of two ASCII bytes left out; 65,536 counts."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for at in range(0, len(data), PART):
        codes = np.frombuffer(data[at:at + PART + 1], dtype=np.uint8).astype(np.int32)
        pairs = (codes[:-1] << 8) | codes[1:]
        out += np.bincount(pairs[(codes[:-1] | codes[1:]) > 127], minlength=1 << 16)
    return out


def share_class(counts: np.ndarray, size: int) -> int:
    """The class of a content of ``size`` bytes by its share of telling pairs: 0 for over a half, 1 for over a quarter and so on."""
    return min(SHARES - 1, int(math.log2(max(size - 1, 1) / max(int(counts.sum()), 1))))


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of byte pairs and of classes of their share, a row per charset; of fixed size."""

    charsets: tuple[str, ...]
    scores: np.ndarray
    shares: np.ndarray | None = None

    def likely(self, data: bytes) -> tuple[str, float] | None:
        """(charset, its share of the likelihood of all); None if no charset can hold the bytes or no pair tells."""
        counts = telling_pairs(data)
        used = np.flatnonzero(counts)
        fits = [k for k, charset in enumerate(self.charsets) if _holds(data, charset)]
        if not fits or not len(used):
            return None
        # A pair that comes again says less than a new one: a text may be one word over and over.
        logs = self.scores[fits][:, used].astype(np.float64) @ np.log2(1 + counts[used])
        if self.shares is not None:
            logs += self.shares[fits, share_class(counts, len(data))]
        shares = np.exp(logs - logs.max())
        best = int(shares.argmax())
        return self.charsets[fits[best]], float(shares[best] / shares.sum())


def _decoded(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(codec_of(charset))
    except UnicodeDecodeError:
        return None


def _holds(data: bytes, charset: str) -> bool:
    """Whether all bytes stand for characters; the last one may be cut."""
    try:
        codecs.getincrementaldecoder(codec_of(charset))().decode(data)
    except UnicodeDecodeError:
        return False
    return True


def _wide(data: bytes) -> str | None:
    """UTF-16 by its zero bytes: most second (first) bytes of ASCII text are zero, few of the others."""
    if len(data) < 4 or len(data) % 2:
        return None
    zeros = np.frombuffer(data, dtype=np.uint8).reshape(-1, 2) == 0
    first, second = zeros.mean(0)
    found = "utf-16-le" if second > 0.5 and first < 0.1 else "utf-16-be" if first > 0.5 and second < 0.1 else None
    return found if found and _decoded(data, found) is not None else None


def guess(data: bytes, model: Model) -> tuple[str, float, str]:
    """(charset, confidence, text) of some bytes; UTF-8 with replacement if no charset is likely enough."""
    for mark, charset in MARKS:
        if data.startswith(mark):
            return charset, 1.0, data[len(mark):].decode(charset, errors="replace")
    wide = _wide(data) if b"\0" in data else None
    if wide:
        return wide, 1.0, data.decode(wide)
    text = _decoded(data, "utf-8")
    if text is not None:
        return "utf-8", 1.0, text
    charset, confidence = model.likely(data) or ("utf-8", 0.0)
    if confidence > LEAST_CONFIDENCE:
        return charset, confidence, data.decode(codec_of(charset), errors="replace")
    return "utf-8", confidence, data.decode("utf-8", errors="replace")


def learn(contents: DataFrame, charsets: tuple[str, ...] = CHARSETS) -> Model:
    """The model of ``contents`` (content binary, charset string), from the byte pairs of all rows.

    Tasks add up their pairs before they are shuffled; at most 65,536 counts per charset, and SHARES, come back. Contents of
    other charsets are left out; a charset without any is never likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Behind the pairs, the contents of each class.
        total = np.zeros((len(charsets), (1 << 16) + SHARES), dtype=np.int64)
        for batch in batches:
            for data, charset in zip(batch.column("content").to_pylist(), batch.column("charset").to_pylist(), strict=True):
                if data and charset in charsets:
                    pairs = telling_pairs(data)
                    own = total[charsets.index(charset)]
                    own[:1 << 16] += pairs
                    if pairs.any():
                        own[(1 << 16) + share_class(pairs, len(data))] += 1
        number, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[number, pair])],
                                         ["number", "pair", "n"])

    rows = contents.select("content", "charset").mapInArrow(run, "number int, pair int, n long")
    counted = rows.groupBy("number", "pair").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((len(charsets), (1 << 16) + SHARES))
    both[counted.column("number").to_numpy(), counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    counts, classes = both[:, :1 << 16] + PRIOR, both[:, 1 << 16:] + SHARE_PRIOR
    scores = np.log(counts / counts.sum(1, keepdims=True))
    shares = np.log(classes / classes.sum(1, keepdims=True))
    seen = np.isin(np.arange(len(charsets)), counted.column("number").to_numpy())
    kept = tuple(c for c, s in zip(charsets, seen.tolist(), strict=True) if s)
    return Model(kept, scores[seen].astype(np.float32), shares[seen])


def reader(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """content -> struct(charset, confidence, text); null content has all three null, empty content is UTF-8.

    Content that is valid UTF-8, has no zero byte and no mark is decoded in the JVM and not handed to Python.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("charset string, confidence double, text string")
    def other(data: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if d is None else guess(d, shared.value) for d in data]
        return pd.DataFrame(found, columns=["charset", "confidence", "text"])

    def read(c: Column) -> Column:
        plain = F.is_valid_utf8(c.cast("string")) & ~F.contains(c, F.lit(b"\0")) & ~F.startswith(c, F.lit(codecs.BOM_UTF8))
        sure = F.struct(F.lit("utf-8").alias("charset"), F.lit(1.0).alias("confidence"), decode_text(c).alias("text"))
        return F.when(c.isNotNull() & plain, sure).otherwise(other(F.when(~plain, c)))

    return read


def decode_guess(df: DataFrame, model: Model, content: str = "content") -> DataFrame:
    """Adds ``charset``, ``confidence`` and ``text`` of the content, as ``reader`` gives them."""
    found = df.withColumn("_read", reader(df.sparkSession, model)(F.col(content)))
    return found.withColumns({c: F.col(f"_read.{c}") for c in ("charset", "confidence", "text")}).drop("_read")


def encoded(text: Column, charset: Column) -> Column:
    """The text as bytes of the charset, characters that it lacks as ``?``; null for null."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None else t.encode(codec_of(n), errors="replace")
                          for t, n in zip(texts, names, strict=True)])

    return run(text, charset)

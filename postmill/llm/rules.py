"""Quality rules: word counts of the text and compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from postmill.llm.batches import pieces, rowwise, texts

BLANK = bytes(range(9, 14)) + b" "
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size. A text is held to the last row whose length in bytes it reaches."""

    level: int = 3
    # (bytes from, least ratio, greatest ratio). Short texts carry the frame's own bytes, long ones share more.
    texts: tuple[tuple[int, float, float], ...] = field(default=(
        (0, 0.0, 9.0), (100, 0.40, 1.10), (250, 0.45, 0.95), (1000, 0.43, 0.85), (2000, 0.41, 0.80),
        (4000, 0.39, 0.75), (8000, 0.37, 0.75), (16000, 0.34, 0.75)))
    # (text bytes from, chunk bytes, least ratio, greatest ratio): texts of that length are cut into fixed chunks, the last of
    # which ends with the text. Small chunks carry the frame's own bytes and share less. Shorter texts are a chunk by themselves
    # and held to the limits above.
    chunks: tuple[tuple[int, int, float, float], ...] = field(default=(
        (256, 256, 0.50, 0.90), (1024, 512, 0.46, 0.78), (16384, 2048, 0.38, 0.70)))
    # Share of the chunks that may miss their limits.
    chunks_outside: float = 0.2


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, n_chunks long, n_chunks_outside long, kept boolean")


def _renumber(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per distinct pair."""
    return np.unique((left.astype(np.int64) << 32) | right.astype(np.int64), return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a run of eight that the text holds twice or more, the first time included.

    Words get numbers, pairs of numbers get numbers, and so on to eight words: equal numbers mean equal runs.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    runs = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    for step in (1, 2, 4):
        runs = _renumber(runs[:-step], runs[step:])
        if runs.max() == len(runs) - 1:  # all differ, and so do all longer runs
            return 0
    twice = np.bincount(runs)[runs] > 1
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.nonzero(twice)[0]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def chunks_outside(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[int, int]:
    """Number of fixed chunks of a text, and of those whose ratio is outside the limits of their size.

    Each byte is in a chunk: the last chunk ends with the text and may overlap the one before.
    """
    held = [row for row in bands.chunks if len(raw) >= row[0]]
    if not held:
        return 0, 0
    _, size, least, most = held[-1]
    starts = [*range(0, len(raw) - size + 1, size)]
    if starts[-1] + size < len(raw):
        starts.append(len(raw) - size)
    view = memoryview(raw)
    return len(starts), sum(not least * size <= len(pack.compress(view[a:a + size])) <= most * size for a in starts)


def judge(text: str | None, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA after doc_id for one text; null is the empty text."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK)]
    blanks = len(raw) - len(raw.translate(None, BLANK))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    n_repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    ratio = len(pack.compress(raw)) / len(raw) if raw else 0.0
    _, least, most = [row for row in bands.texts if len(raw) >= row[0]][-1]
    n_chunks, outside = chunks_outside(raw, bands, pack)
    kept = not failed and least <= ratio <= most and outside <= bands.chunks_outside * n_chunks
    return (len(words), len(text or "") - blanks, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, ratio,
            n_chunks, outside, kept)


def judged(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """SCHEMA per row of ``docs``: the base counts of its whole text and the verdict of the compression bands.

    Words are runs of anything but ASCII blanks. A row is not kept if the base rule fails (fewer than 20 words, or over
    30 in 100 words in repeated runs of eight), if the zstandard ratio of the whole text leaves the band
    of its length, or if too many of its fixed chunks leave the chunk band. Null and empty texts have no words and
    are not kept. Null and repeated doc_ids are passed through; each row is judged by itself.
    """
    bands = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for part in pieces(batches, "text"):
            rows = [judge(t, bands, pack) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)


NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


def keep(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; rows are neither moved nor joined."""
    bands = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for part in pieces(batches, "text"):
            yield part.filter(pa.array([judge(t, bands, pack)[-1] for t in part.column("text").to_pylist()], pa.bool_()))

    return rowwise(docs, run)

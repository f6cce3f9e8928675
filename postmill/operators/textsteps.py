"""The text steps in their fixed order, and user-supplied rewriting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.masking import mask_pii
from postmill.operators import spelling

CHUNK = 1000                       # fixed value: longest chunk handed to a rewriter
PROMPT = "improve grammar: "       # fixed value: prefix for prompt-driven rewriters

Rewriter = Callable[[str], str]


def rewrite(c: Column, make: Callable[[], Rewriter]) -> Column:
    """Apply a user's rewriter to a text column.

    ``make`` builds it once per task. A text it fails on, or that is empty, stays as it is.
    """
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()

        def one(text: str | None) -> str | None:
            if not text:
                return text
            try:
                return call(text)
            except Exception:  # a rewriter's failure must not lose the text
                return text
        for batch in batches:
            yield batch.map(one)
    return run(c)


def prompted(make: Callable[[], Rewriter], prompt: str = PROMPT) -> Callable[[], Rewriter]:
    """A rewriter called with the prompt in front; blank answers give the text back."""
    def build() -> Rewriter:
        call = make()

        def run(text: str) -> str:
            answer = call(prompt + text).strip()
            return answer or text
        return run
    return build


def _chunk_pattern(width: int) -> str:
    """As much as fits from one non-blank to another that a blank follows, else a word that is longer."""
    return rf"(?s)\S(?:.{{0,{width - 2}}}\S)?(?=\s|$)|\S+"


def wrap_chunks(text: str, width: int = CHUNK) -> list[str]:
    """Pieces of at most ``width`` characters, cut at white space; longer words stay whole."""
    return re.findall(_chunk_pattern(width), text)


def chunk_text(df: DataFrame, column: str = "text", width: int = CHUNK) -> DataFrame:
    """One row per chunk: ``chunk_no`` and ``chunk``, cut in the JVM as by ``wrap_chunks``; the other columns stay."""
    rest = [c for c in df.columns if c != column]
    chunks = F.regexp_extract_all(F.col(column), F.lit(f"(?U){_chunk_pattern(width)}"), F.lit(0))
    return df.select(*rest, F.posexplode(chunks).alias("chunk_no", "chunk"))


def join_chunks(chunks: DataFrame, key: str, column: str = "chunk", out: str = "text") -> DataFrame:
    """The chunks of each ``key`` put together in order, without a gap."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", F.col(column).alias("part"))))
    return chunks.groupBy(key).agg(F.array_join(parts["part"], "").alias(out))


def chunked(make: Callable[[], Rewriter]) -> Callable[[], Rewriter]:
    """A rewriter that sees one chunk at a time; the answers are put together without a gap."""
    def build() -> Rewriter:
        call = make()
        return lambda text: "".join(call(p) for p in wrap_chunks(text))
    return build


def text_steps(df: DataFrame, key: str, column: str = "text", out: str = "processed", *,
               sanitize: bool = True, custom: Mapping[str, str] | None = None,
               dictionary: DataFrame | None = None, grammar: Callable[[], Rewriter] | None = None,
               neural: Callable[[], Rewriter] | None = None) -> DataFrame:
    """Mask, then correct spelling, then grammar, then a neural rewriter; each is optional.

    Null becomes ''. Without the two rewriters no row leaves the JVM.
    """
    step = df.withColumn(out, F.coalesce(F.col(column), F.lit("")))
    if sanitize:
        step = step.withColumn(out, mask_pii(F.col(out), custom))
    if dictionary is not None:
        step = spelling.spell_correct(step, dictionary, key, out, out)
    if grammar is not None:
        step = step.withColumn(out, rewrite(F.col(out), chunked(grammar)))
    if neural is not None:
        step = step.withColumn(out, rewrite(F.col(out), prompted(neural)))
    return step

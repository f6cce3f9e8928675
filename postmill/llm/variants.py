"""Spelling variants by a dictionary of pairs of trie nodes.

The words are sorted, forward and reversed; a trie node is numbered by the first word in that order that has it, and its
depth. A word that lacks the letter at i lies at the pair (prefix node of depth i, node of the suffix after i); a word as it
stands lies, for each cut i, at the pair (prefix node of depth i, node of the suffix from i). Words that meet at a pair are one
edit apart, and all that are meet there, so the integers decide and no words are compared.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import pieces, texts
from postmill.llm.shipping import ship
from postmill.session import written

# A-Z are lower-cased before; shorter runs cannot give a word.
LEAST = 7
RUN = r"[a-zÀ-ÿ]{%d,}"
DROP_ONE_IN = 31
LEAST_COUNT = 2
FORM_RATIO = 10
# Different words a task counts before it hands them on, and rows of a batch.
HELD = 200_000
BATCH = 2000
# Places of a word's number: the range above, its place in the range below.
PART_BIT = 40


def words_of(doc_id: int | None, text: str | None, least: int = LEAST, one_in: int = DROP_ONE_IN) -> Counter:
    """Words of ``least`` letters or more in a text, and how often; where a hash of doc_id and run says so, less one letter.

    Runs in a text without a doc_id stay as they are.
    """
    runs = Counter(re.findall(RUN % least, (text or "").encode().lower().decode()))
    if doc_id is None:
        return runs
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame, least: int = LEAST, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least_count`` times or more in all texts; tasks count before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for part in pieces(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                held.update(words_of(doc_id, text, least))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def number(part: int, place: int) -> int:
    return (part << PART_BIT) | place


def _walk(words: Iterator[tuple], part: int) -> Iterator[tuple]:
    """(number, word, more, shared, owners) of each (word, more) of a sorted range.

    ``shared`` is the greatest depth of a node that another word may have, ``owners`` the first words of the nodes of
    depth 1 to ``shared``. The ends of a range count as shared throughout: what lies beyond is not seen.
    """
    last, place = None, 0
    for word, more in words:
        common = _common(last[1], word) if last else 0
        if last:
            shared = len(last[1]) if last[0] == number(part, 0) else max(last[3], common)
            yield last[0], last[1], last[2], shared, last[4][:shared]
        own = number(part, place)
        last = (own, word, more, common, (last[4][:common] if last else []) + [own] * (len(word) - common))
        place += 1
    if last:
        yield last[0], last[1], last[2], len(last[1]), last[4]


def _numbered(rows: DataFrame, word: str, more: str) -> tuple[DataFrame, DataFrame]:
    """(id, word, more) and (id, word, more, shared, owners) of rows (word string, more long), all words different.

    Ranges of the sorted words are walked side by side. Nodes that a range's first word shares with the range before get the
    owners that they have there; each range's first and last word pass through the driver, a line per range.
    """
    spark = rows.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pairs = ((w, m) for b in batches for w, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held: list[tuple] = []
        size = 0
        for row in _walk(pairs, part):
            held.append(row)
            size += len(row[4])
            if len(held) >= BATCH or size > 64 * BATCH:
                yield batch(held, part)
                held, size = [], 0
        if held:
            yield batch(held, part)

    def batch(held: list[tuple], part: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), *columns], NUMBERED)

    ranged = rows.select(word, more).repartitionByRange(word).sortWithinPartitions(word)
    found = written(ranged.mapInArrow(run, "part int, id long, word string, more long, shared int, owners array<long>"), "trie")
    ends = found.groupBy("part").agg(F.min_by("word", "id").alias("first"), F.max_by("word", "id").alias("last"),
                                     F.max_by("owners", "id").alias("owners")).orderBy("part").collect()
    carried = _carried([(r["part"], r["first"], r["last"], r["owners"]) for r in ends])
    plain = found.select("id", "word", "more")
    if not carried:
        return plain, found.drop("part")
    before = spark.createDataFrame(carried, "part int, carried array<long>")
    first = F.shiftleft(F.col("part").cast("long"), PART_BIT)
    mended = F.transform("owners", lambda x, i: F.when((x == first) & (i < F.size("carried")), F.get("carried", i)).otherwise(x))
    return plain, found.join(before, "part", "left").withColumn(
        "owners", F.when(F.col("carried").isNull(), F.col("owners")).otherwise(mended)).drop("part", "carried")


NUMBERED = ["part", "id", "word", "more", "shared", "owners"]


def _carried(ends: list[tuple[int, str, str, list[int]]]) -> list[tuple[int, list[int]]]:
    """(part, owners from depth 1 on) of the nodes that a range's first word shares with the range before it."""
    out: list[tuple[int, list[int]]] = []
    before: tuple[str, list[int]] | None = None
    for part, first, last, owners in ends:
        shared = before[1][:_common(before[0], first)] if before else []
        if shared:
            out.append((part, shared))
        own = number(part, 0)
        before = (last, [shared[i] if i < len(shared) and x == own else x for i, x in enumerate(owners)])
    return out


def _places(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _node(owners: str, depth: Column) -> Column:
    """The owner of the node of that depth; the root's is 0."""
    return F.when(depth > 0, F.get(owners, depth - 1)).otherwise(F.lit(0).cast("long"))


def pairs_of(forward: DataFrame) -> DataFrame:
    """Rows (i, rest, p, s) + (id, n, lacks, last): the places of each word, numbered in its trie, in the dictionary of pairs.

    i and rest are the depths of the prefix node and of the suffix node, p and s their owners. ``lacks`` tells pairs
    around a letter left out; ``last`` tells that the next letter is another, so that of equal letters in a row one counts.
    Pairs with a node that no other word has are left out, since nothing can meet there.
    """
    _, back = _numbered(forward.select("id", F.reverse("word").alias("rev")), "rev", "id")
    both = forward.select("id", "word", F.col("more").alias("n"), F.col("shared").alias("f"), F.col("owners").alias("fs")).join(
        back.select(F.col("more").alias("id"), F.col("shared").alias("b"), F.col("owners").alias("bs")), "id")
    size = F.col("size")
    both = both.withColumn("size", F.length("word")).withColumn("letters", F.split("word", ""))
    place = lambda i, rest, lacks, last: F.struct(
        i.alias("i"), rest.alias("rest"), _node("fs", i).alias("p"), _node("bs", rest).alias("s"), lacks.alias("lacks"), last.alias("last"))
    without = F.transform(_places(F.greatest(F.lit(0), size - 1 - F.col("b")), F.least(size - 1, F.col("f"))), lambda i: place(
        i, size - 1 - i, F.lit(True), ~F.get("letters", i).eqNullSafe(F.get("letters", F.when(i < size - 1, i + 1)))))
    whole = F.transform(_places(F.greatest(F.lit(0), size - F.col("b")), F.least(size, F.col("f"))), lambda i: place(
        i, size - i, F.lit(False), F.lit(False)))
    return both.select("id", "n", F.explode(F.concat(without, whole)).alias("at")).select("at.*", "id", "n")


def near(forward: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of each word that has near ones: their number, the greatest count among them and its least id.

    A pair is met by one whole word at most and by no more words less a letter than there are letters, since they differ
    in that letter alone. Two words of equal length meet at one pair; a longer word less a letter and the
    shorter one are counted where the letter is the last of its run: so each near word counts once, and no pairs of words are listed.
    """
    rank = F.struct("n", (-F.col("id")).alias("id"))  # the more frequent, then the first in order
    met = pairs_of(forward).groupBy("i", "rest", "p", "s").agg(F.collect_list(F.struct(rank.alias("rank"), "lacks", "last")).alias("met")) \
        .filter(F.size("met") > 1)
    pick = lambda test: F.sort_array(F.filter("met", test), asc=False)
    groups = met.select("met", pick(lambda m: m["lacks"]).alias("short"), pick(lambda m: m["lacks"] & m["last"]).alias("once"),
                        F.get(F.filter("met", lambda m: ~m["lacks"]), F.lit(0)).alias("whole"))
    one = groups.select("short", "once", "whole", F.explode("met").alias("m"))
    also = F.when(F.col("m.last"), F.col("whole.rank"))
    number_of = F.when(F.col("m.lacks"), F.size("short") - 1 + F.when(also.isNotNull(), 1).otherwise(0)).otherwise(F.size("once"))
    other = F.when(F.get("short", F.lit(0))["rank"] == F.col("m.rank"), F.get("short", F.lit(1))["rank"]).otherwise(F.get("short", F.lit(0))["rank"])
    best = F.when(F.col("m.lacks"), F.greatest(other, also)).otherwise(F.get("once", F.lit(0))["rank"])
    each = one.select((-F.col("m.rank.id")).alias("id"), number_of.cast("long").alias("n_near"), best.alias("best")).filter("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).select(
        "id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.id")).alias("best"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(id, root) of rows (id, form): where following forms ends. Counts rise tenfold a step, so ``most`` bounds the steps."""
    steps = max(1, math.ceil(math.log(max(most, 2), FORM_RATIO)))
    now = forms.select("id", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        now = written(now.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root")), "roots")
    return now


def grouped(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n), all words different.

    Words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its near word of the
    greatest n, then the least in code-point order, if that n is FORM_RATIO times the word's or more; its root is where
    following forms ends, the word itself if it has none.
    """
    base, forward = _numbered(words, "word", "n")
    base = base.withColumnRenamed("more", "n")
    taken = F.col("best_n") >= FORM_RATIO * F.col("n")
    links = written(base.join(near(forward), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("to"),
        F.when(taken, F.col("best_n")).alias("form_n")), "links")
    roots = _roots(links.filter("to IS NOT NULL").select("id", F.col("to").alias("form")), links.agg(F.max("n")).first()[0] or 0)
    name = lambda key, value: links.select(F.col("id").alias(key), F.col("word").alias(value))
    rooted = links.join(roots.withColumnRenamed("root", "end"), "id", "left")
    return rooted.join(name("to", "form"), "to", "left").join(name("end", "last"), "end", "left").select(
        "word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = LEAST, least_count: int = LEAST_COUNT) -> DataFrame:
    """As ``grouped``, of the words in the texts of ``docs``.

    Words are maximal runs of letters (A-Z lower-cased), less a letter in the texts where ``words_of`` says so, that have
    ``least`` letters and occur ``least_count`` times or more in all texts. Null and empty texts have none; texts without a
    doc_id are read as they are; repeated rows count again. An empty table gives an empty result.
    """
    return grouped(counted(docs, least, least_count))

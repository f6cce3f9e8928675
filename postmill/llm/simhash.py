"""Near-duplicates by SimHash with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import pieces, texts
from postmill.llm.graph import components
from postmill.session import unsized, written

SEED = 42
# Fingerprints that share a whole half: up to so many are compared by the join, more in blocks of BLOCK.
CROWD = 256
BLOCK = 2048
# Shingles hashed at a time; bounds the bit matrix of a very long text.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 majority bits of a text's shingle hashes, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII blanks; shingles are ``shingle`` words joined by
    one space (a text of fewer words is one shingle). A bit is set if it is set in over half the hashes.
    A null text and a text without words have the fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist(),
                                                                     strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(starts)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row of ``docs``, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """Two rows per fingerprint: side, its 32-bit segment of that side as a long, the fingerprint."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("seg")),
                                              F.struct(F.lit(1).alias("side"), low.alias("seg")))).alias("h")) \
        .select("fp", "h.side", "h.seg")


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p)


def _close(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def _variant_pairs(halves: DataFrame, most: int) -> DataFrame:
    """Links between fingerprints one half of which differs by at most one bit.

    A segment goes to the left with the variants whose wildcard stands on a 0 bit, to the right with those whose
    wildcard stands on a 1 bit, and to both with the whole segment, so that each pair meets once for each half.
    """
    spots = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p")
    wild = halves.select("fp", "side", "seg", spots).withColumn("one", F.col("seg").bitwiseAND(_bit(F.col("p"))) != 0)
    packed = lambda seg, p: (F.col("side") * 64 + p + 1) * F.lit(1 << 32) + seg
    whole = halves.select("fp", packed(F.col("seg"), F.lit(-1)).alias("k"))
    cleared = F.when(F.col("one"), F.col("seg") - _bit(F.col("p"))).otherwise(F.col("seg"))
    keyed = wild.select("fp", "one", packed(cleared, F.col("p")).alias("k"))
    left = keyed.filter(~F.col("one")).select(F.col("fp").alias("a"), "k").unionByName(whole.select(F.col("fp").alias("a"), "k"))
    right = keyed.filter("one").select(F.col("fp").alias("b"), "k").unionByName(whole.select(F.col("fp").alias("b"), "k"))
    met = left.join(unsized(right), "k")
    same = F.col("k") % F.lit(1 << 38) < F.lit(1 << 32)  # no wildcard: both orders meet, one is enough
    return met.filter(_close(F.col("a"), F.col("b"), most) & (~same | (F.col("a") < F.col("b")))).select("a", "b")


def _block_links(most: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Edges that join what the block's links join, at most one per row."""
        left = block.loc[block["left"], "fp"].to_numpy().view(np.uint64)
        right = block.loc[~block["left"], "fp"].to_numpy().view(np.uint64)
        out: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in left:
            for y in right[np.bitwise_count(right ^ x) <= most]:
                i, j = root(int(x)), root(int(y))
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    out.append((int(x), int(y)))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _crowded_links(halves: DataFrame, sizes: DataFrame, crowded: DataFrame, most: int, block: int) -> DataFrame:
    """Links of fingerprints with a crowded segment, or one bit away from one, block by block.

    A segment's fingerprints are dealt to blocks of about ``block``; a task gets two blocks and compares
    them; it returns only edges that join new parts, so a dense group yields no list of all its pairs.
    """
    near = crowded.select("side", F.col("seg").alias("s"), F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("p")) \
        .withColumn("t", F.when(F.col("p") < 0, F.col("s")).otherwise(
            F.col("s").bitwiseXOR(_bit(F.greatest(F.col("p"), F.lit(0)))))) \
        .select("side", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()
    count = lambda name: sizes.select("side", F.col("seg").alias(name), F.ceil(F.col("n") / block).alias(f"blocks_{name}"))
    pairs = near.join(unsized(count("s")), ["side", "s"]).join(unsized(count("t")), ["side", "t"]) \
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_s") - 1))) \
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_t") - 1))) \
        .filter("s <> t OR i <= j")
    dealt = halves.join(unsized(sizes), ["side", "seg"]).withColumn("at", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block)))
    keys = ["side", "s", "t", "i", "j"]
    first = dealt.select("side", F.col("seg").alias("s"), F.col("at").alias("i"), "fp").join(unsized(pairs), ["side", "s", "i"])
    second = dealt.select("side", F.col("seg").alias("t"), F.col("at").alias("j"), "fp").join(unsized(pairs), ["side", "t", "j"])
    rows = first.select(*keys, "fp", F.lit(True).alias("left")).unionByName(
        second.select(*keys, "fp", F.lit(False).alias("left")))
    return rows.groupBy(*keys).applyInPandas(_block_links(most), "a long, b long")


def links(fps: DataFrame, most: int = 3, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps`` that join all within ``most`` bits (3 at most).

    A fingerprint is cut into two halves. Of two fingerprints with up to three differing bits, one half differs
    by one bit at most, so that one of its one-wildcard variants (or the half itself) is equal: an
    equality join on the variants finds every candidate, and the bit count decides. Where more than ``crowd``
    fingerprints share a half, their links come from blocks instead, reduced to edges that join them.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves find up to three differing bits")
    halves = _halves(fps.select("fp").distinct())
    sizes = halves.groupBy("side", "seg").agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > crowd)
    if crowded.isEmpty():
        return _variant_pairs(halves, most)
    crowded = written(crowded, "crowded")
    sparse = halves.join(crowded, ["side", "seg"], "left_anti")
    return _variant_pairs(sparse, most).unionByName(_crowded_links(halves, sizes, crowded, most, block))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, crowd: int = CROWD,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Rows of equal fingerprint are one node; nodes are linked at ``most`` or fewer differing bits; component_id is
    the smallest doc_id among all rows that can be reached, the row's own included. Repeated rows give
    repeated rows. A null doc_id is passed through and is never a component_id unless its component has no
    other. Null, empty and blank texts share the fingerprint 0. An empty table gives an empty result.
    """
    return grouped(written(fingerprints(docs, shingle), "fingerprints"), lambda nodes: links(nodes, most, crowd, block))


def grouped(signed: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of (doc_id, fp); ``linked`` gives the edges between the fps."""
    nodes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(linked(nodes))
    rooted = nodes.join(unsized(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return signed.join(unsized(named), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group of near-duplicates.

    The document with the smallest doc_id stays; of rows that repeat a doc_id and its text one stays. Rows without
    a doc_id stay, since nothing names them. Columns and their order are those of ``docs``.
    """
    return firsts(docs, near_duplicates(docs, shingle, most), _fingerprint_column(shingle))


def firsts(docs: DataFrame, groups: DataFrame, fingerprint_of: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps, by ``groups`` (doc_id, fingerprint, component_id)."""
    found = written(groups.filter(F.col("doc_id").isNotNull()), "groups")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        stay = found.filter("doc_id = component_id").select("doc_id", F.col("fingerprint").alias("_fp")).distinct()
        again = docs.join(twice, "doc_id", "left_semi").withColumn("_fp", fingerprint_of(F.col("text"))) \
            .join(stay, ["doc_id", "_fp"], "left_semi").dropDuplicates(["doc_id", "_fp"]).drop("_fp")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(again.select(*kept.columns))
    return kept.select(*docs.columns)


def _fingerprint_column(shingle: int):
    @F.pandas_udf("string")
    def column(text: pd.Series) -> pd.Series:
        return text.map(lambda t: f"{fingerprint(t, shingle):016x}")

    return column

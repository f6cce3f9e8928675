"""Substring search by an index of three-letter pieces.

The index holds, for each piece of the searched text, the rows that have it, sorted and cut into ranges by piece, so that a
search reads the row groups of a few pieces. What is found has all of the term's rarest pieces and is verified on the text.
The text is lengthened by two marks, so that a piece starts at each letter and a term of one or two letters is the
beginning of a piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.index import haystack
from postmill.session import shared_dir

SIZE = 3
# Pieces of a term that are looked up, the rarest ones; values that a pushed-down filter tells apart.
RAREST = 3
VALUES = 10
# Bytes of a row group of the index.
GROUP_BYTES = 8 << 20
END = "\u0001"


@dataclass(frozen=True)
class Index:
    """Folders of the postings (gram, key) and of the counts (gram, n)."""

    root: str
    key: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"gram string, {self.key} long").parquet(f"{self.root}/postings")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, n long").parquet(f"{self.root}/counts")


def _pieces(text: Column) -> Column:
    """All runs of SIZE letters, each once; none for a shorter text."""
    def runs(letters: Column) -> Column:
        # The letters beside each other, shifted against themselves: one pass, however long the text is.
        out = letters
        for k in range(2, SIZE + 1):
            out = F.zip_with(out, F.slice(letters, F.lit(k), F.size(letters)), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.slice(out, F.lit(1), F.size(letters) - (SIZE - 1)))

    # Bound to a name, or the text would be cut again for each of its letters.
    cut = F.get(F.transform(F.array(F.split(text, "")), runs), 0)
    return F.when(F.length(text) >= SIZE, cut).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """The pieces that start at each letter of a text."""
    return _pieces(F.concat(text, F.lit(END * (SIZE - 1))))


def build(df: DataFrame, key: str = "scan_pos", root: str | None = None, group_bytes: int = GROUP_BYTES) -> Index:
    """Writes the index of the searched fields of ``df``, whose ``key`` is a long that tells rows apart.

    Postings are sorted by (gram, key), so that a piece that most rows have fills several files.
    """
    root = root or shared_dir(df.sparkSession, "search-index")
    index = Index(root, key)
    rows = df.select(F.col(key).cast("long").alias(key), F.explode(grams(haystack())).alias("gram"))
    rows.select("gram", key).repartitionByRange("gram", key).sortWithinPartitions("gram", key) \
        .write.option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 8)).parquet(f"{root}/postings")
    counts = index.postings(df.sparkSession).groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/counts")
    return index


def _one_of(values: Sequence[str]) -> Column:
    """gram is one of the values, told in parts that each are pushed down as they are."""
    values = sorted(values)
    parts = [F.col("gram").isin(values[k:k + VALUES]) for k in range(0, len(values), VALUES)]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def candidates(spark: SparkSession, index: Index, terms: Sequence[str]) -> DataFrame:
    """(term, key) of the rows that may hold each term, all of one or more letters; the terms' pieces pass through the driver."""
    asked = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").withColumn("low", F.lower("term"))
    found = asked.select("term", "low", _pieces(F.col("low")).alias("grams")).collect()
    wanted = {g for r in found for g in r["grams"]}
    known = {r["gram"]: r["n"] for r in index.counts(spark).filter(_one_of(sorted(wanted))).collect()} if wanted else {}
    chosen, short = [], []
    for r in found:
        if len(r["low"]) < SIZE:
            short.append((r["term"], r["low"]))
        elif all(g in known for g in r["grams"]):
            rare = sorted(r["grams"], key=lambda g: (known[g], g))[:RAREST]
            chosen += [(r["term"], g, len(rare)) for g in rare]
    postings = index.postings(spark)
    pairs = spark.createDataFrame(chosen, "term string, gram string, wanted int")
    met = postings.filter(_one_of({g for _, g, _ in chosen})).join(pairs, "gram")
    out = met.groupBy("term", index.key).agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")) \
        .filter("n = wanted").select("term", index.key)
    for term, low in short:
        begins = postings.filter(F.startswith("gram", F.lit(low))).select(F.lit(term).alias("term"), index.key)
        out = out.unionByName(begins.distinct())
    return out


def lookup(df: DataFrame, index: Index, terms: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that hold each term in the searched fields, case-insensitively, with ``term``; '' finds all.

    ``df`` must be the rows that were indexed. Repeated terms count once; a null key is never found but by ''.
    """
    spark = df.sparkSession
    out = df.join(candidates(spark, index, [t for t in terms if t]), index.key).where(F.contains(haystack(), F.lower("term")))
    return out.unionByName(df.withColumn("term", F.lit("")).select(*out.columns)) if "" in terms else out

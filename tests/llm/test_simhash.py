import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import graph, simhash

BLANKS = " \t\n\r\x0b\x0c"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in BLANKS:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, most=3):
    """{node: least node of its component}, comparing all pairs."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= most and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def plain_rows(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for i, f in prints), key=str)


def signed(values):
    return [(int(v),) for v in np.array(values, dtype=np.uint64).view(np.int64)]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == plain_rows(rows)


def test_odd_rows(odd_docs, odd_rows):
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=str) == plain_rows([r[:2] for r in odd_rows])


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize(("crowd", "block"), [(256, 2048), (1, 3), (4, 2), (0, 1000)])
def test_links_join_what_all_pairs_join(spark, crowd, block):
    r = np.random.default_rng(3)
    centres = [int(x) for x in r.integers(0, 1 << 63, size=6)]
    values = set(centres) | {0}
    for _ in range(150):  # walks of few bits around some centres, so that halves are crowded
        x = centres[int(r.integers(0, 3))]
        for b in r.choice([1, 2, 5, 33, 34, 40, 60, 63], size=int(r.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    for shift in range(64):  # one bit in every place
        values.add(centres[4] ^ (1 << shift))
    found = simhash.links(spark.createDataFrame(signed(sorted(values)), "fp long"), 3, crowd, block).collect()
    edges = {(e.a % (1 << 64), e.b % (1 << 64)) for e in found}
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in edges)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(v) for v in values} == plain_components(values)


def broadcast(df):
    """The kinds of the joins that Spark would broadcast a side of."""
    return re.findall(r"Broadcast\w+Join.*(Inner|LeftOuter|RightOuter|LeftAnti|LeftSemi)",
                      df._jdf.queryExecution().executedPlan().toString())


def test_variants_are_not_broadcast_however_small_their_table_looks(spark, tmp_path):
    # The table of fingerprints is far below Spark's bound, the table of their variants is 33 times as long.
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    fps = spark.read.parquet(str(tmp_path / "fps"))
    assert broadcast(simhash.links(fps)) == []
    # Crowded halves are a small written table that the fingerprints are filtered by.
    assert set(broadcast(simhash.links(fps, crowd=0))) <= {"LeftAnti"}


def test_components_are_joined_without_a_broadcast(spark, tmp_path):
    # All nodes hang below one, so that the written edges are far smaller than their rows.
    spark.range(1, 3000).selectExpr("id AS a", "0L AS b").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    assert broadcast(graph._large_star(edges)) == broadcast(graph._small_star(edges)) == []
    signed = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("fp"))
    # The roots of the fingerprints and the names of all rows; the first ids of components are sized as they are made.
    assert len(broadcast(simhash.grouped(signed, lambda nodes: edges))) <= 1


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError, match="three"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_keep_one(odd_docs, odd_rows, spark):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    # 1, 2 and 2 are equal; 4, 5 and 6 have no words; the two rows without a doc_id stay.
    assert ids == {1: 1, 3: 1, None: 2, 4: 1, 7: 1, 8: 1, 9: 1, 10: 1}


def test_a_doc_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (5, "v w x y z")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, "a b c d e"), (5, "v w x y z")]


def test_components_of_a_chain_a_star_and_a_loop(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (9, 3), (3, 9)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(200, 260)} | {7: 7, 3: 3, 9: 3}
    assert got == want
    assert graph.components(edges.limit(0)).collect() == []

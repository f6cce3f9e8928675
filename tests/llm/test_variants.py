import collections
import re
import zlib

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from postmill.llm import variants


def plain_words(rows, least=7, least_count=2):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_grouped(counts):
    words = sorted(counts)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, counts[w], len(near[w]), f and counts[f]))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return rows_of(variants.grouped(words))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_words((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert rows_of(variants.variants(docs)) == plain_grouped(want)


def test_odd_rows(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 10)
    assert rows_of(variants.variants(odd_docs)) == plain_grouped(plain_words(r[:2] for r in odd_rows))
    assert variants.variants(no_docs).collect() == []


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_words_over_few_letters(spark, coalesce):
    """Dense neighbourhoods, runs of equal letters, words that begin other words, and ranges that share beginnings."""
    r = np.random.default_rng(5)
    counts = {"".join(r.choice(list("abé"), size=int(r.integers(1, 8)))): int(10 ** r.uniform(0, 4)) for _ in range(700)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert grouped(spark, counts) == plain_grouped(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_beginnings_shared_over_many_ranges(spark):
    counts = {"z" * k: k for k in range(1, 60)} | {"z" * 30 + "y" * k: 5 for k in range(1, 40)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        assert grouped(spark, counts) == plain_grouped(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_forms_are_followed_to_the_last_and_ties_go_by_order(spark):
    counts = {f"abcdefg{'h' * k}": 2 * 10**k for k in range(9)} | {"zzzzzzx": 90, "zzzzzzy": 90, "zzzzzzw": 9}
    got = grouped(spark, counts)
    assert got == plain_grouped(counts)
    by_word = {row[0]: row for row in got}
    assert by_word["abcdefg"][2] == "abcdefg" + "h" * 8
    assert by_word["zzzzzzw"][1] == "zzzzzzx"


def test_very_long_words(spark):
    base = "".join(prose(1, 5000).split())
    counts = {base: 50, base[:-1]: 4, base[:1000] + "q" + base[1001:]: 3, base[::-1]: 2}
    assert grouped(spark, counts) == plain_grouped(counts)


def test_carried_owners_chain_over_ranges():
    own = variants.number
    ends = [(0, "ab", "abcd", [own(0, 0)] * 2 + [own(0, 3)] * 2), (2, "abce", "abcf", [own(2, 0)] * 3 + [own(2, 5)]),
            (3, "abcg", "b", [own(3, 9)]), (4, "c", "c", [own(4, 0)])]
    assert variants._carried(ends) == [(2, [own(0, 0), own(0, 0), own(0, 3)]), (3, [own(0, 0), own(0, 0), own(0, 3)])]


def test_no_pairs_of_words_are_listed(spark):
    """A word in 90 forms: rows grow with the words, not with their pairs."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"abc{x}defg": 2 for x in letters}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    _, forward = variants._numbered(words, "word", "n")
    assert variants.pairs_of(forward).count() <= 20 * len(counts)
    out = variants.grouped(words)
    assert {r.n_near for r in out.collect()} == {len(letters) - 1}
    assert out.filter(F.col("form").isNotNull()).count() == 0

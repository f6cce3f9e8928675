"""The index of three-letter pieces against a scan of all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postmill.operators import index, search

FIELDS = index.SEARCHED_FIELDS
WORDS = ["Straße", "aaaa", "re:", "übung", "日本語の本", "😀smile", "x", "ab", "Meeting", "2024-01-02", "a" * 60, "", "%_"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, *(r.choice([None, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 4)))]) for _ in FIELDS)) for i in range(400)]
    return out + [(400 + i, "shared by most rows", "x", None, "", "") for i in range(600)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "scan_pos long, " + ", ".join(f"`{f}` string" for f in FIELDS) + "").withColumn("gram", F.lit("z"))


def hay(row):
    return " ".join(v or "" for v in row[1:]).lower()


def test_lookup_equals_a_scan(spark, rows, frame):
    r = random.Random(8)
    texts = [hay(row) for row in rows]
    terms = {"", "a", "x", "aa", "日", "😀", "ß", "zzz", "STRASSE", "Straße", "aaa", "aaaaa", "a" * 60, "a" * 61, "shared by most rows", "y x", "ws x", "%", "_", " "}
    while len(terms) < 100:
        text = r.choice(texts)
        at = r.randrange(len(text) + 1)
        terms.add(text[at:at + r.randint(1, 9)].upper() if r.random() < 0.3 else text[at:at + r.randint(1, 9)])
    terms = [t for t in terms if len(t.upper()) == len(t)]
    built = search.build(frame.repartition(3))
    got = sorted((x.term, x.scan_pos) for x in search.lookup(frame, built, terms).collect())
    assert got == sorted((t, row[0]) for t in terms for row, text in zip(rows, texts, strict=True) if t.lower() in text)


def test_one_row_per_piece_and_row(spark, rows, frame):
    built = search.build(frame)
    want = {(h[k:k + 3], row[0]) for row in rows for h in [hay(row) + search.END * 2] for k in range(len(h) - 2)}
    assert {(x.gram, x.scan_pos) for x in built.postings(spark).collect()} == want
    assert built.postings(spark).count() == len(want)
    assert sum(x.n for x in built.counts(spark).collect()) == len(want)


def scanned(df):
    """Rows that the scans of an executed plan gave, before any filter."""
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


def test_only_the_row_groups_of_the_pieces_are_read(spark):
    texts = [(i, f"{(i * 7919) % 100_003:06x} {(i * 104_729) % 1_000_003:06x}", "", "", "", "") for i in range(40_000)]
    frame = spark.createDataFrame(texts, "scan_pos long, " + ", ".join(f"`{f}` string" for f in FIELDS))
    built = search.build(frame, group_bytes=4096)
    total = built.postings(spark).count()
    term = texts[777][1][:6]
    found = search.candidates(spark, built, [term])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "gram" in plan.split("PushedFilters: [")[1][:80]
    assert 0 < scanned(found) < total / 10
    assert scanned(search.candidates(spark, built, ["zz"])) < total / 10
    assert 777 in {r.scan_pos for r in search.lookup(frame, built, [term]).collect()}


def test_empty_tables_and_terms(spark, frame):
    none = frame.limit(0)
    built = search.build(none)
    assert search.lookup(none, built, ["a", "abc", ""]).collect() == []
    assert search.lookup(frame, search.build(frame), []).collect() == []


def test_pieces_of_a_long_text_take_one_pass(spark):
    """Cutting the text anew for each letter took minutes here."""
    n = 200_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n // 6)), lambda i: F.lpad((i * 7919 % 99_991).cast("string"), 5, "0")))
    rows = spark.range(1).select(text.alias("t")).localCheckpoint()
    start = time.time()
    got = set(rows.select(F.explode(search.grams(F.col("t"))).alias("g")).toPandas()["g"])
    assert time.time() - start < 60
    whole = rows.first()["t"] + search.END * 2
    assert got == {whole[k:k + 3] for k in range(len(whole) - 2)}

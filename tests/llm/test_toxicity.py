import math
import random
import zlib

import numpy as np
import pytest

from postmill.llm import queries, toxicity

BAD = ["loser", "trashy", "lowei"]


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("etaoinsrhd") for _ in range(r.randint(2, 6))) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randint(0, len(words)), r.choice(BAD[:2] + [BAD[2] + r.choice("abcdefgh")]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def planted(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 or i % 5 == 0], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(planted):
    rows, docs, labels = planted
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(r.held_out == out(i) for i, r in got.items())
    test = [(got[i].predicted, y) for i, _, y in rows if out(i)]
    assert np.mean([p for p, y in test if y]) > 0.95
    assert np.mean([p for p, y in test if not y]) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_held_out_labels_change_nothing(planted, spark):
    rows, docs, labels = planted
    turned = spark.createDataFrame([(r.doc_id, 1 - r.toxic if out(r.doc_id) else r.toxic) for r in labels.collect()],
                                   "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.scored(docs, turned).collect()}
    assert a == b


def test_the_risk_is_kept_from_going_negative():
    """All unlabelled texts hold the positives' bucket: a plain difference of risks would go far below zero."""
    positive = np.array([True] * 20 + [False] * 400)
    bucket = np.concatenate([np.zeros(20), np.zeros(60), np.arange(1, 341)]).astype(np.int32)
    model = toxicity.fit(positive, bucket, np.ones(420, dtype=np.int64), prior=0.1)
    assert model.weights[0] > 0 and np.isfinite(model.bias) and abs(model.bias) < 30


def test_sample_and_query_on_the_tables(spark, sf_dir):
    got = queries.op3_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    small = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                   spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.Sample(5, 7))
    assert small[0].sum() <= 5 and (~small[0]).sum() == 7 and small[2].sum() == len(small[1])


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    got = toxicity.scored(odd_docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r.doc_id or 0 for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert {r.predicted for r in toxicity.scored(odd_docs, no_labels).collect()} == {0}
    assert toxicity.scored(no_docs, labels).collect() == []
    kept = toxicity.keep(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def plain_risk(f, positive, prior):
    """(prior * loss(P, +), loss(U, -) - prior * loss(P, -)) by loops over the texts."""
    loss = lambda x, sign: math.log1p(math.exp(-sign * x))
    mean = lambda values: sum(values) / len(values)
    pos, unl = [x for x, p in zip(f, positive, strict=True) if p], [x for x, p in zip(f, positive, strict=True) if not p]
    return prior * mean([loss(x, 1) for x in pos]), mean([loss(x, -1) for x in unl]) - prior * mean([loss(x, -1) for x in pos])


@pytest.mark.parametrize(("shift", "negative"), [(0.0, False), (3.0, True)])
def test_risk_and_slope_equal_plain_loops(shift, negative):
    r = np.random.default_rng(4)
    positive = np.arange(30) % 3 == 0
    f = r.normal(size=30) + np.where(positive, shift, -shift)
    prior = 0.6
    first, rest = plain_risk(f, positive, prior)
    value, slope = toxicity.risk(f, positive, prior)
    assert (rest < 0) == negative and value == pytest.approx(first + max(0.0, rest))
    for k in range(30):
        up, down = f.copy(), f.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        goal = [(-b if negative else a + b) for a, b in (plain_risk(up, positive, prior), plain_risk(down, positive, prior))]
        assert slope[k] == pytest.approx((goal[0] - goal[1]) / 2e-6, abs=1e-6)


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    """An id on a third of all rows brings one of them, the same whatever the order of the rows."""
    rows = [(1, f"word{i} loser trashy") for i in range(3000)] + [(i, f"text{i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    found = [toxicity.training_rows(spark.createDataFrame(some, "doc_id long, text string"), labels, toxicity.Sample())
             for some in (rows, rows[::-1])]
    assert found[0][0].sum() == 1 and len(found[0][0]) < 50
    assert all((a == b).all() for a, b in zip(found[0][:3], found[1][:3], strict=True))

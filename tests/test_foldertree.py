"""The walk around a tree against a plain depth-first visit."""

import random

import pytest

from postmill.operators import foldertree

SCHEMA = "folder string, parent string, place int, messages int, depth string"


def plain_order(rows):
    kids = {}
    names = {r[0] for r in rows}
    for folder, parent, place, messages in rows:
        kids.setdefault(parent if parent in names else None, []).append((place or 0, folder, messages or 0))
    out, seen = {}, 0
    todo = [(k, 0) for k in sorted(kids.get(None, []), reverse=True)]
    order = []
    while todo:
        (_, folder, messages), depth = todo.pop()
        out[folder] = [len(order), depth, 1, seen, messages]
        order.append(folder)
        seen += messages
        todo += [(k, depth + 1) for k in sorted(kids.get(folder, []), reverse=True)]
    parents = {r[0]: r[1] for r in rows}
    for folder in reversed(order):
        parent = parents[folder]
        if parent in out:
            out[parent][2] += out[folder][2]
            out[parent][4] += out[folder][4]
    return {f: tuple(v) for f, v in out.items()}


def got_order(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return {r.folder: tuple(r)[1:] for r in foldertree.tree_order(df).collect()}


def random_tree(n, seed):
    r = random.Random(seed)
    return [(f"f{i}", None if not i else f"f{r.randrange(max(0, i - r.choice([1, 1, 5, 300])), i)}", r.choice([0, 1, 5000, 9000, None]), r.randint(0, 9))
            for i in range(n)]


@pytest.mark.parametrize("rows", [
    random_tree(300, 1), [("a", None, 0, 3)], [("a", None, 1, 3), ("b", None, 0, 2), ("c", "gone", 0, None), ("d", "b", 0, 1)],
    [("r", None, 0, 1)] + [(f"k{i}", "r", -i, i % 4) for i in range(3000)]], ids=["random", "one", "tops", "hub"])
def test_order_equals_a_visit(spark, rows):
    assert got_order(spark, rows) == plain_order(rows)


def test_a_path_of_two_thousand_folders_with_a_hub_of_ten_thousand(spark):
    rows = [(f"p{i}", f"p{i - 1}" if i else None, 0, 1) for i in range(2000)] + [(f"h{i}", "p1000", i + 1, 2) for i in range(10_000)]
    assert got_order(spark, rows) == plain_order(rows)


@pytest.mark.parametrize("rows", [[("a", "a", 0, 1)], [("a", "b", 0, 1), ("b", "a", 0, 1)],
                                  [("r", None, 0, 1), ("a", "c", 0, 1), ("b", "a", 0, 1), ("c", "b", 0, 1), ("d", "c", 1, 1)]])
def test_cycles_raise(spark, rows):
    with pytest.raises(ValueError, match="cycle"):
        got_order(spark, rows)


def test_repeated_and_null_folders_raise_and_no_folders_have_no_order(spark):
    for rows in ([("a", None, 0, 1), ("a", None, 0, 1)], [(None, None, 0, 1)]):
        with pytest.raises(ValueError, match="told apart"):
            got_order(spark, rows)
    assert foldertree.tree_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_messages_get_their_place_in_the_visit(spark):
    order = foldertree.tree_order(spark.createDataFrame([("r", None, 0, 2, ""), ("b", "r", 1, 1, ""), ("a", "r", 2, 2, "")], SCHEMA))
    messages = spark.createDataFrame([("a", 7, "x"), ("r", 5, "y"), ("b", 1, "z"), ("r", 2, "w"), ("a", 900_000, "v")], "folder string, pos long, n string")
    got = {r.n: r.scan_index for r in foldertree.scan_index(messages, order, block=4).collect()}
    assert got == {"w": 0, "y": 1, "z": 2, "x": 3, "v": 4}

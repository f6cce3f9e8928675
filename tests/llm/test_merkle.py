import hashlib
import zlib

import pytest

from postmill.llm import merkle, places


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def plain_levels(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_siblings(levels, at, arity):
    out = []
    for level in levels[:-1]:
        base = at - at % arity
        out.append(("".join(level[base:at]), "".join(level[at + 1:base + arity])))
        at //= arity
    return out


def plain_rows(rows, arity=8):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        levels[name] = plain_levels([x[2] for x in trees[name]], arity)
    top = plain_levels([levels[name][-1][0] for name in names], arity)
    out = []
    for j, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(trees[name]):
            steps = plain_siblings(levels[name], i, arity) + plain_siblings(top, j, arity)
            h = leaf
            if r.doc_id is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                h = plain_leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            for left, right in steps:
                h = sha(left + h + right)
            root = top[-1][0]
            out.append((r.doc_id, leaf, levels[name][-1][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def got_rows(df, arity=8):
    return sorted(map(tuple, merkle.audited(df, arity).collect()), key=str)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_equals_brute_force(spark, sf_dir, arity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = got_rows(docs, arity)
    assert got == plain_rows(docs.collect(), arity)
    assert 0 < sum(row[-1] for row in got) < len(got)


def test_odd_rows(odd_docs, no_docs):
    assert got_rows(odd_docs) == plain_rows(odd_docs.collect())
    out = merkle.audited(no_docs)
    assert out.collect() == []
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 1, "": 1}, {"en": 8, "é": 9, "z": 65}, {None: 64, "a": 1, "b": 7}, {f"x{i}": 1 for i in range(20)}])
def test_sizes_of_trees(spark, sizes):
    rows = [(1000 * k + i * 7 % 101, None, lang, i, f"Text {i}") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    docs = docs_of(spark, rows).repartition(4)
    assert got_rows(docs) == plain_rows(docs.collect())


def test_a_language_and_an_id_with_most_rows(spark):
    rows = [(5, "s", "en", 3, "Same")] * 300 + [(5, "s", "en", 3, f"Other {i}") for i in range(40)] + [(i, "s", "de", 1, "Q") for i in range(9)]
    docs = docs_of(spark, rows).repartition(5)
    assert got_rows(docs) == plain_rows(docs.collect())


def test_null_and_text_of_a_dash_differ(spark):
    docs = docs_of(spark, [(1, None, "en", 1, "-"), (1, "-", "en", 1, None), (1, "-", "en", 1, "-")])
    assert len({row[1] for row in got_rows(docs)}) == 3


def test_places_are_a_permutation_in_order(spark):
    rows = [("a" if i % 3 else "b", i * 37 % 500, str(i)) for i in range(500)] + [("c", 1, "x")]
    found = places.placed(spark.createDataFrame(rows, "tree string, k long, v string").repartition(7), "tree", ["k"]).collect()
    for tree in "abc":
        mine = sorted((r.idx, r.k) for r in found if r.tree == tree)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [k for _, k in mine] == sorted(k for _, k in mine)
        assert {r.n for r in found if r.tree == tree} == {len(mine)}


def test_one_slot_is_refused(spark):
    with pytest.raises(ValueError, match="two slots"):
        merkle.audited(docs_of(spark, [(1, None, None, 0, "")]), 1)

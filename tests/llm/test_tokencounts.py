import random

import public_tokenizers
import pytest
import tiktoken

from postmill.llm import bpe, queries, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.ids, special_tokens={})


def test_edits_keep_the_counts_exact(coder, reference, monkeypatch):
    monkeypatch.setattr(tokencounts, "LEAF", 4)
    monkeypatch.setattr(tokencounts, "LEAF_MOST", 16)
    r = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "r", "e", "1", "23", ".", "!?", " x", "é", "日", "\t"]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 300)))
        tree = tokencounts.TokenTree(text, coder)
        for _ in range(12):
            start = r.randint(0, len(text))
            end = min(len(text), start + r.choice([0, 0, 1, 2, 5, 60]))
            new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 8, 90])))
            text = text[:start] + new + text[end:]
            tree.replace(start, end, new)
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(reference.encode_ordinary(text))


def test_an_edit_encodes_only_its_surroundings(coder):
    tree = tokencounts.TokenTree("some words here " * 5000, coder)
    tree.replace(40000, 40004, "other")
    assert tree.encoded < 100


def test_edits_outside_are_refused(coder):
    with pytest.raises(ValueError, match="outside"):
        tokencounts.TokenTree("abc", coder).replace(2, 9, "")


def edited(text):
    for start, end, new in tokencounts.redactions(text):
        text = text[:start] + new + text[end:]
    return text


def test_redactions():
    text = "mail a.b@mail1.example.com from 10.0.0.255, key da3fe1beadc3e135f8 card 4328024104680480 and 12345"
    assert edited(text) == "mail [email] from [address], key [secret] card [number] and 12345"


def rows_of(reference, rows):
    out = []
    for i, text in rows:
        after = edited(text or "")
        out.append((i, len(reference.encode_ordinary(text or "")), len(tokencounts.redactions(text or "")),
                    len(reference.encode_ordinary(after)), len(after)))
    return sorted(out, key=str)


def test_query_equals_counting_again(spark, sf_dir, reference):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op6_token_counts(spark, sf_dir).drop("n_encoded_again").collect()
    assert sorted(map(tuple, got), key=str) == rows_of(reference, rows)
    assert any(r.n_edits for r in got)


def test_odd_rows(odd_docs, odd_rows, no_docs, reference):
    run = lambda docs: tokencounts.counted(docs, PATH, public_tokenizers.PATTERN).drop("n_encoded_again").collect()
    assert sorted(map(tuple, run(odd_docs)), key=str) == rows_of(reference, [r[:2] for r in odd_rows])
    assert run(no_docs) == []

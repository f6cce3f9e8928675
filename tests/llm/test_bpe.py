import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from postmill.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.ids, special_tokens={})


def texts():
    r = random.Random(4)
    out = ["", " ", "a", "\n\n  x", "it's we're I'LL", "<|endoftext|>", "日本語 ü 1234 ½ ²", "x" * 3000, "ab" * 700, "\x1c\x1d\x85\xa0a"]
    for _ in range(300):
        out.append("".join(r.choice("abcdefghij  \n'é日.1🙂　") for _ in range(r.randint(1, 300))))
    return out


def test_ids_are_the_librarys(coder, reference):
    for text, ids in zip(texts(), coder.encode_all(texts()), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_every_code_point_is_split_as_the_library_does(coder, reference):
    points = [chr(c) for c in [*range(0x3000), *range(0xD7A0, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1F700)]]
    batch = [f"a{c}1{c} {c}{c}b." for c in points]
    want = reference.encode_ordinary_batch(batch, num_threads=4)
    assert [ids.tolist() for ids in coder.encode_all(batch)] == want


def test_one_by_one_and_many_at_once_agree(coder):
    r = random.Random(9)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(2, 60))).encode() for _ in range(400)]
    assert [ids.tolist() for ids in bpe.merge_many(words, coder.ranks)] == [bpe.merge_one(w, coder.ranks) for w in words]


def test_a_very_long_text_goes_step_by_step(coder, reference, monkeypatch):
    text = "the that 12 ing\n" * 5000
    monkeypatch.setattr(bpe, "WHOLE_TEXT", 1000)
    monkeypatch.setattr(bpe, "STEP", 333)
    assert coder.encode_all([text])[0].tolist() == reference.encode_ordinary(text)


def test_forgetting_changes_nothing(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in texts()[:40]:
        assert coder.encode_all([text])[0].tolist() == reference.encode_ordinary(text)


def digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_query_equals_the_library(spark, sf_dir, reference):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_byte_bpe(spark, sf_dir).collect()}
    assert got == {i: digests(reference, t) for i, t in rows.items()}


def test_odd_rows(odd_docs, odd_rows, no_docs, reference):
    vocabulary = (PATH, public_tokenizers.PATTERN)
    run = lambda docs: bpe.digests(bpe.decode(bpe.encode(docs, *vocabulary), *vocabulary)).collect()
    want = sorted([(r[0], *digests(reference, r[1])) for r in odd_rows], key=str)
    assert sorted(map(tuple, run(odd_docs)), key=str) == want
    both = bpe.digests(bpe.round_trip(odd_docs, *vocabulary)).collect()
    assert sorted(map(tuple, both), key=str) == want and bpe.round_trip(no_docs, *vocabulary).collect() == []
    assert run(no_docs) == []

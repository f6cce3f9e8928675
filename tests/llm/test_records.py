import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm import records
from postmill.session import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = records.Encoder(PATH)


def encoded(encoder, texts):
    return [np.frombuffer(i, encoder.kind).tolist() for i in encoder.encode([t.encode() for t in texts])]


def plain_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def plain_rows(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = plain_ids(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, records.round_trip(docs.repartition(5), PATH, file_bytes=20_000).collect()))
    assert got == plain_rows(rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, records.round_trip(odd_docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    want = plain_rows([r[:2] for r in odd_rows])
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert records.round_trip(no_docs, PATH).collect() == []


BLANKS = "".join(map(chr, [*range(9, 14), 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF, 0x200B]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAİIıΣςß'’sd́̇é12<|>.,;!)\"\x01" + BLANKS), st.characters(codec="utf-8")), max_size=40), max_size=3))
def test_chunks_give_what_whole_texts_give(texts):
    got = encoded(ENCODER, texts)
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|ENDOFTEXT|>.", "Don't, DON'T! 'Stop'. it's). a-, a.-. É.\"", "x.,;:!?)\".", "E\u0301. e\u0301."])
def test_stems_and_marks(text):
    assert encoded(ENCODER, [text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_long_texts_are_cut_at_blanks(monkeypatch):
    texts = [prose(3, 3000) + "\t" + "x" * 5000 + " end", "y" * 4000, "", "a b"]
    monkeypatch.setattr(records, "PART_BYTES", 1000)
    got = encoded(records.Encoder(PATH), texts)
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 3)
    texts = [prose(k, 20) for k in range(5)]
    encode = records.Encoder(PATH)
    for t in texts:
        assert encoded(encode, [t, t]) == [LIBRARY.encode(t, add_special_tokens=False).ids] * 2


@pytest.fixture
def dataset(spark):
    rows = [(i, prose(i, i % 40)) for i in range(300)] + [(None, "no id"), (7, "again")]
    return records.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shared_dir(spark, "records"),
                         PATH, file_bytes=2000)


def test_files_say_what_they_hold(spark, dataset, monkeypatch):
    again = records.opened(dataset.root)
    assert again == dataset and len(dataset.files) > 3
    monkeypatch.setattr(records, "SLICE", 7)
    read = records.read(spark, again).collect()
    assert len(read) == 302 and sum(r.n_tokens for r in read) == sum(f[2] for f in dataset.files)
    for r in read:
        assert len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        if r.doc_id is not None and r.doc_id != 7:
            assert np.frombuffer(r.ids, "<u4").tolist() == plain_ids(prose(r.doc_id, r.doc_id % 40))


def test_shuffled_reads_give_each_record_once(spark, dataset):
    orders = [[r.start for r in records.shuffled(spark, dataset, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(orders[0]) == sorted(orders[2]) == sorted(r.start for r in records.read(spark, dataset).collect())
    assert orders[0] != sorted(orders[0])


@pytest.mark.parametrize("width", [2, 4])
def test_frames(width):
    data = b"".join(records.frame(i, np.full(i, i, f"<u{width}").tobytes(), width) for i in range(4)) + records.frame(None, b"", width)
    at, found = 0, []
    while at < len(data):
        doc_id, ids, at = records.unframe(memoryview(data), at)
        found.append((doc_id, np.frombuffer(ids, "<u4").tolist()))
    assert found == [*((i, [i] * i) for i in range(4)), (None, [])]


@pytest.mark.parametrize("at", [0, 5, 9, 14, 22, 27, 32])
def test_a_changed_byte_is_noticed(at):
    data = bytearray(records.frame(5, b"abcdefgh"))
    data[at] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(memoryview(bytes(data)))
    with pytest.raises((ValueError, struct.error)):
        records.unframe(memoryview(records.frame(5, b"abcdefgh"))[:-3])

"""Charset choice: marks, zero bytes, pairs of bytes, and what is left unsure."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import attachments
from postmill.operators import charsets as CS
from postmill.sources import sample

SCHEMA = "k long, content binary, charset string"


@pytest.fixture(scope="module")
def contents(spark, sf_dir):
    return sample.reencoded(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def model(contents):
    return CS.learn(contents)


def plain_model(rows):
    """Log-likelihoods by counting pairs one at a time."""
    counts = {}
    for data, charset in rows:
        if charset in CS.CHARSETS:
            here = counts.setdefault(charset, Counter())
            here.update((a, b) for a, b in zip(data, data[1:], strict=False) if a > 127 or b > 127)
    return {c: (n, sum(n.values()) + CS.PRIOR * 65536) for c, n in counts.items()}


def test_model_equals_plain_counts(contents, model, monkeypatch):
    want = plain_model([(bytes(r.content), r.charset) for r in contents.collect()])
    assert set(model.charsets) == set(want)
    for k, charset in enumerate(model.charsets):
        n, total = want[charset]
        for (a, b), times in n.items():
            assert model.scores[k, a * 256 + b] == pytest.approx(math.log((times + CS.PRIOR) / total), rel=1e-4)
    monkeypatch.setattr(CS, "PART", 7)
    data = random.Random(1).randbytes(1000)
    assert {(int(p) >> 8, int(p) & 255): int(CS.telling_pairs(data)[p]) for p in np.flatnonzero(CS.telling_pairs(data))} == Counter(
        (a, b) for a, b in zip(data, data[1:], strict=False) if a > 127 or b > 127)


def test_accuracy_on_texts_that_were_not_learned(contents):
    """Learned on half of the documents, asked for 60 characters here and there of the other half."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = CS.learn(contents.filter(half))
    right = asked = 0
    for r in contents.filter(~half).collect():
        if r.charset in CS.CHARSETS:
            for at in range(0, len(r.written), 200):
                part = r.written[at:at + 60].encode(CS.codec_of(r.charset), errors="replace")
                if sum(x > 127 for x in part) >= 3 and CS._decoded(part, "utf-8") is None:
                    asked += 1
                    right += CS.guess(part, model)[0] == r.charset
    assert asked > 300 and right / asked > 0.95


def test_marks_zero_bytes_and_utf8(model):
    text = "Grüße an alle"
    assert CS.guess(b"\xef\xbb\xbf" + text.encode(), model) == ("utf-8", 1.0, text)
    for charset, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        assert CS.guess(mark + text.encode(charset), model) == (charset, 1.0, text)
        assert CS.guess(text.encode(charset), model) == (charset, 1.0, text)
    assert CS.guess(text.encode(), model) == ("utf-8", 1.0, text)
    assert CS.guess(b"", model) == ("utf-8", 1.0, "")
    assert CS.guess(b"a\0b", model) == ("utf-8", 1.0, "a\0b")


def test_what_is_unsure_is_utf8_with_replacement(model, spark):
    charset, confidence, text = CS.guess(b"\xff", model)  # one byte makes no pair
    assert (charset, confidence, text) == ("utf-8", 0.0, "�")
    equal = CS.Model(("windows-1252", "koi8-r"), np.zeros((2, 1 << 16), np.float32))
    assert CS.guess(b"ab\xe9cd", equal) == ("utf-8", 0.5, "ab�cd")
    assert CS.guess("カタカナ".encode("shift_jis")[:-1], model)[0] == "shift_jis"
    none = CS.learn(spark.createDataFrame([], SCHEMA))
    assert none.charsets == () and CS.guess(b"ab\xe9cd", none)[0] == "utf-8"


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, b"", None), (3, b"plain", "utf-8"), (3, b"plain", "utf-8"), (None, b"\xef\xbb\xbfx", ""),
            (4, "тхе хоусе оф тхе роад ".encode("koi8-r") * 100_000, "x"), (5, b"\xc3\x28", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("charset", "note").withColumn("other", F.lit(1))
    got = sorted(((r.k or 0, r.charset, r.text and r.text[:5]) for r in CS.decode_guess(df, model).collect()), key=str)
    assert got[:5] == [(0, "utf-8", "x"), (1, None, None), (2, "utf-8", ""), (3, "utf-8", "plain"), (3, "utf-8", "plain")]
    assert got[5] == (4, "koi8-r", "тхе х") and len(got) == len(rows)
    assert CS.decode_guess(df.limit(0), model).collect() == []


def test_attachments_are_read_with_it(spark, model):
    rows = [(1, "a.txt", "анд тхе хоусе стоод оф роад".encode("koi8-r")), (2, "b.bin", b"\xe9\xe9"),
            (3, "c.txt", "ü".encode())]
    att = spark.createDataFrame(rows, "attachment_index int, safe_name string, content binary")
    plain = {r.attachment_index: r.extracted_text for r in attachments.describe_content(att).collect()}
    read = CS.reader(spark, model)
    guessed = {r.attachment_index: r.extracted_text for r in attachments.describe_content(
        att, decode=lambda c: read(c)["text"]).collect()}
    assert "�" in plain[1] and "хоусе" in guessed[1]
    assert plain[2] is guessed[2] is None and plain[3] == guessed[3] == "ü"


def test_a_lone_accent_in_ascii_text_is_of_a_charset_with_few(spark):
    """In iso-8859-2 each e is learned as an ogonek, so its pairs are the likelier ones, but no such text has only one."""
    dense = "dęs lęs ęquę nęq tęrrę"
    sparse = "des les equipes de la terre sont venues par la route et la ville "
    rows = [(i, (dense if i % 2 else sparse + ("anêque" if i % 20 == 0 else "fête")).encode("iso-8859-2" if i % 2 else "cp1252"), "iso-8859-2" if i % 2 else "windows-1252")
            for i in range(200)]
    model = CS.learn(spark.createDataFrame(rows, SCHEMA))
    data = "la ville et la route des gens de la terre et anêque chpation le des le la".encode("cp1252")
    bare = CS.Model(model.charsets, model.scores)
    assert CS.guess(data, bare)[0] == "iso-8859-2"
    assert CS.guess(data, model)[0] == "windows-1252"
    # The share counts once, so many pairs outweigh it.
    mixed = b"a line of plain text here\n" * 400 + dense.encode("iso-8859-2") * 5
    assert CS.guess(mixed, model)[0] == "iso-8859-2"

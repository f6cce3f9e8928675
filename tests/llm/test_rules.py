import random
import re
import string

import pytest
import zstandard

from postmill.llm import queries, rules

PACK = zstandard.ZstdCompressor(level=3)


def plain(text):
    """The base counts, by their definition."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)} if len(windows) < 900 else None
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen, dups = set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, None if covered is None else len(covered)


def test_base_counts(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        n_words, chars, symbols, dups, repeat = plain(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n_words, chars, symbols, dups)
        if repeat is not None:
            assert r.n_repeat_words == repeat
        assert r.base_failed == (n_words < 20 or 100 * r.n_repeat_words > 30 * n_words)
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("words", [
    "a b c d e f g h a b c d e f g h".split(), ["x"] * 9, ["x"] * 8, list("abcdefgh"), [],
    "q a b c d e f g h r s a b c d e f g h t".split(), [str(i % 11) for i in range(40)]])
def test_repeated_words(words):
    assert rules.repeated_words([w.encode() for w in words]) == plain(" ".join(words))[4]


def verdict(text):
    return rules.judge(text, rules.Bands(), PACK)


def test_bands(odd_rows):
    prose = odd_rows[0][1]
    assert verdict(prose)[-1]
    assert not verdict("same words and again " * 400)[-1]
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(9)) for _ in range(400))
    assert not verdict(noise)[5] and not verdict(noise)[-1]  # incompressible, and only the bands say so


def test_repetition_in_one_part_is_found_by_chunks():
    bands = rules.Bands(texts=((0, 0.0, 9.0),))
    r = random.Random(2)
    good = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(2000))
    lazy = " ".join(["tick tock tack"] * 300 + [good])
    assert rules.judge(good, bands, PACK)[-1]
    found = rules.judge(lazy, bands, PACK)
    assert found[8] >= 2 and not found[-1]


def plain_outside(raw, bands):
    """Chunks by their definition, as slices of the text."""
    row = [r for r in bands.chunks if len(raw) >= r[0]]
    if not row:
        return 0, 0
    size = row[-1][1]
    chunks = [raw[a:a + size] for a in range(0, len(raw), size)]
    chunks[-1] = raw[-size:]
    return len(chunks), sum(not row[-1][2] <= len(PACK.compress(c)) / size <= row[-1][3] for c in chunks)


def prose(n, seed=7):
    """Made-up words of letters as frequent as in a language, cut to ``n`` bytes."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwyp"
    words = ["".join(r.choices(letters, range(18, 0, -1), k=r.randint(2, 9))) for _ in range(n)]
    return " ".join(words)[:n]


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 511, 512, 1023, 1024, 1025, 1536, 2047, 16383, 16384, 16385, 50001])
def test_chunks_cover_every_byte(size):
    raw = prose(size).encode()
    assert rules.chunks_outside(raw, rules.Bands(), PACK) == plain_outside(raw, rules.Bands())
    if size >= 256:
        spoiled = raw[:-200] + bytes(random.Random(size).randbytes(200))
        assert rules.chunks_outside(spoiled, rules.Bands(chunks=((256, 256, 0.5, 0.9),)), PACK)[1] > 0


@pytest.mark.parametrize(("size", "noise"), [(1200, 500), (2048, 1000), (4000, 2000)])
def test_a_noisy_tail_is_found(size, noise):
    r = random.Random(size)
    tail = "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(noise))
    assert verdict(prose(size))[-1] and verdict(prose(size + noise))[-1]
    assert not verdict(prose(size) + " " + tail)[-1]


def test_verdict_follows_from_its_columns(spark, sf_dir):
    """kept is the base rule, the text's band and the share of chunks, recomputed from the texts."""
    bands, rows = rules.Bands(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        raw = rows[r.doc_id].encode()
        ratio = len(PACK.compress(raw)) / len(raw)
        n, outside = plain_outside(raw, bands)
        least, most = next((b[1], b[2]) for b in reversed(bands.texts) if len(raw) >= b[0])
        assert (r.ratio, r.n_chunks, r.n_chunks_outside) == (ratio, n, outside)
        assert r.kept == (not r.base_failed and least <= ratio <= most and outside <= bands.chunks_outside * n)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = rules.judged(odd_docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars) for r in got if r.doc_id) == sorted(
        (r[0], *plain(r[1])[:2]) for r in odd_rows if r[0])
    assert not any(r.kept for r in got if r.doc_id in (4, 5, 6, 8))
    kept = rules.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in got if r.kept)
    assert rules.judged(no_docs).collect() == [] and rules.keep(no_docs).collect() == []

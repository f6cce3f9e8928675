"""Splits and joins of words against every way to read them."""

import itertools
import random
import re

import pytest

from postmill.operators import compound

WORDS = {"the": 50, "quick": 9, "brown": 8, "fox": 7, "a": 40, "lot": 6, "of": 30, "quickly": 2, "in": 20, "into": 5, "to": 25, "together": 4,
         "get": 9, "her": 8, "straße": 3}


def near(a, b):
    """Edit distance with swaps of neighbours, by its recursion."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_reading(token, words):
    """(edits, -estimate, replacement) of the best reading, over all ways to cut; None if there is none."""
    total = float(sum(words.values()))
    if token in words:
        return 0, -float(words[token]), token
    ways = [(d, -float(f), w) for w, f in words.items() if (d := near(token, w)) <= 2]
    for i in range(1, len(token)):
        for x, y in itertools.product(words, words):
            edits = 1 + near(token[:i], x) + near(token[i:], y)
            if edits <= 2:
                ways.append((edits, -(float(words[x]) * float(words[y]) / total), f"{x} {y}"))
        for j in range(i + 1, len(token)):
            x, m, y = token[:i], token[i:j], token[j:]
            if x in words and m in words and y in words:
                ways.append((2, -(float(words[x]) * float(words[m]) / total * float(words[y]) / total), f"{x} {m} {y}"))
    return min(ways, default=None)


def read(spark, tokens, words):
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    dictionary = spark.createDataFrame(list(words.items()), "word string, freq long")
    return {r.token: (r.edits, -r.estimate, r.replacement) for r in compound.readings(frame, dictionary).collect()}


def test_readings_equal_all_ways(spark):
    r = random.Random(4)
    tokens = {"thequick", "alot", "intothe", "ofthefox", "teh", "quikbrown", "thqeuick", "x", "zzzzzz", "fox", "straßefox", "a" * 300}
    for _ in range(150):
        word = "".join(r.choice(list(WORDS)) for _ in range(r.randint(1, 3)))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(word))
            word = word[:k] + r.choice("aeothx") * r.randint(0, 2) + word[k + 1:]
            word = word or "q"
        tokens.add(word)
    want = {t: way for t in tokens if (way := plain_reading(t, WORDS))}
    got = read(spark, sorted(tokens), WORDS)
    assert set(got) == set(want)
    for t, (edits, rank, text) in want.items():
        assert got[t] == (edits, pytest.approx(rank), text)


def corrected(spark, texts, words):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    dictionary = spark.createDataFrame(list(words.items()), "word string, freq long")
    return [r.corrected for r in compound.spell_compound(frame, dictionary, "k").orderBy("k").collect()]


CASES = {
    "thequick brown fox": "the quick brown fox", "th e quick": "the quick", "TheQuick, th  e FOX!": "the quick, the FOX!",
    "toget her": "together", "in to": "in to", "to get her": "to get her", "<EMAIL> thequick <URL>": "<EMAIL> the quick <URL>",
    "zzzzzz": "zzzzzz", "": "", "ofthefox": "of the fox",
}
BY_FREQUENCY = ["th, e", "qui ck ly", "alot of"]


def test_texts(spark):
    assert corrected(spark, [*CASES, None], WORDS) == [*CASES.values(), ""]


def plain_text(text, words):
    """Words corrected one by one, then pairs from the left that take fewer edits as one word."""
    total = float(sum(words.values()))
    pieces = re.findall(r"<[A-Z][A-Z0-9_]*>|[^\W\d_]+|(?:[^\w<]|[\d_])+|<", text or "")
    out, i = [], 0
    is_word = lambda p: bool(re.fullmatch(r"[^\W\d_]+", p))
    while i < len(pieces):
        p = pieces[i]
        if not is_word(p):
            out.append(p)
            i += 1
            continue
        a = plain_reading(p.lower(), words)
        if i + 2 < len(pieces) and re.fullmatch(" +", pieces[i + 1]) and is_word(pieces[i + 2]):
            b, joined = plain_reading(pieces[i + 2].lower(), words), (p + pieces[i + 2]).lower()
            apart = (a[0] if a else 3) + (b[0] if b else 3)
            if joined in words and (apart > 1 or (apart == 1 and words[joined] > a[1] * b[1] / total)):
                out.append(joined)
                i += 3
                continue
        out.append(a[2] if a and a[0] else p)
        i += 1
    return "".join(out)


def test_running_text_equals_a_walk(spark):
    r = random.Random(9)
    texts = [*CASES, *BY_FREQUENCY]
    for _ in range(60):
        words = [r.choice(list(WORDS)) for _ in range(r.randint(1, 30))]
        text = "".join(w + r.choice([" ", "", "  ", ", ", " "]) for w in words)
        for _ in range(len(words) // 3):
            k = r.randrange(len(text))
            text = text[:k] + r.choice([" ", "", "x"]) + text[k + 1:]
        texts.append(text)
    texts.append("qui ck " * 400 + "fo x")
    assert corrected(spark, texts, WORDS) == [plain_text(t, WORDS) for t in texts]


def test_empty_dictionary_and_empty_table(spark):
    assert corrected(spark, ["any words here"], {"zz": 1}) == ["any words here"]
    frame = spark.createDataFrame([], "k long, text string")
    empty = spark.createDataFrame([], "word string, freq long")
    assert compound.spell_compound(frame, empty, "k").collect() == []
    some = spark.createDataFrame([(1, "a text")], "k long, text string")
    assert [r.corrected for r in compound.spell_compound(some, empty, "k").collect()] == ["a text"]


def test_a_line_end_is_no_blank(spark):
    texts = ["th \ne quick", "th  e quick"]
    assert corrected(spark, texts, WORDS) == [plain_text(t, WORDS) for t in texts] == ["the \na quick", "the quick"]


def test_two_edits_are_tried_only_where_one_is_not_enough(spark, monkeypatch):
    compared, whole = {1: set(), 2: set()}, compound.spelling.candidates

    def watched(tokens, dictionary, distance, *rest):
        compared[distance] |= {r.token for r in tokens.collect()}
        return whole(tokens, dictionary, distance, *rest)

    monkeypatch.setattr(compound.spelling, "candidates", watched)
    got = read(spark, ["thequick", "foxx", "qiukc", "brown"], WORDS)
    assert {t: r[2] for t, r in got.items()} == {"thequick": "the quick", "foxx": "fox", "qiukc": "quick", "brown": "brown"}
    assert compared[2] == {"qiukc"}

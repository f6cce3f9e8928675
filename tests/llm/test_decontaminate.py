import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import decontaminate, queries
from helpers import prose

QUESTION = "the train leaves Boston at 9 and travels 300 miles to reach Denver so how many hours does the trip take for Boston"
SWAPPED = "the train leaves Madrid at 7 and travels 450 km to reach Lyon so how many days does the trip take for Madrid"
BROKEN = "the train leaves Madrid at 7 and travels 450 km to reach Lyon so how many days does the trip take for Oslo"


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, h long, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_ids, r.coverage) for r in decontaminate.checked(d, b, **kw).collect()}


def test_query_equals_containment(spark, sf_dir):
    """In the tables items stand in documents word for word; fragments of them do not count."""
    clean = lambda t: " ".join((t or "").split())
    docs = {r.doc_id: clean(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: clean(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {i: sorted(k for k, q in items.items() if q in t) for i, t in docs.items()}
    got = {r.doc_id: r for r in queries.op2_decontamination(spark, sf_dir).collect()}
    assert {i: list(r.item_ids) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.contaminated} == {i for i, k in want.items() if k}
    assert any(want.values())


def test_changed_parameters_are_found_and_inconsistent_ones_not(spark):
    docs = [(1, f"{prose(1, 30)} {QUESTION} {prose(2, 30)}", 0, 0), (2, f"{prose(3, 30)} {SWAPPED}", 0, 0), (3, BROKEN, 0, 0),
            (4, prose(4, 100), 0, 0), (5, " ".join(QUESTION.split()[:11]), 0, 0), (6, QUESTION + " " + SWAPPED, 0, 0)]
    got = check(spark, docs, [(7, QUESTION), (8, None), (9, ""), (10, "A B C D E F G H I J K")])
    assert got[1][:2] == (True, [7]) and got[2][:2] == (True, [7]) and got[6][:2] == (True, [7])
    assert not got[3][0] and not got[4][0] and not got[5][0]


def test_short_items_are_one_window(spark):
    docs = [(1, "so what is seven times eight then", 0, 0), (2, "what is seven times nine", 0, 0)]
    got = check(spark, docs, [(1, "what is seven times eight"), (2, "is it")])
    assert got[1] == (True, [1], 1.0) and not got[2][0]


def plain_hits(text, items, windows):
    """Windows of ``text`` whose template equals one of an item, by comparing the templates themselves."""
    forms = lambda t: [decontaminate.template(x) for x in re.findall(decontaminate.TOKEN, t or "")]
    mine, out = forms(text), set()
    for item in items:
        theirs = forms(item)
        width = min(windows.tokens, len(theirs))
        for k in range(len(theirs) - width + 1 if width else 0):
            for i in range(len(mine) - width + 1):
                part = mine[i:i + width]
                if part == theirs[k:k + width] and sum(f not in "#@%" for f in part) >= min(windows.literals, width):
                    out.add((i, k))
    return out


@pytest.mark.parametrize("text", [SWAPPED, BROKEN, QUESTION * 2, prose(5, 40), "", "Boston " * 30])
def test_window_hits_equal_brute_force(spark, text):
    windows = decontaminate.Windows()
    items = decontaminate.item_windows(spark.createDataFrame([(1, QUESTION)], "item_id long, text string"), windows)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hits = decontaminate.window_hits(docs, items, windows).join(items, "h")
    assert {(r["at"], r["item_at"]) for r in hits.collect()} == plain_hits(text, [QUESTION], windows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (None, prose(2, 50)), (1, odd_rows[0][1])], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.contaminated) for r in decontaminate.checked(odd_docs, items).collect()))
    want = sorted(((r[0] or 0, r[0] in (1, 2, 3) or (r[0] is None and r[1] is not None)) for r in odd_rows))
    assert got == want
    kept = decontaminate.keep(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i for i, bad in want if not bad)
    assert decontaminate.keep(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.checked(no_docs, items).collect() == []


def test_copies_in_capitals_and_title_case_are_found(spark):
    docs = [(1, f"{prose(1, 30)} {QUESTION.upper()} {prose(2, 30)}", 0, 0), (2, QUESTION.title(), 0, 0), (3, QUESTION.lower(), 0, 0),
            (4, prose(4, 60).upper(), 0, 0)]
    got = check(spark, docs, [(7, QUESTION)])
    assert [got[i][:2] for i in (1, 2, 3)] == [(True, [7])] * 3 and not got[4][0]


def test_items_without_eligible_windows_are_found(spark):
    items = {1: "What is photosynthesis?", 2: "7 times 8 is 56", 3: "3 kg", 4: "1 2 3 4 5 6 7 8 9 10 11 12", 5: "Who wrote Hamlet?"}
    docs = [(k, f"{prose(k, 20)} {t.lower()} {prose(k + 50, 20)}", 0, 0) for k, t in items.items()]
    docs += [(6, "7 times 8 is 57 and 4 kg of 1 2 3 5 who wrote Macbeth", 0, 0)]
    got = check(spark, docs, [*items.items(), (6, "?!")])
    assert {k: (r[0], r[1]) for k, r in got.items()} == {**{k: (True, [k]) for k in items}, 6: (False, [])}


def test_one_changed_value_does_not_undo_equal_windows(spark):
    parts = [prose(60 + k, 14) for k in range(3)]
    item = f"{parts[0]} 12 {parts[1]} 12 {parts[2]}"
    docs = [(1, item.replace("12", "13", 1), 0, 0), (2, item.replace("12", "14"), 0, 0), (3, BROKEN, 0, 0)]
    got = check(spark, docs, [(1, item), (2, QUESTION)])
    assert got[1][:2] == (True, [1]) and 0.5 < got[1][2] < 1 and got[2] == (True, [1], 1.0) and not got[3][0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBzİßé١²Ⅷ_09.,. \n"), st.characters(codec="utf-8")), max_size=60))
def test_tokens_are_those_of_the_pattern(text):
    want = [(m.start(), m.end()) for m in decontaminate.TOKEN.finditer(text)]
    got = decontaminate.tokens_of(text)
    assert list(zip(got.start.tolist(), got.end.tolist(), strict=True)) == want
    forms = {decontaminate.LITERAL: None, **decontaminate.SLOTS}
    for (a, b), kind in zip(want, got.types.tolist(), strict=True):
        form = decontaminate.template(text[a:b])
        assert forms[kind] == (form if form in "#@%" else None)


def test_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    words = sorted({w.lower() for k in range(40) for w in prose(k, 200).split()} | {"a", "aa", "ab", "ba", "b"})
    text = " ".join(words + [w.upper() for w in words])
    found = decontaminate.tokens_of(text).hashes
    assert len(set(found.tolist())) == len(words) and (found[:len(words)] == found[len(words):]).all()
    monkeypatch.setattr(decontaminate, "CHARS", 50)
    assert (decontaminate.tokens_of(text).hashes == found).all()


@pytest.mark.parametrize("k", range(10))
def test_lists_of_other_names_are_clean(spark, k):
    """Names agree with any names; what few words stand between them are no item."""
    r = random.Random(k)
    name = lambda: "".join(r.choice("aeiou") + r.choice("bdklmnrst") for _ in range(r.randint(2, 3))).title()
    names = lambda n: " ".join(name() for _ in range(n))
    words = ["met in the hall", "were all seen there", "lived by that river", "won it once more"][k % 4]
    item = f"{names(8)} {words} {names(3 + k)}"
    docs = [(1, f"Last week {names(8)} {words} {names(9)} and we all went home", 0, 0), (2, f"{prose(k, 9)} {item} {prose(k + 20, 9)}", 0, 0),
            (3, item.upper(), 0, 0)]
    got = check(spark, docs, [(1, item)])
    assert not got[1][0] and got[2] == (True, [1], 1.0) and got[3][0]


def test_a_piece_of_many_texts_gives_what_each_gives(spark, monkeypatch):
    parts = QUESTION.split()
    docs = [(i, " ".join(parts[i % 5:i % 5 + 12]), 0, 0) for i in range(20)] + [(30, QUESTION, 0, 0), (31, "", 0, 0), (32, None, 0, 0)]
    items = decontaminate.item_windows(spark.createDataFrame([(1, QUESTION)], "item_id long, text string"), decontaminate.Windows())
    for size in (1 << 19, 5):
        monkeypatch.setattr(decontaminate, "TOKENS", size)
        frame = spark.createDataFrame(docs, "doc_id long, text string, h long, item_id long").coalesce(1)
        hits = decontaminate.window_hits(frame, items, decontaminate.Windows()).join(items, "h").filter("kind = 0").collect()
        assert {(r.doc_id, r.at, r.item_at) for r in hits} == {
            (i, *hit) for i, text, _, _ in docs for hit in plain_hits(text, [QUESTION], decontaminate.Windows())}


def test_filter_grows_with_the_windows():
    assert [decontaminate.filter_bits(n) for n in (0, 1, 10_000, 1 << 30)] == [16, 16, 19, 28]

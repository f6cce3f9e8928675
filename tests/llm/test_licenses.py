import re

from postmill.llm import licenses, queries


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    starts = [i for i, _ in places]
    found = {t.label for t in licenses.notices(licenses.TEMPLATES) for i in range(-40, len(words))
             if all(i + at >= 0 and [w.encode() for w in words[i + at:i + at + len(key)]] == list(key) for at, key in t.keys)}
    base = {label for _, label in places}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)))


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op10_licenses(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: plain(t) for i, t in rows.items()}
    assert all(0 <= r.score <= 1 for r in got) and any(r.labels for r in got)


CASES = [
    (1, "Released under the MIT License. x Licensed under the Apache License, Version 2.0."), (2, "CC BY CC-BY cc by"),
    (3, "This work is licensed under CC BY-NC 4.0."), (4, "GNU Lesser General Public License"), (5, "mit licence"),
    (6, "all rights all rights reserved"), (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files"), (8, "MIT License"), (9, "the mit mit license"), (10, "ALL RIGHTS RESERVEDé")]


def test_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {i: tuple(r)[1:7] for i, r in got.items()} == {i: plain(t) for i, t in CASES}
    assert got[1].labels == "apache-2.0,mit" and got[2].n_base == 3 and got[3].labels == "cc-by,cc-by-nc-4.0"
    assert got[4].labels == "gpl,lgpl" and got[5].labels == "" and got[7].labels == "mit" and got[8].score < 1 == got[7].score


def test_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").repartition(4)
    n, found = licenses.document_frequencies(docs, {b"mit", b"license", b"nowhere"})
    assert (n, found) == (10, {b"mit": 4, b"license": 4})


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r)[:7] for r in licenses.scan(odd_docs).collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in odd_rows), key=str)
    assert licenses.scan(no_docs).collect() == []


def test_time_grows_with_the_text():
    """A phrase on every second word: places are counted on from the last one."""
    import time
    def seconds(n):
        words = b"cc by x".split() * n
        t0 = time.perf_counter()
        assert len(licenses.base_places(words)) == n
        return time.perf_counter() - t0
    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.002)
    assert [at for at, _ in licenses.base_places(b"cc by cc by x general public license cc by".split())] == [0, 2, 8, 5]

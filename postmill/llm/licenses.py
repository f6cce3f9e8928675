"""Licence scan with a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import pieces, texts

# Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, words of a notice, and the phrases in it that must be there, each at its place in the notice.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["granted free of charge to any person obtaining a copy of this software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["copy modify and or distribute this software"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc0-1.0", "released under cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]
# Rare words by which a notice is looked up.
RARE = 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, after A-Z are lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # place in the notice, words


def notices(templates: list[tuple[str, str, list[str]]]) -> list[Notice]:
    out = []
    for label, text, phrases in templates:
        words = tuple(text.encode().split())
        keys = []
        for phrase in phrases:
            key = tuple(phrase.encode().split())
            keys.append((next(i for i in range(len(words)) if words[i:i + len(key)] == key), key))
        out.append(Notice(label, words, tuple(keys)))
    return out


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of documents with each word of ``vocabulary``, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in pieces(batches, "text"):
            for text in part.column("text").to_pylist():
                counts[""] += 1
                counts.update(w.decode() for w in vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         ["word", "n"])

    rows = texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings (notice, place) of each notice's rarest key words, and the weights of all its words."""

    def __init__(self, all_notices: list[Notice], n_docs: int, frequencies: dict[bytes, int]) -> None:
        self.notices = all_notices
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) + 1 for t in all_notices for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for number, notice in enumerate(all_notices):
            places = {at + k: w for at, key in notice.keys for k, w in enumerate(key)}
            rare = sorted(set(places.values()), key=lambda w: (-self.idf[w], w))[:RARE]
            for place, word in places.items():
                if word in rare:
                    self.postings.setdefault(word, []).append((number, place))
        self.rare = [set(w for w, posts in self.postings.items() if any(n == number for n, _ in posts))
                     for number in range(len(all_notices))]

    def find(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word of the notice's key, share of the notice's weight that is there) of each verified notice."""
        votes: dict[tuple[int, int], set[bytes]] = {}
        if not self.postings.keys() & set(words):
            return []
        for at, word in enumerate(words):
            for number, place in self.postings.get(word, ()):
                votes.setdefault((number, at - place), set()).add(word)
        out = []
        for (number, start), met in votes.items():
            notice = self.notices[number]
            if met != self.rare[number]:  # every rare word stands at the same distance from the notice's start
                continue
            if all(tuple(words[start + at:start + at + len(key)]) == key for at, key in notice.keys if start + at >= 0) \
                    and all(start + at >= 0 for at, _ in notice.keys):
                there = [w for k, w in enumerate(notice.words)
                         if 0 <= start + k < len(words) and words[start + k] == w]
                share = sum(map(self.idf.get, there)) / sum(map(self.idf.get, notice.words))
                out.append((notice.label, start + notice.keys[0][0], share))
        return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where the words of a base phrase stand consecutively."""
    joined = b" %s " % b" ".join(words)
    out = []
    for phrase, label in BASE.items():
        at, before, seen = joined.find(b" %s " % phrase.encode()), 0, 0
        while at >= 0:
            before, seen = before + joined.count(b" ", seen, at), at
            out.append((before, label))
            at = joined.find(b" %s " % phrase.encode(), at + 1)
    return out


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, notice_words array<long>")
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """SCHEMA per row of ``docs``: base phrases and licence notices in its whole text.

    The frequencies of the notices' words are counted over all rows first; each notice is indexed by the rarest words of
    its mandatory phrases. A text's rare words vote for (notice, start); where all rare words of a notice agree on a
    start, the mandatory phrases are compared in place. Each place of a mandatory phrase has all these votes, so none is
    missed. score: the greatest share of a found notice's weight, 0.5 at least for a base phrase, else 0.
    notice_words: where found notices' first mandatory phrases begin. Null and empty texts have no words and no labels
    (empty strings, score 0); null and repeated doc_ids are passed through.
    """
    index_of = notices(templates or TEMPLATES)
    n_docs, frequencies = document_frequencies(docs, {w for t in index_of for w in t.words})
    index = Index(index_of, n_docs, frequencies)

    def row(text: str | None) -> tuple:
        words = words_of(text)
        base, found = base_places(words), index.find(words)
        starts = [at for at, _ in base]
        base_labels = {label for _, label in base}
        labels = base_labels | {label for label, _, _ in found}
        score = max([0.5 if base else 0.0, *(share for _, _, share in found)])
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), min(1.0, score), sorted({at for _, at, _ in found}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            columns = zip(*map(row, part.column("text").to_pylist()), strict=True)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns, kinds)], NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)

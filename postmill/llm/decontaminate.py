"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders, names also small words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import pieces
from postmill.llm.shipping import ship
from postmill.session import written

TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+")
# Words that count as units of measure.
UNITS = frozenset("""m cm mm km ft inch inches mile miles yard yards kg g mg lb lbs ounce ounces ton tons l ml litre litres liter
liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
percent dollar dollars euro euros cent cents pound pounds usd eur mph kmh degrees""".split())
# Bits of the filter that is handed to all tasks: so many for each window of an item, within these bounds as powers of two.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 32, 16, 28
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Characters that are cut into tokens at a time, and tokens whose windows are hashed at a time.
CHARS, TOKENS = 1 << 20, 1 << 19


@dataclass(frozen=True)
class Windows:
    """Tokens per window; literals a window must have; the share of an item's tokens that must be under windows that are
    met; and the words (or equal values) that a placement must have in common with the item, or all if it has fewer."""

    tokens: int = 8
    literals: int = 4
    coverage: float = 0.6
    evidence: int = 6


def template(token: str) -> str:
    """``#`` for a number, ``@`` for a capitalised word (a name), ``%`` for a unit, else the word itself."""
    if token[0].isdecimal():
        return "#"
    if token.lower() in UNITS:
        return "%"
    return "@" if token[0].isupper() else token.lower()


# Forms of a token that windows are hashed in; the hashes of different forms differ. TEMPLATE is ``template``; FOLDED has
# capitalised words as words; EXACT has no slots and is for items without an eligible window in the others.
TEMPLATE, FOLDED, EXACT = range(3)
LITERAL, NUMBER, NAME, UNIT = range(4)
SLOTS = {NUMBER: "#", NAME: "@", UNIT: "%"}
# Kinds of characters: none, letter, decimal digit, point within a number.
_NONE, _LETTER, _DIGIT, _POINT = range(4)


class Alphabet:
    """Kind, case and small form of the characters seen so far, as tables by code point."""

    def __init__(self) -> None:
        self.seen = np.zeros(0x110000, dtype=bool)
        self.kind = np.zeros(0x110000, dtype=np.uint8)
        self.upper = np.zeros(0x110000, dtype=bool)
        self.small = np.arange(0x110000, dtype=np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        here = np.flatnonzero(np.bincount(codes))
        for code in here[~self.seen[here]].tolist():
            char = chr(code)
            self.kind[code] = _DIGIT if char.isdecimal() else _POINT if char in ".," else _LETTER if char.isalnum() else _NONE
            self.upper[code] = char.isupper()
            if len(char.lower()) == 1:
                self.small[code] = ord(char.lower())
            self.seen[code] = True


@lru_cache(maxsize=1)
def alphabet() -> Alphabet:
    return Alphabet()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd multiplier, and of its inverse, modulo 2**64."""
    up = np.full(n + 1, MULTIPLIER, dtype=np.uint64)
    down = np.full(n + 1, pow(int(MULTIPLIER), -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Tokens:
    """Tokens of a text: places of their characters, hashes of their small forms, and what they are as templates."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    types: np.ndarray


def _tokens_of(codes: np.ndarray) -> Tokens:
    """The tokens that TOKEN finds, by passes over the characters; hashes are polynomials over the small characters."""
    letters = alphabet()
    letters.learn(codes)
    kind = letters.kind[codes]
    n = len(kind)
    points = np.flatnonzero(kind == _POINT)
    if len(points):
        # A point belongs to a number that goes on behind it, with nothing but digits and points between.
        digit = kind == _DIGIT
        numeric = digit | (kind == _POINT)
        place = np.arange(n)
        last_digit = np.maximum.accumulate(np.where(digit, place, -1))
        last_other = np.maximum.accumulate(np.where(numeric, -1, place))
        next_digit = np.minimum.accumulate(np.where(digit, place, n)[::-1])[::-1]
        next_other = np.minimum.accumulate(np.where(numeric, n, place)[::-1])[::-1]
        inside = (last_digit[points] > last_other[points]) & (next_digit[points] < next_other[points])
        kind[points] = np.where(inside, _DIGIT, _NONE)
    edges = np.flatnonzero(np.diff(kind, prepend=_NONE, append=_NONE))
    start, end = edges[:-1], edges[1:]
    real = kind[start] != _NONE
    start, end = start[real], end[real]
    up, down = _powers(1 << max(0, n - 1).bit_length())
    # The small characters times falling powers, summed up, so that a token's part can be cut out and brought to one scale.
    sums = np.concatenate([[np.uint64(0)], np.cumsum((letters.small[codes].astype(np.uint64) + np.uint64(1)) * down[:n])])
    hashes = mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    types = np.where(kind[start] == _DIGIT, NUMBER, np.where(letters.upper[codes[start]], NAME, LITERAL)).astype(np.uint8)
    return Tokens(start, end, hashes, types)


@lru_cache(maxsize=1)
def unit_hashes() -> np.ndarray:
    return np.array([_tokens_of(_codes(word)).hashes[0] for word in sorted(UNITS)], dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def tokens_of(text: str) -> Tokens:
    """The tokens of a text, cut into parts of about CHARS characters where a blank stands."""
    parts, at = [], 0
    while at < len(text):
        stop = min((p for p in (text.find(b, at + CHARS) for b in " \n") if p >= 0), default=len(text))
        part = _tokens_of(_codes(text[at:stop]))
        parts.append(Tokens(part.start + at, part.end + at, part.hashes, part.types))
        at = stop
    if not parts:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none.astype(np.uint64), none.astype(np.uint8))
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    out = Tokens(join("start"), join("end"), join("hashes"), join("types"))
    units = np.isin(out.hashes, unit_hashes()) & (out.types != NUMBER)
    out.types[units] = UNIT
    return out


def literal(types: np.ndarray, form: int) -> np.ndarray:
    """Which tokens stand for themselves in a form."""
    return np.ones(len(types), bool) if form == EXACT else (types == LITERAL) | ((types == NAME) & (form == FOLDED))


def windows_of(tokens: Tokens, width: int, form: int, least: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows of ``width`` tokens, from first to before last, with ``least`` literals or more."""
    last = len(tokens.hashes) if last is None else last
    n = last - first - width + 1
    if n < 1 or not width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    types = tokens.types[first:last]
    words = literal(types, form)
    each = np.where(words, tokens.hashes[first:last] | np.uint64(8), types.astype(np.uint64))
    counts = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    starts = np.flatnonzero(counts[width:] - counts[:n] >= min(least, width))
    total = np.full(len(starts), width * len(SLOTS) + form, dtype=np.uint64)
    for k in range(width):
        total = total * MULTIPLIER + each[starts + k]
    return starts + first, mixed(total)


def slots_of(text: str, tokens: Tokens, start: int, width: int, form: int) -> tuple[list[int], list[str]]:
    """Places of the slots of a window, from its start, and type and value of each."""
    if form == EXACT:
        return [], []
    at = np.flatnonzero(~literal(tokens.types[start:start + width], form)).tolist()
    return at, [SLOTS[int(tokens.types[start + k])] + text[tokens.start[start + k]:tokens.end[start + k]] for k in at]


ITEM_SCHEMA = ("h long, item_id long, item_at long, item_slots array<string>, slot_at array<int>, words array<int>, kind long, "
               "width long, n_tokens long")
HIT_SCHEMA = "doc_id long, row_hash long, h long, at long, slots array<string>"


def item_windows(benchmark: DataFrame, windows: Windows) -> DataFrame:
    """ITEM_SCHEMA per window and form of each item; an item shorter than a window is one window.

    ``slot_at`` and ``words`` are the places of its slots and of its literals in the item.
    """
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            rows = []
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                tokens = tokens_of(text or "")
                n = len(tokens.hashes)
                width = min(windows.tokens, n)
                found = [(form, *windows_of(tokens, width, form, windows.literals)) for form in (TEMPLATE, FOLDED)]
                if not any(len(starts) for _, starts, _ in found):
                    found.append((EXACT, *windows_of(tokens, width, EXACT, windows.literals)))
                for form, starts, hashes in found:
                    for at, h in zip(starts.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        places, values = slots_of(text, tokens, at, width, form)
                        words = [at + k for k in range(width) if k not in places]
                        rows.append((h, item, at, values, [at + k for k in places], words, form, width, n))
            if rows:
                kinds = [*[pa.int64()] * 3, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 2, *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 [column.split()[0] for column in ITEM_SCHEMA.split(", ")])

    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, ITEM_SCHEMA)


def filter_bits(n_windows: int) -> int:
    """The power of two of the filter's size; beyond the bound it lets more through, which the join drops."""
    return max(FILTER_LEAST, min(FILTER_MOST, math.ceil(math.log2(FILTER_SHARE * max(n_windows, 1)))))


def _spot(hashes: np.ndarray, bits: int, which: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * which)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _set(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (table[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0


def _filter_of(items: DataFrame, bits: int) -> bytes:
    """A bit map that holds two bits per window hash; tasks fold theirs, sixteen maps reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            for which in (0, 1):
                spots = _spot(batch.column("h").to_numpy().view(np.uint64), bits, which)
                np.bitwise_or.at(table, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in items.select("h").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], dtype=np.uint8)
    return total.tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both, by which a row is known even if its doc_id is null or repeated."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.withColumn("row_hash", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def window_hits(docs: DataFrame, items: DataFrame, windows: Windows) -> DataFrame:
    """HIT_SCHEMA: the windows of whole texts that may be windows of an item; few pass the filter wrongly.

    The texts of a piece are laid end to end; windows that reach from one into the next are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    bits = filter_bits(items.count())
    shared = spark.sparkContext.broadcast(_filter_of(items, bits))
    # At most the tokens of a window times the forms.
    widths = sorted((r["width"], r["kind"]) for r in items.select("width", "kind").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        for part in pieces(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            starts_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
            whole = "\n".join(texts)
            tokens = tokens_of(whole)
            owner = np.searchsorted(starts_at, tokens.start, "right") - 1
            first = np.searchsorted(owner, np.arange(len(texts)))
            docs_of, row_hashes = part.column("doc_id").to_pylist(), part.column("row_hash").to_pylist()
            rows = []
            for low in range(0, len(owner), TOKENS):
                for width, form in widths:
                    high = min(len(owner), low + TOKENS + width - 1)
                    starts, hashes = windows_of(tokens, width, form, windows.literals, low, high)
                    for which in (0, 1):
                        met = np.flatnonzero(_set(table, _spot(hashes, bits, which)))
                        starts, hashes = starts[met], hashes[met]
                    one = owner[starts] == owner[starts + width - 1]
                    for at, h in zip(starts[one].tolist(), hashes[one].view(np.int64).tolist(), strict=True):
                        k = int(owner[at])
                        rows.append((docs_of[k], row_hashes[k], h, at - int(first[k]), slots_of(whole, tokens, at, width, form)[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True), [pa.int64()] * 4 + [pa.list_(pa.string())], strict=True)],
                    ["doc_id", "row_hash", "h", "at", "slots"])

    return _keyed(docs).mapInArrow(run, HIT_SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, windows: Windows | None = None) -> DataFrame:
    """(doc_id, row_hash, item_id, coverage) of each document row and item that shares enough consistent windows.

    Windows are hash-joined in two forms, as templates and with names as words whatever their case. Windows of one document
    and item at the same distance, of either form, are one placement; it counts if its slots agree: the same value of the
    item always stands for the same value of the document, of the same type. Of a placement whose slots do not agree, the windows with
    the item's own values count. What a placement has in common with the item beyond types of slots, its words and equal
    values, must come to ``windows.evidence`` or to all of the item. coverage is the share of the item's tokens under the
    windows of such placements.
    """
    windows = windows or Windows()
    items = written(item_windows(benchmark, windows), "items")
    hits = window_hits(docs, items, windows)
    met = hits.join(items, "h").filter(F.size("slots") == F.size("item_slots"))
    item = ["doc_id", "row_hash", "item_id", "n_tokens"]
    slots = F.arrays_zip("slot_at", "item_slots", "slots")
    equal = F.filter(slots, lambda z: z["item_slots"] == z["slots"])
    window = F.struct("item_at", "width", (F.size(equal) == F.size("slots")).alias("same"),
                      F.concat("words", F.transform(equal, lambda z: z["slot_at"])).alias("common"))
    placed = met.select(*item, (F.col("at") - F.col("item_at")).alias("place"), window.alias("window"),
                        F.array_distinct(F.arrays_zip("item_slots", "slots")).alias("pairs"))
    # Of bounded size: a placement has at most one row per window and form of the item.
    placements = placed.groupBy(*item, "place").agg(
        F.collect_set("window").alias("met"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    agree = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    typed = F.forall("pairs", lambda p: F.substring(p["item_slots"], 1, 1) == F.substring(p["slots"], 1, 1))
    good = placements.withColumn("good", F.when(agree & typed, F.col("met")).otherwise(F.filter("met", lambda w: w["same"])))
    common = F.size(F.array_distinct(F.flatten(F.transform("good", lambda w: w["common"]))))
    spots = F.flatten(F.transform("good", lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1)))
    strong = good.filter(common >= F.least(F.lit(windows.evidence), F.col("n_tokens")))
    return strong.select(*item, F.explode(F.array_distinct(spots)).alias("spot")).distinct() \
        .groupBy(*item).agg((F.count("*") / F.col("n_tokens")).alias("share")).filter(F.col("share") >= windows.coverage) \
        .groupBy("doc_id", "row_hash", "item_id").agg(F.max("share").alias("coverage"))


def checked(docs: DataFrame, benchmark: DataFrame, windows: Windows | None = None) -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage) per row of ``docs``.

    item_ids are the items found in the row's text, ascending (an empty list if none); coverage is the best share (0 if
    none). Null and empty texts and items hold nothing. Rows without a doc_id and rows that repeat a doc_id are told apart
    by their text; equal rows get equal results. Items none of whose windows has enough literals are found by windows of
    their exact words and numbers; only items without a letter or digit hold nothing.
    """
    found = written(matches(docs, benchmark, windows).groupBy("doc_id", "row_hash").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")), "contaminated")
    rows = _keyed(docs).select("doc_id", "row_hash")
    joined = rows.join(found, (rows["row_hash"] == found["row_hash"]) & rows["doc_id"].eqNullSafe(found["doc_id"]), "left")
    return joined.select(rows["doc_id"], F.col("item_ids").isNotNull().alias("contaminated"),
                         F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
                         F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def keep(docs: DataFrame, benchmark: DataFrame, windows: Windows | None = None) -> DataFrame:
    """The rows of ``docs`` without those that hold an item, with the columns of ``docs``."""
    found = written(matches(docs, benchmark, windows).select("doc_id", "row_hash").distinct(), "contaminated")
    keyed = docs.withColumn("_row_hash", F.xxhash64(docs["doc_id"].cast("long").isNull(), docs["doc_id"].cast("long"),
                                                    docs["text"].cast("string")))
    on = (keyed["_row_hash"] == found["row_hash"]) & keyed["doc_id"].eqNullSafe(found["doc_id"])
    return keyed.join(found, on, "left_anti").select(*docs.columns)

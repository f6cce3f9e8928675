"""Corpus spell correction as joins over the vocabulary.

Two words within edit distance d share a string that is left after at most d deletions from each, and
so do their first PREFIX letters: of two aligned words whose prefixes match unequally far, the letters
matched beyond a prefix are no more than the other's unmatched ones. Candidates are found by an equi-join
on the strings left of the prefixes, at most 29 per word however long it is, and then checked. The distance counts an
adjacent swap as one edit. A word's correction is its nearest dictionary word, then the more
frequent one, then the first by spelling. Distance 1 is tried first; only words without a hit pay
for distance 2. Everything runs on the vocabulary (distinct words), never on the running text.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import shuffle_width, written

PREFIX = 7  # fixed value: letters of a word that keys are built from
# A placeholder such as <EMAIL>, a word, or what lies between.
PIECES = r"<[A-Z][A-Z0-9_]*>|\p{L}+|[^\p{L}<]+|<"


def _swaps(w: Column) -> Column:
    """The word with each pair of neighbours exchanged."""
    return F.when(F.length(w) >= 2, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.concat(
        F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2)))
    ).otherwise(F.array().cast("array<string>"))


def delete_keys(w: Column, distance: int, length: int) -> Column:
    """What is left of a word's first ``length`` letters after up to ``distance`` deletions, each once.

    Every choice of places is an expression of its own; places beyond the word's end delete nothing.
    """
    def left(places: tuple[int, ...]) -> Column:
        runs = itertools.pairwise((0, *places, length + 1))
        kept = [F.substring(w, low + 1, high - low - 1) for low, high in runs if high - low > 1]
        return F.concat(*kept) if kept else F.lit("")

    return F.array_distinct(F.array(*[left(places) for n in range(distance + 1)
                                      for places in itertools.combinations(range(1, length + 1), n)]))


def _distance(token: Column, word: Column, lev: Column) -> Column:
    """0, 1 or 2 edits (insert, delete, replace, swap of neighbours); null beyond.

    ``lev`` is the plain edit distance up to 4, else negative. A swap costs it two, so one swap
    shows as 2 at equal length, a swap and an edit as at most 3, two swaps as at most 4. The swaps
    are tried only for pairs where they can matter.
    """
    same_length = F.length(token) == F.length(word)
    swap_then_edit = F.exists(_swaps(token), lambda s: F.levenshtein(s, word, 1) >= 0)
    edit_then_swap = F.exists(_swaps(word), lambda s: F.levenshtein(token, s, 1) >= 0)
    two_swaps = same_length & F.arrays_overlap(_swaps(token), _swaps(word))
    return (F.when((lev >= 0) & (lev <= 1), lev)
            .when((lev == 2) & same_length & F.array_contains(_swaps(word), token), 1)
            .when(lev == 2, 2)
            .when((lev == 3) & (swap_then_edit | edit_then_swap), 2)
            .when((lev >= 3) & two_swaps, 2))


def letter_bits(column: str) -> Column:
    """The letters of a word as a set of 61 bits. An edit changes two of them at most, a swap none."""
    return F.expr(f"aggregate(split({column}, ''), 0L, (bits, letter) -> bits | shiftleft(1L, ascii(letter) % 61))")


def candidates(tokens: DataFrame, dictionary: DataFrame, distance: int, prefix: int = PREFIX) -> DataFrame:
    """(token, word, freq, distance) for all pairs within ``distance``.

    ``tokens`` has distinct ``token``s, ``dictionary`` distinct ``word``s. Tokens no dictionary word is near to in length
    are dropped first. Pairs that share a key but differ in more letters than the edits can change are dropped as they are
joined. A pair usually shares several keys, so equal pairs are merged before the check. The vocabulary is
    small in bytes but costly per word, so it is spread to the full width by number, which the runtime does not undo.
    """
    width = shuffle_width(tokens.sparkSession)
    lengths = dictionary.select(F.length("word").alias("n")).distinct().select(
        F.explode(F.sequence(F.col("n") - distance, F.col("n") + distance)).alias("n")).distinct()
    t = tokens.withColumn("n", F.length("token")).join(lengths, "n", "left_semi").drop("n")
    t = t.select("token", letter_bits("token").alias("t_bits")).repartition(width, "token")
    t = t.select("token", "t_bits", F.explode(delete_keys(F.col("token"), distance, prefix)).alias("key"))
    w = dictionary.select("word", "freq", letter_bits("word").alias("w_bits"),
                          F.explode(delete_keys(F.col("word"), distance, prefix)).alias("key"))
    differing = F.bit_count(F.col("t_bits").bitwiseXOR(F.col("w_bits")))
    near = (F.abs(F.length("token") - F.length("word")) <= distance) & (differing <= 2 * distance)
    shared = t.join(w, (t["key"] == w["key"]) & near)
    pairs = shared.groupBy("token", "word").agg(F.first("freq").alias("freq"), F.first(differing).alias("differing"))

    def measured(lev: Column) -> Column:
        # Beyond two plain edits only swaps come near, one with an edit or two alone; these change few letters. A swap that
        # counts as two plain edits changes none.
        apart = F.abs(F.length("token") - F.length("word"))
        possible = ((lev == 2) | ((lev == 3) & (F.col("differing") <= 2) & (apart <= 1)) | ((lev > 2) & (F.col("differing") == 0) & (apart == 0)))
        plain = ((lev >= 0) & (lev <= 1)) | ((lev == 2) & (F.col("differing") > 0))
        return F.when(plain, lev).when(possible, _distance(F.col("token"), F.col("word"), lev))

    # Measured once: a condition on a column would be worked out again where it is filtered.
    found = F.transform(F.array(F.levenshtein("token", "word", 2 * distance)), measured)
    return pairs.select("token", "word", "freq", F.explode(F.filter(found, lambda d: d <= distance)).alias("distance"))


def _best(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("token").agg(F.min(F.struct("distance", (-F.col("freq")).alias("rank"), "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("correction"), F.col("b.distance").alias("distance"))


def unknown_words(tokens: DataFrame, dictionary: DataFrame, min_length: int = 1) -> DataFrame:
    """Tokens of ``min_length`` letters or more that the dictionary does not know."""
    return tokens.where(F.length("token") >= min_length).join(
        dictionary, F.col("token") == F.col("word"), "left_anti")


def corrections(tokens: DataFrame, dictionary: DataFrame, min_length: int = 1) -> DataFrame:
    """Best dictionary word for each unknown token that has one within two edits."""
    # Vocabulary-sized tables that are needed several times; their source is the whole corpus.
    dictionary = written(dictionary.select("word", "freq"), "dictionary")
    unknown = written(unknown_words(tokens, dictionary, min_length), "unknown")
    first = written(_best(candidates(unknown, dictionary, 1)), "first")
    rest = unknown.join(first, "token", "left_anti")
    return first.unionByName(_best(candidates(rest, dictionary, 2)))


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct lower-cased words of a corpus."""
    return texts.select(F.explode(_words(F.col(column))).alias("token")).distinct()


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PIECES), F.lit(0))


def _words(c: Column) -> Column:
    """Distinct lower-cased words of one text. Words inside placeholders are among them; they are
    never looked up."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), F.lower))


def spell_correct(texts: DataFrame, dictionary: DataFrame, key: str, column: str = "text",
                  out: str = "corrected", min_length: int = 1) -> DataFrame:
    """Add ``out``: the text with unknown words of ``min_length`` letters or more replaced; all else, also placeholders,
    is kept. ``key`` identifies a row."""
    return correct_columns(texts, dictionary, key, {column: out}, min_length)


def correct_columns(texts: DataFrame, dictionary: DataFrame, key: str, columns: Mapping[str, str],
                    min_length: int = 1) -> DataFrame:
    """Correct several text columns of a row at once; ``columns`` maps each to its output name.

    Each row sends its distinct words, over all columns, to one join; the corrections that hit come
    back as small maps per row, so running text is never shuffled by word.
    """
    words = F.array_distinct(F.flatten(F.array(*[_words(F.col(c)) for c in columns])))
    # Cut into words once, for the vocabulary and for the rows to correct.
    tokens = written(texts.select(key, F.explode(words).alias("token")), "tokens")
    fixes = corrections(tokens.select("token").distinct(), dictionary, min_length).select("token", "correction")
    hits = tokens.join(fixes, "token").groupBy(key).agg(
        F.collect_list(F.struct("token", "correction")).alias("_entries"))
    found = texts.join(hits, key, "left").withColumn("_slots", _slotted(F.col("_entries")))

    def fix(piece: Column) -> Column:
        word = F.lower(piece)
        own = F.get(F.col("_slots"), _slot(word, F.size("_slots")))
        # Every other piece is a blank, as a rule.
        return F.when(piece == " ", piece).otherwise(F.coalesce(F.try_element_at(own, word), piece))

    def fixed(column: str) -> Column:
        as_is = F.coalesce(F.col(column), F.lit(""))
        return F.when(F.col("_entries").isNull(), as_is).otherwise(
            F.array_join(F.transform(_pieces(F.col(column)), fix), ""))
    return found.withColumns({out: fixed(c) for c, out in columns.items()}).drop("_entries", "_slots")


def _slot(word: Column, slots: Column) -> Column:
    return F.pmod(F.crc32(word), slots).cast("int")


def _slotted(entries: Column) -> Column:
    """A text's corrections as an array of small maps, about the square root of their number.

    A map is searched from its start, so one map per text would cost its size for every word.
    """
    def maps(numbered: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _slots(numbered) - 1), lambda s: F.map_from_entries(
            F.transform(F.filter(numbered, lambda x: x["slot"] == s), lambda x: x["entry"])))

    # Numbers are worked out once for each entry and bound to names, not again for each slot.
    numbered = F.get(F.transform(F.array(_slots(entries)), lambda n: F.transform(
        entries, lambda e: F.struct(_slot(e["token"], n).alias("slot"), e.alias("entry")))), 0)
    return F.get(F.transform(F.array(numbered), maps), 0)


def _slots(entries: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(entries))).cast("int"))

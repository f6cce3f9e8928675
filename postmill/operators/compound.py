"""Spell correction that also splits and joins words.

An unknown word becomes the dictionary word, or the two or three of them, that it is fewest edits away from; a split is one
edit, and no word takes more than two. Of equally near ones the more frequent wins, several words counting as often as
they would stand side by side by chance. Two neighbouring words, one of them unknown, become one dictionary word
where that takes fewer edits than correcting them apart. All candidates come from equality joins of distinct words, their
beginnings and ends with the dictionary; running text is cut, looked up in and put together row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators import spelling
from postmill.session import written

MOST_EDITS = 2
# Edits that a word counts for which no correction is known.
HOPELESS = MOST_EDITS + 1


def _sizes(dictionary: DataFrame) -> tuple[float, int]:
    """(sum of the frequencies, letters of the longest word)."""
    row = dictionary.agg(F.sum("freq").cast("double").alias("n"), F.max(F.length("word")).alias("longest")).first()
    return float(row["n"] or 1.0), int(row["longest"] or 0)


def _beside(left: Column, right: Column, total: float) -> Column:
    """How often two words of these frequencies would stand side by side."""
    return left * right / F.lit(total)


def _ends(unknown: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(token, i, part): the first i letters of each token, and the letters from i on, as far as a word can be near to them."""
    # No more than three words make a token, and a part is one letter longer than a word at most.
    n, most = F.length("token"), F.lit(longest + 1)
    tokens = unknown.filter((n > 1) & (n <= 3 * longest + 1)).select("token", n.alias("n"))
    spots = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("i")
    heads = tokens.select("token", spots(F.lit(1), F.least(F.col("n") - 1, most)))
    tails = tokens.select("token", spots(F.greatest(F.lit(1), F.col("n") - most), F.col("n") - 1))
    return (heads.withColumn("part", F.substr("token", F.lit(1), F.col("i"))),
            tails.withColumn("part", F.substr("token", F.col("i") + 1)))


def _nearest(parts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(part, word, freq): the most frequent dictionary word one edit from each part."""
    found = spelling.candidates(parts.select(F.col("part").alias("token")).distinct(), dictionary, 1)
    best = found.groupBy("token").agg(F.min(F.struct((-F.col("freq")).alias("rank"), "word")).alias("b"))
    return best.select(F.col("token").alias("part"), F.col("b.word").alias("word"), (-F.col("b.rank")).alias("freq"))


def _exact_splits(unknown: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, tails, splits): beginnings and ends of each token that are words, and the tokens that are two words."""
    total, longest = _sizes(dictionary)
    words = dictionary.select(F.col("word").alias("part"), F.col("freq").cast("double").alias("freq"))
    heads, tails = _ends(unknown, longest)
    heads = written(heads.join(words, "part").select("token", "i", F.col("part").alias("left"), F.col("freq").alias("f_left")), "heads")
    tails = written(tails.join(words, "part").select("token", "i", F.col("part").alias("right"), F.col("freq").alias("f_right")), "tails")
    return heads, tails, written(_read(heads.join(tails, ["token", "i"]), 1, total), "exact-splits")


def _read(rows: DataFrame, edits: int, total: float) -> DataFrame:
    return rows.select("token", F.lit(edits).alias("edits"), _beside(F.col("f_left"), F.col("f_right"), total).alias("estimate"),
                       F.concat_ws(" ", "left", "right").alias("replacement"))


def _rough_splits(heads: DataFrame, tails: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, edits, estimate, replacement): tokens read as two words of which one is an edit off, or as three words.

    ``heads`` and ``tails`` are those of tokens that are not two words.
    """
    total, longest = _sizes(dictionary)
    words = dictionary.select(F.col("word").alias("part"), F.col("freq").cast("double").alias("freq"))
    # The other part of a token one of whose parts is a word. It is none itself, else the token were two words.
    right = heads.withColumn("part", F.substr("token", F.col("i") + 1)).filter(F.length("part") <= longest + 1)
    left = tails.withColumn("part", F.substr("token", F.lit(1), F.col("i"))).filter(F.length("part") <= longest + 1)
    parts = written(right.select("part").unionByName(left.select("part")).distinct(), "parts")
    near = written(_nearest(parts, dictionary), "near-parts")
    rough_right = right.join(near.select("part", F.col("word").alias("right"), F.col("freq").cast("double").alias("f_right")), "part")
    rough_left = left.join(near.select("part", F.col("word").alias("left"), F.col("freq").cast("double").alias("f_left")), "part")
    # A word at the beginning, one at the end, and one between.
    middle = heads.join(tails.withColumnRenamed("i", "j"), "token").filter("j > i") \
        .withColumn("part", F.substr("token", F.col("i") + 1, F.col("j") - F.col("i"))).join(words, "part")
    three = middle.select("token", F.lit(2).alias("edits"), _beside(_beside(F.col("f_left"), F.col("freq"), total), F.col("f_right"), total)
                          .alias("estimate"), F.concat_ws(" ", "left", "part", "right").alias("replacement"))
    return _read(rough_right, 2, total).unionByName(_read(rough_left, 2, total)).unionByName(three)


def _known(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.col("word").alias("token"), F.lit(0).alias("edits"), F.col("freq").cast("double").alias("estimate"),
                             F.col("word").alias("replacement"))


def _unknown_readings(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, edits, estimate, replacement): the best reading of each token, none of which is a word.

    What costs one edit is looked for first. Only tokens without such a reading are compared with words two edits away and
    read as two words with an edit or as three.
    """
    first = written(spelling._best(spelling.candidates(unknown, dictionary, 1)), "first")
    heads, tails, exact = _exact_splits(unknown, dictionary)
    still_open = written(unknown.join(first.select("token").unionByName(exact.select("token")), "token", "left_anti"), "open")
    second = spelling._best(spelling.candidates(still_open, dictionary, 2))
    single = first.unionByName(second).join(dictionary, F.col("correction") == F.col("word")).select(
        "token", F.col("distance").cast("int").alias("edits"), F.col("freq").cast("double").alias("estimate"), F.col("correction").alias("replacement"))
    open_heads, open_tails = (rows.join(still_open, "token", "left_semi") for rows in (heads, tails))
    ways = single.unionByName(exact).unionByName(_rough_splits(open_heads, open_tails, dictionary))
    best = ways.groupBy("token").agg(F.min(F.struct("edits", (-F.col("estimate")).alias("rank"), "replacement")).alias("b"))
    return best.select("token", "b.edits", (-F.col("b.rank")).alias("estimate"), "b.replacement")


def readings(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, edits, estimate, replacement) of each token that is a word or can be read as words; edits is 0 for a word.

    ``tokens`` has distinct ``token``s, ``dictionary`` distinct ``word``s with ``freq``.
    """
    unknown = written(spelling.unknown_words(tokens, dictionary), "unknown")
    known = _known(dictionary).join(tokens, "token", "left_semi")
    return known.unionByName(_unknown_readings(unknown, dictionary))


def _neighbours(cut: DataFrame, key: str, longest: int) -> DataFrame:
    """(key, i, a, b): words ``a`` and ``b`` with blanks between them, together no longer than a word can be; i is the place of ``a``."""
    i, piece = F.col("i"), lambda at: F.get("_pieces", at)
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_pieces") - 3, F.lit(0)))).alias("i")
    # What stands beside blanks is a word, a placeholder or a "<".
    words = ~F.startswith(piece(i), F.lit("<")) & ~F.startswith(piece(i + 2), F.lit("<"))
    pairs = cut.select(key, "_pieces", places).filter((F.trim(piece(i + 1)) == "") & words)
    return pairs.select(key, "i", F.lower(piece(i)).alias("a"), F.lower(piece(i + 2)).alias("b")) \
        .filter(F.length("a") + F.length("b") <= longest)


def spell_compound(texts: DataFrame, dictionary: DataFrame, key: str, column: str = "text", out: str = "corrected") -> DataFrame:
    """Add ``out``: the text with unknown words corrected, split or joined with a neighbour; all else is kept.

    ``key`` identifies a row. Words are runs of letters outside placeholders. Neighbours are joined only over blanks;
    where a word could be joined with either neighbour, pairs are taken from the left. Null texts give an empty text.
    """
    dictionary = written(dictionary.select("word", "freq"), "dictionary")
    total, longest = _sizes(dictionary)
    # Cut once: into words for the vocabulary, into pieces for the pairs and for what is put together in the end.
    cut = written(texts.withColumns({"_pieces": spelling._pieces(F.col(column)), "_words": spelling._words(F.col(column))}), "cut")
    tokens = cut.select(key, F.explode("_words").alias("token"))
    unknown = written(spelling.unknown_words(tokens.select("token").distinct(), dictionary), "unknown")
    fixes = written(_unknown_readings(unknown, dictionary), "readings")
    entry = F.struct("token", "replacement")
    hits = tokens.join(fixes.select("token", "replacement"), "token").groupBy(key).agg(F.collect_list(entry).alias("_entries"))

    whole = _neighbours(cut, key, longest).join(dictionary.select(F.col("word").alias("joined"), F.col("freq").cast("double").alias("f")),
                                                F.concat("a", "b") == F.col("joined"))
    known = _known(dictionary).unionByName(fixes)
    cost = lambda side: known.select(F.col("token").alias(side), F.col("edits").alias(f"e_{side}"), F.col("estimate").alias(f"f_{side}"))
    costed = whole.join(cost("a"), "a", "left").join(cost("b"), "b", "left")
    apart = F.coalesce("e_a", F.lit(HOPELESS)) + F.coalesce("e_b", F.lit(HOPELESS))
    better = (apart > 1) | ((apart == 1) & (F.col("f") > _beside(F.col("f_a"), F.col("f_b"), total)))
    wanted = costed.filter(better).select(key, "i", "joined")
    # A row of words that could each be joined with the next: the first pair, the third and so on. Words are two pieces apart.
    after = F.col("i") - 2 * F.row_number().over(Window.partitionBy(key).orderBy("i"))
    within = F.row_number().over(Window.partitionBy(key, "_run").orderBy("i"))
    chosen = wanted.withColumn("_run", after).withColumn("_nth", within).filter(F.col("_nth") % 2 == 1)
    entry = F.struct(F.col("i").cast("string").alias("token"), "joined")
    marks = chosen.groupBy(key).agg(F.collect_list(entry).alias("_marks"))

    def slotted(entries: str, of: DataFrame) -> Column:
        return spelling._slotted(F.coalesce(entries, F.array().cast(of.schema[entries].dataType)))

    found = cut.drop("_words").join(hits, key, "left").join(marks, key, "left") \
        .withColumns({"_slots": slotted("_entries", hits), "_joined": slotted("_marks", marks)})

    def look(column: str, token: Column) -> Column:
        return F.try_element_at(F.get(F.col(column), spelling._slot(token, F.size(column))), token)

    def corrected(p: Column) -> Column:
        # Every other piece is a blank, as a rule.
        return F.when(p == " ", p).otherwise(F.coalesce(look("_slots", F.lower(p)), p))

    def fixed(p: Column, i: Column) -> Column:
        joined = lambda at: look("_joined", at.cast("string"))
        gone = joined(i - 1).isNotNull() | joined(i - 2).isNotNull()
        return F.when(gone, "").otherwise(F.coalesce(joined(i), corrected(p)))

    pieces = F.when(F.col("_marks").isNotNull(), F.transform("_pieces", fixed)) \
        .when(F.col("_entries").isNotNull(), F.transform("_pieces", corrected)).otherwise(F.col("_pieces"))
    return found.withColumn(out, F.array_join(pieces, "")).drop("_slots", "_pieces", "_joined", "_marks", "_entries")

"""What keeps spell correction small: letters are compared before words, and slots are numbered once."""

import itertools
import random

from pyspark.sql import functions as F

from postmill.operators import spelling


def edited(r, word):
    """The word with one edit or swap of neighbours."""
    at, kind = r.randrange(len(word) + 1), r.randrange(4)
    letter = r.choice("abcdeéß")
    if kind == 0:
        return word[:at] + letter + word[at:]
    if kind == 1:
        return word[:at] + word[at + 1:] or letter
    if kind == 2:
        return word[:at] + letter + word[at + 1:]
    return word[:at] + word[at + 1:at + 2] + word[at:at + 1] + word[at + 2:]


def test_letters_of_near_words_differ_in_few_bits(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeßü日😀") for _ in range(r.randint(1, 9))) for _ in range(500)]
    rows = [(w, edited(r, w), edited(r, edited(r, w))) for w in words]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    bits = {c: spelling.letter_bits(c) for c in "abc"}
    far = df.select(F.bit_count(bits["a"].bitwiseXOR(bits["b"])).alias("one"), F.bit_count(bits["a"].bitwiseXOR(bits["c"])).alias("two"))
    most = far.agg(F.max("one"), F.max("two")).first()
    assert most[0] <= 2 and most[1] <= 4


def test_pairs_of_other_letters_are_dropped_at_the_join(spark):
    tokens = spark.createDataFrame([("abcdexyz",), ("abcdefhg",)], "token string")
    dictionary = spark.createDataFrame([("abcdefgh", 3)], "word string, freq long")
    found = spelling.candidates(tokens, dictionary, 2)
    assert [(x.token, x.distance) for x in found.collect()] == [("abcdefhg", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "bit_count" in line for line in plan.splitlines())


def test_slots_hold_every_entry_once(spark):
    for n in (0, 1, 2, 500):
        made = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("token"), i.alias("v")))
        entries = made if n else F.expr("cast(array() as array<struct<token:string,v:int>>)")
        slots = spark.range(1).select(spelling._slotted(entries).alias("s")).first()["s"]
        assert len(slots) == max(1, -(-n ** 0.5 // 1))
        assert {k: v for m in slots for k, v in m.items()} == {f"w{i}": i for i in range(1, n + 1)}
        assert sum(len(m) for m in slots) == n


def test_delete_keys_are_all_ways_to_leave_letters_out(spark):
    words = ["", "a", "aa", "straße", "thethe", "abcdefg", "abcdefgh", "日本語", "😀a😀bc"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for distance in (0, 1, 2):
        got = df.select("w", spelling.delete_keys(F.col("w"), distance, 7).alias("k")).collect()
        for w, keys in got:
            head = w[:7]
            want = {"".join(c) for n in range(distance + 1) for c in itertools.combinations(head, max(0, len(head) - n))}
            assert len(keys) == len(want) and set(keys) == want


def test_a_key_is_one_flat_expression(spark):
    df = spark.createDataFrame([("abcdefgh",)], "w string").select(spelling.delete_keys(F.col("w"), 2, 7))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()

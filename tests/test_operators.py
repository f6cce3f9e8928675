"""Operators against brute force on small fixtures, hot groups included."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postmill.operators import addresses, attachments, dedup, dictionary, folders, health, index, messages, spelling, textsteps
from postmill.operators.numbering import numbered
from postmill.sources import readers


def test_numbered_with_a_hot_group(spark):
    rng = random.Random(1)
    pos = rng.sample(range(100_000), 3000)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", p) for p in pos]
    df = spark.createDataFrame(rows, "k string, p long").repartition(7)
    out = numbered(df, ["k"], [F.col("p")], [F.expr("p div 10000"), F.expr("p div 500")], "n").collect()
    groups = {}
    for k, p in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append(p)
    assert {(r["k"], r["p"]): r["n"] for r in out} == {(k, p): i for k, ps in groups.items() for i, p in enumerate(ps)}
    everything = numbered(df, [], [F.col("p")], [F.expr("p div 10000"), F.expr("p div 500")], "n").collect()
    assert {r["p"]: r["n"] for r in everything} == {p: i for i, p in enumerate(sorted(pos))}


def test_keep_first(spark):
    rng = random.Random(2)
    keys = ["hot", "", None] + [f"k{i}" for i in range(50)]
    rows = [(rng.choice(keys[:3]) if rng.random() < 0.5 else rng.choice(keys), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, scan_pos long").repartition(5)
    seen, want = set(), set()
    for k, i in rows:
        if k and k in seen:
            continue
        seen.add(k)
        want.add(i)
    kept = dedup.keep_first(df, F.col("k"))
    assert {r["scan_pos"] for r in kept.collect()} == want
    assert dedup.keep_first(kept, F.col("k")).count() == len(want)
    stats = dedup.dedup_stats(df, F.col("k")).first()
    assert (stats["total"], stats["unique"], stats["duplicates"]) == (2000, len(want), 2000 - len(want))


def test_equal_records_without_ids_collapse(spark):
    row = ("", "", "Subject", "", "sender@example.com", "2025-01-01", "")
    names = ["Email_ID", "Message_ID", "Subject", "Sender_Email", "From", "Date_Received", "Date_Sent"]
    df = spark.createDataFrame([(*row, 0), (*row, 1)], [*names, "scan_pos"])
    assert [r["scan_pos"] for r in dedup.keep_first(df, dedup.record_key()).collect()] == [0]


def sequential_names(names):
    taken, out = set(), []
    for n in names:
        stem, dot, ext = n.rpartition(".")
        stem, suffix = (stem, dot + ext) if stem and ext else (n, "")
        pick, k = n, 2
        while pick in taken:
            pick, k = f"{stem}_{k}{suffix}", k + 1
        taken.add(pick)
        out.append(pick)
    return out


def test_stored_names_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    pool = ["a.txt", "a_2.txt", "a_3.txt", "a_2_2.txt", "a_2_3.txt", "a_2_2_2.txt", "b", "b_2", "b_02", "c.d.e", "c.d_2.e"]
    boxes = {m: [rng.choice(pool[:rng.randint(1, len(pool))]) for _ in range(rng.randint(1, 14))] for m in range(150)}
    boxes[1000] = ["test.txt", "test.txt"]
    boxes[1001] = ["document.pdf", "document_2.pdf", "document_3.pdf", "document.pdf"]
    boxes[1002] = ["README", "README"]
    rows = [(m, i, n) for m, ns in boxes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "m long, i long, safe_name string").repartition(4)
    out = attachments.stored_names(df, ["m"], "i").collect()
    got = {(r["m"], r["i"]): r["stored_name"] for r in out}
    assert got == {(m, i): s for m, ns in boxes.items() for i, s in enumerate(sequential_names(ns))}
    assert [got[(1001, i)] for i in range(4)][-1] == "document_4.pdf"


def test_stored_names_of_a_hot_message(spark):
    rows = [(7, i, "same.bin") for i in range(10_000)]
    out = attachments.stored_names(spark.createDataFrame(rows, "m long, i long, safe_name string"), ["m"], "i")
    got = {r["i"]: r["stored_name"] for r in out.collect()}
    assert got[0] == "same.bin" and all(got[i] == f"same_{i + 1}.bin" for i in range(1, 10_000))


def test_stored_names_of_a_message_with_a_hundred_thousand_literal_names(spark):
    """Files of one name among literal numbered ones, before and after them: the rule by the free numbers as they go."""
    rng = random.Random(11)
    names = ["a.txt"] * 30_000 + [f"a_{k}.txt" for k in range(2, 100_002)]
    rng.shuffle(names)
    want, used, free = [], set(), 2
    for n in names:
        if n in used or (n == "a.txt" and want and "a.txt" in used):
            if n != "a.txt":  # a literal name that is taken gets a number of its own; its first is free
                n = f"{n[:-4]}_2.txt"
            else:
                while f"a_{free}.txt" in used:
                    free += 1
                n = f"a_{free}.txt"
        used.add(n)
        want.append(n)
    t0 = time.perf_counter()
    df = spark.createDataFrame([(7, i, n) for i, n in enumerate(names)], "m long, i long, safe_name string")
    got = {r["i"]: r["stored_name"] for r in attachments.stored_names(df, ["m"], "i").collect()}
    assert [got[i] for i in range(len(names))] == want
    assert time.perf_counter() - t0 < 120


def edits_within_two(a):
    letters = "abcdeé"

    def once(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return ({x + y[1:] for x, y in cuts if y} | {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1}
                | {x + c + y[1:] for x, y in cuts if y for c in letters} | {x + c + y for x, y in cuts for c in letters})
    first = once(a) | {a}
    return {a: 0} | {w: 1 for w in first - {a}} | {v: 2 for v in set().union(*(once(w) for w in first)) - first}


@pytest.mark.parametrize("distance", [1, 2])
def test_spelling_candidates_equal_brute_force(spark, distance):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    tokens, words = {word() for _ in range(60)}, {word() for _ in range(120)}
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    d = spark.createDataFrame([(x, 1) for x in words], "word string, freq long")
    got = {(r["token"], r["word"]): r["distance"] for r in spelling.candidates(t, d, distance).collect()}
    near = {x: edits_within_two(x) for x in tokens}
    assert got == {(x, w): near[x][w] for x in tokens for w in words if w in near[x] and near[x][w] <= distance}


def test_spelling_keeps_everything_else(spark):
    d = spark.createDataFrame([("hello", 10), ("help", 30), ("world", 5)], "word string, freq long")
    t = spark.createDataFrame([(1, "Hlelo <EMAIL>, wrold! helo xyzzyx ab <"), (2, None), (3, "Hello")], "id int, text string")
    got = {r["id"]: r["corrected"] for r in spelling.spell_correct(t, d, "id").collect()}
    # helo is one edit from both hello and help; the more frequent one wins
    assert got == {1: "hello <EMAIL>, world! help xyzzyx ab <", 2: "", 3: "Hello"}


def test_spelling_of_several_columns(spark):
    d = spark.createDataFrame([("hello", 10), ("world", 5)], "word string, freq long")
    t = spark.createDataFrame([(1, "Hlelo", "my wrold"), (2, None, "fine")], "id int, a string, b string")
    got = {r["id"]: (r["a"], r["b"]) for r in spelling.correct_columns(t, d, "id", {"a": "a", "b": "b"}).collect()}
    assert got == {1: ("hello", "my world"), 2: ("", "fine")}


def test_address_report_of_lists_and_texts(spark):
    rows = [("A@x.org", "", "", ["B@y.org", "none", " ", "Doe, Jo; x"], "a@x.org; c", None)]
    df = spark.createDataFrame(rows, "Sender_Email string, Reply_To string, Return_Path string, To array<string>, CC string, BCC string")
    got = {r["Address"]: r for r in addresses.address_report(df).collect()}
    assert set(got) == {"a@x.org", "b@y.org", "c", "doe, jo; x"}
    assert got["a@x.org"]["Count"] == 2 and got["a@x.org"]["Roles"] == ["cc", "sender"]
    assert got["c"]["Domains"] == [""] and got["c"]["Names"] == ["c"]
    compact = {r["Address"]: r for r in addresses.address_report(df, compact=True).collect()}
    assert compact["c"]["Domains"] == []
    hops = spark.createDataFrame([(["A.example ", "b"],), (["b"],)], "Received_Hops array<string>")
    assert [(r["Host"], r["Count"]) for r in addresses.host_report(hops).collect()] == [("b", 2), ("a.example", 1)]


@pytest.mark.parametrize("bad,seen,score", [(10, 200, 95.0), (0, 0, 100.0), (5, 5, 0.0), (50, 100, 50.0), (10, 100, 90.0)])
def test_health_score(spark, bad, seen, score):
    assert spark.range(1).select(health.health_score(F.lit(bad), F.lit(seen))).first()[0] == score


def test_folder_paths(spark):
    df = spark.createDataFrame([(["", "A", ""],), (["Top"],), ([],)], "s array<string>").coalesce(1)
    assert [r[0] for r in df.select(folders.folder_path(F.col("s"))).collect()] == ["/Root/A/(Unnamed)", "/Top", "/Root"]
    known = spark.createDataFrame([("/Root/A",), ("/Root/A/B",)], "folder_path string")
    assert folders.resolve_folder(known, "/A//B").count() == 1
    assert folders.resolve_folder(known, "/Root/X").count() == 0
    with pytest.raises(ValueError):
        folders.resolve_folder(known, "A/B")


def test_folder_page_limits(spark):
    df = spark.createDataFrame([("/Root/A", i, i % 2 == 0) for i in range(10)], "folder_path string, pos long, parsed boolean")
    assert [r["pos"] for r in messages.folder_page(df, "/Root/A", 3, 2).collect()] == [4, 6]
    assert messages.folder_page(df, "/Root/A", 0, 0).count() == 0


def test_enrichment_keeps_a_message_in_one_row(spark):
    rows = [(1, i, f"f{i}.txt", f"text {i}".encode()) for i in range(10)] + [(2, 0, "p.pdf", b"%PDF-1")]
    df = spark.createDataFrame(rows, "m long, attachment_index long, safe_name string, content binary")
    described = attachments.describe_content(df).withColumn("stored_name", F.col("safe_name"))
    out = attachments.enrich(described, ["m"]).orderBy("m").collect()
    assert [(r["m"], len(r["Attachment_Metadata"])) for r in out] == [(1, 10), (2, 1)]
    assert out[0]["Attachment_Content"] == "\n\n".join(f"text {i}" for i in range(10))
    assert out[1]["Attachment_Types"] == ["application/pdf"]


def test_content_over_limit_keeps_the_row(spark):
    df = spark.createDataFrame([(0, "a.txt", b"x" * 2_000_000), (1, "b.txt", b"ok")], "attachment_index long, safe_name string, content binary")
    got = {r["attachment_index"]: r for r in attachments.describe_content(df, max_mb=1).collect()}
    assert got[0]["error_message"] == "Attachment too large (2000000 bytes > 1MB)" and got[0]["mime_type"] == "application/octet-stream"
    assert got[1]["error_message"] is None and got[1]["extracted_text"] == "ok"


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "good.txt").write_text("# header\nalpha 10\n\nbeta\t3\nthree word line 5\n" + "".join(f"w{i} {i}\n" for i in range(50)))
    (tmp_path / "bad.txt").write_text("alpha 99\nbroken\nbroken too much\n")
    (tmp_path / "more.txt").write_text("alpha 12\ngamma -4\n" + "".join(f"v{i} 1\n" for i in range(20)))
    lines = readers.read_dictionary_lines(spark, *[str(p) for p in sorted(tmp_path.iterdir())])
    verdict = {r["source"].rsplit("/", 1)[1]: r for r in dictionary.validate(lines).collect()}
    assert verdict["good.txt"]["is_valid"] and verdict["more.txt"]["is_valid"] and not verdict["bad.txt"]["is_valid"]
    assert verdict["bad.txt"]["message"] == "Too many invalid lines: 2/3"
    merged = {r["word"]: r["freq"] for r in dictionary.merge(lines).collect()}
    assert merged["alpha"] == 12 and merged["beta"] == 3 and merged["gamma"] == 0 and len(merged) == 73
    first = dictionary.by_frequency(dictionary.merge(lines)).first()
    assert first["freq"] == 49


def test_text_steps_order_and_failures(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now"), (2, None), (3, "boom")], "id int, text string")

    def shout():
        def run(t):
            if t == "boom":
                raise ValueError
            return t.upper()
        return run
    got = {r["id"]: r["processed"] for r in textsteps.text_steps(df, "id", grammar=shout).collect()}
    assert got == {1: "MAIL <EMAIL> NOW", 2: "", 3: "boom"}
    plain = {r["id"]: r["processed"] for r in textsteps.text_steps(df, "id", sanitize=False).collect()}
    assert plain == {1: "mail a@b.co now", 2: "", 3: "boom"}


def test_chunks_cover_the_text(spark):
    words = " ".join(f"word{i}" for i in range(1000))
    rows = textsteps.chunk_text(spark.createDataFrame([(1, words), (2, "x" * 1500), (3, "  ")], "id int, text string")).collect()
    mine = [r["chunk"] for r in sorted(rows, key=lambda r: (r["id"], r["chunk_no"])) if r["id"] == 1]
    assert " ".join(mine) == words and max(map(len, mine)) <= textsteps.CHUNK
    assert [r["chunk"] for r in rows if r["id"] == 2] == ["x" * 1500]
    assert not [r for r in rows if r["id"] == 3]


def test_index_accepts_short_names(spark):
    named = index.with_known_names(spark.createDataFrame([("s", 1)], "preview string, id int"))
    assert {"Body", "Email_ID"} <= set(named.columns)

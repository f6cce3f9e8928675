"""Cases the sample tables do not hold: positions, large messages, old mail, long words, real file heads."""

import html

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import files, flat, masking, text
from postmill.operators import attachments, messages, spelling
from postmill.plans import jobs, queries_attachments
from postmill.sinks import writers
from postmill.sources import readers, sample
from postmill.streaming import streams

ATT = ("folder_path string, message_index long, attachment_index long, long_filename string, file_name string, name string, "
       "size string, content binary")


def raw_message(spark, sf_dir, rows):
    """Rows (pos, message id) as mailbox rows of one folder."""
    template = sample.mailbox(spark, sf_dir).limit(1).drop("pos", "scan_pos", "internet_message_id", "folder_path", "number_of_attachments")
    ids = spark.createDataFrame(rows, "pos long, internet_message_id string")
    return ids.crossJoin(template).withColumns({"folder_path": F.lit("/Root/A"), "scan_pos": F.col("pos") + 100,
                                                "number_of_attachments": F.lit(0)})


def exchanges_with(df, column):
    """Shuffles of the plan that carry a column, adaptive parts included."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if name == "Exchange" and any(node.output().apply(i).name() == column for i in range(node.output().size())):
            found += 1
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_files_follow_their_message_when_copies_and_broken_rows_go(spark, sf_dir, tmp_path):
    raw = raw_message(spark, sf_dir, [(0, "<a>"), (3, "<a>"), (5, "<x>"), (6, "<b>"), (9, "<c>")])
    raw = raw.withColumn("_corrupt_record", F.when(F.col("internet_message_id") == "<x>", "{"))
    att = spark.createDataFrame([("/Root/A", m, 0, f"{n}.txt", "", "", "1", n.encode()) for m, n in ((0, "a"), (3, "b"), (4, "c"))], ATT)
    result = jobs.extract(spark, raw, str(tmp_path), jobs.Options(deduplicate=True, attachment_text=True), att)
    rows = {r["Message_ID"]: r for r in spark.read.json(result.paths["json"]).collect()}
    assert set(rows) == {"<a>", "<b>", "<c>"} and result.email_count == 3 and result.attachments_saved == 3
    for n in "abc":
        r = rows[f"<{n}>"]
        assert [p.split("/")[1] for p in r["Attachment_Paths"]] == [f"{n}.txt"] and r["Attachment_Content"] == n
        assert r["Attachment_Metadata"][0]["filename"] == f"{n}.txt" and r["Attachment_Types"] == ["text/plain"]
    csv = {r["Message_ID"]: r for r in writers.read_csv(spark, writers.write_csv(spark.read.json(result.paths["json"]), str(tmp_path / "c"))).collect()}
    assert csv["<b>"]["Attachment_Content"] == "b" and '"filename": "b.txt"' in csv["<b>"]["Attachment_Metadata"]
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.extract(spark, raw, str(tmp_path), jobs.Options(deduplicate=True), att)


def test_a_message_with_many_files_stays_one_message(spark, sf_dir, tmp_path):
    raw = raw_message(spark, sf_dir, [(0, "<a>"), (1, "<b>")])
    n = 1200
    att = spark.createDataFrame([("/Root/A", 0, i, f"f{i}.txt", "", "", "1", b"t") for i in range(n)], ATT)
    result = jobs.extract(spark, raw, str(tmp_path), jobs.Options(formats=["json", "csv", "mbox"], index=True, attachment_text=True), att)
    assert (result.email_count, result.attachments_saved) == (2, n)
    back = spark.read.json(result.paths["json"])
    assert sorted(len(r["Attachment_Paths"]) for r in back.collect()) == [0, n] and "part" not in back.columns
    assert max(r["Attachment_Count"] for r in back.collect()) == n
    assert spark.read.parquet(result.paths["index"]).count() == 2


def test_attachment_texts_are_masked_and_rewriters_run(spark, sf_dir, tmp_path):
    raw = raw_message(spark, sf_dir, [(0, "<a>")]).withColumn("subject", F.lit("plain words"))
    att = spark.createDataFrame([("/Root/A", 0, 0, "a.txt", "", "", "1", b"write to me@mill.example.org")], ATT)
    options = jobs.Options(mask=True, mask_all_text=True, attachment_text=True, grammar=lambda: lambda t: t.replace("plain", "PLAIN"),
                           neural=lambda: lambda p: p.removeprefix("improve grammar: ") + ".")
    row = spark.read.json(jobs.extract(spark, raw, str(tmp_path), options, att).paths["json"]).first()
    assert row["Attachment_Content"] == row["Attachment_Metadata"][0]["extracted_text"] == "write to <EMAIL>"
    assert row["Subject"] == "PLAIN words."


def test_bytes_cross_one_exchange(spark, sf_dir):
    """Names are settled on written tables of names; a table that held the bytes would show as a wider schema."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_with(queries_attachments._saved(spark, sf_dir), "content") == 1
        records = spark.createDataFrame([("/Root/Inbox", i, i, f"id{i}") for i in range(70)],
                                        "folder_path string, pos long, scan_pos long, Email_ID string")
        stored = jobs.stored_attachments(records, records, sample.attachments(spark, sf_dir))
        assert exchanges_with(stored, "content") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_with_large_literal_numbers_stay_unique(spark):
    n = 10_050
    rows = [("m", i, "a.txt") for i in range(n)] + [("m", n, "a_10000.txt"), ("m", n + 1, "a_99999999999999999999.txt")]
    att = spark.createDataFrame(rows, "k string, i long, safe_name string")
    got = [r["stored_name"] for r in attachments.stored_names(att, ["k"], "i").collect()]
    assert len(got) == len(set(got)) == n + 2


def test_a_page_moves_no_bodies(spark, sf_dir, tmp_path):
    sample.mailbox(spark, sf_dir).write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    page = messages.folder_page(df, "/Root/Inbox", 5, 10)
    assert exchanges_with(page, "html_body") == 0
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
    whole = messages.with_message_index(df.where("folder_path = '/Root/Inbox'")).orderBy("message_index").collect()
    assert [r["scan_pos"] for r in page.collect()] == [r["scan_pos"] for r in whole[5:15]]


def test_stream_dedup_keeps_mail_of_any_age(spark, tmp_path):
    for i, day in enumerate(["2024-12-01", "2024-06-01", "2023-01-01"]):
        rows = [(f"k{i}{j}" if j else "", day, i * 10 + j) for j in (0, 1, 1, 2)]
        spark.createDataFrame(rows, "Email_ID string, day string, scan_pos long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = streams.file_stream(spark, str(tmp_path / "in/*"), T.StructType.fromDDL("Email_ID string, day string, scan_pos long"), files_per_trigger=1)
    streams.stream_dedup(stream, "Email_ID", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [r["Email_ID"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["", "", ""] + sorted(f"k{i}{j}" for i in range(3) for j in (1, 2))


def test_hours_are_complete_whatever_the_order(spark, tmp_path):
    hours = ["2024-05-03 10:10:00", "2024-05-03 10:50:00", "2024-05-01 00:00:00", "2020-01-01 05:00:00", "2024-05-03 10:59:59"]
    for i, h in enumerate(hours):
        spark.createDataFrame([(h,)], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = streams.file_stream(spark, str(tmp_path / "in/*"), T.StructType.fromDDL("ts timestamp"), files_per_trigger=1)
    streams.stream_hourly_volume(stream, "ts", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {str(r["hour_start"]): r["n"] for r in streams.latest_volume(spark, str(tmp_path / "out")).collect()}
    assert got == {"2024-05-03 10:00:00": 3, "2024-05-01 00:00:00": 1, "2020-01-01 05:00:00": 1}


@pytest.mark.parametrize("distance", [1, 2])
def test_keys_of_prefixes_find_what_keys_of_whole_words_find(spark, distance):
    words = ["abcdefghij", "abcdefg", "abcdefgh", "banana", "bandana", "straßenbahn", "a", "ab", "zzzzzzzzz"]
    tokens = set()
    for w in words:
        tokens |= {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + "q" + w[i:] for i in range(len(w) + 1)}
        tokens |= {w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)} | {w[:i] + "q" + w[i + 1:] for i in range(len(w))}
        tokens |= {w[1:6] + "x" + w[7:], "qq" + w, w + "qq", w[2:], w[:5] + w[6:7] + w[5:6] + w[8:9] + w[7:8] + w[9:]}
    t = spark.createDataFrame([(x,) for x in sorted(tokens - {""})], "token string")
    d = spark.createDataFrame([(w, 1) for w in words], "word string, freq long")
    rows = lambda p: {tuple(r) for r in spelling.candidates(t, d, distance, p).select("token", "word", "distance").collect()}
    assert rows(spelling.PREFIX) == rows(1000) != set()


def test_very_long_words_cost_nothing(spark):
    d = spark.createDataFrame([("hello", 5), ("world", 4)], "word string, freq long")
    t = spark.createDataFrame([(1, "acgt" * 25_000 + " helo wrold"), (2, "x"), (3, None)], "id long, text string")
    got = {r["id"]: r["corrected"] for r in spelling.spell_correct(t, d, "id").collect()}
    assert got == {1: "acgt" * 25_000 + " hello world", 2: "x", 3: ""}


def test_short_words_can_be_left_alone(spark):
    d = spark.createDataFrame([("to", 5), ("hello", 1)], "word string, freq long")
    t = spark.createDataFrame([(1, "tp helo")], "id long, text string")
    assert spelling.spell_correct(t, d, "id").first()["corrected"] == "to hello"
    assert spelling.spell_correct(t, d, "id", min_length=3).first()["corrected"] == "tp hello"


def test_references_as_the_standard_library_reads_them(spark):
    names = list(html.entities.html5)
    rows = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}tail" for n in names[::5]]
    rows += [f"&#{n};&#x{n:x} &#{n}z" for n in [*range(170), 0xD800, 0xFDD0, 0xFFFF, 0x10FFFF, 0x110000, 10**30]]
    rows += ["&", "&&", "& x", "&#", "&#;", "&#x;", "&;", "&\n", "&" + "a" * 50, "&amp;amp;lt;", "no reference"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    assert [r[0] for r in df.select("i", text.unescape(F.col("s")).alias("o")).orderBy("i").select("o").collect()] == [html.unescape(s) for s in rows]


def test_types_of_containers_and_bitmaps(spark):
    cases = [(b"PK\x03\x04..", "a.docx", files.DOCX, "docx_native"), (b"PK\x03\x04..", "a.zip", "application/zip", "fallback"),
             (b"PK\x03\x04..", "a", "application/zip", "fallback"), (b"BMW cars are", "a.txt", "text/plain", "direct"),
             (b"BM\x10\x00\x00\x00\x00\x00\x00\x00\x36", "a.bin", "image/bmp", "ocr"),
             (bytes.fromhex("D0CF11E0A1B11AE1"), "a.doc", "application/octet-stream", "fallback"),
             (bytes.fromhex("D0CF11E0A1B11AE1"), "a.msg", "application/vnd.ms-outlook", "msg_eml")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c binary, n string, m string, r string")
    mime = files.mime_from_content(F.col("c"), F.col("n"))
    got = df.select("n", "m", "r", mime.alias("mime"), files.extraction_method(mime).alias("route")).collect()
    assert [(r["n"], r["mime"], r["route"]) for r in got] == [(r["n"], r["m"], r["r"]) for r in got]


def test_doubles_read_like_pythons(spark):
    values = [1704105600.0, 1704105600.25, 0.1, 1e16, 1.5e16, 123456789012345.6, 1e-4, 0.00012345, 1e-5, 2.5e-10, -1e7, -12345678.9, 1e300,
              float("inf"), float("-inf"), float("nan"), 1.0, 9999999.0, 1e15]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = df.select("i", flat.csv_value(F.col("v"), T.DoubleType()).alias("s"), flat.spaced_json(F.array("v"), T.ArrayType(T.DoubleType())).alias("j"))
    assert [(r["s"], r["j"]) for r in got.orderBy("i").collect()] == [(repr(v), f"[{v!r}]") for v in values]


def test_custom_patterns_are_the_jvms(spark):
    rules = masking.masking_rules({"SSN": r"(?P<n>\d{3})-\d{2}-\d{4}", "TWICE": r"(?P<w>\w+) (?P=w)", "BAD": "[", "LOOK": r"(?<=a+)b"})
    assert "BAD" not in rules and rules["SSN"].startswith("(?<n>")
    df = spark.createDataFrame([("id 123-45-6789 go go",)], "s string")
    out = df.select(masking.mask_pii(F.col("s"), {"SSN": r"(?P<n>\d{3})-\d{2}-\d{4}", "TWICE": r"\b(?P<w>\w+) (?P=w)\b"})).first()[0]
    assert out == "id <SSN> <TWICE>"


def test_keyed_members_escape_ids(spark):
    import json
    df = spark.createDataFrame([('a"b\\', "s")], "Email_ID string, Subject string")
    member = writers.keyed_document(df).first()["member"]
    assert list(json.loads("{" + member + "}")) == ['a"b\\']


def test_broken_rows_can_keep_their_place(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"folder_path": "/Root/A", "pos": 1}\n{"folder_path": "/Root/A", "pos": 2, "is_read": 7}\n')
    kept = readers.read_messages(spark, str(tmp_path), "json", keep_unparsed=True)
    assert "_corrupt_record" in kept.columns and kept.select("pos", "_corrupt_record").count() == 2

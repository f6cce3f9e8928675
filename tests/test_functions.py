"""Small literal inputs for the column functions."""

import hashlib
import html
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import address, display, files, flat, headers, identity, masking, text


def values(spark, inputs, expr, dtype="string"):
    """Results of a column function over single values, in order."""
    rows = [(i, v) for i, v in enumerate(inputs)]
    schema = T.StructType([T.StructField("i", T.IntegerType()),
                           T.StructField("x", dtype if isinstance(dtype, T.DataType) else T.StringType())])
    out = spark.createDataFrame(rows, schema).select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(out, key=lambda r: r["i"])]


def test_masking_examples(spark):
    got = values(spark, [
        "write to desk.7@mill.example.org, ring 555.010.7788, host 10.20.30.40", "see https://files.example.net/a/me@mill.example.org",
        "(555) 010-7788", "", None, "ring +44 555 010 7788 now", "twelve letters"], masking.mask_pii)
    assert got[0] == "write to <EMAIL>, ring <PHONE>, host <IP>"
    assert "<URL>" in got[1] and "<EMAIL>" in got[1]
    assert got[2] == "<PHONE>" and got[3] == "" and got[4] == ""
    assert "<PHONE>" in got[5] and got[6] == "twelve letters"


def test_masking_equals_all_patterns_one_after_the_other(spark):
    def plain(c):
        for key, pattern in masking.PATTERNS.items():
            c = F.regexp_replace(c, f"(?U){pattern}", f"<{key}>")
        return c

    r = random.Random(3)
    parts = ["1", "23", "456", "7890", "\u0661\u0662\u0663\u0664", ".", ":", "-", " ", "@", "://", "a.b", "cafe", "f", "http", "<", "(", ")"]
    inputs = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    inputs += ["1:2:3:4:5:6:7:8", "a@b.cd1.2.3.4", "10.0.0.1", "fe80:0:0:0:a:b:c:d", "x5550107788y"]
    assert values(spark, inputs, masking.mask_pii) == values(spark, inputs, plain)


def test_texts_without_digits_run_no_digit_patterns(spark):
    df = spark.createDataFrame([("x",)], "t string").select(masking.mask_pii(F.col("t")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") >= 2 and plan.count("<EMAIL>") <= 2


def test_masking_custom_patterns(spark):
    custom = {"BADGE": r"B\d{4}-[A-Z]", "UNCLOSED": "(a"}
    assert values(spark, ["badge B1234-Q here"], lambda c: masking.mask_pii(c, custom)) == ["badge <BADGE> here"]
    assert list(masking.masking_rules(custom)) == ["EMAIL", "PHONE", "IP", "URL", "BADGE"]
    assert masking.masking_rules({"EMAIL": "x"})["EMAIL"] == "x"
    assert list(masking.masking_rules({"EMAIL": "x"}))[0] == "EMAIL"


def test_masking_is_complete_and_unicode_aware(spark):
    inputs = ["a@b.co, c.d@e.org", "１２３-456-7890 123 456 7890", "x" * 50 + "@y.net"]
    got = values(spark, inputs, masking.mask_pii)
    email = re.compile(masking.PATTERNS["EMAIL"])
    assert not any(email.search(g) for g in got)

    def same_in_python(s):
        for key, pattern in masking.PATTERNS.items():
            s = re.sub(pattern, f"<{key}>", s)
        return s
    assert got == [same_in_python(s) for s in inputs]


def collapsed(s):
    lines = [line.strip() for line in s.splitlines()]
    return "\n".join(line for line in lines if line) or s.strip()


def test_collapse_whitespace(spark):
    rng = random.Random(5)
    alphabet = ["a", "b ", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　"]
    inputs = ["", "  ", "a\n\n b \r\nc"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(300)]
    assert values(spark, inputs, text.collapse_whitespace) == [collapsed(s) for s in inputs]


def test_strip_equals_python(spark):
    inputs = [" a b ", " x ", "\x1c\x1dq\x1f", "", "\n", "é　"]
    assert values(spark, inputs, text.strip) == [s.strip() for s in inputs]


def test_clean_utf8(spark):
    inputs = [b"ok", b"caf\xc3\xa9", b"bad\xff\xfe!", b"cut\xe2\x82", None]
    want = [(b or b"").decode("utf-8", errors="ignore") for b in inputs]
    assert values(spark, inputs, text.clean_utf8, T.BinaryType()) == want


def test_cleaning_works_a_wellformed_text_out_once(spark):
    # Beside the value stands only what is worked out where it is malformed; before, the value stood in a condition as well.
    df = spark.createDataFrame([("<p>x</p>",)], "h string").select(text.html_to_text(F.col("h")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") <= 4


def test_entities(spark):
    inputs = ["a &amp; b", "&amp;lt;", "&lt;p&gt; &quot;q&quot; &#39;", "&nbsp;x &copy; &middot;", None]
    want = [html.unescape(s) if s is not None else None for s in inputs]
    assert values(spark, inputs, text.unescape) == want
    more = ["&#233;&eacute;&copy", "plain"]
    assert values(spark, more, text.unescape) == [html.unescape(s) for s in more]


def test_html_to_text(spark):
    doc = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head>"
           "<body><!-- c --><p>Hello <b>bold</b> a &lt; b</p><br>End&nbsp;</body></html>")
    assert values(spark, [doc, "", None], text.html_to_text) == ["T\nHello\nbold\na < b\nEnd", "", ""]


def test_body_choice(spark):
    rows = [("plain ", "<p>h</p>", "{r}"), ("  ", "<p>h</p>", "{r}"), (None, "", "{\\b r}"), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, h string, r string").coalesce(1)
    got = [r[0] for r in df.select(text.resolve_body(F.col("p"), F.col("h"), F.col("r"))).collect()]
    assert got == ["plain", "h", "\\b r", ""]


HEADERS = ("Received: from a\r\n\tby b\nReceived: from c\nReply-To: first@x\nREPLY-TO: last@x \nIn-Reply-To: <p@x>\n"
           "References: junk <r1@x>\n <r2@x>\nSubject: s\nX-A: 1\n folded: 2\nContent-Type: multipart/mixed")


def test_headers(spark):
    one = lambda f: values(spark, [HEADERS], f)[0]
    assert one(lambda h: headers.header_field(h, "reply-to")) == "last@x"
    assert one(lambda h: headers.header_field(h, "return-path")) == ""
    assert one(headers.references) == "junk <r1@x> <r2@x>"
    assert one(headers.parent_id) == "<p@x>"
    assert one(headers.received_hops) == "Received: from a by b; Received: from c"
    kept = one(headers.foreign_headers)
    assert "X-A: 1 folded: 2" in kept and not any(k.lower().startswith(("subject", "content-")) for k in kept)


@pytest.mark.parametrize("refs,parent,mid,want", [
    ("<a> <b>", "<p>", "<m>", "<a>"), ("no brackets", "<p>", "<m>", "<p>"), ("no brackets", "", "<m>", "<m>"),
    ("", "<p>", "<m>", "<p>"), ("", "", "<m>", "<m>"), ("", "", "", ""), ("x<a>y", "", "<m>", "<a>")])
def test_thread_id(spark, refs, parent, mid, want):
    df = spark.range(1).select(headers.thread_id(F.lit(refs), F.lit(parent), F.lit(mid)))
    assert df.first()[0] == want


def test_email_id(spark):
    at = datetime(2024, 1, 1, 10, 0, 0)
    rows = [(" <m@x> ", "s", "e@x", "N", at), ("  ", "s", "e@x", "N", at), (None, "s", "", "N", at), ("", None, None, None, None)]
    df = spark.createDataFrame(rows, "m string, s string, e string, n string, t timestamp").coalesce(1)
    got = [r[0] for r in df.select(identity.email_id(*[F.col(c) for c in "msent"])).collect()]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    assert got == [hashlib.sha256(b" <m@x> ").hexdigest()[:16], md5("s|e@x|2024-01-01 10:00:00"),
                   md5("s|N|2024-01-01 10:00:00"), md5("||None")]


def test_dedup_key(spark):
    rows = [("id", "m", "s", "e", "f", "r", "t"), ("", "m", "s", "e", "f", "r", "t"), ("", "", "s", "", "f", "", "t"),
            (None, None, None, None, None, None, None), ("", "", "", "", "", "", ""), ("", "", "", "e", "", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string").coalesce(1)
    got = [r[0] for r in df.select(identity.dedup_key(*[F.col(c) for c in "abcdefg"])).collect()]
    assert got == ["id", "m", "s|f|t", "", "", "|e|"]


def test_timestamp_text(spark):
    times = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000)]
    assert values(spark, times, identity.timestamp_text, T.TimestampType()) == [str(t) for t in times]
    assert values(spark, times, identity.epoch_seconds, T.TimestampType())[0] == 1704164645.0


def test_address_rules(spark):
    inputs = ["A@B.c@d", "Team", "x@"]
    assert values(spark, inputs, address.address_domain) == ["B.c@d", "", ""]
    assert values(spark, inputs, address.address_name) == ["A", "Team", "x"]
    assert values(spark, ["a; b,c ;; ,", None, ""], address.split_recipients) == [["a", "b", "c"], [], []]
    assert values(spark, [" None", "x", "", None], address.is_address) == [False, True, False, False]
    assert values(spark, [" From A ", "", None], address.host_values) == [["from a"], [], []]


def test_file_names(spark):
    inputs = ["my file.txt", "*?:", "  ", None, "..a__b..", "ü.pdf", "x" * 300, "a/b\\c.txt"]
    got = values(spark, inputs, lambda c: files.safe_name(c, F.lit("attachment_0")))

    def rule(name):
        candidate = (name or "").strip() or "attachment_0"
        cleaned = re.sub(r"[^A-Za-z0-9._-]+", "_", candidate.replace(" ", "_")).strip("._")
        return (cleaned or "attachment_0")[:255]
    assert got == [rule(n) for n in inputs]
    assert values(spark, ["my-file.with.dots.txt", "README", ".rc"], files.name_stem) == ["my-file.with.dots", "README", ".rc"]
    assert values(spark, ["my-file.with.dots.txt", "README", ".rc"], files.name_suffix) == [".txt", "", ""]


def test_types(spark):
    assert values(spark, ["a.PDF", "b.docx", "c", "d.tar.gz", "e.jpeg"], files.mime_from_extension) == [
        "application/pdf", files.DOCX, files.OCTET_STREAM, files.OCTET_STREAM, "image/jpeg"]
    sniff = values(spark, [b"%PDF-1", b"\x89PNG\r\n\x1a\n0", b"PK\x03\x04", b"plain"],
                   lambda c: files.mime_from_content(c, F.lit("x.txt")), T.BinaryType())
    assert sniff == ["application/pdf", "image/png", "application/zip", "text/plain"]
    cats = values(spark, ["text/csv", "image/gif", files.DOCX, "application/zip", "message/rfc822", "x/y"], files.content_category)
    assert cats == ["text", "image", "document", "archive", "embedded_message", "binary"]
    assert values(spark, ["message/rfc822", "text/csv", "application/zip", "image/png"], files.extraction_method) == [
        "msg_eml", "direct", "fallback", "ocr"]


def test_size_rules(spark):
    rows = [("10", 10), ("104857601", 10), ("-1", 10), ("many", 10), (None, 10), ("10", 104857601), ("10", 0)]
    df = spark.createDataFrame(rows, "s string, n long").coalesce(1)
    got = [r[0] for r in df.select(files.size_rejection(F.col("s"), F.col("n"))).collect()]
    assert [g is None for g in got] == [True, False, False, False, True, False, False]


def test_format_size(spark):
    inputs = [0, 1, 1023, 1024, 1280, 1792, 1536, 1048576, 5 * 1024**3, 3 * 1024**4, 2000 * 1024**4]

    def rule(n):
        size, i = float(n), 0
        while size >= 1024 and i < 4:
            size, i = size / 1024, i + 1
        return "0 B" if n == 0 else f"{size:.1f} {files.SIZE_UNITS[i]}"
    assert values(spark, inputs, files.format_size, T.LongType()) == [rule(n) for n in inputs]


def test_display(spark):
    assert values(spark, ["", None, "x" * 61], display.subject_line) == ["(No Subject)", "(No Subject)", "x" * 60 + "..."]
    assert values(spark, ["Ann B Cee", "solo", "  ", None], display.sender_initials) == ["AC", "S", "?", "?"]
    assert values(spark, ["a\r\nb" + "c" * 90], display.preview_line) == ["a  b" + "c" * 76 + "..."]
    lines = values(spark, ["a,b", "a,b,c,d,e", ""], lambda c: display.recipients_line(display.comma_recipients(c)))
    assert lines == ["To: a, b", "To: a, b, c (+2 more)", ""]


def test_csv_values(spark):
    import json
    df = spark.createDataFrame(
        [(0, ["a", 'q"x\n'], {"n": 1, "t": None}, True), (3, [], {"n": 0, "t": "é"}, False)],
        "i int, l array<string>, s struct<n:int,t:string>, b boolean").coalesce(1)
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[flat.csv_value(F.col(c), types[c]).alias(c) for c in df.columns]).collect()
    assert [r["i"] for r in got] == ["", "3"] and [r["b"] for r in got] == ["True", ""]
    assert [r["l"] for r in got] == [json.dumps(["a", 'q"x\n']), ""]
    assert [r["s"] for r in got] == [json.dumps({"n": 1, "t": None}), json.dumps({"n": 0, "t": "é"}, ensure_ascii=False)]


def test_parse_iso(spark):
    got = values(spark, ["2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "nonsense", None], identity.parse_iso)
    assert got == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10), None, None]

"""Mailbox tables derived from the sample star schema, for queries, tests and the benchmark.

Every function reads whole tables and derives each row from its own columns and key joins, so the
results grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import charsets as CS
from postmill.operators import dictionary as D
from postmill.operators import folders as FO
from postmill.session import apply_runtime_conf, written

START = "2024-01-01 00:00:00"
# Character references that bodies of real mail hold and the sample pages do not.
PLANTED_HTML = "<p>Caf&eacute; it&#8217;s &euro;5 &#x41;&#150;</p>"


# Tables whose rows cost more to work on than to move.
SPREAD_TABLES = {"documents", "pages", "conversations", "benchmark", "lineitem"}
SPREAD = "postmill.sample.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table, read as it lies. Where the session sets ``SPREAD`` (the benchmark does, whose tables are one file
    each) a costly table is dealt to as many tasks."""
    apply_runtime_conf(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread and name in SPREAD_TABLES else df


def _text(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with bodies and headers: one per conversation turn, some filed twice."""
    conv = table(spark, sf_dir, "conversations")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "html")
    c, t = F.col("conv_id"), F.col("turn")
    eol = F.when(c % 4 == 0, "\r\n").otherwise("\n")
    subject = F.concat(F.when(t > 0, "Re: ").otherwise(""), _text("Conversation ", c))
    has_parent = t > 0
    bare = has_parent & (c % 9 == 4)
    root_ref = _text("<c", c, ".0@mail.example.com>")
    prev_ref = _text("<c", c, ".", t - 1, "@mail.example.com>")
    thread_lines = F.when(~has_parent, "").otherwise(F.concat(
        F.when(bare, _text("References: bare-", c)).otherwise(
            F.concat(F.lit("References: "), root_ref, eol, F.lit(" "), prev_ref)), eol,
        F.when(bare & (c % 2 == 0), "").otherwise(F.concat(F.lit("In-Reply-To: "), prev_ref, eol))))
    headers = F.concat(
        _text("Received: from mx", c % 5, ".example.net"), eol, F.lit("\t"), _text("by relay", t % 2, ".example.net"),
        eol, F.lit("Received: from origin.example.org"), eol, F.lit("Subject: "), subject, eol, thread_lines,
        _text("Reply-To: old", c % 6, "@example.com"), eol, _text("reply-to: Desk", c % 6, "@example.com"), eol,
        _text("Return-Path: bounce", c % 3, "@example.com"), eol, _text("X-Mailer: Mailer ", c % 2), eol,
        F.lit("Content-Type: text/plain"), eol, _text("X-Trace: ", c))
    odd, no_html = t % 2 == 1, (c % 5 == 0) | F.col("html").isNull()
    minutes = (c * 60 + t).cast("bigint")
    delivered = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + minutes * 60)
    rank = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3).otherwise(4)
    pos = c * 65536 + t
    base = conv.join(pages, "conv_id", "left").select(
        c, t,
        F.when(F.col("role") == "user", "/Root/Inbox").when(F.col("role") == "assistant", "/Root/Sent")
        .otherwise("/Root/System/Notices").alias("folder_path"),
        pos.alias("pos"), (rank * F.lit(1 << 44) + pos).alias("scan_pos"),
        F.when((c + t) % 11 == 0, "").otherwise(_text("<c", c, ".", t, "@mail.example.com>")).alias("internet_message_id"),
        subject.alias("subject"),
        _text("User ", c % 17).alias("sender_name"),
        F.when(c % 13 == 0, "").otherwise(_text("User", c % 17, "@Dept", c % 3, ".Example.com")).alias("sender_email_address"),
        _text("user", c % 5, "@Example.org; Team ", t % 4, ", None;").alias("display_to"),
        F.when(t > 0, _text("cc", t % 3, "@example.net")).alias("display_cc"),
        F.when(t > 0, _text("bcc", c % 4, "@example.net")).alias("display_bcc"),
        delivered.alias("delivery_time"),
        F.when(c % 7 != 0, delivered - F.expr("interval 1 minute")).alias("client_submit_time"),
        F.when(~odd, F.col("text")).alias("plain_text_body"),
        F.when(odd & ~no_html, F.concat("html", F.lit(PLANTED_HTML))).alias("html_body"),
        F.when(odd & no_html, F.concat(F.lit("{\\rtf1 "), F.col("text"), F.lit("}"))).alias("rtf_body"),
        F.when(F.col("role") == "system", "REPORT.IPM.Note").otherwise("IPM.Note").alias("message_class"),
        headers.alias("transport_headers"),
        (t % 3).cast("int").alias("number_of_attachments"),
        (c % 3 - 1).cast("int").alias("priority"),
        (t % 2 == 0).alias("is_read"))
    # Every tenth conversation is filed twice; the joins above run once.
    filings = F.when(c % 10 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    filed = base.withColumn("_archived", F.explode(filings))
    return filed.withColumns({
        "folder_path": F.when(F.col("_archived"), "/Root/Archive").otherwise(F.col("folder_path")),
        "scan_pos": F.when(F.col("_archived"), F.lit(1 << 44) + F.col("pos")).otherwise(F.col("scan_pos"))}) \
        .drop("conv_id", "turn", "_archived")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short records: one per order line, sent by the customer to the supplier.

    Both joins have a unique side (order, customer), so a hot order or customer only makes its line
    side skewed, which the runtime splits.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = lines.join(orders, "o_orderkey").join(customers, "c_custkey", "left")
    k, cust, status = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_orderstatus")
    headers = F.concat(
        _text("Received: from mx", cust % 20, ".example.net\n by relay", F.col("l_suppkey") % 3, ".example.net\n"),
        _text("References: <t", cust, "@orders.example.com>\n <o", k, "@orders.example.com>\n"),
        _text("In-Reply-To: <t", cust, "@orders.example.com>"))
    return joined.select(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("/Root/"), F.col("o_orderpriority")).alias("folder_path"),
        _text("<o", k, "@orders.example.com>").alias("Message_ID"),
        F.lower(F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@"), F.col("c_mktsegment"),
                         F.lit(".example.com"))).alias("Sender_Email"),
        _text("supplier", F.col("l_suppkey"), "@parts.example.com; Part", F.col("l_partkey") % 97,
              "@Stock.Example.com, none").alias("To"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "audit@example.org").otherwise("").alias("CC"),
        F.when(F.col("l_returnflag") == "R", "returns@example.org").otherwise("").alias("BCC"),
        F.when(status == "F", "billing@example.com").otherwise("").alias("Reply_To"),
        F.when(status == "P", "bounce@example.com").otherwise("").alias("Return_Path"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Date_Received"),
        headers.alias("Full_Headers"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attachments per message: documents under colliding, odd and misleading names."""
    d = table(spark, sf_dir, "documents")
    key, idx = F.expr("doc_id div 3"), F.col("doc_id") % 3
    d = d.withColumns({"k": key, "i": idx})
    k, i = F.col("k"), F.col("i")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".csv", ".xml", ".pdf", ".docx", ".png", ".zip", "")]),
                       (k % 8 + 1).cast("int"))
    plain = _text("Report ", F.when(k % 7 == 0, "*?: ").otherwise(""), i % 2)
    stem = F.when((k % 9 == 0) & (i == 1), "Report 0_2").otherwise(plain)
    name = F.concat(stem, ext)
    doc = F.col("doc_id")
    size = (F.when(doc % 50 == 7, "200000000").when(doc % 51 == 0, "-5").when(doc % 53 == 0, "60000000")
            .when(doc % 59 == 0, "unknown").otherwise(F.col("n_chars").cast("string")))
    # Leading bytes of real files: a container under a name of its own kind and under others, and text like a bitmap.
    packed = ((doc % 3 == 1) & (k % 8 == 4)) | (doc % 29 == 0)
    prefix = F.when(doc % 11 == 0, F.lit("%PDF-")).when(packed, "PK\x03\x04").when(doc % 23 == 0, "BM").otherwise("")
    # cast: on a string literal the bytes are its UTF-8
    content = F.when(doc % 13 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(
        F.concat(prefix, F.col("text")).cast("binary"))
    return d.select(
        doc, F.lit("/Root/Inbox").alias("folder_path"), k.alias("message_index"), i.alias("attachment_index"),
        F.when(doc % 17 != 0, name).otherwise("").alias("long_filename"),
        F.when(doc % 34 != 0, name).otherwise("").alias("file_name"),
        F.lit(None).cast("string").alias("name"), size.alias("size"),
        F.when(doc % 61 == 0, F.lit("").cast("binary")).otherwise(content).alias("content"))


def folder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the mailbox with their ancestors, and an empty one."""
    empty = FO.describe(spark.range(1).select(F.lit("/Root/Drafts").alias("folder_path")))
    return FO.folders_of(mailbox(spark, sf_dir)).unionByName(empty)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_texts(table(spark, sf_dir, "benchmark"))


def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dictionary files as lines: a good one, one with too many bad lines, one with overlaps."""
    bench = table(spark, sf_dir, "benchmark")
    words = D.from_texts(bench)
    docs = D.from_texts(table(spark, sf_dir, "conversations"))
    w, f = F.col("word"), F.col("freq")
    good = F.when(f % 50 == 49, F.concat(F.lit("# "), w)).otherwise(_text(" ", w, "  ", f))
    bad = F.when(F.length(w) % 2 == 0, _text(w, " many")).otherwise(_text(w, " ", f))
    mixed = F.when(F.length(w) == 17, _text(w, " two words ", f)).when(F.length(w) == 19, _text(w, " -", f)).otherwise(
        _text(w, "\t", f + 1))
    lines = (words.select(F.lit("good").alias("source"), w.alias("line_no"), good.alias("line"))
            .unionByName(words.select(F.lit("bad").alias("source"), w.alias("line_no"), bad.alias("line")))
            .unionByName(docs.select(F.lit("mixed").alias("source"), w.alias("line_no"), mixed.alias("line"))))
    return written(lines, "dictionary-lines")


# Letters that stand for the small ASCII ones in texts of other alphabets.
CENTRAL = ("aeosz", "ąęóšž")
CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыжз")
KATAKANA = ("abcdefghijklmnopqrstuvwxyz", "アブクデエフガヒイジカルマノオパキラサタウヴワシヤズ")


def reencoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: (doc_id, charset, written, content), in six encodings by their number, with letters of each."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "?")
    latin = F.regexp_replace(text, r"[^\x00-\x7FÀ-ÿ]", "?")
    shown = (F.when(kind == 1, latin).when(kind == 2, F.translate(ascii_only, *CENTRAL))
             .when(kind == 3, F.translate(ascii_only, *CYRILLIC)).when(kind == 4, F.translate(ascii_only, *KATAKANA)).otherwise(text))
    charset = F.when(kind == 5, "utf-16-le").when(kind == 0, "utf-8")
    for number, name in enumerate(CS.CHARSETS, 1):
        charset = charset.when(kind == number, name)
    rows = table(spark, sf_dir, "documents").select("doc_id", charset.alias("charset"), shown.alias("written"))
    content = CS.encoded(F.col("written"), F.col("charset"))
    marked = F.when(F.col("doc_id") % 12 == 5, F.concat(F.lit(b"\xff\xfe"), F.col("content"))).otherwise(F.col("content"))
    return rows.withColumn("content", content).withColumn("content", marked)


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per document: every fifth below the one five before it, a path; a seventh of all below the first, a hub;
    the others below the nearest folder of the path or beside it."""
    k = F.col("doc_id")
    path = F.when(k > 0, F.when(k % 5 == 0, k - 5).when(k % 7 == 3, 0).when(k % 5 == 4, k - 1).otherwise(k - k % 5))
    return table(spark, sf_dir, "documents").select(
        k.cast("long").alias("folder"), path.cast("long").alias("parent"), (k * 7919 % 1009).alias("place"), (F.col("n_chars") % 11).alias("messages"))

"""Named queries over message records: scans, fields, filters, positions, duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import address as A
from postmill.functions import display as D
from postmill.functions import flat, headers, identity, text
from postmill.functions import files as X
from postmill.operators import dedup, folders, foldertree, health, index, messages, pages, search
from postmill.plans import statements as S
from postmill.schema import MESSAGES
from postmill.session import shared_dir, written
from postmill.sources import readers, sample

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def records(spark: SparkSession, sf: str) -> DataFrame:
    return messages.build_records(sample.mailbox(spark, sf))


def _fields(*names: str) -> str:
    return S.query(S.RECORDS, "SELECT scan_pos, " + ", ".join(f'"{n}"' for n in names) + " FROM records")


# --- scans -------------------------------------------------------------------------------------


def _damaged_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = sample.mailbox(spark, sf)
    line = F.to_json(F.struct(*MESSAGES.fieldNames()))
    cut = F.when(F.col("pos") % 7 == 3, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return m.select(cut.alias("value"))


_WHOLE = S.query(S.MAILBOX, "SELECT scan_pos, subject, plain_text_body FROM mailbox WHERE pos % 7 <> 3")


@query(_WHOLE)
def scan_messages(spark, sf):
    path = shared_dir(spark, "lines")
    _damaged_lines(spark, sf).write.text(path)
    return readers.read_messages(spark, path, "json").select("scan_pos", "subject", "plain_text_body")


@query(_WHOLE)
def drop_unparsed(spark, sf):
    parsed = readers.parse_messages(_damaged_lines(spark, sf), "value", MESSAGES)
    return messages.drop_unparsed(parsed).select("scan_pos", "subject", "plain_text_body")


@query(S.query(S.MAILBOX, """SELECT folder_path, pos,
  row_number() OVER (ORDER BY string_split(folder_path, '/'), pos) - 1 AS scan_index FROM mailbox"""))
def scan_folder_tree(spark, sf):
    return messages.with_scan_index(sample.mailbox(spark, sf)).select("folder_path", "pos", "scan_index")


def _page_sql(folder: str, start: int, limit: int, where: str) -> str:
    return S.query(S.MAILBOX, f"""SELECT folder_path, message_index, subject FROM (
  SELECT *, row_number() OVER (ORDER BY pos) - 1 AS message_index FROM mailbox WHERE folder_path = '{folder}')
  WHERE message_index >= {start} AND {where} ORDER BY message_index LIMIT {limit}""")


@query(_page_sql("/Root/Inbox", 10, 25, "pos % 5 <> 0"))
def scan_folder_page(spark, sf):
    marked = sample.mailbox(spark, sf).withColumn("parsed", F.col("pos") % 5 != 0)
    page = messages.folder_page(marked, "/Root/Inbox", 10, 25)
    return page.select("folder_path", "message_index", "subject")


@query(_page_sql("/Root/Sent", 0, 50, "true"))
def folder_first_page(spark, sf):
    page = messages.folder_page(sample.mailbox(spark, sf), "/Root/Sent", 0, 50)
    return page.select("folder_path", "message_index", "subject")


# Folder, start and length of some pages, one of them empty.
PAGES = [("/Root/Inbox", 0, 20), ("/Root/Inbox", 50, 64), ("/Root/Sent", 130, 40), ("/Root/Archive", 7, 5), ("/Root/Sent", 10**9, 9)]
_PAGED = [f"""(SELECT folder_path, message_index, subject, {number} AS page FROM indexed
  WHERE folder_path = '{folder}' AND pos % 5 <> 0 AND message_index >= {start} ORDER BY message_index LIMIT {limit})"""
          for number, (folder, start, limit) in enumerate(PAGES)]


@query(S.query(S.MAILBOX + """,
indexed AS (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY pos) - 1 AS message_index FROM mailbox)""", " UNION ALL ".join(_PAGED)))
def folder_pages(spark, sf):
    """Pages here and there in the folders, read from clustered messages by their directory."""
    marked = sample.mailbox(spark, sf).select("folder_path", "pos", "subject", (F.col("pos") % 5 != 0).alias("parsed"))
    stored = pages.build(marked, block_rows=64)
    found = [pages.page(spark, stored, *asked).withColumn("page", F.lit(number)) for number, asked in enumerate(PAGES)]
    return functools.reduce(DataFrame.unionByName, found).select("folder_path", "message_index", "subject", "page")


@query("""SELECT conv_id, turn, '/' || CASE WHEN conv_id % 4 = 0 THEN 'Root' ELSE 'Top' END
  || '/' || 'F' || (conv_id % 7) || '/' || CASE WHEN turn % 3 = 0 THEN '(Unnamed)' ELSE 'S' || turn END AS path FROM conversations""")
def folder_paths(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    names = F.array(F.when(c % 4 == 0, "").otherwise("Top"), F.concat(F.lit("F"), (c % 7).cast("string")),
                    F.when(t % 3 == 0, "").otherwise(F.concat(F.lit("S"), t.cast("string"))))
    return sample.table(spark, sf, "conversations").select(c, t, folders.folder_path(names).alias("path"))


@query(S.query(S.MAILBOX + "," + S.FOLDERS, "SELECT * FROM folders WHERE folder_path = '/Root/System/Notices'"))
def resolve_folder(spark, sf):
    return folders.resolve_folder(sample.folder_table(spark, sf), "/System/Notices")


# --- scalar fields -----------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS clean FROM documents""")
def clean_utf8(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(
        F.col("text").cast("binary"))
    raw = F.when(F.col("doc_id") % 5 != 0, raw)
    return sample.table(spark, sf, "documents").select("doc_id", text.clean_utf8(raw).alias("clean"))


@query(f"SELECT doc_id, {S.collapse('text')} AS collapsed FROM documents")
def collapse_whitespace(spark, sf):
    return sample.table(spark, sf, "documents").select(
        "doc_id", text.collapse_whitespace(F.col("text")).alias("collapsed"))


@query(f"SELECT page_id, {S.html_text('html')} AS plain FROM pages")
def html_to_text(spark, sf):
    return sample.table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("plain"))


# References with and without a semicolon, numbers in and out of range, and text that is no reference.
_ODD = "&eacute;&#8217;&euro;&#x41;&#150; &copycat &notit; &#0;&#1114112;&#1;&nosuch; & &; &#; &#x; &amp;lt; &Eacute;&NotEqualTilde; &#xD800;&#128512;"
_ODD_TEXT = "é’€A– ©cat ¬it; \ufffd\ufffd&nosuch; & &; &#; &#x; &lt; É≂̸ \ufffd😀"


@query(f"SELECT page_id, {S.decode('html')} || '{_ODD_TEXT}' AS decoded FROM pages")
def html_unescape(spark, sf):
    odd = F.concat("html", F.lit(_ODD))
    return sample.table(spark, sf, "pages").select("page_id", text.unescape(odd).alias("decoded"))


@query(f"SELECT page_id, {S.html_text('html')} || chr(10) || 'Café it’s €5 A–' AS plain FROM pages")
def html_to_text_all_entities(spark, sf):
    return sample.table(spark, sf, "pages").select(
        "page_id", text.html_to_text(F.concat("html", F.lit(sample.PLANTED_HTML))).alias("plain"))


@query(S.query(S.MAILBOX, f"SELECT scan_pos, {S.rtf_text('rtf_body')} AS plain FROM mailbox"))
def rtf_strip(spark, sf):
    return sample.mailbox(spark, sf).select("scan_pos", text.rtf_strip(F.col("rtf_body")).alias("plain"))


@query(_fields("Body", "HTML_Body"))
def resolve_body(spark, sf):
    return records(spark, sf).select("scan_pos", "Body", "HTML_Body")


@query(S.query(S.MAILBOX, "SELECT scan_pos, coalesce(display_cc, '') AS cc, priority::VARCHAR AS priority FROM mailbox"))
def safe_property(spark, sf):
    return sample.mailbox(spark, sf).select(
        "scan_pos", text.text_or_empty(F.col("display_cc")).alias("cc"),
        text.text_or_empty(F.col("priority")).alias("priority"))


@query(_fields("Email_ID"))
def email_id(spark, sf):
    return records(spark, sf).select("scan_pos", "Email_ID")


@query(_fields("From"))
def from_display(spark, sf):
    return records(spark, sf).select("scan_pos", "From")


@query("""SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS seconds,
  try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS parsed FROM orders""")
def epoch_seconds(spark, sf):
    given = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return sample.table(spark, sf, "orders").select(
        "o_orderkey", identity.epoch_seconds(F.col("o_orderdate")).alias("seconds"),
        identity.epoch_seconds_from_text(given).alias("parsed"))


@query(_fields("Reply_To", "Return_Path", "Email_Client"))
def header_field(spark, sf):
    return records(spark, sf).select("scan_pos", "Reply_To", "Return_Path", "Email_Client")


@query(_fields("Importance"))
def importance(spark, sf):
    return records(spark, sf).select("scan_pos", "Importance")


@query(_fields("Thread_ID", "Parent_ID", "References"))
def thread_metadata(spark, sf):
    return records(spark, sf).select("scan_pos", "Thread_ID", "Parent_ID", "References")


@query(_fields("Received_Hops"))
def received_hops(spark, sf):
    return records(spark, sf).select("scan_pos", "Received_Hops")


@query(S.query(S.MAILBOX, f"SELECT scan_pos, array_to_string({S.split_list('display_to')}, '|') AS recipients FROM mailbox"))
def split_recipients(spark, sf):
    return sample.mailbox(spark, sf).select(
        "scan_pos", F.array_join(A.split_recipients(F.col("display_to")), "|").alias("recipients"))


@query(S.query(S.MAILBOX, """SELECT scan_pos, lower(sender_email_address) AS address,
  CASE WHEN strpos(sender_email_address, '@') > 0 THEN lower(string_split(sender_email_address, '@')[2]) ELSE '' END AS domain,
  lower(string_split(sender_email_address, '@')[1]) AS name FROM mailbox"""))
def address_parts(spark, sf):
    a = A.normal_address(F.col("sender_email_address"))
    return sample.mailbox(spark, sf).select(
        "scan_pos", a.alias("address"), A.address_domain(a).alias("domain"), A.address_name(a).alias("name"))


@query(S.query(S.RECORDS, """SELECT scan_pos, lower(trim("Received_Hops")) AS hosts FROM records"""))
def host_values(spark, sf):
    return records(spark, sf).select(
        "scan_pos", F.array_join(A.host_values(F.col("Received_Hops")), "|").alias("hosts"))


@query(S.query(S.MAILBOX, f"""SELECT scan_pos,
  CASE WHEN number_of_attachments = 0 THEN '' ELSE number_of_attachments::VARCHAR END AS number,
  CASE WHEN is_read THEN 'True' ELSE '' END AS flag, epoch(delivery_time)::BIGINT || '.0' AS received,
  '[' || array_to_string(list_transform({S.split_list('display_to')}, lambda v: '"' || v || '"'), ', ') || ']' AS list,
  '{{"n": ' || priority || ', "s": "' || subject || '", "x": ' || coalesce('"' || display_cc || '"', 'null') || '}}' AS record
  FROM mailbox"""))
def csv_value(spark, sf):
    df = sample.mailbox(spark, sf).select(
        "scan_pos", F.col("number_of_attachments").alias("number"), F.col("is_read").alias("flag"),
        identity.epoch_seconds(F.col("delivery_time")).alias("received"),
        A.split_recipients(F.col("display_to")).alias("list"),
        F.struct(F.col("priority").alias("n"), F.col("subject").alias("s"), F.col("display_cc").alias("x")).alias("record"))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select("scan_pos", *[flat.csv_value(F.col(c), types[c]).alias(c) for c in df.columns[1:]])


# --- display -----------------------------------------------------------------------------------


@query(S.query(S.RECORDS, rf"""SELECT scan_pos,
  CASE WHEN length("Subject") > 60 THEN substr("Subject", 1, 60) || '...' WHEN "Subject" = '' THEN '(No Subject)' ELSE "Subject" END AS subject_line,
  CASE WHEN "From" = '' THEN 'Unknown Sender' ELSE "From" END AS sender_line,
  CASE WHEN "Date_Sent" = '' THEN 'Unknown Date' ELSE substr("Date_Sent", 1, 16) END AS date_line,
  CASE WHEN length(b) > 80 THEN substr(b, 1, 80) || '...' ELSE b END AS preview_line,
  CASE WHEN len(r) = 0 THEN '' ELSE 'To: ' || array_to_string(r[1:3], ', ') || CASE WHEN len(r) > 3 THEN ' (+' || (len(r) - 3) || ' more)' ELSE '' END END AS recipients_line
  FROM (SELECT *, {S.strip('''replace(replace("Body", chr(10), ' '), chr(13), ' ')''')} AS b,
    list_filter(list_transform(string_split("To" || ',' || "CC" || ',' || "BCC", ','), lambda x: trim(x)), lambda x: x <> '') AS r FROM records)"""))
def message_list_view(spark, sf):
    return index.message_list_view(records(spark, sf)).drop("Email_ID", "initials")


@query("""SELECT c_custkey, CASE WHEN len(w) = 0 THEN '?' WHEN len(w) = 1 THEN upper(substr(w[1], 1, 1))
    ELSE upper(substr(w[1], 1, 1) || substr(w[-1], 1, 1)) END AS initials
  FROM (SELECT c_custkey, list_filter(string_split(CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN lower(c_mktsegment)
    ELSE c_name || ' of ' || lower(c_mktsegment) || ' ' END, ' '), lambda x: x <> '') AS w FROM customer)""")
def sender_initials(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "  ").when(k == 1, F.lower("c_mktsegment")).otherwise(
        F.concat(F.col("c_name"), F.lit(" of "), F.lower("c_mktsegment"), F.lit(" ")))
    return sample.table(spark, sf, "customer").select("c_custkey", D.sender_initials(name).alias("initials"))


_SIZE = "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE floor(o_totalprice * o_orderkey * (o_orderkey % 4 + 1))::BIGINT END"


@query(f"""SELECT o_orderkey, CASE WHEN s = 0 THEN '0 B' WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE)
    WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE)
    WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', s / 1099511627776.0::DOUBLE) END AS shown
  FROM (SELECT o_orderkey, {_SIZE} AS s FROM orders)""")
def format_size(spark, sf):
    k = F.col("o_orderkey")
    size = F.when(k % 50 == 0, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") * k * (k % 4 + 1)))
    df = sample.table(spark, sf, "orders").select(k, size.cast("bigint").alias("s"))
    return df.select(k, X.format_size(F.col("s")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS parsed FROM orders""")  # a time alone is no date
def parse_iso_date(spark, sf):
    k = F.col("o_orderkey") % 3
    given = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.when(F.col("o_orderkey") % 2 == 0, "10:30").otherwise(F.date_format("o_orderdate", "'on' dd/MM/yy")))
    return sample.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(identity.parse_iso(given), "yyyy-MM-dd HH:mm").alias("parsed"))


# --- filters and index -------------------------------------------------------------------------

_HAY = """lower(concat_ws(' ', "Subject", "From", "Sender_Email", "To", "Date_Received"))"""


@query(S.query(S.RECORDS, f"SELECT scan_pos, \"Subject\" FROM records WHERE contains({_HAY}, 'user1@dept')"))
def index_search(spark, sf):
    return index.index_search(records(spark, sf), "User1@Dept").select("scan_pos", "Subject")


@query(S.query(S.RECORDS, f"SELECT count(*) FILTER (WHERE contains({_HAY}, '2024-01-02')) AS shown, count(*) AS \"of\" FROM records"))
def index_search_counts(spark, sf):
    return index.search_counts(records(spark, sf), "2024-01-02")


# A hundred searches: subjects, addresses, dates, several fields at once, one and two letters, and some that find nothing.
TERMS = [*(f"conversation {k}" for k in range(40)), *(f"User{k}@Dept{k % 3}" for k in range(17)), *(f"2024-01-0{k}" for k in range(1, 10)),
         *(f"team {k}" for k in range(5)), *(f"<user{k}@" for k in range(1, 8)), *(f"0:{k}" for k in range(10, 15)), "u", "@", "zq", "é", "00",
         "RE: CONV", "none; user", "example.org; team 3, none; 2024", "example.com user", "re: conversation 1 user 1", "no such text at all",
         "conversation 999999", "com>", "00:00", "e", ";", "17"]


@query(S.query(S.RECORDS + f""",
terms AS (SELECT DISTINCT unnest([{", ".join(f"'{t}'" for t in TERMS)}]) AS term)""", f"""SELECT term, count(*) AS shown,
  CAST(sum(scan_pos % 1000003) AS BIGINT) AS places FROM records JOIN terms ON contains({_HAY}, lower(term)) GROUP BY term"""))
def index_lookup(spark, sf):
    """What each of the searches shows, found by the index of three-letter pieces."""
    rows = written(records(spark, sf).select("scan_pos", *index.SEARCHED_FIELDS), "indexed")
    found = search.lookup(rows, search.build(rows), TERMS)
    return found.groupBy("term").agg(F.count("*").alias("shown"), F.sum(F.col("scan_pos") % 1000003).alias("places"))


@query(S.query(S.RECORDS, """SELECT "Subject", "From", "Sender_Email", "To", "CC", "BCC", "Date_Received", "Date_Sent",
  "Attachment_Count", '' AS "Attachment_Paths", "Email_ID", "Subject" AS "Shown_Subject", "From" AS "Shown_Sender",
  "To" || CASE WHEN "CC" <> '' THEN ', ' || "CC" ELSE '' END || CASE WHEN "BCC" <> '' THEN ', ' || "BCC" ELSE '' END AS "Shown_Recipients",
  "Date_Received" AS "Shown_Date",
  CASE "Attachment_Count" WHEN 0 THEN '' WHEN 1 THEN '1 attachment' ELSE "Attachment_Count" || ' attachments' END AS "Shown_Attachments"
  FROM records"""))
def index_view(spark, sf):
    return index.index_view(records(spark, sf)).withColumn("Attachment_Paths", F.array_join("Attachment_Paths", "|"))


@query("""WITH RECURSIVE folders AS (SELECT doc_id AS folder, CASE WHEN doc_id = 0 THEN NULL WHEN doc_id % 5 = 0 THEN doc_id - 5 WHEN doc_id % 7 = 3 THEN 0
    WHEN doc_id % 5 = 4 THEN doc_id - 1 ELSE doc_id - doc_id % 5 END AS parent, doc_id * 7919 % 1009 AS place, n_chars % 11 AS messages FROM documents),
visited AS (SELECT folder, messages, 0 AS depth, [(place, folder)] AS path FROM folders WHERE parent IS NULL
  UNION ALL SELECT f.folder, f.messages, depth + 1, list_append(path, (f.place, f.folder)) FROM visited v JOIN folders f ON f.parent = v.folder),
placed AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS preorder,
  coalesce(sum(messages) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_index FROM visited),
below AS (SELECT unnest(path)[2] AS folder, messages FROM visited)
SELECT folder, preorder, depth::BIGINT AS depth, subtree_size, first_index::BIGINT AS first_index, subtree_messages
FROM placed JOIN (SELECT folder, count(*) AS subtree_size, sum(messages)::BIGINT AS subtree_messages FROM below GROUP BY folder) USING (folder)""")
def scan_tree_order(spark, sf):
    """Depth-first order, depth, size and first message of every folder, from parents and places alone."""
    return foldertree.tree_order(sample.folder_tree(spark, sf))


@query(S.query(S.MAILBOX, f"""SELECT scan_pos, r AS entry FROM (
  SELECT scan_pos, unnest({S.split_list('display_to')}) AS r FROM mailbox) WHERE lower(r) <> 'none'"""))
def valid_address(spark, sf):
    entries = sample.mailbox(spark, sf).select(
        "scan_pos", F.explode(A.split_recipients(F.col("display_to"))).alias("entry"))
    return entries.where(A.is_address(F.col("entry")))


@query(S.query(S.RECORDS, r"""SELECT scan_pos, array_to_string(list_filter(string_split(hu, chr(10)),
  lambda x: contains(x, ':') AND NOT regexp_matches(x, '^(Subject|From|To|Cc|Bcc|Date|Message-ID)')), '|') AS kept FROM records"""))
def header_deny_list(spark, sf):
    return sample.mailbox(spark, sf).select(
        "scan_pos", F.array_join(headers.deny_listed_lines(F.col("transport_headers")), "|").alias("kept"))


# --- positions, folders ------------------------------------------------------------------------


@query(S.query(S.MAILBOX, """SELECT folder_path, pos,
  row_number() OVER (PARTITION BY folder_path ORDER BY pos) - 1 AS message_index FROM mailbox"""))
def message_index(spark, sf):
    return messages.with_message_index(sample.mailbox(spark, sf)).select("folder_path", "pos", "message_index")


@query(S.query(S.RECORDS, """SELECT scan_pos, CASE WHEN "Message_ID" = '' THEN 'email_' || (row_number() OVER (ORDER BY scan_pos) - 1)
  ELSE "Email_ID" END AS "Email_ID" FROM records"""))
def fallback_row_id(spark, sf):
    blank = F.when(F.col("Message_ID") != "", F.col("Email_ID")).otherwise("")
    return messages.with_fallback_id(records(spark, sf).withColumn("Email_ID", blank)).select("scan_pos", "Email_ID")


_COUNTS = S.MAILBOX + "," + S.FOLDERS


def _counts(spark, sf):
    return folders.folder_counts(sample.folder_table(spark, sf), sample.mailbox(spark, sf))


@query(S.query(_COUNTS, "SELECT folder_path, name, total_count FROM counts"))
def folder_counts_outer(spark, sf):
    return _counts(spark, sf).select("folder_path", "name", "total_count")


@query(S.query(S.MAILBOX, "SELECT folder_path, count(*) AS n FROM mailbox GROUP BY folder_path"))
def folder_counts(spark, sf):
    return sample.mailbox(spark, sf).groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"))


@query(S.query(_COUNTS, "SELECT folder_path, total_count FROM counts WHERE total_count > 0"))
def non_empty_folders(spark, sf):
    return folders.non_empty(_counts(spark, sf)).select("folder_path", "total_count")


@query(S.query(_COUNTS, "SELECT folder_path, unread_count FROM counts"))
def unread_counts(spark, sf):
    return _counts(spark, sf).select("folder_path", "unread_count")


@query(S.query(_COUNTS, "SELECT sum(total_count)::BIGINT AS messages, count(*) - 1 AS folders FROM counts"))
def tree_counts(spark, sf):
    return folders.tree_counts(_counts(spark, sf))


@query(S.query(_COUNTS, "SELECT sum(total_count)::BIGINT AS total FROM counts"))
def total_email_count(spark, sf):
    return folders.total_email_count(_counts(spark, sf))


@query(S.query(S.MAILBOX, "SELECT count(*) AS messages FROM mailbox"))
def count_messages(spark, sf):
    return folders.count_messages(sample.mailbox(spark, sf))


@query(S.query(_COUNTS, """SELECT (SELECT sum(total_count)::BIGINT FROM counts) AS total_emails,
    (SELECT count(*) - 1 FROM counts) AS folder_count, count(*) FILTER (WHERE bad) AS corrupted_samples, count(*) AS sampled,
    (SELECT round(sum(length(transport_headers)) / 1048576.0, 2)::DOUBLE FROM mailbox) AS estimated_size_mb,
    round_even(greatest(0.0, 1.0 - count(*) FILTER (WHERE bad) / greatest(1, count(*))) * 100.0, 1)::DOUBLE AS health_score
  FROM (SELECT internet_message_id = '' AS bad FROM mailbox ORDER BY scan_pos LIMIT 200)"""))
def mailbox_health(spark, sf):
    m = sample.mailbox(spark, sf)
    size = m.agg(F.sum(F.length("transport_headers")).alias("bytes"))
    return health.mailbox_health(m, F.col("internet_message_id") == "", _counts(spark, sf), size)


@query(S.query(S.MAILBOX, "SELECT folder_path, count(*) AS n, sum(length(subject))::BIGINT AS chars FROM mailbox GROUP BY folder_path"))
def union_chunks(spark, sf):
    m = sample.mailbox(spark, sf)
    chunks = [m.where(F.pmod("pos", F.lit(3)) == i) for i in range(3)]
    return readers.union_mailboxes(*chunks).groupBy("folder_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("subject")).alias("chars"))


# --- duplicates --------------------------------------------------------------------------------


@query(S.query(S.UNIQUE, 'SELECT scan_pos, "Email_ID", "Subject" FROM kept'))
def dedup_email_id(spark, sf):
    return dedup.keep_first(records(spark, sf), F.col("Email_ID")).select("scan_pos", "Email_ID", "Subject")


_KEYED = S.RECORDS + """,
shaped AS (SELECT scan_pos, "Subject", "Message_ID", CASE WHEN scan_pos % 4 = 1 THEN '' ELSE "Sender_Email" END AS s,
  CASE WHEN scan_pos % 2 = 0 THEN "Email_ID" ELSE '' END AS e, "From", "Date_Received", "Date_Sent" FROM records),
keyed AS (SELECT *, coalesce(nullif(e, ''), nullif("Message_ID", ''),
  "Subject" || '|' || coalesce(nullif(s, ''), "From") || '|' || coalesce(nullif("Date_Received", ''), "Date_Sent")) AS key FROM shaped)"""


def _partly_keyed(spark, sf):
    """Records of which some lack the id or the sender, so every step of the key rule is used."""
    even = F.col("scan_pos") % 2 == 0
    return records(spark, sf).withColumns({
        "Email_ID": F.when(even, F.col("Email_ID")).otherwise(""),
        "Sender_Email": F.when(F.col("scan_pos") % 4 == 1, "").otherwise(F.col("Sender_Email"))})


@query(S.query(_KEYED, "SELECT scan_pos, key FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY scan_pos) = 1"))
def dedup_key(spark, sf):
    df = _partly_keyed(spark, sf)
    return dedup.keep_first(df, dedup.record_key()).select("scan_pos", dedup.record_key().alias("key"))


@query(S.query(_KEYED, 'SELECT count(*) AS total, count(DISTINCT key) AS "unique", count(*) - count(DISTINCT key) AS duplicates FROM keyed'))
def dedup_stats(spark, sf):
    return dedup.dedup_stats(_partly_keyed(spark, sf), dedup.record_key())


@query(S.query(S.TRAFFIC, """SELECT "Message_ID", l_linenumber, l_partkey, l_suppkey, "To" FROM traffic
  QUALIFY row_number() OVER (PARTITION BY "Message_ID" ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""))
def dedup_traffic(spark, sf):
    df = sample.traffic(spark, sf)
    kept = dedup.keep_first(df, F.col("Message_ID"), ("l_linenumber", "l_partkey", "l_suppkey"))
    return kept.select("Message_ID", "l_linenumber", "l_partkey", "l_suppkey", "To")

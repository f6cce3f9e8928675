"""Named queries that write an export and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import dedup, messages
from postmill.plans import statements as S
from postmill.plans.queries_messages import records
from postmill.schema import EXPORT_FIELDS
from postmill.session import shared_dir
from postmill.sinks import render, writers
from postmill.sources import sample

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


_PLAIN = [f for f in EXPORT_FIELDS if not f.startswith("Attachment_") and f != "Email_ID"]
_NAMED = f"""SELECT scan_pos, {', '.join(f'"{f}"' for f in _PLAIN)}, "Date_Received_Timestamp", "Date_Sent_Timestamp", "HTML_Body",
  "Attachment_Count",
  CASE WHEN "Message_ID" = '' THEN 'email_' || (row_number() OVER (ORDER BY scan_pos) - 1) ELSE "Email_ID" END AS "Email_ID" FROM records"""


@query(S.query(S.RECORDS, _NAMED))
def sink_json(spark, sf):
    blank = F.when(F.col("Message_ID") != "", F.col("Email_ID")).otherwise("")
    df = records(spark, sf).withColumn("Email_ID", blank)
    path = writers.write_json(df, shared_dir(spark, "json"))
    back = spark.read.schema(df.schema).json(path)
    return back.select("scan_pos", *_PLAIN, "Date_Received_Timestamp", "Date_Sent_Timestamp", "HTML_Body", "Attachment_Count", "Email_ID")


def _csv_sql() -> str:
    empty = {"Attachment_Paths", "Attachment_Metadata", "Attachment_Content", "Attachment_Types"}
    cells = []
    for f in EXPORT_FIELDS:
        if f in empty:
            cells.append(f"'' AS \"{f}\"")
        elif f == "Attachment_Count":
            cells.append("""CASE WHEN "Attachment_Count" = 0 THEN '' ELSE "Attachment_Count"::VARCHAR END AS "Attachment_Count" """)
        else:
            cells.append(f'"{f}"')
    return S.query(S.RECORDS, f"SELECT {', '.join(cells)} FROM records")


@query(_csv_sql())
def sink_csv(spark, sf):
    path = writers.write_csv(records(spark, sf), shared_dir(spark, "csv"))
    return writers.read_csv(spark, path)


@query(S.query(S.RECORDS, 'SELECT "Email_ID", "Subject", "Body" FROM records'))
def sink_gzip(spark, sf):
    fields = ["Email_ID", "Subject", "Body"]
    path = writers.write_csv(records(spark, sf), shared_dir(spark, "csv-gz"), fields, compress=True)
    return writers.read_csv(spark, path, fields)


# The message text: first lines, foreign headers one by one, blank line, body.
_TEXT = S.RECORDS + r""",
texts AS (SELECT "Email_ID", scan_pos, "Date_Received_Timestamp" AS received_at,
  array_to_string(list_filter(['Subject: ' || "Subject", 'From: ' || "From", 'To: ' || "To",
    CASE WHEN "CC" <> '' THEN 'Cc: ' || "CC" END, CASE WHEN "BCC" <> '' THEN 'Bcc: ' || "BCC" END,
    strftime(make_timestamp(("Date_Received_Timestamp" * 1000000)::BIGINT), 'Date: %a, %d %b %Y %H:%M:%S GMT'),
    'Message-ID: ' || "Message_ID"]
    || list_transform(list_filter(string_split(hu, chr(10)), lambda x: contains(x, ':')
         AND NOT regexp_matches(x, '^(Subject|From|To|Cc|Bcc|Date|Message-ID)') AND NOT regexp_matches(x, '(?i)^content-')),
       lambda x: trim(substr(x, 1, strpos(x, ':') - 1)) || ': ' || trim(substr(x, strpos(x, ':') + 1))), lambda x: x IS NOT NULL), chr(10))
  || chr(10) || chr(10) || "Body" || chr(10) AS rendered FROM records)"""


@query(S.query(_TEXT, """SELECT "Email_ID", "Email_ID" || '.eml' AS file_name, rendered FROM texts"""))
def render_message_text(spark, sf):
    path = writers.write_eml(records(spark, sf), shared_dir(spark, "eml"))
    return spark.read.parquet(path).select("Email_ID", "file_name", "rendered")


@query(S.query(_TEXT, r"""SELECT scan_pos, 'From - ' || strftime(make_timestamp((received_at * 1000000)::BIGINT), '%a %b %d %H:%M:%S %Y') || chr(10)
  || regexp_replace(rendered, '(?m)^From ', '>From ', 'g') AS mbox FROM texts"""))
def mbox_message(spark, sf):
    return records(spark, sf).select("scan_pos", render.mbox_text().alias("mbox"))


@query(S.query(_TEXT, r"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(
  'From - ' || strftime(make_timestamp((received_at * 1000000)::BIGINT), '%a %b %d %H:%M:%S %Y') || chr(10)
    || regexp_replace(rendered, '(?m)^From ', '>From ', 'g'), chr(10))) AS line FROM texts) GROUP BY line"""))
def sink_mbox_text(spark, sf):
    path = writers.write_mbox(records(spark, sf), shared_dir(spark, "mbox"))
    lines = spark.read.text(path, lineSep="\n")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(S.query(S.UNIQUE, f"""SELECT f AS format, count(*) AS n, count(DISTINCT "Email_ID") AS ids
  FROM kept, (SELECT unnest(['csv', 'json', 'eml']) AS f) GROUP BY f"""))
def fan_out(spark, sf):
    df = messages.mask_records(dedup.keep_first(records(spark, sf), dedup.record_key()))
    paths = writers.fan_out(df, shared_dir(spark, "fan-out"), ["CSV", "json", "eml", "csv"])
    back = {"csv": writers.read_csv(spark, paths["csv"]), "json": spark.read.schema(df.schema).json(paths["json"]),
            "eml": spark.read.parquet(paths["eml"])}
    ids = None
    for fmt, frame in back.items():
        part = frame.select(F.lit(fmt).alias("format"), "Email_ID")
        ids = part if ids is None else ids.unionByName(part)
    per = ids.groupBy("format", "Email_ID").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("format").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ids"))

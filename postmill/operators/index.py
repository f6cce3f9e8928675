"""Search index rows, text search, list view, run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import display as D
from postmill.functions import identity as I
from postmill.functions.text import text_or_empty
from postmill.schema import INDEX_FIELDS

SEARCHED_FIELDS = ["Subject", "From", "Sender_Email", "To", "Date_Received"]  # fixed value
# fixed value: short column names accepted in place of the record's own
ALIASES = {
    "subject": "Subject", "from": "From", "sender": "Sender_Email", "to": "To", "cc": "CC", "bcc": "BCC",
    "date": "Date_Received", "attachments": "Attachment_Paths", "id": "Email_ID", "preview": "Body",
}


def with_known_names(df: DataFrame) -> DataFrame:
    """Add the record's column names for short ones, where they are missing."""
    missing = {full: F.col(short) for short, full in ALIASES.items()
               if short in df.columns and full not in df.columns}
    return df.withColumns(missing) if missing else df


def index_view(df: DataFrame) -> DataFrame:
    """The eleven index columns plus the texts shown for them."""
    def shown(c: str) -> F.Column:
        return F.nullif(text_or_empty(F.col(c)), F.lit(""))
    recipients = F.nullif(F.concat_ws(", ", shown("To"), shown("CC"), shown("BCC")), F.lit(""))
    files = F.coalesce(F.col("Attachment_Count"), F.lit(0))
    label = F.when(files > 0, F.concat(
        files.cast("string"), F.lit(" attachment"), F.when(files != 1, "s").otherwise(""))).otherwise("")
    return df.select(
        *INDEX_FIELDS,
        F.coalesce(shown("Subject"), F.lit("(No Subject)")).alias("Shown_Subject"),
        F.coalesce(shown("From"), shown("Sender_Email"), F.lit("N/A")).alias("Shown_Sender"),
        F.coalesce(recipients, F.lit("N/A")).alias("Shown_Recipients"),
        F.coalesce(shown("Date_Received"), shown("Date_Sent"), F.lit("N/A")).alias("Shown_Date"),
        label.alias("Shown_Attachments"))


def haystack() -> F.Column:
    """The searched fields in small letters, joined by blanks."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in SEARCHED_FIELDS]))


def matches(term: str) -> F.Column:
    return F.contains(haystack(), F.lower(F.lit(term)))


def index_search(df: DataFrame, term: str) -> DataFrame:
    """Rows with the term in one of the searched fields, case-insensitively; '' finds all."""
    return df.where(matches(term))


def search_counts(df: DataFrame, term: str) -> DataFrame:
    """How many of all rows a search shows."""
    return df.agg(F.count_if(matches(term)).alias("shown"), F.count(F.lit(1)).alias("of"))


def message_list_view(df: DataFrame) -> DataFrame:
    recipients = D.comma_recipients(F.col("To"), F.col("CC"), F.col("BCC"))
    return df.select(
        "Email_ID", "scan_pos",
        D.subject_line(F.col("Subject")).alias("subject_line"),
        D.sender_line(F.col("From")).alias("sender_line"),
        D.date_line(I.parse_iso(F.nullif(F.col("Date_Sent"), F.lit("")))).alias("date_line"),
        D.preview_line(F.col("Body")).alias("preview_line"),
        D.recipients_line(recipients).alias("recipients_line"),
        D.sender_initials(F.col("From")).alias("initials"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row of all their columns, without a join."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def run_summary(records: DataFrame, addresses: DataFrame, hosts: DataFrame) -> DataFrame:
    """Counts of a run in one row; each input is reduced to one row before they meet."""
    return side_by_side(
        records.agg(F.count(F.lit(1)).alias("email_count"),
                    F.coalesce(F.sum(F.size("Attachment_Paths")), F.lit(0)).alias("attachments_saved")),
        addresses.agg(F.count(F.lit(1)).alias("address_count")),
        hosts.agg(F.count(F.lit(1)).alias("host_count")))

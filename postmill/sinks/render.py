"""Messages as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.headers import foreign_headers
from postmill.functions.text import text_or_empty


def _date(ts_seconds: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(ts_seconds), pattern)


def message_text() -> Column:
    """Headers, a blank line, the body. A message without a time has no Date line."""
    def line(name: str, field: str, default: str | None = None) -> Column:
        value = F.col(field) if default is None else F.coalesce(F.col(field), F.lit(default))
        return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))

    def optional(name: str, field: str) -> Column:
        return F.when(text_or_empty(F.col(field)) != "", line(name, field))
    date = F.concat(F.lit("Date: "), _date(F.col("Date_Received_Timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    head = F.concat_ws(
        "\n", line("Subject", "Subject", "No Subject"), line("From", "From", "unknown@example.com"),
        line("To", "To", ""), optional("Cc", "CC"), optional("Bcc", "BCC"), date,
        line("Message-ID", "Message_ID", ""), foreign_headers(F.col("Full_Headers")))
    return F.concat(head, F.lit("\n\n"), text_or_empty(F.col("Body")), F.lit("\n"))


def rendered(records: DataFrame) -> DataFrame:
    """Email_ID, file name and text of every record."""
    return records.select("Email_ID", F.concat("Email_ID", F.lit(".eml")).alias("file_name"),
                          message_text().alias("rendered"))


def mbox_text() -> Column:
    """The text as it stands in a mailbox file: a separator line ahead, ``From`` lines escaped."""
    stamp = F.coalesce(_date(F.col("Date_Received_Timestamp"), "EEE MMM dd HH:mm:ss yyyy"),
                       F.lit("Thu Jan 01 00:00:00 1970"))
    escaped = F.regexp_replace(message_text(), r"(?md)^From ", ">From ")
    return F.concat(F.lit("From - "), stamp, F.lit("\n"), escaped)

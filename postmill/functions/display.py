"""Projections for message lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip, text_or_empty

# --- fixed values: lengths and placeholder texts of the list view -------------------------------
SUBJECT_LENGTH = 60
PREVIEW_LENGTH = 80
SHOWN_RECIPIENTS = 3
NO_SUBJECT = "(No Subject)"
NO_SENDER = "Unknown Sender"
NO_DATE = "Unknown Date"
# ----------------------------------------------------------------------------------------------


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def shorten(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def subject_line(subject: Column) -> Column:
    return shorten(_or(subject, NO_SUBJECT), SUBJECT_LENGTH)


def sender_line(sender: Column) -> Column:
    return _or(sender, NO_SENDER)


def date_line(sent: Column) -> Column:
    return F.coalesce(F.date_format(sent, "yyyy-MM-dd HH:mm"), F.lit(NO_DATE))


def preview_line(body: Column) -> Column:
    return shorten(strip(F.translate(text_or_empty(body), "\r\n", "  ")), PREVIEW_LENGTH)


def comma_recipients(*fields: Column) -> Column:
    """Comma-separated entries of several fields in one array (semicolons do not split here)."""
    def one(c: Column) -> Column:
        return F.filter(F.transform(F.split(text_or_empty(c), ","), strip), lambda x: x != "")
    return F.concat(*[one(c) for c in fields])


def recipients_line(recipients: Column) -> Column:
    shown = F.concat(F.lit("To: "), F.array_join(F.slice(recipients, 1, SHOWN_RECIPIENTS), ", "))
    more = F.concat(F.lit(" (+"), (F.size(recipients) - SHOWN_RECIPIENTS).cast("string"), F.lit(" more)"))
    return F.when(F.size(recipients) == 0, "").otherwise(
        F.concat(shown, F.when(F.size(recipients) > SHOWN_RECIPIENTS, more).otherwise("")))


def sender_initials(sender: Column) -> Column:
    words = F.split(strip(text_or_empty(sender)), r"(?U)\s+")
    first = F.upper(F.substring(F.element_at(words, 1), 1, 1))
    last = F.upper(F.substring(F.element_at(words, -1), 1, 1))
    return (F.when(strip(text_or_empty(sender)) == "", "?")
            .when(F.size(words) >= 2, F.concat(first, last)).otherwise(first))

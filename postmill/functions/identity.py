"""Message identity, sender display, dates, importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import first_filled, strip, text_or_empty


def timestamp_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with six fraction digits only where there is a fraction."""
    has_fraction = F.date_format(ts, "SSSSSS") != "000000"
    return F.when(has_fraction, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def epoch_seconds(ts: Column) -> Column:
    """Timestamp to seconds since 1970 as a double (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def epoch_seconds_from_text(c: Column) -> Column:
    """A number given as text to seconds; anything else is null."""
    return c.try_cast("double")


def email_id(message_id: Column, subject: Column, sender_email: Column, sender_name: Column,
             delivery_time: Column) -> Column:
    """16 hex digits: of the message id if there is one, else of subject, sender and time."""
    mid = text_or_empty(message_id)
    sender = first_filled(sender_email.cast("string"), sender_name.cast("string"))
    when = F.coalesce(timestamp_text(delivery_time), F.lit("None"))
    content = F.concat_ws("|", text_or_empty(subject), sender, when)
    return F.when(strip(mid) != "", F.substring(F.sha2(mid, 256), 1, 16)).otherwise(
        F.substring(F.md5(content), 1, 16))


def from_display(sender_name: Column, sender_email: Column) -> Column:
    name, email = text_or_empty(sender_name), text_or_empty(sender_email)
    return F.when(email != "", F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(name)


def importance(priority: Column) -> Column:
    return F.when(priority == 1, "High").when(priority == -1, "Low").otherwise("Normal")


def parse_iso(c: Column) -> Column:
    """ISO date-time text, with or without fraction, zone or ``Z``; null if it is none. A time alone is none."""
    return F.when(F.rlike(c, F.lit(r"^\s*\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(c))


def dedup_key(email_id_: Column, message_id: Column, subject: Column, sender: Column, from_: Column,
              received: Column, sent: Column) -> Column:
    """Key of a message for duplicate removal; '' means never a duplicate."""
    who, when = first_filled(sender, from_), first_filled(received, sent)
    content = F.concat_ws("|", text_or_empty(subject), who, when)
    # Three empty parts leave the two separators only.
    return first_filled(email_id_, message_id, F.regexp_replace(content, r"^\|\|$", ""))

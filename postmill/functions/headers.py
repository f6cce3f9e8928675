"""Transport headers: single fields, thread fields, delivery path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import first_filled, strip

# --- fixed values: header lines a rendered message writes itself --------------------------------
OWN_HEADERS = ["Subject", "From", "To", "Cc", "Bcc", "Date", "Message-ID"]
# ----------------------------------------------------------------------------------------------


def _plain_breaks(headers: Column) -> Column:
    return F.replace(F.coalesce(headers, F.lit("")), F.lit("\r"), F.lit(""))


def unfold(headers: Column) -> Column:
    """Join continuation lines to the header they belong to, by one blank."""
    return F.regexp_replace(_plain_breaks(headers), r"[ \t]*\n[ \t]+", " ")


def _all_values(text: Column, name: str, keep_name: bool = False) -> Column:
    pattern = rf"(?imd)^({name}:.*)$" if keep_name else rf"(?imd)^{name}:(.*)$"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _last_value(text: Column, name: str) -> Column:
    return strip(F.coalesce(F.try_element_at(_all_values(text, name), F.lit(-1)), F.lit("")))


def header_field(headers: Column, name: str) -> Column:
    """Value on the last line that starts with ``name:``; continuation lines are not read."""
    return _last_value(_plain_breaks(headers), name)


def references(headers: Column) -> Column:
    return F.regexp_replace(_last_value(unfold(headers), "references"), r"\s+", " ")


def parent_id(headers: Column) -> Column:
    return F.regexp_replace(_last_value(unfold(headers), "in-reply-to"), r"\s+", " ")


def thread_id(refs: Column, parent: Column, message_id: Column) -> Column:
    """First bracketed reference, else the parent, else the message's own id."""
    return first_filled(F.regexp_extract(refs, r"<[^<>\s]*>", 0), parent, message_id)


def received_hops(headers: Column) -> Column:
    """All ``Received`` headers, unfolded, name kept, in order, joined by '; '."""
    hops = _all_values(unfold(headers), "received", keep_name=True)
    return F.array_join(F.transform(hops, strip), "; ")


def foreign_headers(headers: Column) -> Column:
    """Header lines to copy into a rendered message, as an array of ``name: value``.

    Lines without a colon, the ones the renderer writes itself, and content-* (the rendered
    text carries no MIME parts) are left out.
    """
    own = "|".join(OWN_HEADERS)
    lines = F.split(unfold(headers), "\n")
    kept = F.filter(lines, lambda x: x.contains(":") & ~x.rlike(rf"^(?:{own})|(?i)^content-"))
    return F.transform(kept, lambda x: F.concat(
        strip(F.substring_index(x, ":", 1)), F.lit(": "), strip(F.substr(x, F.locate(":", x) + 1))))


def deny_listed_lines(headers: Column) -> Column:
    """Unfolded header lines with a colon whose start is not one of the renderer's own names."""
    own = "|".join(OWN_HEADERS)
    lines = F.split(unfold(headers), "\n")
    return F.filter(lines, lambda x: x.contains(":") & ~x.rlike(rf"^(?:{own})"))

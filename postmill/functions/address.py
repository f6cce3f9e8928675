"""Recipient lists, address parts, transport hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip


def split_recipients(c: Column) -> Column:
    """``;``- or ``,``-separated text to an array of stripped, non-blank entries."""
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), ",", ";"), ";")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clean_recipients(c: Column) -> Column:
    """The same for a value that is already an array."""
    return F.filter(F.transform(F.coalesce(c, F.array()), lambda x: strip(F.coalesce(x, F.lit("")))),
                    lambda x: x != "")


def is_address(c: Column) -> Column:
    """Not blank and not the literal ``none``."""
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin("", "none")


def normal_address(c: Column) -> Column:
    return F.lower(strip(c))


def address_domain(a: Column) -> Column:
    """What follows the first ``@``; '' without one."""
    return F.when(F.contains(a, F.lit("@")), F.substr(a, F.locate("@", a) + 1)).otherwise("")


def address_name(a: Column) -> Column:
    """What precedes the first ``@``; the whole without one."""
    return F.substring_index(a, "@", 1)


def host_values(hops: Column, is_array: bool = False) -> Column:
    """Hosts of one message as an array: the whole text is one value, an array gives one each."""
    items = F.coalesce(hops, F.array().cast("array<string>")) if is_array else F.array(hops)
    return F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), lambda x: strip(F.lower(x)))

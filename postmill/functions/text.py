"""Text clean-up: UTF-8, whitespace, HTML, RTF, body choice."""

from __future__ import annotations

import functools
import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a line break and as white space, over the whole of Unicode.
_BREAK = r"\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029"
_SPACE = r"\s\x1c-\x1f"

# The same as a set of characters.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Slots of the table of named references; a slot holds about nine names.
_SLOTS = 256


def text_or_empty(c: Column) -> Column:
    """Any value as a string; null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_utf8(c: Column) -> Column:
    """Bytes or string to well-formed text: malformed sequences are dropped, null becomes ''.

    The JVM validator puts U+FFFD where it repairs, so a value that already carried one is
    only touched if it was malformed too.
    """
    s = c.cast("string")
    # Where it is well-formed, the value is worked out once: what is behind it may be the whole text of a document.
    return F.coalesce(F.try_validate_utf8(s), F.regexp_replace(F.make_valid_utf8(s), "\ufffd", ""), F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_whitespace(c: Column) -> Column:
    """Strip every line and drop the blank ones.

    A run of white space that holds a line break is exactly what lies between two kept lines,
    so one replacement does it, without splitting into arrays.
    """
    s = strip(clean_utf8(c))
    return F.regexp_replace(s, rf"(?U)[{_SPACE}&&[^{_BREAK}]]*[{_BREAK}][{_SPACE}]*", "\n")


@functools.cache
def _references() -> str:
    """The named references of HTML as JSON: a list of small objects, a name in the slot of its CRC-32."""
    slots: list[dict[str, str]] = [{} for _ in range(_SLOTS)]
    for name, char in html.entities.html5.items():
        slots[zlib.crc32(name.encode()) % _SLOTS][name] = char
    return json.dumps(slots)


def _named(name: Column) -> Column:
    # The parsed table is a constant of the plan; a map is searched from its start, hence the slots.
    table = F.from_json(F.lit(_references()), "array<map<string,string>>")
    return F.try_element_at(F.get(table, F.pmod(F.crc32(name), F.lit(_SLOTS)).cast("int")), name)


@functools.cache
def _controls() -> str:
    """What numbers of control characters stand for, as JSON: 80 to 9F are read as Windows-1252, most others vanish."""
    found = {n: "" for n in [*range(1, 9), 11, *range(14, 32), 127]} | {0: "\ufffd"}
    found |= {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
    return json.dumps(found)


def _numeric(ref: Column) -> Column:
    """``#233;`` or ``#xE9;`` as a character: surrogates and numbers out of range are U+FFFD, noncharacters vanish."""
    # Twelve digits are out of range whatever follows.
    digits = F.substring(F.ltrim(F.rtrim(F.substr(ref, F.lit(2)), F.lit(";")), F.lit("0xX")), 1, 12)
    number = F.when(F.rlike(ref, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")

    def char(n: Column) -> Column:
        special = F.try_element_at(F.from_json(F.lit(_controls()), "map<string,string>"), n.cast("string"))
        beyond = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        nothing = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(beyond, "\ufffd").when(nothing, "").otherwise(F.coalesce(special, plain))

    return F.get(F.transform(F.array(F.coalesce(number, F.lit(0).cast("bigint"))), char), 0)


def _decoded(piece: Column) -> Column:
    """The text that stands for ``&`` and a piece (``rest``, and ``ref`` at its start)."""
    rest, ref = piece["rest"], piece["ref"]
    behind = F.substr(rest, F.length(ref) + 1)
    # The longest beginning of the name that is known: some names need no semicolon.
    tried = F.when(F.length(ref) >= 2, F.transform(F.sequence(F.length(ref), F.lit(2), F.lit(-1)), lambda k: F.struct(
        k.alias("k"), _named(F.substr(ref, F.lit(1), k)).alias("char"))))
    named = F.transform(F.slice(F.filter(tried, lambda t: t["char"].isNotNull()), 1, 1), lambda t: F.concat(
        t["char"], F.substr(ref, t["k"] + 1), behind))
    return F.when(F.startswith(ref, F.lit("#")), F.concat(_numeric(ref), behind)).otherwise(
        F.coalesce(F.get(named, 0), F.concat(F.lit("&"), rest)))


_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape(c: Column) -> Column:
    """Decode every named and numeric character reference; a text without ``&`` is not cut. ``c`` is named once, so nested
    calls stay small."""
    def cut(x: Column) -> Column:
        pieces = F.transform(F.split(x, "&"), lambda p: F.struct(
            p.alias("rest"), F.regexp_extract(p, _REFERENCE, 1).alias("ref")))
        return F.array_join(F.transform(pieces, lambda q, i: F.when(i == 0, q["rest"]).otherwise(_decoded(q))), "")

    return F.get(F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit("&")), cut(x)).otherwise(x)), 0)


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML document, one line per text node.

    Script, style and comments go, every other tag becomes a line break, references are decoded
    twice (once by parsing, once on the extracted text) and the lines are collapsed.
    """
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "\n")
    s = F.regexp_replace(s, r"(?s)<[!/?A-Za-z][^>]*>", "\n")
    return collapse_whitespace(unescape(unescape(s)))


def rtf_strip(c: Column) -> Column:
    """Fallback for rich text: braces out, references decoded, lines collapsed."""
    return collapse_whitespace(unescape(F.translate(F.coalesce(c, F.lit("")), "{}", "")))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else ''.

    Each argument is named once, so conditions on the result stay small when they are pushed down.
    """
    filled = F.filter(F.array(*columns), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.try_element_at(filled, F.lit(1)), F.lit(""))


def _non_empty(c: Column) -> Column:
    """Null for ''. ``nullif`` would compute its argument twice inside ``coalesce``."""
    return F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1))


def resolve_body(plain: Column, html_body: Column, rtf: Column) -> Column:
    """Plain text, else text of the HTML, else stripped RTF, else ''.

    ``coalesce`` stops at the first value, so the HTML and RTF work is done only for the
    rows that need it.
    """
    return F.coalesce(
        _non_empty(collapse_whitespace(plain)),
        _non_empty(html_to_text(html_body)),
        _non_empty(rtf_strip(rtf)),
        F.lit(""),
    )

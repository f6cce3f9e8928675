"""Personal-data masking as nested JVM replacements."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# --- fixed values: masking patterns, in the order they are applied ------------------------------
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?",
    "PHONE": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "IP": r"(?:\b(?:\d{1,3}\.){3}\d{1,3}\b)|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}",
    "URL": r"https?://(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^?@<\s]*(?:\?[^@<\s]*)?)?",
}
# ----------------------------------------------------------------------------------------------

# Text every match must contain. Where it is missing the replacement is not run at all.
_MUST_CONTAIN = {"EMAIL": "@", "URL": "://"}
# The same where it is no fixed text; much cheaper than the pattern.
_MUST_MATCH = {"PHONE": r"(?U)\d{4}", "IP": r"(?U)\d\.\d|:[0-9a-fA-F]{1,4}:"}


def masking_rules(custom: Mapping[str, str] | None = None) -> dict[str, str]:
    """Default patterns plus ``custom``; a default key is replaced in place, a bad pattern skipped.

    Named groups in the form ``(?P<n>...)`` and ``(?P=n)`` are turned into the JVM's form, and the JVM says whether a
    pattern is good.
    """
    rules = dict(PATTERNS)
    for key, pattern in (custom or {}).items():
        pattern = pattern.replace("(?P<", "(?<")
        while (at := pattern.find("(?P=")) >= 0:
            end = pattern.find(")", at)
            pattern = f"{pattern[:at]}\\k<{pattern[at + 4:end]}>{pattern[end + 1:]}"
        if problem := _problem_of(pattern):
            log.warning("masking pattern %s skipped: %s", key, problem)
            continue
        rules[key] = pattern
    return rules


def _problem_of(pattern: str) -> str | None:
    """What the JVM has against a pattern, found out on one row of nothing."""
    try:
        SparkSession.active().range(1).select(F.regexp_replace(F.lit("").cast("string"), f"(?U){pattern}", "")).collect()
    except PySparkException as exc:
        return str(exc).splitlines()[0]
    return None


def mask_pii(c: Column, custom: Mapping[str, str] | None = None) -> Column:
    """Replace every match by ``<KEY>``, pattern after pattern. Null becomes ''."""
    out = F.coalesce(c, F.lit(""))
    for key, pattern in masking_rules(custom).items():
        token = f"<{key}>".replace("\\", "\\\\").replace("$", "\\$")
        default = PATTERNS.get(key) == pattern

        def masked(text: Column) -> Column:
            return F.regexp_replace(text, f"(?U){pattern}", token)  # noqa: B023

        def where_needed(text: Column) -> Column:
            return F.when(_may_match(key, text), masked(text)).otherwise(text)  # noqa: B023

        # Bound to a name, the text is worked out once and the plan grows by one step for each pattern.
        out = F.get(F.transform(F.array(out), where_needed), 0) if default else masked(out)
    return out


def _may_match(key: str, text: Column) -> Column:
    """False only for texts without a match of a default pattern."""
    if key in _MUST_CONTAIN:
        return F.contains(text, F.lit(_MUST_CONTAIN[key]))
    return F.rlike(text, F.lit(_MUST_MATCH[key]))

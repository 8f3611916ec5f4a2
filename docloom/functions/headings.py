"""Heading tests and heading titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import WS, col, contains_any, strip, word_count

# Heading patterns and known titles.
NUMBERED = r"(?U)^(\d+(?:\.\d+)*)\s+(.+)$"
NUMBERED_SHORT = r"(?U)^(\d{1,2}(?:\.\d{1,2})*)\s+(.+)$"
NUMBER_PREFIX = r"(?U)^(\d{1,2}(?:\.\d{1,2})*)\s+"
ANNEX = r"(?iU)^(?:annexure|annex|appendix)\s+[a-z0-9]+(?:\s*[-–:]\s*.+)?\s*$"
ALL_CAPS = r"^[A-Z][A-Z0-9\s\-/&]{3,80}$"
NOT_TITLE_CASE = r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}"
KNOWN_TITLES = [
    "introduction",
    "scope of work",
    "technical requirements",
    "eligibility criteria",
    "submission instructions",
    "evaluation criteria",
    "payment terms",
    "general terms and conditions",
    "commercial terms",
    "bill of quantities",
    "instructions to bidders",
    "statement of work",
]


def _numbered(s: Column) -> Column:
    rest = F.regexp_extract(s, NUMBERED_SHORT, 2)
    return (
        s.rlike(NUMBERED_SHORT)
        & rest.rlike(r"(?s)\p{L}.*\p{L}")
        & ~rest.startswith("(")
        & ~rest.rlike(r"(?iU)\b(fax|tel|phone)\b")
        & ~rest.rlike(r"^\p{Ll}")
        & ~(rest.rlike(r"(?iU)\bmiles\b") & rest.rlike(r"(?iU)\blength\b"))
        & ~(rest.endswith(".") & (word_count(rest) >= 4))
    )


def is_heading_stripped(s: Column) -> Column:
    """Heading test of a line without outer whitespace; long lines leave at the first check."""
    low = F.lower(s)
    words = F.size(F.split(s, WS + "+"))
    all_caps = s.rlike(ALL_CAPS) & words.between(2, 12) & ~((words == 2) & (F.length(s) <= 10))
    title_case = contains_any(low, KNOWN_TITLES) & (words <= 8) & ~s.endswith(".") & ~s.rlike(NOT_TITLE_CASE)
    return F.length(s).between(1, 200) & (_numbered(s) | low.isin(KNOWN_TITLES) | s.rlike(ANNEX) | all_caps | title_case)


def is_numbered_heading(c) -> Column:
    return _numbered(strip(c))


def is_heading(c) -> Column:
    return is_heading_stripped(strip(c))


def heading_title(c) -> Column:
    return strip(F.regexp_replace(strip(c), NUMBERED, "$1 $2"))


def section_level(title, explicit=None) -> Column:
    """Explicit level when positive, else the number of numeric segments, else 1."""
    num = F.regexp_extract(strip(F.coalesce(col(title), F.lit(""))), NUMBER_PREFIX, 1)
    inferred = F.when(num == "", 1).otherwise(F.size(F.split(num, r"\.")))
    if explicit is None:
        return inferred
    e = col(explicit)
    return F.when(e > 0, e).otherwise(inferred)


def section_prefix(title) -> Column:
    return F.regexp_extract(strip(F.coalesce(col(title), F.lit(""))), r"(?U)^(\d+(?:\.\d+)*)", 1)


"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes, and the same set as a regex class.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def collapse(c) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.btrim(F.regexp_replace(col(c), WS + "+", " "), F.lit(" "))


def normalize_newlines(c) -> Column:
    return F.regexp_replace(col(c), LINE_BREAKS, "\n")


def lines_of(c) -> Column:
    return F.split(normalize_newlines(c), "\n")


def word_count(c) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, WS + "+")))


def head(c, n: int | None) -> Column:
    """The first n characters; the whole text where no limit is given."""
    return col(c) if n is None else F.substring(col(c), 1, n)


def first(values, n: int | None) -> Column:
    """The first n elements; all of them where no limit is given."""
    return col(values) if n is None else F.slice(col(values), 1, n)


def within(rank, n: int | None) -> Column:
    """Whether a rank is inside a limit; always where none is given."""
    return F.lit(True) if n is None else col(rank) <= n


def contains_any(text: Column, needles) -> Column:
    """True where the text holds at least one of a fixed list of literals."""
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def count_contained(text: Column, needles) -> Column:
    """How many of a fixed list of literals the text holds."""
    out = F.lit(0)
    for needle in needles:
        out = out + text.contains(needle).cast("int")
    return out


def norm_ws(c) -> Column:
    return F.lower(collapse(F.coalesce(col(c), F.lit(""))))


def norm_cite(c) -> Column:
    """Citation normal form: lower case, table pipes and dash runs taken out."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return collapse(F.regexp_replace(F.regexp_replace(lowered, WS + r"*\|" + WS + "*", " "), "-{2,}", " "))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ordered_join(order_and_text: Column, sep: str) -> Column:
    """Join collected (order..., text) structs in order; `text` is the last field. Collected lists hold no null,
    so the natural order does, without a comparison by lambda for every two elements."""
    return F.array_join(F.transform(F.sort_array(order_and_text), lambda s: s["text"]), sep)


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

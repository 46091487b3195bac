"""Text helpers for headlines and display values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text holds at least one of the words."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def feed_date(c: Column) -> Column:
    """Day, month and hh:mm of a feed date with five or more tokens, else its first 16 characters."""
    parts = F.split(c, " ")
    short = F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.substring(F.get(parts, F.lit(4)), 1, 5))
    return F.when(F.size(parts) >= 5, short).otherwise(F.substring(c, 1, 16))


def parse_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double")


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def thousands_text(c: Column, digits: int = 0) -> Column:
    return F.format_number(c, digits)


def bold_to_tag(c: Column) -> Column:
    return F.regexp_replace(c, r"\*\*(.+?)\*\*", "<b>$1</b>")

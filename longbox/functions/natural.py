"""Natural order of item numbers, as sort-key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 1.7976931348623157e308


def _number(column: Column, pattern: str) -> Column:
    found = F.regexp_extract(column, pattern, 1)
    return F.when(found != "", found).try_cast("double")


def natural_key_a(number: Column) -> list[Column]:
    """Empty last, then the first number anywhere, then the text."""
    empty = F.coalesce(number == "", F.lit(True))
    return [
        F.when(empty, 1).otherwise(0),
        F.coalesce(_number(number, r"(\d+(?:\.\d+)?)"), F.lit(LAST)),
        F.lower(number),
    ]


def natural_key_b(number: Column, cover_date: Column) -> list[Column]:
    """Empty last, leading number after a known prefix, date, then the text.

    Numbers without a leading figure sort behind all others by their text.
    """
    empty = F.coalesce(number == "", F.lit(True))
    bare = F.trim(F.regexp_replace(F.lower(number), r"^(annual|special|one-shot)\s*", ""))
    return [
        F.when(empty, 1).otherwise(0),
        F.coalesce(_number(bare, r"^(\d+(?:\.\d+)?)"), F.lit(LAST)),
        F.when(cover_date.isNull(), 1).otherwise(0),
        cover_date,
        F.lower(number),
    ]

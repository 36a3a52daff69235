"""Rounding, parsing and size formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters of the server and browser size formats.
SERVER_UNITS = "KMGTPE"
BROWSER_UNITS = ["Bytes", "KB", "MB", "GB"]
DEFAULT_THRESHOLD = 0.55


def round_half_up(column: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles, the catalogue's own rounding."""
    scale = float(10**digits)
    return F.floor(column.cast("double") * scale + 0.5) / scale


def percent(part: Column, whole: Column, digits: int = 1, empty: float = 0.0) -> Column:
    share = round_half_up(part * F.lit(100.0) / whole, digits)
    return F.when(whole > 0, share).otherwise(F.lit(empty))


def first_int(column: Column) -> Column:
    found = F.regexp_extract(column, r"(\d+)", 1)
    return F.coalesce(F.when(found != "", found).try_cast("bigint"), F.lit(0).cast("bigint"))


def completion_pct(owned: Column, available: Column) -> Column:
    share = F.floor(owned.cast("double") / available * 100 + 0.5)
    return F.when(available > 0, share).otherwise(F.lit(0).cast("bigint"))


def parse_threshold(column: Column) -> Column:
    """``55%``, ``55`` and ``0.55`` are the same share; anything else the default."""
    text = F.trim(column.cast("string"))
    share = F.trim(F.regexp_replace(text, r"%+$", "")).try_cast("double") / 100
    plain = text.try_cast("double")
    parsed = F.when(text.endswith("%"), share).otherwise(
        F.when(plain > 1, plain / 100).otherwise(plain)
    )
    return F.coalesce(parsed, F.lit(DEFAULT_THRESHOLD))


def int_from_map(values: Column, keys: list[str]) -> Column:
    """First of ``keys`` whose value is a whole number."""
    found = []
    for key in keys:
        text = F.try_element_at(values, F.lit(key)).cast("string")
        found.append(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")))
    return F.coalesce(*found)


def format_size(column: Column) -> Column:
    """``512 B``, ``1.5 KB`` … ``EB``; the unit is found by comparison."""
    size = column.cast("bigint")
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SERVER_UNITS, start=1):
        scaled = F.concat(F.format_string("%.1f", size / float(1024**power)), F.lit(f" {unit}B"))
        text = F.when(size >= F.lit(1024**power), scaled).otherwise(text)
    return text


def format_size_ui(column: Column) -> Column:
    """Up to two decimals without trailing zeros, ``0 Bytes`` for nothing."""
    size = column.cast("bigint")
    text = F.lit("0 Bytes")
    for power, unit in enumerate(BROWSER_UNITS):
        two = F.format_string("%.2f", size / float(1024**power))
        short = F.regexp_replace(F.regexp_replace(two, r"0+$", ""), r"\.$", "")
        text = F.when(size >= F.lit(1024**power), F.concat(short, F.lit(f" {unit}"))).otherwise(text)
    return text

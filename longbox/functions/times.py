"""Durations, relative times and date parts; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Long duration words and their lengths in seconds.
LONG_UNITS = [
    ("year", 31536000),
    ("month", 2592000),
    ("week", 604800),
    ("day", 86400),
    ("hour", 3600),
    ("minute", 60),
]


def moment(value: str | Column) -> Column:
    """A literal or column as a zone-less timestamp."""
    return value if isinstance(value, Column) else F.to_timestamp_ntz(F.lit(value))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def millis_between(start: Column, end: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / 1000)


def duration_s(start: Column, end: Column, as_of: str | Column) -> Column:
    """Whole seconds; an open start or end stands for ``as_of``."""
    now = moment(as_of)
    return seconds_between(F.coalesce(start, now), F.coalesce(end, now))


def _two(column: Column) -> Column:
    text = column.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _div(column: Column, by: int) -> Column:
    return F.floor(column / F.lit(by))


def fmt_hms(seconds: Column) -> Column:
    """``mm:ss``, with hours in front only when there are any."""
    hours = _div(seconds, 3600)
    minutes = _div(seconds % 3600, 60)
    short = F.concat_ws(":", _two(minutes), _two(seconds % 60))
    return F.when(hours > 0, F.concat_ws(":", _two(hours), short)).otherwise(short)


def fmt_mmss(seconds: Column) -> Column:
    """``mm:ss`` whose minutes run past the hour."""
    return F.concat_ws(":", _two(_div(seconds, 60)), _two(F.floor(seconds % 60)))


def fmt_short(seconds: Column) -> Column:
    hours, minutes = _div(seconds, 3600), _div(seconds % 3600, 60)
    rest = (seconds % 60).cast("bigint")
    return (
        F.when(seconds.isNull(), "")
        .when(seconds < 0, "Invalid")
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


def fmt_long(seconds: Column) -> Column:
    """``1 day 2 hours 5 seconds``; seconds shown when non-zero or alone."""
    rest = F.floor(seconds)
    parts = []
    for word, size in LONG_UNITS:
        count = _div(rest, size)
        plural = F.when(count > 1, "s").otherwise("")
        parts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {word}"), plural)))
        rest = rest % size
    larger = F.concat_ws(" ", *parts)
    tail = F.concat(rest.cast("string"), F.lit(" second"), F.when(rest != 1, "s").otherwise(""))
    return (
        F.when(seconds.isNull(), "")
        .when(larger == "", tail)
        .when(rest > 0, F.concat_ws(" ", larger, tail))
        .otherwise(larger)
    )


def relative_time(column: Column, as_of: str | Column, fine: bool = False) -> Column:
    """``Just now``, ``5m ago`` …; a week or more gives the date itself."""
    seconds = seconds_between(column, moment(as_of))
    minutes, hours, days = (_div(seconds, n) for n in (60, 3600, 86400))

    def ago(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f"{unit} ago"))

    if fine:
        return (
            F.when(column.isNull(), "Unknown")
            .when(seconds < 10, "Just now")
            .when(seconds < 60, ago(seconds, "s"))
            .when(minutes < 60, ago(minutes, "m"))
            .when(hours < 24, ago(hours, "h"))
            .when(days == 1, "Yesterday")
            .when(days < 7, ago(days, "d"))
            .otherwise(F.date_format(column, "MMM d, h:mm a"))
        )
    return (
        F.when(column.isNull(), "")
        .when(minutes < 1, "Just now")
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .when(days < 7, ago(days, "d"))
        .otherwise(F.date_format(column, "MMM d, yyyy"))
    )


def month_label(month: Column) -> Column:
    """``2024-01`` as ``Jan '24``."""
    day = F.to_date(F.concat(month, F.lit("-01")))
    return F.concat(F.date_format(day, "MMM"), F.lit(" '"), F.substring(month, 3, 2))


def month_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def eta(started: Column, percentage: Column, as_of: str | Column) -> Column:
    """Struct (remaining_s, label); null until some progress is known."""
    known = started.isNotNull() & F.coalesce(percentage > 0, F.lit(False))
    elapsed = seconds_between(started, moment(as_of)).cast("double")
    remaining = F.greatest(elapsed / (percentage / 100.0) - elapsed, F.lit(0.0))
    minutes = F.ceil(remaining / 60)
    label = (
        F.when(minutes <= 0, "Soon")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(
            F.concat(
                _div(minutes, 60).cast("string"), F.lit("h "),
                (minutes % 60).cast("string"), F.lit("m"),
            )
        )
    )
    return F.when(known, F.struct(remaining.alias("remaining_s"), label.alias("label")))


def from_date_array(parts: Column) -> Column:
    """``[y, m, d(, h, mi, s(, ns))]`` as a zone-less timestamp, cut to millis."""

    def at(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(0))

    millis = _div(at(6), 1_000_000)
    second = at(5) + (millis / 1000.0).cast("decimal(8,6)")
    built = F.try_make_timestamp_ntz(at(0), at(1), at(2), at(3), at(4), second)
    return F.when(F.size(parts) >= 3, built)


def parse_date(column: Column) -> Column:
    """ISO dates only; anything else is null rather than an error."""
    return F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}$"), column).try_cast("date")


def end_year_candidate(cover_date: Column) -> Column:
    """Year of an ISO date, else of its first four characters."""
    return F.coalesce(F.year(parse_date(cover_date)), F.substring(cover_date, 1, 4).try_cast("int"))


def derive_end_year(latest_year: Column, as_of: str) -> Column:
    """The latest cover year, once it lies two calendar years back."""
    return F.when(F.lit(int(as_of[:4])) - latest_year >= 2, latest_year)

"""Text, name and URL functions, all JVM-side."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded by `make_readable`, in this order.
READABLE_ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
]
# Entities decoded by `clean_only`, in this order.
CLEAN_ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
# Paragraph-break rules, applied in this order. A further rule,
# a break before "Place:" openings, only finds places where the first rule has
# already left exactly one blank line, so it changes nothing and is left out:
# on long texts without a colon it would read to the end from every sentence.
READABLE_BREAKS = [
    r"([.!?])\s*([A-Z])",
    r"([.!?])\s*(\"[^\"]*\")",
    r"(\"[^\"]*\")\s*([A-Z])",
]
# The conservative paragraph-break rules.
BASIC_BREAKS = [r"([.!?])\s*([A-Z][a-z]+[,:])", r"([.!?])\s*(\")"]
NAME_LIMIT = 100
UNKNOWN = "unknown"
IMAGE_EXTENSIONS = r"\.(jpg|jpeg|png|gif|webp|bmp)$"


def _replace_all(column: Column, pairs: list[tuple[str, str]]) -> Column:
    for found, put in pairs:
        column = F.replace(column, F.lit(found), F.lit(put))
    return column


def _break_all(column: Column, patterns: list[str]) -> Column:
    for pattern in patterns:
        column = F.regexp_replace(column, pattern, "$1\n\n$2")
    return F.regexp_replace(column, r"\n{3,}", "\n\n")


def strip_edges(column: Column) -> Column:
    """Trim every control or space character, not just the space."""
    return F.regexp_replace(column, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(column: Column) -> Column:
    """Null, empty or white space only."""
    return column.isNull() | (strip_edges(column) == "")


def _plain(column: Column, entities: list[tuple[str, str]]) -> Column:
    untagged = F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(_replace_all(untagged, entities), r"\s+", " "))


def make_readable(column: Column) -> Column:
    return _break_all(_plain(column, READABLE_ENTITIES), READABLE_BREAKS)


def basic_paragraphs(column: Column) -> Column:
    return strip_edges(_break_all(column, BASIC_BREAKS))


def clean_only(column: Column) -> Column:
    return _plain(column, CLEAN_ENTITIES)


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Characters that decompose (NFD) to an ASCII letter, digit, space or dash and marks; and these.

    Each has exactly one such character, the first. All other characters decompose
    to none, so a name that drops what is not ASCII needs no more than this.
    """
    kept = set(string.ascii_letters + string.digits + string.whitespace + "-_")
    first = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(128, sys.maxunicode + 1)}
    found = {c: base for c, base in first.items() if base in kept}
    return "".join(found), "".join(found.values())


def _unaccented(column: Column) -> Column:
    return F.translate(column, *_bases())


def _shorten(column: Column, edge: str) -> Column:
    def cut(bare: Column) -> Column:
        short = F.regexp_replace(F.substring(bare, 1, NAME_LIMIT), f"{edge}+$", "")
        return F.when(bare == "", UNKNOWN).when(F.length(bare) > NAME_LIMIT, short).otherwise(bare)

    # As an element of a list the long chain behind the column runs once a row.
    return F.element_at(F.transform(F.array(column), cut), 1)


def normalize_name(column: Column) -> Column:
    """Folder name: accents and odd characters dropped, spaces to underscores."""
    bare = F.regexp_replace(_unaccented(F.coalesce(column, F.lit(""))), r"[^a-zA-Z0-9\s\-_]+", "")
    bare = F.lower(F.regexp_replace(bare, r"\s+", "_"))
    return _shorten(F.trim(bare, F.lit("_-")), "_")


def slug(column: Column) -> Column:
    """URL slug: lower case, dashes for space and underscore."""
    bare = _unaccented(F.lower(F.coalesce(column, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\s_]+", "-"), r"[^a-z0-9-]+", "")
    return _shorten(F.trim(F.regexp_replace(bare, r"-+", "-"), F.lit("-")), "-")


def sanitize_key(column: Column) -> Column:
    key = F.regexp_replace(F.lower(column), r"[^a-z0-9_-]", "_")
    key = F.regexp_replace(F.regexp_replace(key, r"_{2,}", "_"), r"^_|_$", "")
    return F.when(column.isNull(), "null").otherwise(key)


def _after(column: Column, marker: str) -> Column:
    return F.substr(column, F.locate(marker, column) + F.lit(len(marker)))


def image_path(column: Column) -> Column:
    return (
        F.when(column.contains("stored_images/"), _after(column, "stored_images/"))
        .when(column.contains("/image/"), _after(column, "/image/"))
        .otherwise(column)
    )


def normalize_barcode(column: Column) -> Column:
    digits = F.regexp_replace(column, r"\D", "")
    padded = (F.length(digits) == 13) & digits.startswith("0")
    return F.when(padded, F.substring(digits, 2, 12)).otherwise(digits)


def issue_number_match(left: Column, right: Column) -> Column:
    a, b = (F.lower(F.regexp_replace(c, r"[^0-9a-zA-Z]", "")) for c in (left, right))
    return F.coalesce((a == b) | a.startswith(b) | b.startswith(a), F.lit(False))


def absolute_url(column: Column, base: str, scheme: str = "https:") -> Column:
    root = base.rstrip("/")
    return (
        F.when(column.startswith("//"), F.concat(F.lit(scheme), column))
        .when(column.startswith("/"), F.concat(F.lit(root), column))
        .when(~column.startswith("http"), F.concat(F.lit(root + "/"), column))
        .otherwise(column)
    )


def id_from_url(column: Column) -> Column:
    """Second-last path segment; empty segments at the end do not count."""
    parts = F.split(F.regexp_replace(column, r"/+$", ""), "/")
    return F.try_element_at(parts, F.lit(-2)).try_cast("bigint")


def capitalised(column: Column, start: str) -> Column:
    """Upper case after every zero-width match of ``start``."""
    return F.array_join(F.transform(F.split(column, start), lambda part: F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))), "")


def state_label(column: Column) -> Column:
    for pattern in (r"(?i)\(Displayname=([^)]+)\)", r"(?i)\(Value=([^)]+)\)", r"\.([^.]+)$"):
        column = F.when(column.rlike(pattern), F.regexp_extract(column, pattern, 1)).otherwise(column)
    bare = strip_edges(F.regexp_replace(column, r"\([^)]*\)", ""))
    return capitalised(F.lower(F.replace(bare, F.lit("_"), F.lit(" "))), r"(?<!\w)(?=\w)")


def name_year(column: Column) -> Column:
    """Struct (name, year) of a folder called ``Name (YYYY)``."""
    folder = F.element_at(F.split(F.regexp_replace(column, r"[/\\]+$", ""), "/"), -1)
    year = F.regexp_extract(folder, r"\((\d{4})\)", 1)
    return F.struct(
        strip_edges(F.regexp_replace(folder, r"\s*\(\d{4}\)\s*", "")).alias("name"),
        F.when(year != "", year.cast("int")).alias("year"),
    )


def etag(column: Column) -> Column:
    """SHA-256 in the URL-safe base64 alphabet without padding."""
    encoded = F.base64(F.unhex(F.sha2(column.cast("binary"), 256)))
    return F.translate(encoded, "+/=", "-_")


def url_hash(column: Column) -> Column:
    return F.md5(column)


def content_hash(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def fallback_text(series: Column, number: Column, title: Column, date: Column) -> Column:
    opening = F.when(
        title.isNotNull() & (title != ""), F.concat(F.lit('In "'), title, F.lit('", '))
    ).otherwise(F.concat(F.lit("In issue #"), number, F.lit(" of "), series, F.lit(", ")))
    closing = F.when(
        date.isNotNull() & (date != ""), F.concat(F.lit(" Published "), date, F.lit("."))
    ).otherwise("")
    # The two template sentences.
    body = (
        "the story continues with new adventures and challenges. "
        "This issue promises exciting developments in the ongoing narrative."
    )
    return F.concat(opening, F.lit(body), closing)


def default_title(title: Column, series: Column, number: Column) -> Column:
    return F.when(title == "", F.concat(series, F.lit(" #"), number)).otherwise(title)


def safe_name(column: Column) -> Column:
    return F.rtrim(F.regexp_replace(column, r"[^\p{L}\p{N} _\-]", ""))


def url_ext(column: Column, default: str = ".jpg") -> Column:
    """Extension of the last path segment, the query string left out."""
    found = F.regexp_extract(F.substring_index(column, "?", 1), r"[^/.][^/]*?(\.[^./]*)$", 1)
    return F.when(found.isin("", "."), default).otherwise(found)


def year_range(start: Column, end: Column) -> Column:
    has_start = F.coalesce(start != 0, F.lit(False))
    ranged = has_start & F.coalesce((end != 0) & (end != start), F.lit(False))
    return (
        F.when(ranged, F.concat(start.cast("string"), F.lit(" - "), end.cast("string")))
        .when(has_start, start.cast("string"))
        .otherwise("")
    )


def folder_display(column: Column) -> Column:
    return F.replace(F.regexp_replace(column, r"^\d+_", ""), F.lit("_"), F.lit(" "))


def is_image_file(column: Column) -> Column:
    return F.lower(column).rlike(IMAGE_EXTENSIONS)

"""Remote folder listings (WebDAV multistatus documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING = (
    "response ARRAY<STRUCT<href: STRING, propstat: ARRAY<STRUCT<prop: STRUCT<getetag: STRING, "
    "getcontentlength: STRING, getcontenttype: STRING, getlastmodified: STRING>>>>>"
)
# Fixed value: the RFC 1123 date format behind the weekday.
STAMP_FORMAT = "d MMM yyyy HH:mm:ss z"


def _first(props: Column, name: str) -> Column:
    """First value of a property over the status blocks of a response."""
    values = F.filter(F.transform(props, lambda p: p["prop"][name]), lambda v: v.isNotNull())
    return F.try_element_at(values, F.lit(1))


def _stamp(column: Column) -> Column:
    # Weekday names do not take part in parsing.
    text = F.regexp_replace(column, r"^\w{3},\s*", "")
    return F.try_to_timestamp(text, F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


def _responses(df: DataFrame, column: str) -> DataFrame:
    parsed = F.from_xml(column, LISTING, {"ignoreNamespace": "true"})
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.inline(parsed["response"]))
    props = F.col("propstat")
    return rows.select(
        *keep,
        "href",
        _first(props, "getetag").alias("raw_etag"),
        _first(props, "getcontentlength").alias("length"),
        _first(props, "getcontenttype").alias("content_type"),
        _first(props, "getlastmodified").alias("modified"),
    )


def parse_listing_xml(df: DataFrame, column: str, folder: str, root: str) -> DataFrame:
    """Files of each listing; the folder's own row (``folder`` column) is left out.

    ``root`` names the remote folder whose contents the paths are relative to.
    """
    rows = _responses(df, column)
    own = F.col("href").endswith("/") & F.col("href").contains(F.col(folder))
    return rows.filter(~own).select(
        *[c for c in df.columns if c != column],
        F.substring_index("href", "/", -1).alias("file_name"),
        F.regexp_replace(F.coalesce("raw_etag", F.lit("")), '"', "").alias("file_etag"),
        F.nullif("length", F.lit("")).cast("bigint").alias("file_size"),
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        _stamp(F.col("modified")).alias("file_last_modified"),
        F.regexp_replace("href", f"^.*{root}", "").alias("file_path"),
    )


def folder_info(df: DataFrame, column: str, folder: str) -> DataFrame:
    """Etag (quotes kept) and time of each listing's own folder."""
    own = _responses(df, column).filter(F.col("href") == F.col(folder))
    return own.select(
        *[c for c in df.columns if c != column],
        F.coalesce("raw_etag", F.lit("")).alias("folder_etag"),
        _stamp(F.col("modified")).alias("folder_last_modified"),
    )

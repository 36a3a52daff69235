"""Stored catalogue responses: JSON text columns to typed rows.

Objects are read as string maps, which keeps apart a field that is missing
(reads as empty text) and one that is null (reads as the text "null").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.natural import natural_key_b
from longbox.functions.text import id_from_url, make_readable
from longbox.plans.scale import order_by

OBJECTS = "results ARRAY<MAP<STRING, STRING>>"
OBJECT = "results MAP<STRING, STRING>"
PAGE_SIZE = 100


def _has(node: Column, key: str) -> Column:
    return F.map_contains_key(node, key)


def as_text(node: Column, key: str) -> Column:
    value = F.try_element_at(node, F.lit(key))
    return F.when(~F.coalesce(_has(node, key), F.lit(False)), "").otherwise(F.coalesce(value, F.lit("null")))


def as_int(node: Column, key: str) -> Column:
    value = F.trim(F.try_element_at(node, F.lit(key)))
    return F.coalesce(value.try_cast("int"), value.try_cast("double").try_cast("int"), F.lit(0))


def _inside(node: Column, key: str, path: str) -> Column:
    """Text inside a nested object; null when the object is missing."""
    found = F.get_json_object(F.try_element_at(node, F.lit(key)), f"$.{path}")
    return F.when(_has(node, key), F.coalesce(found, F.lit("")))


def _results(df: DataFrame, column: str, single: bool) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    if single:
        parsed = df.withColumn("_r", F.from_json(column, OBJECT)["results"])
        return parsed.filter(F.col("_r").isNotNull()).select(*keep, F.lit(0).alias("position"), "_r")
    parsed = df.withColumn("_r", F.from_json(column, OBJECTS)["results"])
    return parsed.select(*keep, F.posexplode("_r").alias("position", "_r"))


def _series_columns(node: Column) -> list[Column]:
    end = as_int(node, "end_year")
    return [
        as_text(node, "id").alias("id"),
        as_text(node, "name").alias("name"),
        as_text(node, "description").alias("description"),
        as_int(node, "count_of_issues").alias("issue_count"),
        _inside(node, "publisher", "name").alias("publisher"),
        as_int(node, "start_year").alias("start_year"),
        F.when(end > 0, end).alias("end_year"),
        _inside(node, "image", "medium_url").alias("image_url"),
    ]


def _keep(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_r"]


def parse_series_json(df: DataFrame, column: str) -> DataFrame:
    """Series search: volumes only, readable descriptions."""
    rows = _results(df, column, single=False)
    rows = rows.filter(as_text(F.col("_r"), "resource_type") == "volume")
    return rows.select(*_keep(rows), *_series_columns(F.col("_r"))).withColumn(
        "description", make_readable(F.col("description"))
    )


def parse_volumes_json(df: DataFrame, column: str, single: bool = False) -> DataFrame:
    """Volume list or one volume. The list form has raw text and no count."""
    rows = _results(df, column, single)
    out = rows.select(*_keep(rows), *_series_columns(F.col("_r")))
    if single:
        return out.withColumn("description", make_readable(F.col("description")))
    return out.withColumns(
        {"issue_count": F.lit(None).cast("int"), "publisher": F.coalesce("publisher", F.lit(""))}
    )


def parse_issues_json(df: DataFrame, column: str, single: bool = False) -> DataFrame:
    """Issue list or one issue, associated images as ``variants``."""
    rows = _results(df, column, single)
    node = F.col("_r")
    images = F.from_json(F.try_element_at(node, F.lit("associated_images")), "ARRAY<MAP<STRING, STRING>>")
    variants = F.transform(
        images,
        lambda v: F.struct(
            *[as_text(v, key).alias(key) for key in ("id", "original_url", "caption", "image_tags")]
        ),
    )
    return rows.select(
        *_keep(rows),
        as_text(node, "id").alias("id"),
        as_text(node, "issue_number").alias("issue_number"),
        as_text(node, "name").alias("name"),
        make_readable(as_text(node, "description")).alias("description"),
        as_text(node, "cover_date").alias("cover_date"),
        _inside(node, "image", "medium_url").alias("image_url"),
        variants.alias("variants"),
    )


def union_pages(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Issues of all (volume_id, page, body) rows in natural order.

    The first short page of a volume is its last one. A page holds at most
    ``size`` issues, so exploding one stays small.
    """
    sized = df.withColumn("_n", F.coalesce(F.size(F.from_json("body", OBJECTS)["results"]), F.lit(0)))
    last = sized.filter(F.col("_n") < size).groupBy("volume_id").agg(F.min("page").alias("_last"))
    pages = sized.join(last, "volume_id", "left").filter(
        F.col("_last").isNull() | (F.col("page") <= F.col("_last"))
    )
    issues = parse_issues_json(pages.select("volume_id", "page", "body"), "body")
    keys = natural_key_b(F.col("issue_number"), F.col("cover_date"))
    return order_by(issues, *keys, F.col("volume_id"), F.col("page"), F.col("position"))


STORY = (
    "STRUCT<type: STRING, title: STRING, feature: STRING, sequence_number: INT, page_count: STRING, "
    "script: STRING, pencils: STRING, inks: STRING, colors: STRING, letters: STRING, editing: STRING, "
    "job_number: STRING, genre: STRING, characters: STRING, synopsis: STRING, notes: STRING>"
)
DUMP_SERIES = (
    "api_url STRING, name STRING, country STRING, language STRING, active_issues ARRAY<STRING>, "
    "issue_descriptors ARRAY<STRING>, color STRING, dimensions STRING, paper_stock STRING, binding STRING, "
    "publishing_format STRING, notes STRING, year_began INT, year_ended INT, publisher STRING"
)
DUMP_ISSUE = (
    "api_url STRING, series_name STRING, descriptor STRING, publication_date STRING, price STRING, "
    "page_count STRING, editing STRING, indicia_publisher STRING, brand STRING, isbn STRING, barcode STRING, "
    "rating STRING, on_sale_date STRING, indicia_frequency STRING, notes STRING, variant_of STRING, "
    f"series STRING, story_set ARRAY<{STORY}>, cover STRING, cover_set ARRAY<STRING>, active_covers ARRAY<STRING>"
)


def parse_gcd_api(df: DataFrame, column: str, kind: str = "series") -> DataFrame:
    """Dump-site API documents; series also get ``issue_ids`` and their count."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_json(column, DUMP_SERIES if kind == "series" else DUMP_ISSUE).alias("_d"))
    out = parsed.select(*keep, "_d.*")
    if kind != "series":
        return out
    return out.withColumns(
        {
            "issue_ids": F.transform("active_issues", id_from_url),
            "issue_count": F.coalesce(F.size("active_issues"), F.lit(0)),
        }
    )

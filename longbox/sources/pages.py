"""Links and images in stored web pages, by pattern on the JVM side.

A page is one row; following a link is a join on the page url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import absolute_url, is_blank, issue_number_match, strip_edges

IMG = r"(?is)<img\b[^>]*>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<td\b[^>]*>(.*?)</td>"
LISTING = r"(?is)<table\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?listing(?:\s[^\"']*)?[\"'][^>]*>(.*?)</table>"
COVER_BOX = r"(?is)<(\w+)\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?cover(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>"
# Image selectors, most specific first. "tag" patterns are tried
# on each image tag, "inside" patterns give the text to look for images in.
SELECTORS = [
    ("tag", r"(?i)\bsrc\s*=\s*[\"'][^\"']*/covers_by_id/"),
    ("tag", r"(?i)\bclass\s*=\s*[\"'](?:[^\"']*\s)?cover_img(?:\s[^\"']*)?[\"']"),
    ("tag", r"(?i)\bsrc\s*=\s*[\"'][^\"']*covers"),
    ("inside", COVER_BOX),
    ("tag", r"(?i)\balt\s*=\s*[\"'][^\"']*cover"),
]


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute, with entities for & decoded."""
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def links(html: Column, part: str) -> Column:
    """``href`` values that contain ``part``, in page order."""
    pattern = rf"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*{part}[^\"']*[\"'][^>]*>"
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda a: attribute(a, "href"))


def _full(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def cell_text(cell: Column) -> Column:
    return strip_edges(F.regexp_replace(F.regexp_replace(cell, r"<[^>]*>", ""), r"\s+", " "))


def extract_cover_links(
    searches: DataFrame, pages: DataFrame, base: str, series_part: str = "/series/", cover_part: str = "/covers/"
) -> DataFrame:
    """(search_id, position, image_url) for search pages with an issue number.

    search page → first series link → listing rows of a matching number →
    cover pages → first cover image. ``searches``: search_id, issue_number,
    html; ``pages``: url, html.
    """
    first = F.try_element_at(links(F.col("html"), series_part), F.lit(1))
    found = searches.select("search_id", "issue_number", _full(first, base).alias("url")).filter(
        F.col("url").isNotNull()
    )
    tables = F.regexp_extract_all("html", F.lit(LISTING), F.lit(1))
    rows = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(ROW), F.lit(1))))
    listed = found.join(pages, "url").select("search_id", "issue_number", F.posexplode(rows).alias("row_at", "row"))
    cells = F.regexp_extract_all("row", F.lit(CELL), F.lit(1))
    number = cell_text(F.try_element_at(cells, F.lit(1)))
    wanted = listed.filter((F.size(cells) >= 2) & issue_number_match(number, F.col("issue_number")))
    covers = wanted.select(
        "search_id", "row_at", F.posexplode(links(F.col("row"), cover_part)).alias("link_at", "link")
    ).select("search_id", "row_at", "link_at", _full(F.col("link"), base).alias("url"))
    images = F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(IMG), F.lit(0)), lambda i: attribute(i, "src")),
        lambda src: src.contains(cover_part),
    )
    image = F.try_element_at(images, F.lit(1))
    return (
        covers.join(pages.select("url", image.alias("src")), "url")
        .filter(~is_blank(F.col("src")))
        .select("search_id", "row_at", "link_at", _full(F.col("src"), base).alias("image_url"))
    )


def page_title(html: Column) -> Column:
    """Title behind ``:: ``, else the whole title."""
    title = cell_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    tail = F.regexp_extract(title, r".*:: (.+)$", 1)
    return F.when(tail != "", tail).otherwise(title)


def extract_images(pages: DataFrame, base: str, selectors: list[tuple[str, str]] = SELECTORS) -> DataFrame:
    """Pages with ``name`` and distinct ``urls`` in first-seen order."""
    html = F.col("html")

    def sources(tags: Column) -> Column:
        return F.transform(tags, lambda tag: attribute(tag, "src"))

    def tags(kind: str, pattern: str) -> Column:
        if kind == "tag":
            return F.filter(F.regexp_extract_all(html, F.lit(IMG), F.lit(0)), lambda i: i.rlike(pattern))
        boxes = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
        return F.flatten(F.transform(boxes, lambda b: F.regexp_extract_all(b, F.lit(IMG), F.lit(0))))

    found = [sources(tags(*selector)) for selector in selectors]
    used = F.filter(F.concat(*found), lambda src: ~is_blank(src))
    urls = F.array_distinct(F.transform(used, lambda src: absolute_url(src, base)))
    return pages.withColumns({"name": page_title(html), "urls": urls})


def extract_result_links(pages: DataFrame, marker: str = "result-images-source", k: int = 5) -> DataFrame:
    """Pages with the first ``k`` result links, blank ones then left out."""
    pattern = rf"(?is)<a\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?{marker}(?:\s[^\"']*)?[\"'][^>]*>"
    tags = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    hrefs = F.transform(F.slice(tags, 1, k), lambda a: attribute(a, "href"))
    return pages.withColumn("urls", F.filter(hrefs, lambda u: ~is_blank(u)))

"""Reconciliation joins.

Key sets are made distinct before they meet the other side, so no join emits
more rows than its larger input; lists per key stay flat rows. Physical joins
are left to Spark: it broadcasts below a size threshold, splits skewed sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.natural import natural_key_a
from longbox.functions.text import is_blank
from longbox.functions.times import derive_end_year, end_year_candidate, moment, parse_date
from longbox.plans.scale import first_per_group, order_by, shuffled


def series_with_issues(series: DataFrame, issues: DataFrame) -> DataFrame:
    """Every series with its issues, or one row without, in natural order.

    Flat rows sorted by (series, number) instead of one nested list per
    series: the sort cuts a huge series over many partitions.
    """
    held = issues.select(
        "series_id", F.col("id").alias("issue_id"), "issue_number", *[c for c in ("title",) if c in issues.columns]
    )
    joined = series.join(held, F.col("id") == F.col("series_id"), "left").drop("series_id")
    return order_by(joined, F.col("id"), *natural_key_a(F.col("issue_number")), F.col("issue_id"))


def with_series(issues: DataFrame, series: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Many-to-one enrichment with ``series_<column>``; absent names are Unknown."""
    side = series.select(F.col("id").alias("series_id"), *[F.col(c).alias(f"series_{c}") for c in columns])
    joined = issues.join(side, "series_id", "left")
    if "name" in columns:
        joined = joined.withColumn("series_name", F.coalesce("series_name", F.lit("Unknown")))
    return joined


def match_gcd_series(catalogue: DataFrame, gcd: DataFrame, like: bool = False) -> DataFrame:
    """Catalogue series → dump series of equal name, year and issue count.

    The dump side is cut to one row per key first (lowest id, with the number
    of candidates), so equal keys on both sides cannot multiply. With ``like``
    the names are patterns: those with wildcards join on (year, count) instead.
    """
    candidates = gcd.groupBy(
        F.lower("name").alias("_name"), F.col("year_began").alias("_year"), F.col("issue_count").alias("_count")
    ).agg(F.min("id").alias("gcd_id"), F.count("*").alias("candidates"))
    wanted = [
        F.lower("name") == F.col("_name"),
        F.col("start_year") == F.col("_year"),
        F.col("issues_available_count") == F.col("_count"),
    ]
    joined = catalogue.join(candidates, reduce(lambda a, b: a & b, wanted), "left")
    columns = [*[catalogue[c] for c in catalogue.columns], "gcd_id", "candidates"]
    if not like:
        return joined.select(*columns)
    wild = F.coalesce(F.col("name").rlike("[%_]"), F.lit(False))
    exact = joined.filter(~wild).select(*catalogue.columns, "gcd_id", "candidates")
    patterns = catalogue.filter(wild)
    # One row per distinct pattern key meets the dump, then fans back out.
    keys = patterns.select("name", "start_year", "issues_available_count").distinct()
    found = (
        keys.join(
            candidates,
            (F.col("start_year") == F.col("_year"))
            & (F.col("issues_available_count") == F.col("_count"))
            & F.expr("_name ILIKE name"),
        )
        .groupBy("name", "start_year", "issues_available_count")
        .agg(F.min("gcd_id").alias("gcd_id"), F.sum("candidates").alias("candidates"))
    )
    return exact.unionByName(
        patterns.join(found, ["name", "start_year", "issues_available_count"], "left").select(
            *catalogue.columns, "gcd_id", "candidates"
        )
    )


def map_gcd_issues(issues: DataFrame, links: DataFrame, gcd_issues: DataFrame) -> DataFrame:
    """Dump issue ids per (series, number) that the collection holds.

    ``links`` maps series_id to gcd_series_id. Issues sharing a number share
    one list, so the list is kept once per (series, number) as flat rows.
    """
    wanted = issues.select("series_id", "issue_number").distinct().join(links, "series_id")
    dump = gcd_issues.select(
        F.col("series_id").alias("gcd_series_id"), F.col("number").alias("issue_number"), F.col("id").alias("gcd_issue_id")
    )
    return dump.join(wanted, ["gcd_series_id", "issue_number"]).select(
        "series_id", "issue_number", "gcd_issue_id"
    )


def _owned_ids(owned: DataFrame) -> DataFrame:
    ids = owned.filter(F.col("comic_vine_id").isNotNull())
    return ids.select("series_id", F.col("comic_vine_id").alias("id")).distinct()


def missing(catalogue: DataFrame, owned: DataFrame) -> DataFrame:
    return catalogue.join(_owned_ids(owned), ["series_id", "id"], "left_anti")


def added(catalogue: DataFrame, owned: DataFrame) -> DataFrame:
    return catalogue.join(_owned_ids(owned), ["series_id", "id"], "left_semi")


def reconcile_missing(
    catalogue: DataFrame, owned: DataFrame, known: DataFrame, series: DataFrame, as_of: str
) -> DataFrame:
    """New state of the missing-issue table, with the ``action`` per row.

    Still missing: reopened and stamped, or inserted. Now owned: resolved.
    Rows the catalogue does not mention are kept.
    """
    keys = ["series_id", "comic_vine_id"]
    titles = series.select(F.col("id").alias("series_id"), F.col("name").alias("_series"))
    held = _owned_ids(owned).withColumn("_owned", F.lit(True))
    listed = (
        first_per_group(catalogue, ["series_id", "id"], [F.col("issue_number")])
        .join(held, ["series_id", "id"], "left")
        .join(titles, "series_id", "left")
    )
    title = F.when(F.col("name") != "", F.col("name")).otherwise(
        F.concat("_series", F.lit(" #"), "issue_number")
    )
    date = F.when(is_blank(F.col("cover_date")) | (F.lower("cover_date") == "null"), None).otherwise(
        F.col("cover_date")
    )
    listed = listed.select(
        "series_id",
        F.col("id").alias("comic_vine_id"),
        F.col("issue_number").alias("_number"),
        title.alias("_title"),
        parse_date(date).alias("_date"),
        F.col("image_url").alias("_image"),
        F.coalesce("_owned", F.lit(False)).alias("_owned"),
        F.lit(True).alias("_listed"),
    )
    both = known.withColumn("_known", F.lit(True)).join(listed, keys, "full")
    fresh, is_known = F.col("_known").isNull(), F.col("_known").isNotNull()
    lacking = F.col("_listed").isNotNull() & ~F.col("_owned")
    resolved_now = is_known & F.coalesce(F.col("_owned"), F.lit(False)) & ~F.col("is_resolved")
    action = (
        F.when(fresh & lacking, "inserted")
        .when(is_known & lacking, "updated")
        .when(resolved_now, "resolved")
        .when(is_known, "kept")
    )

    def or_new(old: str, new: str) -> Column:
        return F.when(fresh, F.col(new)).otherwise(F.col(old)).alias(old)

    checked = F.when(lacking, moment(as_of))
    if "last_checked" in known.columns:
        checked = F.coalesce(checked, F.col("last_checked"))
    return both.withColumn("action", action).filter(F.col("action").isNotNull()).select(
        *keys,
        or_new("issue_number", "_number"),
        or_new("expected_issue_name", "_title"),
        or_new("expected_cover_date", "_date"),
        or_new("image_url", "_image"),
        F.when(lacking, False).when(resolved_now, True).otherwise(F.col("is_resolved")).alias("is_resolved"),
        F.coalesce("dismissed", F.lit(False)).alias("dismissed"),
        checked.alias("last_checked"),
        "action",
    )


def candidate_covers(catalogue: DataFrame, owned: DataFrame) -> DataFrame:
    """One main row and one row per variant of every issue not owned."""
    main = F.array(
        F.struct(
            F.col("id").alias("comic_vine_id"), F.array("image_url").alias("urls"),
            F.lit(None).cast("string").alias("parent_comic_vine_id"),
        )
    )
    variants = F.transform(
        "variants",
        lambda v: F.struct(
            v["id"].alias("comic_vine_id"), F.array(v["original_url"]).alias("urls"),
            F.col("id").alias("parent_comic_vine_id"),
        ),
    )
    return missing(catalogue, owned).select(
        "series_id", "name", "issue_number", F.inline(F.concat(main, F.coalesce(variants, F.array())))
    )


def unowned_or(catalogue: DataFrame, owned: DataFrame) -> DataFrame:
    """Not owned by id, nor by number among owned rows without an id."""
    nameless = owned.filter(F.coalesce(F.col("comic_vine_id") == "", F.lit(True)))
    numbers = nameless.select("series_id", "issue_number").distinct()
    return missing(catalogue, owned).join(numbers, ["series_id", "issue_number"], "left_anti")


def flag_owned(releases: DataFrame, owned: DataFrame) -> DataFrame:
    ids = owned.select("comic_vine_id").filter(~is_blank(F.col("comic_vine_id"))).distinct()
    flagged = releases.join(ids.withColumn("_owned", F.lit(True)), "comic_vine_id", "left")
    return flagged.withColumn("owned", F.coalesce("_owned", F.lit(False))).drop("_owned")


def cover_map(covers: DataFrame, position: str = "position") -> DataFrame:
    """url → cover; the last cover naming a url wins."""
    exploded = covers.select(
        F.col(position).alias("_at"), "comic_vine_id", "parent_comic_vine_id", "issue_number",
        F.col("name").alias("comic_name"), "error", F.posexplode("urls").alias("_url_at", "url"),
    ).filter(~is_blank(F.col("url")))
    last = F.max(
        F.struct("_at", "_url_at", "comic_name", "issue_number", "comic_vine_id", "error", "parent_comic_vine_id")
    )
    return exploded.groupBy("url").agg(last.alias("_c")).select("url", "_c.*").drop("_at", "_url_at")


def enrich(results: DataFrame, covers: DataFrame) -> DataFrame:
    """Match results with their cover's fields, Unknown where there is none."""
    return results.join(shuffled(cover_map(covers)), "url", "left").withColumns(
        {
            "comic_name": F.coalesce("comic_name", F.lit("Unknown")),
            "issue_number": F.coalesce("issue_number", F.lit("Unknown")),
            "cover_error": F.coalesce("error", F.lit("")),
        }
    ).drop("error")


def is_variant(image: Column, main: Column, variant_urls: Column) -> Column:
    """The image differs from the main one and is one of the variant urls."""
    found = (image != main) & F.array_contains(variant_urls, image)
    return F.coalesce(found, F.lit(False))


def reverify_issues(issues: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Issues with catalogue facts merged in, and the ``outcome`` per row."""
    facts = first_per_group(catalogue, ["id"], [F.col("series_id"), F.col("issue_number")]).select(
        F.col("id").alias("comic_vine_id"),
        parse_date(F.col("cover_date")).alias("_date"),
        F.col("image_url").alias("_image"),
        F.col("name").alias("_name"),
        F.col("description").alias("_text"),
        F.coalesce("variants", F.array()).alias("_variants"),
        F.lit(True).alias("_found"),
    )
    joined = issues.join(shuffled(facts), "comic_vine_id", "left")
    found = F.col("_found").isNotNull()

    def empty(column: str) -> Column:
        return F.col(column).isNull() | (F.col(column) == "")

    new_date = found & F.col("_date").isNotNull() & ~F.col("cover_date").eqNullSafe(F.col("_date"))
    new_image = found & empty("image_url") & F.col("_image").isNotNull()
    new_title = found & empty("title") & F.col("_name").isNotNull()
    new_text = found & (empty("description") | F.col("generated_description")) & ~empty("_text")
    listed = found & (F.size("_variants") > 0)
    held = F.size(F.coalesce("variant_covers", F.array())) if "variant_covers" in issues.columns else F.lit(0)
    new_variants = listed & (held != F.size("_variants"))
    image = F.when(new_image, F.col("_image")).otherwise(F.col("image_url"))
    urls = F.transform("_variants", lambda v: v["original_url"])
    new_flag = listed & ~F.coalesce("is_variants", F.lit(False)) & is_variant(image, F.col("_image"), urls)
    changed = new_date | new_image | new_title | new_text | new_variants | new_flag

    def merged(rule: Column, new, old: str) -> Column:
        return F.when(rule, new).otherwise(F.col(old))

    covers = F.col("variant_covers") if "variant_covers" in issues.columns else F.lit(None)
    return joined.withColumns(
        {
            "outcome": F.when(F.coalesce(changed, F.lit(False)), "updated").otherwise("skipped"),
            "cover_date": merged(new_date, F.col("_date"), "cover_date"),
            "image_url": image,
            "title": merged(new_title, F.col("_name"), "title"),
            "description": merged(new_text, F.col("_text"), "description"),
            "generated_description": merged(new_text, F.lit(False), "generated_description"),
            "variant_covers": F.when(new_variants, F.col("_variants")).otherwise(covers),
            "is_variants": merged(new_flag, F.lit(True), "is_variants"),
        }
    ).drop("_date", "_image", "_name", "_text", "_variants", "_found")


def outcome_counts(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def reverify_series(
    series: DataFrame, catalogue: DataFrame, gcd: DataFrame, catalogue_issues: DataFrame, as_of: str
) -> DataFrame:
    """Series with counts, years and dump ids taken afresh from the catalogue.

    ``series`` carries ``comic_vine_ids``; ``catalogue`` is keyed by its
    string id. The id lists are the series' own, so re-collecting the matched
    dump ids is bounded by what each row already held.
    """
    links = series.select(F.col("id").alias("_id"), F.posexplode("comic_vine_ids").alias("_at", "_link"))
    rows = match_gcd_series(
        catalogue.select(F.col("id").alias("_link"), "name", "start_year", "end_year", "issues_available_count"), gcd
    )
    linked = shuffled(links).join(shuffled(rows), "_link")
    facts = linked.groupBy("_id").agg(
        F.coalesce(F.sum("issues_available_count"), F.lit(0)).alias("_count"),
        F.min(F.when(F.col("start_year") > 0, F.col("start_year"))).alias("_start"),
        F.max(F.when(F.col("end_year") > 0, F.col("end_year"))).alias("_end"),
        F.array_sort(
            F.collect_list(F.when(F.col("gcd_id").isNotNull(), F.struct("_at", F.col("gcd_id").cast("string").alias("g"))))
        ).alias("_gcd"),
    )
    years = catalogue_issues.groupBy(F.col("series_id").alias("_id")).agg(
        F.max(end_year_candidate(F.col("cover_date"))).alias("_latest")
    )
    derived = F.when(F.size("comic_vine_ids") > 0, derive_end_year(F.col("_latest"), as_of))
    joined = series.join(shuffled(facts), F.col("id") == F.col("_id"), "left").drop("_id")
    joined = joined.join(shuffled(years), F.col("id") == F.col("_id"), "left").drop("_id")
    return joined.withColumns(
        {
            "issues_available_count": F.coalesce("_count", F.lit(0)),
            "start_year": F.coalesce("_start", "start_year"),
            "end_year": F.coalesce("_end", derived, "end_year"),
            "gcd_ids": F.coalesce(F.transform("_gcd", lambda g: g["g"]), F.array().cast("array<string>")),
            "last_reverification": moment(as_of),
        }
    ).drop("_count", "_start", "_end", "_gcd", "_latest")


def new_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files with ``decision`` new, retry or skip.

    Completed and running files are skipped; any other ledger row is dropped
    and its file tried again.
    """
    known = ledger.groupBy("series_id", "file_path").agg(
        F.max(F.col("state").isin("COMPLETED", "PROCESSING")).alias("_done")
    )
    decision = F.when(F.col("_done").isNull(), "new").when(F.col("_done"), "skip").otherwise("retry")
    return listing.join(known, ["series_id", "file_path"], "left").withColumn("decision", decision).drop("_done")


NO_CANDIDATES = "Image was processed while there were no available candidates"


def record_no_candidates(new: DataFrame, series: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger after marking new files of fully owned series as completed."""
    full = series.filter(F.col("issues_owned_count") >= F.col("issues_available_count")).select(
        F.col("id").alias("series_id")
    )
    keys = ["series_id", "file_path"]
    marked = new.filter(F.col("decision") != "skip").join(full, "series_id", "left_semi")
    columns = [c for c in ledger.columns if c in new.columns]
    done = marked.select(*columns).withColumn("state", F.lit("COMPLETED")).withColumn(
        "error_message", F.lit(NO_CANDIDATES)
    )
    before = ledger if "error_message" in ledger.columns else ledger.withColumn(
        "error_message", F.lit(None).cast("string")
    )
    kept = before.join(marked.select(*keys), keys, "left_anti")
    return kept.unionByName(done, allowMissingColumns=True)


def pick(catalogue: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested (pos, id) rows that the catalogue knows, in request order."""
    known = first_per_group(catalogue, ["id"], [F.col("series_id"), F.col("issue_number")])
    return shuffled(requested).join(shuffled(known), "id").orderBy("pos")


def dedupe_upload(requests: DataFrame, issues: DataFrame, hashes: DataFrame) -> DataFrame:
    """Requests with ``reuse_id``: an issue of the same upload and same bytes.

    A request without url meets issues without url, with nothing to compare.
    ``hashes`` gives the stored content hash per url of two or more segments.
    """
    held = issues.groupBy("uploaded_image_url").agg(F.min("id").alias("_held"))
    stored = hashes.groupBy("uploaded_image_url").agg(F.max("content_hash").alias("_stored"))
    url = F.col("uploaded_image_url")
    joined = (
        requests.alias("r")
        .join(held.alias("h"), F.col("r.uploaded_image_url").eqNullSafe(F.col("h.uploaded_image_url")), "left")
        .drop(F.col("h.uploaded_image_url"))
        .join(stored.alias("s"), F.col("r.uploaded_image_url") == F.col("s.uploaded_image_url"), "left")
        .drop(F.col("s.uploaded_image_url"))
    )
    same = (F.size(F.split(url, "/")) >= 2) & F.col("content_hash").eqNullSafe(F.col("_stored"))
    reuse = F.when(url.isNull() | same, F.col("_held"))
    return joined.withColumn("reuse_id", reuse).drop("_held", "_stored")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of the given series ids."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return {
        name: df.join(gone, F.col(keys.get(name, "series_id")) == F.col("_gone"), "left_anti")
        for name, df in tables.items()
    }


def missing_with_series(missing_rows: DataFrame, series: DataFrame) -> DataFrame:
    side = series.select(
        F.col("id").alias("series_id"), F.col("name").alias("series_name"), "publisher", "start_year"
    )
    return missing_rows.join(side, "series_id", "left")


def variants_by_issue(catalogue: DataFrame, links: DataFrame) -> DataFrame:
    """Issues with their found urls; issues without any url are left out."""
    filled = links.filter(F.size("urls") > 0)
    return catalogue.select("series_id", "issue_number").join(shuffled(filled), ["series_id", "issue_number"])


def unlinked(results: DataFrame, linked: DataFrame) -> DataFrame:
    """Search results not linked yet, newest start year first, none last."""
    year = F.nullif(F.col("start_year"), F.lit(0))
    return results.join(linked.select("id").distinct(), "id", "left_anti").orderBy(
        year.desc_nulls_last(), "id"
    )

"""Review of matches: grouping, confidence bands, rules, statistics, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.times import parse_date
from longbox.operators.joins import is_variant
from longbox.plans.scale import first_per_group

HIGH, MEDIUM = 0.7, 0.55
IMAGE = ["session_id", "source_image_index"]


def group_matches(matches: DataFrame) -> DataFrame:
    """Matches by image (no index is image 0) in order, best first.

    Rows stay flat; the sort spreads an image with very many matches.
    """
    indexed = matches.withColumn("source_image_index", F.coalesce("source_image_index", F.lit(0)))
    return indexed.orderBy(*IMAGE, F.desc("similarity"), "url")


def image_groups(matches: DataFrame) -> DataFrame:
    """One row per image: its name (of the best match) and match count."""
    indexed = matches.withColumn("source_image_index", F.coalesce("source_image_index", F.lit(0)))
    best = F.max(F.struct("similarity", "url", "source_image_name"))["source_image_name"]
    default = F.concat(F.lit("Image "), (F.col("source_image_index") + 1).cast("string"))
    return indexed.groupBy(*IMAGE).agg(best.alias("name"), F.count("*").alias("match_count")).withColumn(
        "name", F.coalesce("name", default)
    )


def match_identifier(prefix: str = "") -> Column:
    def text(name: str) -> Column:
        return F.coalesce(F.col(prefix + name).cast("string"), F.lit("unknown" if name == "comic_vine_id" else "null"))

    return F.concat_ws("-", *[text(n) for n in ("comic_vine_id", "comic_name", "issue_number", "url")])


MATCH_FIELDS = ["similarity", "url", "comic_name", "issue_number", "comic_vine_id", "parent_comic_vine_id"]


def classify(matches: DataFrame, images: DataFrame, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """Per image: best match, confidence band, status and variant flag.

    ``images``: session_id, source_image_index, image_name. Images without
    any match have status no_match.
    """
    indexed = matches.withColumn("source_image_index", F.coalesce("source_image_index", F.lit(0)))
    best = first_per_group(indexed, IMAGE, [F.desc("similarity"), F.col("url")]).select(
        *IMAGE, F.struct(*MATCH_FIELDS).alias("best_match")
    )
    joined = images.join(best, IMAGE, "left")
    similarity = F.col("best_match.similarity")
    return joined.withColumns(
        {
            "status": F.when(F.col("best_match").isNull(), "no_match").otherwise("pending"),
            "confidence": F.when(similarity >= high, "high").when(similarity >= medium, "medium").otherwise("low"),
            "selected_match": F.col("best_match"),
            "is_variant": F.col("best_match.parent_comic_vine_id").isNotNull(),
        }
    )


def apply_rules(results: DataFrame, rule: str) -> DataFrame:
    """``accept_all`` pending rows with a match, or ``reject_low`` pending ones."""
    pending = F.col("status") == "pending"
    if rule == "accept_all":
        hit = pending & F.col("best_match").isNotNull()
        status, match = "auto_accepted", F.col("best_match")
    elif rule == "reject_low":
        hit = pending & (F.col("confidence") == "low")
        status, match = "rejected", F.lit(None)
    else:
        raise ValueError(f"unknown rule {rule}")
    return results.withColumns(
        {
            "status": F.when(hit, status).otherwise(F.col("status")),
            "selected_match": F.when(hit, match).otherwise(F.col("selected_match")),
        }
    )


def review_stats(results: DataFrame) -> DataFrame:
    """One row per session: status counts, band shares and acceptance rate."""
    n = F.count("*")

    def status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    def band(name: str) -> Column:
        return F.count_if(F.col("confidence") == name) / n * 100

    auto, manual = status("auto_accepted"), status("manually_accepted")
    return results.groupBy("session_id").agg(
        n.alias("total_images"),
        auto.alias("auto_accepted"),
        manual.alias("manually_accepted"),
        status("pending").alias("pending"),
        status("no_match").alias("no_match"),
        status("rejected").alias("rejected"),
        (auto + manual).alias("total_accepted"),
        F.coalesce(F.avg("best_match.similarity"), F.lit(0.0)).alias("average_confidence"),
        band("high").alias("high_percentage"),
        band("medium").alias("medium_percentage"),
        band("low").alias("low_percentage"),
        (auto / n * 100).alias("auto_acceptance_rate"),
    )


def export_sel(results: DataFrame) -> DataFrame:
    """One JSON text per image: index, name, status, identifier, confidence."""
    chosen = F.when(F.col("selected_match").isNotNull(), match_identifier("selected_match."))
    row = F.struct(
        F.col("source_image_index").alias("imageIndex"),
        F.col("image_name").alias("imageName"),
        "status",
        chosen.alias("selectedMatchIdentifier"),
        "confidence",
    )
    return results.select("session_id", F.to_json(row).alias("selection"))


SELECTION = "imageIndex INT, imageName STRING, status STRING, selectedMatchIdentifier STRING, confidence STRING"


def import_sel(results: DataFrame, selections: DataFrame, matches: DataFrame) -> DataFrame:
    """Results with imported statuses; an identifier selects that image's match
    again, or none if the image has no such match."""
    parsed = selections.select("session_id", F.from_json("selection", SELECTION).alias("s")).select(
        "session_id",
        F.col("s.imageIndex").alias("source_image_index"),
        F.col("s.status").alias("_status"),
        F.col("s.selectedMatchIdentifier").alias("_identifier"),
    )
    parsed = parsed.filter(F.col("_status").isNotNull() & (F.col("_status") != ""))
    parsed = first_per_group(parsed, IMAGE, [F.col("_status"), F.col("_identifier")])
    known = matches.withColumns(
        {"source_image_index": F.coalesce("source_image_index", F.lit(0)), "_identifier": match_identifier()}
    )
    wanted = parsed.filter(F.col("_identifier").isNotNull()).select(*IMAGE, "_identifier")
    found = known.join(wanted, [*IMAGE, "_identifier"], "left_semi")
    found = first_per_group(found, IMAGE, [F.desc("similarity"), F.col("url")]).select(
        *IMAGE, F.struct(*MATCH_FIELDS).alias("_match")
    )
    joined = results.join(parsed, IMAGE, "left").join(found, IMAGE, "left")
    return joined.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "selected_match": F.when(F.col("_identifier").isNotNull(), F.col("_match")).otherwise(F.col("selected_match")),
        }
    ).drop("_status", "_identifier", "_match")


def accepted_to_issues(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Issue rows for accepted matches, from the catalogue issue of the parent
    (or own) id; unknown issues give no row.

    A match on a variant cover puts the matched image and the variant flag on
    the issue.
    """
    match = F.col("selected_match")
    accepted = results.filter(F.col("status").isin("auto_accepted", "manually_accepted") & match.isNotNull())
    wanted = accepted.withColumn(
        "id", F.coalesce("selected_match.parent_comic_vine_id", "selected_match.comic_vine_id")
    )
    facts = first_per_group(catalogue, ["id"], [F.col("series_id")]).select(
        "id", "series_id", "issue_number", "name", "description", "cover_date", "image_url", "variants"
    )
    url = F.col("selected_match.url")
    urls = F.transform("variants", lambda v: v["original_url"])
    variant = F.col("selected_match.parent_comic_vine_id").isNotNull() | is_variant(url, F.col("image_url"), urls)
    return wanted.join(facts, "id").select(
        "session_id",
        "source_image_index",
        "series_id",
        "issue_number",
        F.col("name").alias("title"),
        "description",
        parse_date(F.col("cover_date")).alias("cover_date"),
        F.when(variant, url).otherwise(F.col("image_url")).alias("image_url"),
        F.col("id").alias("comic_vine_id"),
        # The defaults of a newly added issue.
        F.lit("VERY_FINE").alias("condition"),
        F.lit(0).cast("decimal(10,2)").alias("purchase_price"),
        F.lit(0).cast("decimal(10,2)").alias("current_value"),
        F.lit(False).alias("is_key_issue"),
        variant.alias("is_variants"),
    )

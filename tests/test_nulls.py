"""Rows with nulls that earlier fell out of results."""

from longbox.functions.progress import stage_label
from longbox.functions.text import state_label
from longbox.operators import joins
from longbox.sources import caches, tables


def test_series_without_a_name_stay_in_pattern_matching(spark):
    series = spark.createDataFrame([(1, None, 2000, 3), (2, "A%", 2000, 3)], "id BIGINT, name STRING, start_year INT, issues_available_count INT")
    dump = spark.createDataFrame([(9, "Abc", 2000, 2010, 3, 0)], "id BIGINT, name STRING, year_began INT, year_ended INT, issue_count INT, deleted INT")
    got = {r["id"]: r["gcd_id"] for r in joins.match_gcd_series(series, dump, like=True).collect()}
    assert got == {1: None, 2: 9}


def test_images_of_unknown_use_stay_cached(spark):
    images = spark.createDataFrame([("a", None), ("b", "2020-01-01 00:00:00"), ("c", "2024-01-30 00:00:00")], "url_hash STRING, at STRING")
    images = images.selectExpr("url_hash", "CAST(at AS TIMESTAMP_NTZ) AS last_accessed")
    kept, features = caches.retain_cache(images, images.select("url_hash"), "2024-02-01 00:00:00")
    assert {r[0] for r in kept.select("url_hash").collect()} == {"a", "c"} == {r[0] for r in features.collect()}


def test_declared_lengths_are_kept_whatever_they_are():
    assert tables.declared_type("varchar(77)") == ("VARCHAR(77)", "string") and tables.declared_type("blob") == ("TEXT", "string")


def test_capitals_follow_punctuation(column):
    assert column(state_label, ["near-mint", "very_good"]) == ["Near-Mint", "Very Good"]
    assert column(stage_label, ["re-run_2nd", "completed"]) == ["Re-Run 2Nd", "COMPLETED"]

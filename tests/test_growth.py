"""Sides and batches that grow with the input: no broadcast, no single task, bounded memory."""

import pytest
from pyspark.sql import functions as F

from longbox.operators import aggregates, filters, joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def catalogue(spark):
    """What an explode makes of few small rows: Spark's guess of its size stays small."""
    return spark.range(4).selectExpr("id AS s", "explode(sequence(1, 3)) AS n").selectExpr(
        "concat(s, '-', n) AS id", "s AS series_id", "CAST(n AS STRING) AS issue_number", "concat('name ', n) AS name", "'text' AS description",
        "'2000-01-01' AS cover_date", "concat('img/', s, '-', n) AS image_url",
        "array(named_struct('id', 'v', 'original_url', concat('img/v/', s, '-', n))) AS variants")


def test_enrich_never_broadcasts_the_covers(spark, catalogue):
    covers = catalogue.selectExpr(
        "series_id * 8 + CAST(issue_number AS INT) AS position", "id AS comic_vine_id", "CAST(NULL AS STRING) AS parent_comic_vine_id",
        "issue_number", "name", "CAST(NULL AS STRING) AS error", "array(image_url, concat('img/', series_id, '-dup'), '') AS urls")
    results = spark.createDataFrame([(1, "img/2-1"), (2, "img/2-dup"), (3, "nope"), (4, None)], "id INT, url STRING")
    got = joins.enrich(results, covers)
    assert "Broadcast" not in plan(got)
    found = {r["id"]: (r["comic_vine_id"], r["comic_name"]) for r in got.collect()}
    assert found == {1: ("2-1", "name 1"), 2: ("2-3", "name 3"), 3: (None, "Unknown"), 4: (None, "Unknown")}


def test_lookup_and_groups_never_broadcast(spark, catalogue):
    keys = catalogue.selectExpr("id AS comic_vine_id").filter("comic_vine_id <> '1-1'")
    got = filters.lookup(catalogue.withColumnRenamed("id", "comic_vine_id"), keys, ["comic_vine_id"])
    assert "Broadcast" not in plan(got) and got.count() == 11
    series = spark.range(4).selectExpr("id", "'same' AS name", "CAST(2000 + id % 2 AS INT) AS start_year")
    missing = catalogue.selectExpr("id", "series_id", "issue_number", "DATE'2000-01-01' AS expected_cover_date")
    grouped = aggregates.group_missing(missing, series.hint("merge"))
    assert "Broadcast" not in plan(grouped)
    assert {(r["group_key"], r["group_size"]) for r in grouped.collect()} == {("same (2000)", 6), ("same (2001)", 6)}


def test_variants_never_broadcast(spark, catalogue):
    links = catalogue.selectExpr("series_id", "issue_number", "transform(variants, v -> v.original_url) AS urls")
    got = joins.variants_by_issue(catalogue, links)
    assert "Broadcast" not in plan(got) and got.count() == 12


def test_reverified_issues_never_broadcast_the_facts(spark, catalogue):
    issues = catalogue.filter("issue_number = '1'").selectExpr(
        "id AS comic_vine_id", "DATE'1999-01-01' AS cover_date", "CAST(NULL AS STRING) AS image_url", "'' AS title", "'' AS description",
        "false AS generated_description", "false AS is_variants")
    got = joins.reverify_issues(issues, catalogue)
    assert "Broadcast" not in plan(got)
    assert {(r["outcome"], r["title"], str(r["cover_date"])) for r in got.collect()} == {("updated", "name 1", "2000-01-01")}


def test_pick_never_broadcasts(spark, catalogue):
    requested = spark.createDataFrame([(0, "3-2"), (1, "none"), (2, "0-1"), (3, "3-2")], "pos INT, id STRING")
    got = joins.pick(catalogue, requested)
    assert "Broadcast" not in plan(got)
    assert [(r["pos"], r["id"]) for r in got.collect()] == [(0, "3-2"), (2, "0-1"), (3, "3-2")]


def test_names_need_no_python_and_stay_the_same(spark, column):
    import unicodedata

    from longbox.functions import text

    every = "".join(chr(c) for c in range(1, 0x2FFFF) if not 0xD800 <= c < 0xE000)
    letters = "".join(x for x in unicodedata.normalize("NFD", every) if x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    values = [None, "", " \t", "  __ÀÉ--", "Crème Brûlée Ǻ x", "a ́ b", "é" * 150, "\x01 a  b_-_c \x00", "KK İ", "a" * 99 + " b"]
    wanted = ["unknown", "unknown", "unknown", "ae", "creme_brulee_a_x", "a_b", "e" * 100, "a_b_-_c", "kk_i", "a" * 99]
    assert column(text.normalize_name, values) == wanted
    assert column(text.slug, values) == [w.replace("_-_", "-").replace("_", "-") for w in wanted]
    whole = spark.createDataFrame([(every,)], "v STRING")
    got = whole.select(F.regexp_replace(text._unaccented(F.col("v")), "[^a-zA-Z0-9]+", "")).first()[0]
    assert got == letters
    for name in (text.normalize_name, text.slug):
        assert "Python" not in plan(whole.select(name(F.col("v")))) and "ArrowEval" not in plan(whole.select(name(F.col("v"))))

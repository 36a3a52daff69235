import datetime as dt
from decimal import Decimal

from longbox.operators import aggregates as agg
from longbox.operators import filters, ranking
from longbox.plans.report import collection_report

SERIES = "id BIGINT, name STRING, publisher STRING, start_year INT, issues_owned_count INT, issues_available_count INT"
ISSUES = (
    "id BIGINT, series_id BIGINT, issue_number STRING, title STRING, condition STRING, current_value DECIMAL(10,2), "
    "purchase_price DECIMAL(10,2), is_key_issue BOOLEAN, is_variants BOOLEAN, read BOOLEAN, created_at TIMESTAMP_NTZ")


def series(spark):
    return spark.createDataFrame([
        (1, "One", "A", 1991, 5, 10), (2, "Two", "A", 1995, 10, 10), (3, "Three", "B", 2003, 12, 10),
        (4, "Four", None, None, 3, 0), (5, "Five", "", 2003, 0, 4), (6, "Six", " ", 2011, 1, 3)], SERIES)


def issues(spark):
    day = dt.datetime
    rows = [
        (1, 1, "1", "a", "NEAR_MINT", "100.00", "40.00", True, False, True, day(2024, 1, 5)),
        (2, 1, "2", None, "VERY_FINE", "50.00", None, False, True, False, day(2024, 1, 20)),
        (3, 2, "1", "", None, "25.00", "5.00", False, False, False, day(2024, 4, 1)),
        (4, 5, "1", "c", "FAIR", "0.00", "1.01", False, False, True, None),
        (5, 3, "1", "d", "FAIR", None, "1.00", False, False, True, None),
        (6, 3, "2", "e", "FAIR", "-3.00", "1.00", False, False, True, day(2024, 4, 9)),
        (7, 2, "9", "f", "FAIR", "100.00", "1.00", False, False, True, day(2024, 4, 9))]
    return spark.createDataFrame([
        tuple(Decimal(v) if i in (5, 6) and v is not None else v for i, v in enumerate(r)) for r in rows], ISSUES)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_publisher_breakdown(spark):
    got = {r["name"]: (r["series_count"], r["issue_count"], r["percentage"]) for r in agg.publisher_breakdown(series(spark), issues(spark)).collect()}
    assert got == {"A": (2, 4, 33.3), "B": (1, 2, 16.7)}


def test_overview(spark):
    gaps = spark.createDataFrame([(True,), (False,), (False,)], "is_resolved BOOLEAN")
    row = agg.overview(series(spark), issues(spark), gaps).first().asDict()
    assert row == {"total_series": 6, "unique_publishers": 4, "missing_issues": 2, "total_issues": 7, "key_issues": 1, "variant_issues": 1,
                   "total_current_value": 272.0, "total_purchase_value": 49.01}
    empty = agg.overview(series(spark).limit(0), issues(spark).limit(0), gaps.limit(0)).first().asDict()
    assert set(empty.values()) == {0, 0.0}


def test_growth_fills_gaps_and_ends_at_as_of(spark):
    assert rows(agg.growth(issues(spark), "2024-05-15 00:00:00")) == [
        ("2024-01", 2, 2), ("2024-02", 0, 2), ("2024-03", 0, 2), ("2024-04", 3, 5), ("2024-05", 0, 5)]
    assert rows(agg.growth(issues(spark), "2023-12-31 00:00:00")) == []


def test_completion(spark):
    assert rows(agg.completion(series(spark))) == [(2, 5, 56.7)]
    assert [r["name"] for r in agg.completion_rank(series(spark)).collect()] == ["Three", "Two", "One", "Six", "Five"]
    assert [r["name"] for r in agg.completion_rank(series(spark), least=True).collect()] == ["Five", "Six", "One"]
    flags = {r["id"]: r["is_complete"] for r in agg.is_complete_ge(series(spark)).collect()}
    assert flags == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert rows(agg.completion_eq(series(spark))) == [(1, 5, 20)]


def test_values_with_tie_and_negatives(spark):
    row = agg.values(issues(spark), series(spark)).first().asDict()
    assert (row["total_current_value"], row["total_purchase_value"], row["profit_loss"]) == (275.0, 49.01, 225.99)
    assert (row["average_issue_value"], row["issues_with_value"], row["top_id"], row["top_series_name"]) == (68.75, 4, 1, "One")
    empty = agg.values(issues(spark).limit(0), series(spark)).first().asDict()
    assert (empty["average_issue_value"], empty["top_id"], empty["top_series_name"]) == (0.0, None, None)


def test_mean_value_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 1, "1", "", None, Decimal("0.01"), None, False, False, False, None), (2, 1, "1", "", None, Decimal("0.02"), None, False, False, False, None)], ISSUES)
    assert agg.values(df, series(spark)).first()["average_issue_value"] == 0.02


def test_issue_statistics_golden(spark):
    three = issues(spark).filter("id <= 3")
    got = {(r["section"], r["key"]): r["value"] for r in agg.issue_stats(three, series(spark)).collect()}
    assert got[("total", "total_issues")] == 3 and got[("total", "total_collection_value")] == 175.0
    assert got[("total", "key_issues")] == 1 and got[("total", "variant_issues")] == 1
    assert got[("condition", "NEAR_MINT")] == 1 and got[("condition", "VERY_FINE")] == 1


def test_rates_without_finished_rows(spark):
    progress = spark.createDataFrame([("PROCESSING",), (None,)], "state STRING")
    assert rows(agg.success_rate(progress)) == [(0.0, 0, 0)]
    syncs = spark.createDataFrame([("PENDING", 3, 1), ("EMPTY", None, 1)], "sync_status STRING, total_files_count INT, series_id BIGINT")
    assert rows(agg.sync_stats(syncs)) == [(2, 3, 3.0, 100.0, 1)]


def test_five_year_split(spark):
    df = spark.createDataFrame([("1990s", 5), ("2000s", 2)], "decade STRING, count BIGINT")
    assert [(r[0], r[1]) for r in agg.five_year(df).collect()] == [("1990-94", 3), ("1995-99", 2), ("2000-04", 1), ("2005-09", 1)]


def test_dashboard_counts_unknown_publishers(spark):
    row = agg.dashboard(series(spark), issues(spark)).first().asDict()
    assert (row["total_series"], row["unique_publishers"], row["favorite_publisher"]) == (6, 4, "A")


def test_barcode_outcomes(spark):
    runs = spark.createDataFrame([(True, None, False), (False, "1", False), (False, "1", True), (False, None, False), (False, "", True)], "fetch_error BOOLEAN, barcode STRING, save_error BOOLEAN")
    assert rows(agg.barcode_outcomes(runs)) == [(4, 1, 2, 2)]


def test_group_missing_orders_groups(spark):
    gaps = spark.createDataFrame([(1, 1, "10", dt.date(2024, 1, 1)), (2, 1, "2", None), (3, 2, "x", dt.date(2020, 1, 1)), (4, 9, "1", None)],
                                 "id BIGINT, series_id BIGINT, issue_number STRING, expected_cover_date DATE")
    by = lambda sort: [(r["group_key"], r["id"]) for r in agg.group_missing(gaps, series(spark), sort).collect()]
    assert by("series") == [("One (1991)", 2), ("One (1991)", 1), ("Two (1995)", 3)]
    assert by("count") == [("One (1991)", 2), ("One (1991)", 1), ("Two (1995)", 3)]
    assert by("date") == [("One (1991)", 2), ("One (1991)", 1), ("Two (1995)", 3)]
    ignored = spark.createDataFrame([(1,)], "series_id BIGINT")
    assert [r["id"] for r in agg.group_missing(gaps, series(spark), "series", ignored).collect()] == [3]
    assert [r["id"] for r in agg.group_missing(gaps, series(spark), "series", ignored, True).collect()] == [2, 1]


def test_missing_text_filters(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 1, "x"), (4, 2, None)], "id BIGINT, series_id BIGINT, description STRING")
    assert [r[0] for r in filters.missing_text(df).orderBy("id").collect()] == [1, 2, 4]
    assert [r[0] for r in filters.missing_text(df, 1).collect()] == [1]
    assert rows(filters.missing_text_counts(df, 2)) == [(2, 3, 1)]


def test_validate_splits_rows(spark):
    df = spark.createDataFrame([("a", "ok"), (" ", "ok"), (None, "much too long")], "name STRING, note STRING")
    good, bad = filters.validate(df, ["name"], {"note": 5})
    assert [r["name"] for r in good.collect()] == ["a"]
    assert sorted(len(r["errors"]) for r in bad.collect()) == [1, 2]


def test_validate_knows_the_enum_domains(spark):
    from longbox.schemas import ENUMS

    df = spark.createDataFrame([("MINT",), (None,), ("SHREDDED",)], "condition STRING")
    good, bad = filters.validate(df, [], {}, {"condition": ENUMS["condition"]})
    assert [r[0] for r in good.collect()] == ["MINT", None]
    assert [tuple(r["errors"]) for r in bad.collect()] == [("condition is not a known value",)]


def test_advanced_search_uses_start_year_twice(spark):
    assert [r["id"] for r in filters.advanced_search(series(spark), None, 1990, 1999).collect()] == [1, 2]
    assert filters.advanced_search(series(spark), " ").count() == 6


def test_first_barcode_and_head(spark):
    scans = spark.createDataFrame([(1, 2, "5"), (1, 1, "x"), (1, 3, "7"), (2, 1, None)], "series_id BIGINT, issue_order BIGINT, barcode STRING")
    assert rows(ranking.first_barcode(scans)) == [(1, "5")]
    head = ranking.head_per_series(issues(spark).select("id", "series_id"), 1)
    assert sorted((r["series_id"], r["hidden"]) for r in head.collect()) == [(1, 1), (2, 1), (3, 1), (5, 0)]


def test_report_has_all_sections(spark):
    from longbox.suite.aggregates import full_report
    from longbox.suite.registry import Tables

    sections = {r[0] for r in full_report(Tables(spark, "/root/testdata/sf0.001")).select("section").distinct().collect()}
    assert len(sections) >= 26 and collection_report


def test_report_equals_the_single_operators(spark):
    from longbox.plans.bindings import AS_OF_EVENTS
    from longbox.plans.report import _cells
    from longbox.suite.aggregates import full_report
    from longbox.suite.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    report = {}
    for r in full_report(t).collect():
        report.setdefault(r["section"], set()).add((r["key"], r["value"]))
    single = {
        "overview": _cells("x", agg.overview(t.series_owned, t.issues, t.missing_issues)),
        "publisherBreakdown": _cells("x", agg.publisher_breakdown(t.series_owned, t.issues), "name"),
        "conditionBreakdown": _cells("x", agg.conditions(t.issues), "condition"),
        "topSeriesByIssueCount": _cells("x", agg.top_series(t.issues, t.series_owned), "name"),
        "collectionGrowth": _cells("x", agg.growth(t.issues, AS_OF_EVENTS), "month"),
        "valueAnalysis": _cells("x", agg.values(t.issues, t.series_owned)),
        "readStats": _cells("x", agg.read_stats(t.issues)),
    }
    for section, df in single.items():
        assert report[section] == {(r["key"], r["value"]) for r in df.collect()}, section

"""Statistics. Counts per series are taken before any join to series, so a
series with a third of all issues costs one partial row per map task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.numbers import format_size, percent, round_half_up
from longbox.functions.text import is_blank
from longbox.functions.times import fmt_mmss, moment, month_of, seconds_between
from longbox.operators.filters import complete_eq
from longbox.plans.scale import one_row, shuffled, single, total


def _owned() -> Column:
    return F.col("issues_owned_count")


def _available() -> Column:
    return F.col("issues_available_count")


def _n(name: str = "count") -> Column:
    return F.count("*").alias(name)


def _money(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(38,2)").cast("double")


def _histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(_n()).filter(F.col(name).isNotNull())


# --- collection -------------------------------------------------------------


def issue_facts(issues: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Counts, sums and the dearest issue per key: all that the collection
    statistics need of the issues, in one pass with map-side combine."""
    value = F.col("current_value")
    dearest = F.struct(value, (-F.col("id")).alias("neg_id"), "series_id", "issue_number", "title")
    return issues.groupBy(*keys).agg(
        _n("n"),
        F.count_if("read").alias("read"),
        F.count_if("is_key_issue").alias("keys"),
        F.count_if("is_variants").alias("variants"),
        F.sum(value).alias("current"),
        F.sum("purchase_price").alias("paid"),
        F.sum(F.when(value > 0, value)).alias("positive"),
        F.count_if(value > 0).alias("valued"),
        F.max(F.when(value > 0, dearest)).alias("top"),
    )


def overview(series: DataFrame, issues: DataFrame, missing: DataFrame) -> DataFrame:
    """Eight scalars, one pass per table."""
    return overview_of(series, issue_facts(issues, []), missing)


def overview_of(series: DataFrame, facts: DataFrame, missing: DataFrame) -> DataFrame:
    def sum_of(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    owned = one_row(
        facts,
        sum_of("n", "total_issues"),
        sum_of("keys", "key_issues"),
        sum_of("variants", "variant_issues"),
        _money("current").alias("total_current_value"),
        _money("paid").alias("total_purchase_value"),
    )
    gaps = total(missing, F.count_if(~F.col("is_resolved")))
    return (
        series.agg(_n("total_series"), F.count_distinct("publisher").alias("unique_publishers"))
        .withColumn("missing_issues", gaps)
        .withColumn("_i", owned)
        .select("*", "_i.*")
        .drop("_i")
    )


def issues_per_series(issues: DataFrame) -> DataFrame:
    return issues.groupBy("series_id").agg(_n("issue_count"))


def publisher_breakdown(series: DataFrame, issues: DataFrame) -> DataFrame:
    """Series and issue counts per publisher; the share is of all series."""
    return publisher_breakdown_of(series, issues_per_series(issues))


def publisher_breakdown_of(series: DataFrame, counts: DataFrame) -> DataFrame:
    per_series = series.select("id", "publisher").join(counts, F.col("id") == F.col("series_id"), "left")
    named = per_series.groupBy("publisher").agg(
        _n("series_count"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_count")
    )
    return (
        named.filter(~is_blank(F.col("publisher")))
        .withColumn("percentage", percent(F.col("series_count"), total(series, F.count("*"))))
        .withColumnRenamed("publisher", "name")
        .orderBy(F.desc("series_count"), "name")
    )


def decade_of(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def decades(series: DataFrame) -> DataFrame:
    return _histogram(series, decade_of(F.col("start_year")), "decade").orderBy("decade")


def conditions(issues: DataFrame) -> DataFrame:
    return _histogram(issues, F.col("condition"), "condition")


def issues_per_name(issues: DataFrame, series: DataFrame) -> DataFrame:
    """Issue counts by series *name*; series of one name share a row."""
    return counts_per_name(issues_per_series(issues), series)


def counts_per_name(counts: DataFrame, series: DataFrame) -> DataFrame:
    names = series.select(F.col("id").alias("series_id"), "name")
    return counts.join(names, "series_id").groupBy("name").agg(
        F.sum("issue_count").alias("count")
    )


def top_series(issues: DataFrame, series: DataFrame, n: int = 10) -> DataFrame:
    return top_names(issues_per_name(issues, series), n)


def top_names(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("count"), "name").limit(n)


def growth(issues: DataFrame, as_of: str) -> DataFrame:
    """Issues added per month, gaps filled up to ``as_of``, with a running sum.

    The window runs over months, of which a calendar has few.
    """
    dated = issues.filter(F.col("created_at").isNotNull())
    return growth_of(dated.groupBy(first_day()).agg(_n("added")), as_of)


def first_day() -> Column:
    return F.trunc("created_at", "MM").alias("first_day")


def growth_of(added: DataFrame, as_of: str) -> DataFrame:
    end = F.trunc(F.lit(as_of[:10]).cast("date"), "MM")
    span = added.agg(F.min("first_day").alias("start")).filter(F.col("start") <= end)
    months = span.select(F.explode(F.sequence("start", end, F.expr("INTERVAL 1 MONTH"))).alias("first_day"))
    so_far = Window.orderBy("first_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        months.join(added, "first_day", "left")
        .withColumn("added", F.coalesce("added", F.lit(0)))
        .select(
            F.date_format("first_day", "yyyy-MM").alias("month"),
            "added",
            F.sum("added").over(so_far).alias("cumulative"),
        )
        .orderBy("month")
    )


def _share() -> Column:
    return _owned() * 100.0 / _available()


def completion(series: DataFrame) -> DataFrame:
    tracked = series.filter(_available() > 0)
    return tracked.agg(
        F.count_if(_owned() >= _available()).alias("completed_series"),
        _n("total_tracked_series"),
        F.coalesce(round_half_up(F.avg(F.least(_share(), F.lit(100.0))), 1), F.lit(0.0)).alias(
            "average_completion"
        ),
    )


def completion_rank(series: DataFrame, least: bool = False, n: int = 10) -> DataFrame:
    tracked = series.filter(_available() > 0)
    if least:
        tracked = tracked.filter(_owned() < _available())
    share = _share() if least else -_share()
    return tracked.orderBy(share, "id").limit(n).select(
        "id",
        "name",
        _owned().cast("bigint").alias("owned"),
        _available().cast("bigint").alias("available"),
        round_half_up(_share(), 1).alias("percentage"),
    )


def is_complete_ge(series: DataFrame) -> DataFrame:
    return series.withColumn("is_complete", (_available() > 0) & (_owned() >= _available()))


def values(issues: DataFrame, series: DataFrame) -> DataFrame:
    """Value totals and the single dearest issue (lowest id on a tie)."""
    return values_of(issue_facts(issues, []), series)


def values_of(facts: DataFrame, series: DataFrame) -> DataFrame:
    summed = facts.agg(
        F.coalesce(F.sum("positive"), F.lit(0)).cast("decimal(38,2)").alias("current"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(38,2)").alias("paid"),
        F.coalesce(F.sum("valued"), F.lit(0)).alias("issues_with_value"),
        F.max("top").alias("top"),
    )
    names = series.select(F.col("id").alias("top_series_id"), F.col("name").alias("top_series_name"))
    # Scale 2, HALF_UP, on exact cents: floor((2 * cents + n) / (2 * n)).
    cents = (F.col("current") * 100).cast("decimal(38,0)")
    n = F.col("issues_with_value").cast("decimal(38,0)")
    mean = F.when(n > 0, F.floor((cents * 2 + n) / (n * 2)).cast("double") / 100).otherwise(F.lit(0.0))
    return summed.join(names, F.col("top.series_id") == F.col("top_series_id"), "left").select(
        F.col("current").cast("double").alias("total_current_value"),
        F.col("paid").cast("double").alias("total_purchase_value"),
        (F.col("current") - F.col("paid")).cast("double").alias("profit_loss"),
        mean.alias("average_issue_value"),
        "issues_with_value",
        (-F.col("top.neg_id")).alias("top_id"),
        F.col("top.issue_number").alias("top_issue_number"),
        F.col("top.title").alias("top_title"),
        F.when(F.col("top").isNotNull(), F.coalesce("top_series_name", F.lit("Unknown"))).alias("top_series_name"),
        F.col("top.current_value").cast("double").alias("top_value"),
    )


def read_stats(issues: DataFrame) -> DataFrame:
    return read_stats_of(issues.agg(_n("n"), F.count_if("read").alias("read")))


def read_stats_of(facts: DataFrame) -> DataFrame:
    counted = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("read"), F.lit(0)).alias("read"))
    return counted.select(
        "read", (F.col("n") - F.col("read")).alias("unread"),
        percent(F.col("read"), F.col("n")).alias("read_percentage"),
    )


# --- sessions ---------------------------------------------------------------


def session_dist(progress: DataFrame) -> DataFrame:
    """(kind, key, count) by state and by initiator, in one pass."""
    pairs = progress.select(
        F.inline(
            F.array(
                F.struct(F.lit("state").alias("kind"), F.col("state").alias("key")),
                F.struct(F.lit("started_by").alias("kind"), F.col("started_by").alias("key")),
            )
        )
    )
    return pairs.filter(F.col("key").isNotNull()).groupBy("kind", "key").agg(_n())


def _finished() -> Column:
    both = F.col("time_started").isNotNull() & F.col("time_finished").isNotNull()
    return (F.col("state") == "COMPLETED") & both


def durations(progress: DataFrame) -> DataFrame:
    seconds = seconds_between(F.col("time_started"), F.col("time_finished"))
    mean = progress.filter(_finished()).agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean"))
    return mean.select(
        F.floor(F.col("mean") + 0.5).alias("avg_duration_seconds"),
        fmt_mmss(F.col("mean")).alias("avg_duration_formatted"),
    )


def _rate(column: str, good: str, bad: str, empty: float) -> tuple[Column, Column, Column]:
    ok, failed = F.count_if(F.col(column) == good), F.count_if(F.col(column) == bad)
    return ok, failed, percent(ok, ok + failed, 1, empty)


def success_rate(progress: DataFrame) -> DataFrame:
    ok, failed, rate = _rate("state", "COMPLETED", "ERROR", 0.0)
    return progress.agg(
        rate.alias("success_rate"), ok.alias("successful_sessions"), failed.alias("failed_sessions")
    )


def items(progress: DataFrame) -> DataFrame:
    mean = F.avg(F.when(_finished(), F.col("total_items")))
    return progress.agg(
        F.coalesce(F.sum("processed_items"), F.lit(0)).alias("total_items_processed"),
        F.floor(F.coalesce(mean, F.lit(0.0)) + 0.5).alias("avg_items_per_session"),
    )


def by_weekday(progress: DataFrame) -> DataFrame:
    return _histogram(progress, F.upper(F.date_format("time_started", "EEEE")), "weekday")


def by_month(progress: DataFrame) -> DataFrame:
    return _histogram(progress, month_of(F.col("time_started")), "month").orderBy("month")


# --- files and syncs --------------------------------------------------------


def file_stats(files: DataFrame) -> DataFrame:
    sized = F.when(F.col("file_size") > 0, F.col("file_size"))
    ok, failed, rate = _rate("state", "COMPLETED", "ERROR", 0.0)
    summed = files.agg(
        _n("total_files"),
        F.coalesce(F.sum(sized), F.lit(0)).alias("total_file_size"),
        F.coalesce(F.avg(sized), F.lit(0.0)).alias("mean"),
        ok.alias("successful_files"),
        failed.alias("failed_files"),
        rate.alias("file_success_rate"),
        F.count_distinct("series_id").alias("files_per_series_count"),
    )
    return summed.withColumns(
        {
            "total_file_size_formatted": format_size(F.col("total_file_size")),
            "avg_file_size": F.floor(F.col("mean") + 0.5),
            "avg_file_size_formatted": format_size(F.floor("mean")),
        }
    ).drop("mean")


def file_states(files: DataFrame) -> DataFrame:
    return _histogram(files, F.col("state"), "state")


def files_per_day(files: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(F.lit(days))
    recent = files.filter(F.col("processed_at") > since)
    return _histogram(recent, F.date_format("processed_at", "yyyy-MM-dd"), "day").orderBy("day")


def sync_stats(syncs: DataFrame) -> DataFrame:
    _ok, _failed, health = _rate("sync_status", "COMPLETED", "FAILED", 100.0)
    return syncs.agg(
        _n("total_syncs"),
        F.coalesce(F.sum("total_files_count"), F.lit(0)).alias("total_files_tracked"),
        F.coalesce(round_half_up(F.avg("total_files_count"), 1), F.lit(0.0)).alias("avg_files_per_sync"),
        health.alias("sync_health_rate"),
        F.count_distinct("series_id").alias("unique_series_synced"),
    )


def sync_states(syncs: DataFrame) -> DataFrame:
    return _histogram(syncs, F.col("sync_status"), "sync_status")


# --- lists and dashboards ---------------------------------------------------


def issue_stats(issues: DataFrame, series: DataFrame) -> DataFrame:
    """(section, key, value) of totals, conditions and counts by series name."""
    totals = issues.agg(
        _n("total_issues"),
        F.count_if("is_key_issue").alias("key_issues"),
        F.count_if("is_variants").alias("variant_issues"),
        _money("current_value").alias("total_collection_value"),
    ).unpivot([], ["total_issues", "key_issues", "variant_issues", "total_collection_value"], "key", "value")
    by_condition = conditions(issues).select(
        F.lit("condition").alias("section"), F.col("condition").alias("key"), F.col("count").cast("double").alias("value")
    )
    by_name = issues_per_name(issues, series).select(
        F.lit("series").alias("section"), F.col("name").alias("key"), F.col("count").cast("double").alias("value")
    )
    head = totals.select(F.lit("total").alias("section"), "key", F.col("value").cast("double").alias("value"))
    return head.unionByName(by_condition).unionByName(by_name)


def series_stats(series: DataFrame) -> DataFrame:
    """(section, key, value): totals, publishers and decades."""
    head = series.agg(_n("total_series"), F.count("comic_vine_id").alias("linked_series")).unpivot(
        [], ["total_series", "linked_series"], "key", "value"
    )
    publishers = _histogram(series, F.col("publisher"), "publisher")
    by_decade = _histogram(series, decade_of(F.col("start_year")), "decade")
    return (
        head.select(F.lit("total").alias("section"), "key", "value")
        .unionByName(publishers.select(F.lit("publisher").alias("section"), F.col("publisher").alias("key"), F.col("count").alias("value")))
        .unionByName(by_decade.select(F.lit("decade").alias("section"), F.col("decade").alias("key"), F.col("count").alias("value")))
    )


def completion_eq(series: DataFrame) -> DataFrame:
    done, tracked = F.count_if(complete_eq()), F.count_if(F.coalesce(_available(), F.lit(0)) > 0)
    return series.agg(
        done.alias("completed"), tracked.alias("total"),
        percent(done, tracked, 0).cast("bigint").alias("percentage"),
    )


def dashboard_publishers(series: DataFrame) -> DataFrame:
    """Publishers with unrounded share; no publisher counts as Unknown."""
    name = F.when(F.coalesce(F.col("publisher") == "", F.lit(True)), "Unknown").otherwise(F.col("publisher"))
    counted = series.groupBy(name.alias("name")).agg(_n())
    return counted.withColumn("percentage", F.col("count") / total(series, F.count("*")) * 100).orderBy(
        F.desc("count"), "name"
    )


def dashboard(series: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: totals, favourite publisher and completed share."""
    publishers = dashboard_publishers(series)
    best = publishers.orderBy(F.desc("count"), "name").limit(1).select("name").scalar()
    done = one_row(completion_eq(series), F.max("completed").alias("completed"), F.max("percentage").alias("pct"))
    return single(series.sparkSession).select(
        total(series, F.count("*")).alias("total_series"),
        total(issues, F.count("*")).alias("total_issues"),
        total(publishers, F.count("*")).alias("unique_publishers"),
        best.alias("favorite_publisher"),
        done["completed"].alias("completed_series"),
        done["pct"].alias("completion_percentage"),
    )


def popular_publishers(series: DataFrame) -> DataFrame:
    return series.groupBy("publisher").agg(_n()).orderBy(F.desc("count"), "publisher")


def total_value(issues: DataFrame, kind: str = "current", by: str | None = None) -> DataFrame:
    """Sum of current values or purchase prices, overall or per key."""
    amount = F.col("purchase_price" if kind == "purchase" else "current_value")
    grouped = issues.groupBy(by) if by else issues.groupBy()
    return grouped.agg(_money(amount).alias("total"))


def owned_counts(series: DataFrame, issues: DataFrame) -> DataFrame:
    """``series`` with a fresh owned count."""
    counts = issues.groupBy(F.col("series_id").alias("id")).agg(_n("issues_owned_count"))
    return (
        series.drop("issues_owned_count")
        .join(counts, "id", "left")
        .withColumn("issues_owned_count", F.coalesce("issues_owned_count", F.lit(0)))
    )


def completed_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("state") == "COMPLETED").groupBy("series_id").agg(_n())


def avg_per_series(series: DataFrame, issues: DataFrame, nonempty: bool = False) -> DataFrame:
    if nonempty:
        counts = issues_per_series(issues).agg(F.sum("issue_count").alias("i"), _n("s"))
    else:
        counts = series.agg(_n("s")).withColumn("i", total(issues, F.count("*")))
    mean = round_half_up(F.col("i") / F.col("s"), 1)
    return counts.select(F.when(F.col("s") > 0, mean).otherwise(F.lit(0.0)).alias("average"))


def five_year(decade_counts: DataFrame) -> DataFrame:
    """Each decade in halves, the first one getting the odd item."""
    start = F.regexp_extract("decade", r"(\d{4})", 1).cast("int")
    first = F.ceil(F.col("count") / 2)

    def half(offset: int, count: Column) -> Column:
        last = F.substring((start + offset + 4).cast("string"), 3, 2)
        return F.struct(
            F.concat((start + offset).cast("string"), F.lit("-"), last).alias("period"), count.alias("count")
        )

    halves = decade_counts.select(F.inline(F.array(half(0, first), half(5, F.col("count") - first))))
    most = total(halves, F.max("count"))
    share = F.when(most > 0, F.col("count") / most * 100).otherwise(F.lit(0.0))
    return halves.withColumn("percentage", share).orderBy("period")


def top_publishers(breakdown: DataFrame, n: int = 8) -> DataFrame:
    top = breakdown.orderBy(F.desc("issue_count"), "name").limit(n)
    most = total(breakdown, F.max("issue_count"))
    share = F.when(most > 0, F.col("issue_count") / most * 100).otherwise(F.lit(0.0))
    return top.select("name", "issue_count", share.alias("percentage"))


def most_incomplete(series: DataFrame, n: int = 8) -> DataFrame:
    return completion_rank(series, least=True).orderBy("percentage", "id").limit(n).select(
        "name", (F.col("available") - F.col("owned")).alias("missing"), "percentage"
    )


def recent_count(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(F.lit(days))
    return df.agg(F.count_if(F.col("created_at") >= since).alias("recent"))


def _ignored(df: DataFrame, ignored: DataFrame, how: str) -> DataFrame:
    return df.join(ignored.select("series_id").distinct(), "series_id", how)


def missing_summary(missing: DataFrame, series: DataFrame, ignored: DataFrame) -> DataFrame:
    """Oldest date, distinct series kept, and ignored groups by name and year."""
    kept = total(_ignored(missing, ignored, "left_anti"), F.count_distinct("series_id"))
    skipped = total(
        _ignored(missing, ignored, "left_semi").join(_group_keys(series), "series_id"),
        F.count_distinct("group_key"),
    )
    return missing.agg(F.min("expected_cover_date").cast("string").alias("oldest")).select(
        "oldest", kept.alias("series_count"), skipped.alias("ignored_groups")
    )


def release_counts(releases: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of[:10]).cast("date")
    date = F.col("expected_cover_date")
    return releases.agg(
        F.count_if(F.trunc(date, "MM") == F.trunc(day, "MM")).alias("this_month"),
        F.count_if(date >= day).alias("upcoming"),
        F.count_distinct("series_id").alias("series_count"),
    )


def _group_keys(series: DataFrame) -> DataFrame:
    key = F.concat("name", F.lit(" ("), F.col("start_year").cast("string"), F.lit(")"))
    return series.select(F.col("id").alias("series_id"), key.alias("group_key"))


def group_missing(
    missing: DataFrame, series: DataFrame, sort: str = "series", ignored: DataFrame | None = None,
    show_ignored: bool = False,
) -> DataFrame:
    """Missing issues under ``name (year)`` groups, one row per issue.

    Rows keep their group's size and the date of its first issue; the result
    is ordered by group and by number inside the group. Groups stay flat rows,
    so one of any size spreads over many tasks.
    """
    if ignored is not None:
        missing = _ignored(missing, ignored, "left_semi" if show_ignored else "left_anti")
    number = F.coalesce(
        F.regexp_extract("issue_number", r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0)
    )
    rows = missing.join(_group_keys(series), "series_id").withColumn("number", number)
    groups = rows.groupBy("group_key").agg(
        _n("group_size"),
        F.min(F.struct("number", "id", "expected_cover_date")).alias("head"),
    )
    first = F.coalesce(F.col("head.expected_cover_date"), F.lit("1970-01-01").cast("date"))
    groups = groups.select("group_key", "group_size", first.alias("group_date"))
    lead = {"series": [], "date": [F.col("group_date")], "count": [F.desc("group_size")]}[sort]
    return rows.join(shuffled(groups), "group_key").orderBy(*lead, "group_key", "number", "id")


def group_releases(releases: DataFrame) -> DataFrame:
    """Releases with their month, newest month first; no date, no row."""
    dated = releases.filter(F.col("expected_cover_date").isNotNull())
    return dated.withColumns(
        {
            "month": F.date_format("expected_cover_date", "yyyy-MM"),
            "label": F.date_format("expected_cover_date", "MMMM yyyy"),
        }
    ).orderBy(F.desc("month"), F.desc("expected_cover_date"), "id")


def month_counts(releases: DataFrame) -> DataFrame:
    month = F.date_format("expected_cover_date", "yyyy-MM")
    return _histogram(releases, month, "month").orderBy(F.desc("month"))


def read_progress(issues: DataFrame) -> DataFrame:
    read, n = F.count_if("read"), F.count("*")
    return issues.groupBy("series_id").agg(
        read.alias("read_count"), percent(read, n, 0).cast("bigint").alias("read_percentage")
    )


def cache_stats(images: DataFrame, features: DataFrame, counters: DataFrame) -> DataFrame:
    """Inventory of cached images and features with hit rates in percent.

    ``counters`` has one row of memory_hits, memory_misses, db_hits, db_misses.
    """
    detectors = ("sift", "orb", "akaze", "kaze")
    have = one_row(
        features, _n("n"), *[F.count_if(F.col(f"{d}_count") > 0).alias(f"{d}_features_count") for d in detectors]
    )
    hits = one_row(counters, *[F.sum(c).alias(c) for c in ("memory_hits", "memory_misses", "db_hits", "db_misses")])
    base = images.agg(
        _n("cached_images_count"),
        (F.coalesce(F.sum("file_size"), F.lit(0)) / float(1024 * 1024)).alias("total_disk_usage_mb"),
    ).withColumns({"_f": have, "_h": hits})
    asked = F.col("_h.memory_hits") + F.col("_h.memory_misses") + F.col("_h.db_hits") + F.col("_h.db_misses")

    def rate(good: Column) -> Column:
        return F.when(asked > 0, good / asked * 100).otherwise(F.lit(0.0))

    return base.select(
        "cached_images_count",
        "total_disk_usage_mb",
        F.col("_f.n").alias("cached_features_count"),
        *[F.col(f"_f.{d}_features_count") for d in detectors],
        asked.alias("total_requests"),
        rate(F.col("_h.memory_hits") + F.col("_h.db_hits")).alias("hit_rate"),
        rate(F.col("_h.memory_hits")).alias("memory_hit_rate"),
    )


def status_counts(progress: DataFrame) -> DataFrame:
    state = F.col("state")
    active = F.count_if(state == "PROCESSING")
    return progress.agg(
        active.alias("active"), active.alias("processing"), F.lit(0).cast("bigint").alias("queued"),
        F.count_if(state == "COMPLETED").alias("completed"), F.count_if(state == "ERROR").alias("failed"),
    )


def barcode_outcomes(runs: DataFrame) -> DataFrame:
    """Outcome counts of a barcode run.

    ``runs`` has one row per series: fetch_error, barcode, save_error. A failed
    fetch is an error and not processed; a failed save is an error instead of
    a find.
    """
    fetched, found = ~F.col("fetch_error"), F.col("barcode").isNotNull() & (F.col("barcode") != "")
    saved = found & ~F.col("save_error")
    return runs.agg(
        F.count_if(fetched).alias("series_processed"),
        F.count_if(fetched & saved).alias("barcodes_found"),
        F.count_if(fetched & ~found).alias("barcodes_not_found"),
        F.count_if(~fetched | (fetched & found & F.col("save_error"))).alias("errors"),
    )

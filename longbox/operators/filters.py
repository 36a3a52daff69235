"""Searches, lookups and predicates. All narrow: none of these shuffles by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.numbers import first_int
from longbox.functions.text import fallback_text, folder_display, is_image_file
from longbox.functions.times import moment
from longbox.plans.scale import shuffled

# Review filter names and the statuses they stand for.
REVIEW_STATUSES = {
    "auto_selected": "auto_accepted",
    "manually_selected": "manually_accepted",
    "needs_review": "pending",
    "rejected": "rejected",
    "no_match": "no_match",
}
# Session filter names and the states they stand for.
SESSION_STATES = {"processing": "PROCESSING", "completed": "COMPLETED", "error": "ERROR"}


def contains_ci(column: str | Column, term: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(column).contains(term.lower()), F.lit(False))


def any_contains(term: str, *columns: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(c, term) for c in columns])


def search_series(df: DataFrame, term: str) -> DataFrame:
    return df.filter(any_contains(term, "name", "publisher"))


def search_text(df: DataFrame, term: str) -> DataFrame:
    return df.filter(any_contains(term, "title", "description"))


def search_issues(issues: DataFrame, series: DataFrame, term: str, n: int, order: list[str]) -> DataFrame:
    """Title, series name or number contains ``term``; the first ``n`` in ``order``."""
    names = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    found = issues.join(names, "series_id").filter(
        any_contains(term, "title", "series_name", "issue_number")
    )
    return found.orderBy(*order).limit(n)


def advanced_search(
    df: DataFrame, publisher: str | None = None, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Optional filters; both year bounds apply to the start year."""
    if publisher and publisher.strip():
        df = df.filter(contains_ci("publisher", publisher))
    if start is not None:
        df = df.filter(F.col("start_year") >= start)
    if end is not None:
        df = df.filter(F.col("start_year") <= end)
    return df


def by_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def by_decade(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("start_year").between(first, last)).orderBy("start_year", "id")


def linked(df: DataFrame) -> DataFrame:
    return df.filter(F.col("comic_vine_id").isNotNull())


def key_issues(df: DataFrame) -> DataFrame:
    return df.filter("is_key_issue")


def variant_issues(df: DataFrame) -> DataFrame:
    return df.filter("is_variants")


def by_condition(df: DataFrame, condition: str) -> DataFrame:
    return by_eq(df, "condition", condition)


def price_between(df: DataFrame, low, high) -> DataFrame:
    return df.filter(F.col("purchase_price").between(low, high))


def profitable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("current_value") > F.col("purchase_price"))


def missing_text(df: DataFrame, series: int | None = None) -> DataFrame:
    """No description: null or empty overall, null only within one series."""
    text = F.col("description")
    if series is not None:
        return df.filter((F.col("series_id") == series) & text.isNull())
    return df.filter(text.isNull() | (text == ""))


def missing_text_batch(df: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    return missing_text(df).orderBy(*order).limit(limit)


def missing_text_counts(df: DataFrame, limit: int = 50) -> DataFrame:
    """(processed, total, remaining) of one batch run."""
    counted = missing_text(df).agg(F.count("*").alias("total"))
    done = F.least(F.col("total"), F.lit(limit).cast("bigint"))
    return counted.select(done.alias("processed"), "total", (F.col("total") - done).alias("remaining"))


def fill_missing_text(issues: DataFrame, series: DataFrame) -> DataFrame:
    """Template description wherever there is none."""
    names = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    text = fallback_text(
        F.coalesce("series_name", F.lit("Unknown Series")),
        F.col("issue_number"),
        F.col("title"),
        F.col("cover_date").cast("string"),
    )
    empty = F.col("description").isNull() | (F.col("description") == "")
    return (
        issues.join(names, "series_id", "left")
        .withColumn("description", F.when(empty, text).otherwise(F.col("description")))
        .drop("series_name")
    )


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Many point lookups as one semi join."""
    return df.join(shuffled(keys.select(*on)), on, "left_semi")


def gcd_filter(
    df: DataFrame,
    name: str | None = None,
    year: int | None = None,
    publication_date: str | None = None,
    title: str | None = None,
) -> DataFrame:
    for column, term in (("name", name), ("publication_date", publication_date), ("title", title)):
        if term is not None:
            df = df.filter(contains_ci(column, term))
    return df if year is None else df.filter(F.col("year_began") == year)


def _parents(series: DataFrame, **terms) -> DataFrame:
    return gcd_filter(series, **terms).select(F.col("id").alias("series_id"))


def gcd_by_series_year(issues: DataFrame, series: DataFrame, name: str, year: str) -> DataFrame:
    dated = issues.filter(F.col("key_date").contains(year))
    return dated.join(_parents(series, name=name), "series_id", "left_semi")


def gcd_active(
    issues: DataFrame, series: DataFrame | None = None, series_id: int | None = None, name: str | None = None
) -> DataFrame:
    """Rows not deleted, of one series or of all series of a name, in sort order."""
    active = issues.filter(F.col("deleted") == 0)
    if series_id is not None:
        active = active.filter(F.col("series_id") == series_id)
    if name is not None:
        active = active.join(
            series.filter(F.col("name") == name).select(F.col("id").alias("series_id")), "series_id", "left_semi"
        )
    return active.orderBy("sort_code", "series_id", "id")


def gcd_in(df: DataFrame, ids: list[int], column: str = "series_id") -> DataFrame:
    return df.filter(F.col(column).isin(ids))


def not_dismissed(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("dismissed"))


def unresolved(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_resolved"))


def new_releases(df: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    since = F.add_months(F.lit(as_of[:10]).cast("date"), -months)
    fresh = not_dismissed(unresolved(df)).filter(F.col("expected_cover_date") >= since)
    return fresh.orderBy(F.desc("expected_cover_date"), "id")


def recent_sessions(df: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(F.lit(days))
    recent = (F.col("time_started") >= since) | (F.col("time_finished") >= since)
    return not_dismissed(df.filter(recent))


def ledger(
    df: DataFrame,
    series: int | None = None,
    state: str | None = None,
    before: str | None = None,
    session: str | None = None,
) -> DataFrame:
    for column, value in (("series_id", series), ("state", state), ("session_id", session)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df if before is None else df.filter(F.col("processed_at") < moment(before))


def completed_paths(df: DataFrame, series: int) -> DataFrame:
    return ledger(df, series=series, state="COMPLETED").select("file_path")


def sync_filter(df: DataFrame, status: str | None = None, before: str | None = None) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("sync_status") == status)
    return df if before is None else df.filter(F.col("last_sync_timestamp") < moment(before))


def image_files(df: DataFrame, name: str = "file_name", directory: str | None = None) -> DataFrame:
    found = df.filter(is_image_file(F.col(name)))
    return found if directory is None else found.filter(~F.col(directory))


def complete_eq(owned: str = "issues_owned_count", available: str = "issues_available_count") -> Column:
    have, of = F.coalesce(owned, F.lit(0)), F.coalesce(available, F.lit(0))
    return (of > 0) & (have == of)


def list_filter(
    df: DataFrame, term: str | None = None, publisher: str | None = None, completed: bool = False
) -> DataFrame:
    if term and term.strip():
        df = search_series(df, term)
    if publisher:
        df = by_eq(df, "publisher", publisher)
    return df.filter(complete_eq()) if completed else df


def text_filter(df: DataFrame, term: str | None) -> DataFrame:
    """Missing or release rows by series name, number, expected name or publisher."""
    term = (term or "").strip()
    if not term:
        return df
    return df.filter(any_contains(term, "series_name", "issue_number", "expected_issue_name", "publisher"))


def number_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(first_int(F.col("issue_number")).between(first, last))


def review_filter(df: DataFrame, status: str = "all", confidence: str = "all") -> DataFrame:
    if status != "all":
        df = df.filter(F.col("status") == REVIEW_STATUSES[status])
    return df if confidence == "all" else df.filter(F.col("confidence") == confidence)


def rule_errors(
    required: list[str], limits: dict[str, int], domains: dict[str, list[str]] | None = None
) -> Column:
    """Array of the rules a row breaks; nulls pass length and domain checks."""
    blank = [
        F.when(F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), F.lit(f"{c} is required")) for c in required
    ]
    long = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in limits.items()]
    odd = [F.when(~F.col(c).isin(values), F.lit(f"{c} is not a known value")) for c, values in (domains or {}).items()]
    return F.array_compact(F.array(*blank, *long, *odd))


def validate(
    df: DataFrame, required: list[str], limits: dict[str, int], domains: dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their ``errors``)."""
    checked = df.withColumn("errors", rule_errors(required, limits, domains))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def folder_filter(df: DataFrame, term: str) -> DataFrame:
    term = term.strip()
    if not term:
        return df
    return df.filter(any_contains(term, F.col("id").cast("string"), "name", folder_display(F.col("name"))))


def status_filter(df: DataFrame, wanted: str = "all") -> DataFrame:
    state = SESSION_STATES.get(wanted)
    return df if state is None else by_eq(df, "state", state)


def finished_ids(df: DataFrame) -> DataFrame:
    return df.filter(F.col("state").isin("COMPLETED", "ERROR")).select("id")



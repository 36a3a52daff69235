"""Top-k, latest-per-key and ordered listings.

Top-k is ``orderBy().limit()`` (each task keeps k rows); the first rows per
key use a row-number filter that Spark pushes in front of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.natural import natural_key_a, natural_key_b
from longbox.functions.numbers import completion_pct, first_int
from longbox.functions.text import normalize_barcode, normalize_name
from longbox.functions.times import duration_s, fmt_hms, moment
from longbox.operators.aggregates import by_month, issues_per_series
from longbox.plans.scale import first_per_group, order_by, top_per_group, total


def newest_series(series: DataFrame, n: int = 5) -> DataFrame:
    return series.filter(F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), "id").limit(n)


def _named(df: DataFrame, series: DataFrame) -> DataFrame:
    names = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    return df.join(names, "series_id", "left").withColumn(
        "series_name", F.coalesce("series_name", F.lit("Unknown"))
    )


def newest_issues(issues: DataFrame, series: DataFrame, n: int = 8, ties: list[str] | None = None) -> DataFrame:
    """The limit comes before the join, so only ``n`` rows look up a name."""
    newest = issues.filter(F.col("created_at").isNotNull())
    newest = newest.orderBy(F.desc("created_at"), *(ties or ["id"])).limit(n)
    return _named(newest, series)


def recent_sessions(progress: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    started = progress.filter(F.col("time_started").isNotNull())
    seconds = duration_s(F.col("time_started"), F.col("time_finished"), as_of)
    return started.orderBy(F.desc("time_started"), "id").limit(n).withColumn("duration", fmt_hms(seconds))


def recent_syncs(syncs: DataFrame, n: int = 10) -> DataFrame:
    synced = syncs.filter(F.col("last_sync_timestamp").isNotNull())
    return synced.orderBy(F.desc("last_sync_timestamp"), "id").limit(n)


def sync_attention(syncs: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    idle = F.col("updated_at") < moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    status = F.col("sync_status")
    return syncs.filter((status == "FAILED") | ((status == "IN_PROGRESS") & idle))


def natural_order_a(df: DataFrame, column: str = "issue_number", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    return order_by(df, *natural_key_a(F.col(column)), *map(F.col, ties))


def natural_order_b(df: DataFrame, column: str = "issue_number", date: str = "cover_date",
                    ties: tuple[str, ...] = ("id",)) -> DataFrame:
    return order_by(df, *natural_key_b(F.col(column), F.col(date)), *map(F.col, ties))


def recent(df: DataFrame, n: int, by: str = "id", ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *(ties or [])).limit(n)


def popular(series: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    counts = issues_per_series(issues).withColumnRenamed("series_id", "id")
    counted = series.join(counts, "id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    return counted.orderBy(F.desc("issue_count"), "id").limit(n)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page (from 0) of the ordered rows, with the total of all rows."""
    rows = df.orderBy(*order).offset(number * size).limit(size)
    return rows.withColumn("total", total(df, F.count("*")))


def latest_per(df: DataFrame, key: str = "session_id", ts: str = "time_started", ties: tuple = ("id",)) -> DataFrame:
    return first_per_group(df, [key], [F.desc(ts), *[F.desc(t) for t in ties]])


def latest_sync(syncs: DataFrame, by: str = "updated_at", since: str | None = None) -> DataFrame:
    """Latest row per (series, folder), optionally of those synced since."""
    if since is not None:
        syncs = syncs.filter(F.col("last_sync_timestamp") >= moment(since))
    return first_per_group(syncs, ["series_id", "folder_path"], [F.desc_nulls_last(by), F.desc("id")])


def _list_keys() -> dict[str, Column]:
    blank = F.coalesce(F.col("publisher") == "", F.lit(True))
    return {
        "name": F.coalesce("name", F.lit("")),
        "publisher": F.when(blank, "Unknown").otherwise(F.col("publisher")),
        "year": F.coalesce("start_year", F.lit(0)),
        "completion": completion_pct(
            F.coalesce("issues_owned_count", F.lit(0)), F.coalesce("issues_available_count", F.lit(0))
        ),
        "issueCount": F.coalesce("issues_available_count", F.lit(0)),
        "dateAdded": F.coalesce("created_at", moment("1970-01-01 00:00:00")),
    }


def list_sort(df: DataFrame, key: str = "name", asc: bool = True) -> DataFrame:
    """List view order; an unknown key means by name."""
    keys = _list_keys()
    chosen = keys.get(key, keys["name"])
    keyed = df.withColumn("_key", chosen)
    return keyed.orderBy(F.asc("_key") if asc else F.desc("_key"), "id").drop("_key")


def _reading_key(single: Column) -> Column:
    """By number in single-catalogue series, by cover date otherwise."""
    days = F.coalesce(F.unix_date("cover_date"), F.lit(0)).cast("bigint")
    return F.when(single, first_int(F.col("issue_number"))).otherwise(days)


def _with_reading_key(issues: DataFrame, series: DataFrame) -> DataFrame:
    links = series.select(F.col("id").alias("series_id"), (F.col("link_count") == 1).alias("_single"))
    return issues.join(links, "series_id").withColumn("reading_key", _reading_key(F.col("_single"))).drop("_single")


def next_to_read(issues: DataFrame, series: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """First unread issue per series; ``series`` carries ``link_count``."""
    unread = _with_reading_key(issues.filter(~F.col("read")), series)
    return first_per_group(unread, ["series_id"], [F.col("reading_key"), *[F.col(t) for t in ties or ["id"]]])


def issue_order(issues: DataFrame, series: DataFrame) -> DataFrame:
    """All issues in listing order per series, as one range-partitioned sort."""
    return _with_reading_key(issues, series).orderBy("series_id", "reading_key", "id")


def relevant_time() -> Column:
    state = F.col("state")
    ended = state.isin("COMPLETED", "ERROR") & F.col("time_finished").isNotNull()
    return (
        F.when((state == "PROCESSING") & F.col("last_updated").isNotNull(), F.col("last_updated"))
        .when(ended, F.col("time_finished"))
        .otherwise(F.col("time_started"))
    )


def status_order(progress: DataFrame) -> DataFrame:
    return (
        progress.withColumn("relevant_time", relevant_time())
        .withColumn("queue", F.when(F.col("state") == "PROCESSING", 0).otherwise(1))
        .orderBy("queue", F.desc_nulls_last("relevant_time"), "id")
    )


def latest_and_recent(issues: DataFrame, n: int = 5, ties: list[str] | None = None) -> DataFrame:
    """The newest issue and the ``n`` after it, numbered from 1."""
    newest = issues.filter(F.col("created_at").isNotNull())
    newest = newest.orderBy(F.desc("created_at"), *(ties or ["id"])).limit(n + 1)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), *(ties or ["id"])))
    return newest.withColumn("place", place.cast("bigint"))


def head_per_series(issues: DataFrame, n: int = 9, order: list[str] | None = None) -> DataFrame:
    """First ``n`` issues per series with the number of hidden ones."""
    head = top_per_group(issues, ["series_id"], [F.col(c) for c in order or ["id"]], n)
    counts = issues_per_series(issues)
    hidden = F.greatest(F.col("issue_count") - n, F.lit(0).cast("bigint"))
    return head.join(counts, "series_id").withColumn("hidden", hidden).drop("issue_count")


def warm_set(features: DataFrame, capacity: int) -> DataFrame:
    """Most recently used half of the cache."""
    return features.orderBy(F.desc("last_accessed"), "url_hash").limit(capacity // 2)


def cumulative_sessions(progress: DataFrame) -> DataFrame:
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_month(progress).withColumn("cumulative", F.sum("count").over(so_far))


def first_barcode(scans: DataFrame, order: str = "issue_order") -> DataFrame:
    """First readable barcode per series in issue order."""
    code = normalize_barcode(F.col("barcode"))
    readable = scans.withColumn("barcode", F.when(code != "", code)).filter(F.col("barcode").isNotNull())
    return readable.groupBy("series_id").agg(F.min(F.struct(order, "barcode"))["barcode"].alias("barcode"))


def folder_map(series: DataFrame, ids: str = "comic_vine_ids") -> DataFrame:
    """(id, folder): first catalogue id and name; null without any id."""
    first = F.try_element_at(F.col(ids), F.lit(1))
    name = normalize_name(F.concat(first, F.lit("_"), F.col("name")))
    return series.select("id", F.when(first.isNotNull(), name).alias("folder"))

"""Change sets: every operator returns the new state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import default_title, image_path
from longbox.functions.times import moment, parse_date
from longbox.operators.aggregates import owned_counts
from longbox.operators.joins import dedupe_upload
from longbox.plans.scale import first_per_group, total

# The columns whose change makes a progress row an update.
TRACKED = [
    "state",
    "percentage_complete",
    "current_stage",
    "processed_items",
    "successful_items",
    "failed_items",
    "error_message",
]


def _differs(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str] = TRACKED) -> DataFrame:
    """(key, change): add, update or remove; unchanged keys are left out."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    change = (
        F.when(F.col("a").isNull(), "add")
        .when(F.col("b").isNull(), "remove")
        .when(_differs(columns, "a", "b"), "update")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def snapshot_merge(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Current rows, replaced where ``new`` has the key; other new rows ignored."""
    rest = [c for c in current.columns if c != key]
    fresh = new.select(key, F.struct(*rest).alias("_new"))
    joined = current.join(fresh, key, "left")
    return joined.select(
        key,
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            for c in rest
        ],
    )


def _checked_requests(requests: DataFrame, series: DataFrame) -> DataFrame:
    """Fails the job when rows name several series, or one that is unknown."""
    several = total(requests, F.count_distinct("series_id"))
    known = total(series.filter(F.col("id") == total(requests, F.max("series_id"))), F.count("*"))
    return requests.filter(
        F.when(several > 1, F.raise_error(F.lit("All issues must belong to the same series")).cast("boolean"))
        .when(known == 0, F.raise_error(F.lit("Series not found")).cast("boolean"))
        .otherwise(True)
    )


def insert_issues(
    requests: DataFrame, issues: DataFrame, series: DataFrame, missing: DataFrame, hashes: DataFrame
) -> dict[str, DataFrame]:
    """Bulk insert of one series' issues: the new issues, series and missing tables."""
    # All rows name one series, so it is a value and not a key to join on.
    name = total(series.filter(F.col("id") == total(requests, F.max("series_id"))), F.max("name"))
    rows = _checked_requests(requests, series).withColumn("_series", name)
    rows = rows.withColumn(
        "title", default_title(F.col("title"), F.col("_series"), F.col("issue_number"))
    ).drop("_series")
    rows = dedupe_upload(rows, issues, hashes)
    reused = rows.filter(F.col("reuse_id").isNotNull()).select(F.col("reuse_id").alias("id")).distinct()
    placed = rows.withColumn("id", F.coalesce("reuse_id", "id")).drop("reuse_id", "content_hash")
    all_issues = issues.join(reused, "id", "left_anti").unionByName(placed, allowMissingColumns=True)
    found = requests.select("series_id", "comic_vine_id").distinct().withColumn("_hit", F.lit(True))
    resolved = missing.join(found, ["series_id", "comic_vine_id"], "left").withColumn(
        "is_resolved", F.coalesce("_hit", "is_resolved")
    ).drop("_hit")
    return {"issues": all_issues, "series": owned_counts(series, all_issues), "missing_issues": resolved}


def delete_issues(ids: DataFrame, issues: DataFrame, series: DataFrame) -> dict[str, DataFrame]:
    """Issues and series after a bulk delete, and its (successful, failed) counts."""
    asked = ids.select("id")
    left = issues.join(asked, "id", "left_anti")
    done = total(asked.distinct().join(issues.select("id"), "id", "left_semi"), F.count("*"))
    counts = asked.agg(F.count("*").alias("asked")).select(
        done.alias("successful"), (F.col("asked") - done).alias("failed")
    )
    return {"issues": left, "series": owned_counts(series, left), "counts": counts}


def update_rows(df: DataFrame, changes: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Overwrite every column the change table has; ``defaults`` fill its nulls.

    An ``uploaded_image_url`` is stored as the path behind its image folder.
    """
    columns = [c for c in changes.columns if c != key]
    new = changes
    if "uploaded_image_url" in columns:
        new = new.withColumn("uploaded_image_url", image_path(F.col("uploaded_image_url")))
    for column, value in (defaults or {}).items():
        new = new.withColumn(column, F.coalesce(column, F.lit(value)))
    joined = df.join(new.select(key, F.struct(*columns).alias("_new")), key, "left")
    return joined.withColumns(
        {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    ).drop("_new").select(*df.columns)


def set_flag(df: DataFrame, ids: DataFrame, column: str, value, key: str = "id") -> DataFrame:
    """Set ``column`` on the given keys; value ``"toggle"`` flips a boolean."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    new = ~F.col(column) if value == "toggle" else F.lit(value)
    return marked.withColumn(
        column, F.when(F.col("_hit").isNotNull(), new).otherwise(F.col(column))
    ).drop("_hit").select(*df.columns)


def variants_add(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Append one cover per change row's struct ``variant``."""
    joined = df.join(changes.select(key, "variant"), key, "left")
    held = F.coalesce("variant_covers", F.array())
    return joined.withColumn(
        "variant_covers",
        F.when(F.col("variant").isNotNull(), F.array_append(held, F.col("variant"))).otherwise(held),
    ).drop("variant")


def variants_remove(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Drop covers by id; the variant flag follows what is left."""
    joined = df.join(changes.select(key, "variant_id"), key, "left")
    hit = F.col("variant_id").isNotNull()
    left = F.filter("variant_covers", lambda v: v["id"] != F.col("variant_id"))
    joined = joined.withColumn(
        "variant_covers", F.when(hit, left).otherwise(F.col("variant_covers"))
    )
    flag = F.when(hit, F.size("variant_covers") > 0).otherwise(F.col("is_variants"))
    return joined.withColumn("is_variants", flag).drop("variant_id")


def series_from_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "name",
        "description",
        "publisher",
        "start_year",
        F.when(F.col("end_year") > 0, F.col("end_year")).alias("end_year"),
        "image_url",
        F.col("id").alias("comic_vine_id"),
        F.array("id").alias("comic_vine_ids"),
        F.coalesce("issue_count", F.lit(0)).alias("issues_available_count"),
    )


def issues_from_catalogue(catalogue: DataFrame, series: DataFrame) -> DataFrame:
    """Issue rows of catalogue issues whose series is in the collection."""
    owned = series.select(F.col("id").alias("series_id"))
    return catalogue.join(owned, "series_id", "left_semi").select(
        "series_id",
        "issue_number",
        F.col("name").alias("title"),
        "description",
        "image_url",
        F.col("id").alias("comic_vine_id"),
        parse_date(F.col("cover_date")).alias("cover_date"),
        F.coalesce("variants", F.array()).alias("variant_covers"),
    )


def repair_primary(df: DataFrame, primary: str = "comic_vine_id", ids: str = "comic_vine_ids") -> DataFrame:
    """The primary id is one of the list: null for none, else the first."""
    listed = F.coalesce(F.array_contains(ids, F.col(primary)), F.lit(False))
    first = F.try_element_at(F.col(ids), F.lit(1))
    return df.withColumn(primary, F.when(listed, F.col(primary)).otherwise(first))


def mark_replayed(
    progress: DataFrame, files: DataFrame, sessions: DataFrame, as_of: str
) -> dict[str, DataFrame]:
    """Replay sessions (session_id, new_session_id) that have any files."""
    with_files = files.join(sessions, "session_id").groupBy("session_id", "new_session_id").agg(
        F.min("series_id").alias("series_id")
    )
    fresh = with_files.select(
        F.col("new_session_id").alias("session_id"),
        "series_id",
        F.lit("PROCESSING").alias("state"),
        F.lit("AUTOMATIC").alias("started_by"),
        moment(as_of).alias("time_started"),
    )
    marked = set_flag(progress, with_files, "state", "REPLAYED", "session_id")
    return {
        "progress": marked.unionByName(fresh, allowMissingColumns=True),
        "files": set_flag(files, with_files, "state", "REPLAYED", "session_id"),
    }


def complete_files(files: DataFrame, callbacks: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(files after the callbacks, callbacks that failed with their ``error``).

    ``callbacks`` holds session_id, original_file_name, file_hash,
    stored_file_name. Rows without session or name are bad requests.
    """
    keys = ["session_id", "file_name"]
    named = callbacks.withColumnRenamed("original_file_name", "file_name")
    whole = F.col("session_id").isNotNull() & F.col("file_name").isNotNull()
    good = first_per_group(named.filter(whole), keys, [F.desc("file_hash")])
    joined = files.join(good.select(*keys, F.struct("file_hash", "stored_file_name").alias("_cb")), keys, "left")
    hit = F.col("_cb").isNotNull()
    updated = joined.withColumns(
        {
            "file_etag": F.when(hit, F.col("_cb.file_hash")).otherwise(F.col("file_etag")),
            "file_name": F.when(hit, F.col("_cb.stored_file_name")).otherwise(F.col("file_name")),
            "state": F.when(hit, "COMPLETED").otherwise(F.col("state")),
            "processed_at": F.when(hit, moment(as_of)).otherwise(F.col("processed_at")),
        }
    ).select(*files.columns)
    unknown = named.filter(whole).join(files.select(*keys), keys, "left_anti")
    rejects = named.filter(~whole).withColumn("error", F.lit("bad_request")).unionByName(
        unknown.withColumn("error", F.lit("not_found"))
    )
    return updated, rejects


def record_sync(syncs: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Sync rows after a run per (series, folder), on the latest row of each.

    ``runs``: series_id, folder_path, status, total_files, session_id, error.
    An error sets FAILED and its text only; another status clears the error,
    and COMPLETED alone moves the last sync time. Unknown folders get a row.
    """
    keys = ["series_id", "folder_path"]
    latest = first_per_group(
        syncs.select(*keys, "id", "updated_at"), keys, [F.desc_nulls_last("updated_at"), F.desc("id")]
    )
    targets = latest.join(runs, keys).select("id", F.struct("status", "total_files", "session_id", "error").alias("_run"))
    joined = syncs.join(targets, "id", "left")
    run, failed = F.col("_run"), F.col("_run.error").isNotNull()
    hit = run.isNotNull()
    finished = hit & ~failed & (F.col("_run.status") == "COMPLETED")
    session = F.col("session_id") if "session_id" in syncs.columns else F.lit(None).cast("string")
    updated = joined.withColumns(
        {
            "sync_status": F.when(hit & failed, "FAILED").when(hit, F.col("_run.status")).otherwise(F.col("sync_status")),
            "total_files_count": F.when(hit & ~failed, F.coalesce("_run.total_files", "total_files_count")).otherwise(
                F.col("total_files_count")
            ),
            "session_id": F.when(hit & ~failed, F.col("_run.session_id")).otherwise(session),
            "error_message": F.when(hit & failed, F.col("_run.error")).when(~hit, F.col("error_message")),
            "last_sync_timestamp": F.when(finished, moment(as_of)).otherwise(F.col("last_sync_timestamp")),
            "updated_at": F.when(hit, moment(as_of)).otherwise(F.col("updated_at")),
        }
    ).drop("_run")
    # An error on a folder never seen before leaves no row behind.
    unseen = runs.join(syncs.select(*keys), keys, "left_anti").filter(F.col("error").isNull())
    fresh = unseen.select(
        *keys,
        F.col("status").alias("sync_status"),
        F.col("total_files").alias("total_files_count"),
        "session_id",
        F.when(F.col("status") == "COMPLETED", moment(as_of)).alias("last_sync_timestamp"),
        moment(as_of).alias("updated_at"),
    )
    return updated.unionByName(fresh, allowMissingColumns=True)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter((F.col(column) != "") & F.col(column).isNotNull()).distinct().orderBy(column)


def combine_series(catalogue: DataFrame, group: str, current: str = "current_primary") -> DataFrame:
    """One series per group of catalogue rows (ordered by ``pos``).

    The current primary id is kept while still listed, else the first row's.
    A group is the handful of rows a user ticked, so its id list is small.
    """
    keep = F.max(F.col("id") == F.col(current))
    rows = catalogue.groupBy(group).agg(
        F.min("start_year").alias("start_year"),
        F.max("end_year").alias("end_year"),
        F.sum(F.coalesce("issue_count", F.lit(0))).alias("issues_available_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("comic_vine_ids"),
        F.max(current).alias("_current"),
        keep.alias("_kept"),
    )
    primary = F.when(F.col("_kept"), F.col("_current")).otherwise(F.element_at("comic_vine_ids", 1))
    rows = rows.withColumn("comic_vine_id", primary).drop("_current", "_kept")
    lead = catalogue.select(group, F.col("id").alias("comic_vine_id"), "name", "description", "publisher")
    return rows.join(lead, [group, "comic_vine_id"])

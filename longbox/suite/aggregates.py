"""Queries over the statistics operators (inventory section 2.4)."""

from pyspark.sql import functions as F

from longbox.operators import aggregates as op
from longbox.operators import filters
from longbox.plans.bindings import AS_OF, AS_OF_EVENTS
from longbox.plans.report import collection_report
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add

BREAKDOWN = """
    SELECT s.publisher AS name, count(*) AS series_count, CAST(coalesce(sum(i.n), 0) AS BIGINT) AS issue_count,
      floor(count(*) * 100.0 / (SELECT count(*) FROM series) * 10 + 0.5) / 10 AS percentage
    FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM issues GROUP BY 1) i ON i.series_id = s.id
    WHERE s.publisher IS NOT NULL AND trim(s.publisher) <> '' GROUP BY 1"""
R1 = "floor(({}) * 10 + 0.5) / 10"
SHARE = "issues_owned_count * 100.0::DOUBLE / issues_available_count"
DECADES = "SELECT (start_year // 10) * 10 || 's' AS decade, count(*) AS count FROM series GROUP BY 1"


def ignored(t):
    """Series nobody wants to hear about: every seventh one."""
    return t.series.filter("id % 7 = 0").select(F.col("id").alias("series_id"))


@q("d01_overview", """
    SELECT (SELECT count(*) FROM series) AS total_series, (SELECT count(DISTINCT publisher) FROM series) AS unique_publishers,
      (SELECT count(*) FROM missing_issues WHERE NOT is_resolved) AS missing_issues, count(*) AS total_issues,
      count(*) FILTER (is_key_issue) AS key_issues, count(*) FILTER (is_variants) AS variant_issues,
      CAST(sum(current_value) AS DOUBLE) AS total_current_value, CAST(sum(purchase_price) AS DOUBLE) AS total_purchase_value
    FROM issues""")
def _(t):
    return op.overview(t.series, t.issues, t.missing_issues)


@q("d02_publisher_breakdown", BREAKDOWN)
def _(t):
    return op.publisher_breakdown(t.series, t.issues)


@q("d03_decades", DECADES)
def _(t):
    return op.decades(t.series)


@q("d04_conditions", "SELECT condition, count(*) AS count FROM issues WHERE condition IS NOT NULL GROUP BY 1")
def _(t):
    return op.conditions(t.issues)


@q("d05_top_series", "SELECT s.name, count(*) AS count FROM issues i JOIN series s ON s.id = i.series_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return op.top_series(t.issues, t.series)


@q("d06_growth", """
    WITH added AS (SELECT date_trunc('month', created_at) AS m, count(*) AS n FROM issues GROUP BY 1),
    months AS (SELECT unnest(generate_series((SELECT min(m) FROM added)::TIMESTAMP, TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m)
    SELECT strftime(months.m, '%Y-%m') AS month, coalesce(n, 0) AS added,
      CAST(sum(coalesce(n, 0)) OVER (ORDER BY months.m) AS BIGINT) AS cumulative
    FROM months LEFT JOIN added ON added.m = months.m""")
def _(t):
    return op.growth(t.issues, AS_OF)


@q("d07_completion", f"""
    SELECT count(*) FILTER (issues_owned_count >= issues_available_count) AS completed_series, count(*) AS total_tracked_series,
      {R1.format(f'avg(least({SHARE}, 100.0::DOUBLE))')} AS average_completion
    FROM series_owned WHERE issues_available_count > 0""")
def _(t):
    return op.completion(t.series_owned)


@q("d08_completion_rank", f"""
    SELECT * FROM (SELECT 'most' AS kind, id, name, CAST(issues_owned_count AS BIGINT) AS owned, CAST(issues_available_count AS BIGINT) AS available,
      {R1.format(SHARE)} AS percentage FROM series_owned WHERE issues_available_count > 0 ORDER BY {SHARE} DESC, id LIMIT 10)
    UNION ALL
    SELECT * FROM (SELECT 'least', id, name, CAST(issues_owned_count AS BIGINT), CAST(issues_available_count AS BIGINT), {R1.format(SHARE)} FROM series_owned
      WHERE issues_available_count > 0 AND issues_owned_count < issues_available_count ORDER BY {SHARE}, id LIMIT 10)""")
def _(t):
    most = op.completion_rank(t.series_owned).withColumn("kind", F.lit("most"))
    return most.unionByName(op.completion_rank(t.series_owned, least=True).withColumn("kind", F.lit("least")))


@q("d09_is_complete", "SELECT id, issues_available_count > 0 AND issues_owned_count >= issues_available_count AS is_complete FROM series_owned")
def _(t):
    return op.is_complete_ge(t.series_owned).select("id", "is_complete")


@q("d10_values", """
    WITH v AS (SELECT sum(current_value) FILTER (current_value > 0) AS cur, sum(purchase_price) AS paid,
      count(*) FILTER (current_value > 0) AS n FROM issues),
    top AS (SELECT i.*, s.name AS sname FROM issues i LEFT JOIN series s ON s.id = i.series_id
      ORDER BY current_value DESC, i.id, i.series_id DESC LIMIT 1)
    SELECT CAST(cur AS DOUBLE) AS total_current_value, CAST(paid AS DOUBLE) AS total_purchase_value,
      CAST(cur - paid AS DOUBLE) AS profit_loss,
      CAST((CAST(cur * 100 AS HUGEINT) * 2 + n) // (2 * n) AS DOUBLE) / 100 AS average_issue_value, n AS issues_with_value,
      top.id AS top_id, top.issue_number AS top_issue_number, top.title AS top_title, top.sname AS top_series_name,
      CAST(top.current_value AS DOUBLE) AS top_value
    FROM v, top""")
def _(t):
    return op.values(t.issues, t.series)


@q("d11_read_stats", """
    SELECT count(*) FILTER (read) AS read, count(*) FILTER (NOT read) AS unread,
      floor(count(*) FILTER (read) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS read_percentage FROM issues""")
def _(t):
    return op.read_stats(t.issues)


@q("d12_session_dist", """
    SELECT 'state' AS kind, state AS key, count(*) AS count FROM progress GROUP BY 2
    UNION ALL SELECT 'started_by', started_by, count(*) FROM progress WHERE started_by IS NOT NULL GROUP BY 2""")
def _(t):
    return op.session_dist(t.progress)


@q("d13_durations", """
    WITH a AS (SELECT avg(date_diff('second', time_started, time_finished)) AS m FROM progress WHERE state = 'COMPLETED')
    SELECT CAST(floor(m + 0.5) AS BIGINT) AS avg_duration_seconds,
      lpad(CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(m % 60) AS BIGINT) AS VARCHAR), 2, '0') AS avg_duration_formatted
    FROM a""")
def _(t):
    return op.durations(t.progress)


@q("d14_success_rate", """
    SELECT floor(count(*) FILTER (state = 'COMPLETED') * 100.0::DOUBLE / count(*) FILTER (state IN ('COMPLETED', 'ERROR')) * 10 + 0.5) / 10 AS success_rate,
      count(*) FILTER (state = 'COMPLETED') AS successful_sessions, count(*) FILTER (state = 'ERROR') AS failed_sessions
    FROM progress""")
def _(t):
    return op.success_rate(t.progress)


@q("d15_items", """
    SELECT CAST(sum(processed_items) AS BIGINT) AS total_items_processed,
      CAST(floor(avg(total_items) FILTER (state = 'COMPLETED') + 0.5) AS BIGINT) AS avg_items_per_session FROM progress""")
def _(t):
    return op.items(t.progress)


@q("d16_by_weekday_and_month", """
    SELECT 'weekday' AS kind, upper(dayname(time_started)) AS key, count(*) AS count FROM progress GROUP BY 2
    UNION ALL SELECT 'month', strftime(time_started, '%Y-%m'), count(*) FROM progress GROUP BY 2""")
def _(t):
    days = op.by_weekday(t.progress).select(F.lit("weekday").alias("kind"), F.col("weekday").alias("key"), "count")
    return days.unionByName(op.by_month(t.progress).select(F.lit("month").alias("kind"), F.col("month").alias("key"), "count"))


SIZE = """CASE WHEN {0} < 1024 THEN {0} || ' B'
  WHEN {0} < 1048576 THEN printf('%.1f KB', floor({0} / 1024.0::DOUBLE * 10 + 0.5) / 10)
  WHEN {0} < 1073741824 THEN printf('%.1f MB', floor({0} / 1048576.0::DOUBLE * 10 + 0.5) / 10)
  ELSE printf('%.1f GB', floor({0} / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END"""


@q("d17_file_stats", f"""
    WITH a AS (SELECT count(*) AS total_files, CAST(coalesce(sum(file_size) FILTER (file_size > 0), 0) AS BIGINT) AS total_file_size,
      avg(file_size) FILTER (file_size > 0) AS mean, count(*) FILTER (state = 'COMPLETED') AS successful_files,
      count(*) FILTER (state = 'ERROR') AS failed_files, count(DISTINCT series_id) AS files_per_series_count FROM files)
    SELECT total_files, total_file_size, successful_files, failed_files, files_per_series_count,
      floor(successful_files * 100.0::DOUBLE / (successful_files + failed_files) * 10 + 0.5) / 10 AS file_success_rate,
      CAST(floor(mean + 0.5) AS BIGINT) AS avg_file_size,
      {SIZE.format('total_file_size')} AS total_file_size_formatted,
      {SIZE.format('CAST(floor(mean) AS BIGINT)')} AS avg_file_size_formatted
    FROM a""")
def _(t):
    return op.file_stats(t.files)


@q("d17_file_states", "SELECT state, count(*) AS count FROM files GROUP BY 1")
def _(t):
    return op.file_states(t.files)


@q("d18_files_per_day", """
    SELECT strftime(processed_at, '%Y-%m-%d') AS day, count(*) AS count FROM files
    WHERE processed_at > TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 30 DAY GROUP BY 1""")
def _(t):
    return op.files_per_day(t.files, AS_OF_EVENTS)


@q("d19_sync_stats", """
    SELECT count(*) AS total_syncs, CAST(sum(total_files_count) AS BIGINT) AS total_files_tracked,
      floor(avg(total_files_count) * 10 + 0.5) / 10 AS avg_files_per_sync,
      floor(count(*) FILTER (sync_status = 'COMPLETED') * 100.0::DOUBLE / count(*) FILTER (sync_status IN ('COMPLETED', 'FAILED')) * 10 + 0.5) / 10 AS sync_health_rate,
      count(DISTINCT series_id) AS unique_series_synced
    FROM syncs""")
def _(t):
    return op.sync_stats(t.syncs)


@q("d19_sync_states", "SELECT sync_status, count(*) AS count FROM syncs GROUP BY 1")
def _(t):
    return op.sync_states(t.syncs)


@q("d20_issue_stats", """
    SELECT 'total' AS section, 'total_issues' AS key, CAST(count(*) AS DOUBLE) AS value FROM issues
    UNION ALL SELECT 'total', 'key_issues', count(*) FROM issues WHERE is_key_issue
    UNION ALL SELECT 'total', 'variant_issues', count(*) FROM issues WHERE is_variants
    UNION ALL SELECT 'total', 'total_collection_value', CAST(sum(current_value) AS DOUBLE) FROM issues
    UNION ALL SELECT 'condition', condition, count(*) FROM issues GROUP BY 2
    UNION ALL SELECT 'series', s.name, count(*) FROM issues i JOIN series s ON s.id = i.series_id GROUP BY 2""")
def _(t):
    return op.issue_stats(t.issues, t.series)


@q("d21_series_stats", """
    SELECT 'total' AS section, 'total_series' AS key, count(*) AS value FROM series
    UNION ALL SELECT 'total', 'linked_series', count(comic_vine_id) FROM series
    UNION ALL SELECT 'publisher', publisher, count(*) FROM series GROUP BY 2
    UNION ALL SELECT 'decade', (start_year // 10) * 10 || 's', count(*) FROM series GROUP BY 2""")
def _(t):
    return op.series_stats(t.series)


@q("d22_completion_eq", """
    SELECT count(*) FILTER (issues_available_count > 0 AND issues_owned_count = issues_available_count) AS completed,
      count(*) FILTER (issues_available_count > 0) AS total,
      CAST(floor(count(*) FILTER (issues_available_count > 0 AND issues_owned_count = issues_available_count) * 100.0::DOUBLE
        / count(*) FILTER (issues_available_count > 0) + 0.5) AS BIGINT) AS percentage FROM series_owned""")
def _(t):
    return op.completion_eq(t.series_owned)


@q("d23_dashboard", """
    WITH done AS (SELECT count(*) FILTER (issues_owned_count = issues_available_count) AS c, count(*) AS n FROM series_owned WHERE issues_available_count > 0),
    pub AS (SELECT coalesce(publisher, 'Unknown') AS name, count(*) AS n FROM series GROUP BY 1)
    SELECT (SELECT count(*) FROM series) AS total_series, (SELECT count(*) FROM issues) AS total_issues,
      (SELECT count(*) FROM pub) AS unique_publishers, (SELECT name FROM pub ORDER BY n DESC, name LIMIT 1) AS favorite_publisher,
      c AS completed_series, CAST(floor(c * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS completion_percentage FROM done""")
def _(t):
    return op.dashboard(t.series_owned, t.issues)


@q("d23_dashboard_publishers", """
    SELECT coalesce(publisher, 'Unknown') AS name, count(*) AS count,
      count(*)::DOUBLE / (SELECT count(*) FROM series) * 100 AS percentage FROM series GROUP BY 1""")
def _(t):
    return op.dashboard_publishers(t.series)


@q("d24_popular_publishers", "SELECT publisher, count(*) AS count FROM series GROUP BY 1")
def _(t):
    return op.popular_publishers(t.series)


@q("d25_total_value", """
    SELECT 'purchase' AS kind, NULL::BIGINT AS series_id, CAST(sum(purchase_price) AS DOUBLE) AS total FROM issues
    UNION ALL SELECT 'current', NULL, CAST(sum(current_value) AS DOUBLE) FROM issues
    UNION ALL SELECT 'series', series_id, CAST(sum(current_value) AS DOUBLE) FROM issues GROUP BY 2""")
def _(t):
    def pick(kind, df):
        return df.select(F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("series_id"), "total")

    per = op.total_value(t.issues, by="series_id").select(F.lit("series").alias("kind"), "series_id", "total")
    return pick("purchase", op.total_value(t.issues, "purchase")).unionByName(
        pick("current", op.total_value(t.issues))).unionByName(per)


@q("d26_owned_counts", "SELECT id, issues_owned_count FROM series_owned")
def _(t):
    return op.owned_counts(t.series, t.issues).select("id", "issues_owned_count")


@q("d27_completed_files", "SELECT series_id, count(*) AS count FROM files WHERE state = 'COMPLETED' GROUP BY 1")
def _(t):
    return op.completed_files(t.files)


@q("d28_avg_per_series", """
    SELECT 'all' AS kind, floor((SELECT count(*) FROM issues)::DOUBLE / count(*) * 10 + 0.5) / 10 AS average FROM series
    UNION ALL SELECT 'nonempty', floor(count(*)::DOUBLE / count(DISTINCT series_id) * 10 + 0.5) / 10 FROM issues""")
def _(t):
    both = op.avg_per_series(t.series, t.issues).withColumn("kind", F.lit("all"))
    return both.unionByName(op.avg_per_series(t.series, t.issues, True).withColumn("kind", F.lit("nonempty")))


@q("d29_five_year", f"""
    WITH d AS ({DECADES}), h AS (
      SELECT CAST(substr(decade, 1, 4) AS INT) AS y, CAST(ceil(count / 2.0) AS BIGINT) AS a, count AS c FROM d),
    p AS (SELECT y || '-' || substr(CAST(y + 4 AS VARCHAR), 3, 2) AS period, a AS count FROM h
      UNION ALL SELECT (y + 5) || '-' || substr(CAST(y + 9 AS VARCHAR), 3, 2), c - a FROM h)
    SELECT period, count, count::DOUBLE / (SELECT max(count) FROM p) * 100 AS percentage FROM p""")
def _(t):
    return op.five_year(op.decades(t.series))


@q("d30_top_publishers", f"""
    WITH b AS ({BREAKDOWN})
    SELECT name, issue_count, issue_count::DOUBLE / (SELECT max(issue_count) FROM b) * 100 AS percentage
    FROM b ORDER BY issue_count DESC, name LIMIT 8""")
def _(t):
    return op.top_publishers(op.publisher_breakdown(t.series, t.issues))


@q("d31_most_incomplete", f"""
    WITH l AS (SELECT id, name, issues_available_count - issues_owned_count AS missing, {R1.format(SHARE)} AS percentage FROM series_owned
      WHERE issues_available_count > 0 AND issues_owned_count < issues_available_count ORDER BY {SHARE}, id LIMIT 10)
    SELECT name, missing, percentage FROM l ORDER BY percentage, id LIMIT 8""")
def _(t):
    return op.most_incomplete(t.series_owned)


@q("d32_recent_count", """
    SELECT 'missing' AS kind, count(*) AS recent FROM missing_issues WHERE created_at >= TIMESTAMP '2001-12-01' - INTERVAL 7 DAY
    UNION ALL SELECT 'owned', count(*) FROM issues WHERE created_at >= TIMESTAMP '2001-12-01' - INTERVAL 7 DAY""")
def _(t):
    gaps = op.recent_count(t.missing_issues, AS_OF).withColumn("kind", F.lit("missing"))
    return gaps.unionByName(op.recent_count(t.issues, AS_OF).withColumn("kind", F.lit("owned")))


@q("d33_missing_summary", """
    SELECT CAST(min(expected_cover_date) AS VARCHAR) AS oldest,
      count(DISTINCT series_id) FILTER (series_id % 7 <> 0) AS series_count,
      (SELECT count(DISTINCT s.name || '/' || s.start_year) FROM missing_issues m JOIN series s ON s.id = m.series_id WHERE m.series_id % 7 = 0) AS ignored_groups
    FROM missing_issues""")
def _(t):
    return op.missing_summary(t.missing_issues, t.series, ignored(t))


@q("d34_release_counts", """
    SELECT count(*) FILTER (date_trunc('month', expected_cover_date) = DATE '2001-12-01') AS this_month,
      count(*) FILTER (expected_cover_date >= DATE '2001-12-01') AS upcoming, count(DISTINCT series_id) AS series_count
    FROM missing_issues WHERE NOT dismissed AND NOT is_resolved AND expected_cover_date >= DATE '2001-09-01'""")
def _(t):
    return op.release_counts(filters.new_releases(t.missing_issues, AS_OF), AS_OF)


@q("d35_group_missing", """
    WITH r AS (SELECT s.name || ' (' || s.start_year || ')' AS group_key, m.id, m.issue_number, m.expected_cover_date
      FROM missing_issues m JOIN series s ON s.id = m.series_id WHERE m.series_id % 7 <> 0)
    SELECT group_key, id, CAST(issue_number AS DOUBLE) AS number, count(*) OVER (PARTITION BY group_key) AS group_size,
      CAST(coalesce(first_value(expected_cover_date) OVER (PARTITION BY group_key ORDER BY CAST(issue_number AS INT), id), DATE '1970-01-01') AS VARCHAR) AS group_date
    FROM r""")
def _(t):
    grouped = op.group_missing(t.missing_issues, t.series, "count", ignored(t))
    return grouped.select("group_key", "id", "number", "group_size", F.col("group_date").cast("string").alias("group_date"))


@q("d36_group_releases", """
    SELECT id, strftime(expected_cover_date, '%Y-%m') AS month, strftime(expected_cover_date, '%B %Y') AS label
    FROM missing_issues WHERE expected_cover_date IS NOT NULL""")
def _(t):
    return op.group_releases(t.missing_issues).select("id", "month", "label")


@q("d36_month_counts", """
    SELECT strftime(expected_cover_date, '%Y-%m') AS month, count(*) AS count FROM missing_issues
    WHERE expected_cover_date IS NOT NULL GROUP BY 1""")
def _(t):
    return op.month_counts(t.missing_issues)


@q("d37_read_progress", """
    SELECT series_id, count(*) FILTER (read) AS read_count,
      CAST(floor(count(*) FILTER (read) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS read_percentage FROM issues GROUP BY 1""")
def _(t):
    return op.read_progress(t.issues)


@q("d38_cache_stats", """
    WITH c AS (SELECT count(*) FILTER (event_type = 'view') AS mh, count(*) FILTER (event_type = 'click') AS mm,
      count(*) FILTER (event_type = 'purchase') AS dh, count(*) FILTER (event_type = 'error') AS dm FROM events),
    f AS (SELECT count(*) AS n, count(*) FILTER (sift_count > 0) AS s, count(*) FILTER (orb_count > 0) AS o,
      count(*) FILTER (akaze_count > 0) AS a, count(*) FILTER (kaze_count > 0) AS k FROM features)
    SELECT (SELECT count(*) FROM images) AS cached_images_count, (SELECT sum(file_size)::DOUBLE / 1048576.0::DOUBLE FROM images) AS total_disk_usage_mb,
      f.n AS cached_features_count, f.s AS sift_features_count, f.o AS orb_features_count, f.a AS akaze_features_count, f.k AS kaze_features_count,
      mh + mm + dh + dm AS total_requests, (mh + dh)::DOUBLE / (mh + mm + dh + dm) * 100 AS hit_rate,
      mh::DOUBLE / (mh + mm + dh + dm) * 100 AS memory_hit_rate
    FROM c, f""")
def _(t):
    counters = t.events.agg(*[
        F.count_if(F.col("event_type") == kind).alias(name)
        for kind, name in (("view", "memory_hits"), ("click", "memory_misses"), ("purchase", "db_hits"), ("error", "db_misses"))
    ])
    return op.cache_stats(t.images, t.features, counters)


@q("d39_status_counts", """
    SELECT count(*) FILTER (state = 'PROCESSING') AS active, count(*) FILTER (state = 'PROCESSING') AS processing, 0::BIGINT AS queued,
      count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'ERROR') AS failed FROM progress""")
def _(t):
    return op.status_counts(t.progress)


@q("d40_barcode_outcomes", """
    WITH r AS (SELECT id % 13 = 0 AS f, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS b, id % 17 = 0 AS s FROM series)
    SELECT count(*) FILTER (NOT f) AS series_processed, count(*) FILTER (NOT f AND b IS NOT NULL AND NOT s) AS barcodes_found,
      count(*) FILTER (NOT f AND b IS NULL) AS barcodes_not_found, count(*) FILTER (f OR (b IS NOT NULL AND s)) AS errors FROM r""")
def _(t):
    runs = t.series.selectExpr(
        "id % 13 = 0 AS fetch_error", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id AS STRING) END AS barcode", "id % 17 = 0 AS save_error")
    return op.barcode_outcomes(runs)


@q("d41_collection_report", f"""
    SELECT 'readStats' AS section, 'read' AS key, CAST(count(*) FILTER (read) AS VARCHAR) AS value FROM issues
    UNION ALL SELECT 'readStats', 'unread', CAST(count(*) FILTER (NOT read) AS VARCHAR) FROM issues
    UNION ALL SELECT 'conditionBreakdown', condition || '.count', CAST(count(*) AS VARCHAR) FROM issues GROUP BY condition
    UNION ALL SELECT 'decadeBreakdown', decade || '.count', CAST(count AS VARCHAR) FROM ({DECADES})
    UNION ALL SELECT 'fileStates', state || '.count', CAST(count(*) AS VARCHAR) FROM files GROUP BY state
    UNION ALL SELECT 'syncStates', sync_status || '.count', CAST(count(*) AS VARCHAR) FROM syncs GROUP BY sync_status
    UNION ALL SELECT 'sessionSuccess', 'failed_sessions', CAST(count(*) AS VARCHAR) FROM progress WHERE state = 'ERROR'
    UNION ALL SELECT 'syncsNeedingAttention', id || '.' || c, CASE c WHEN 'series_id' THEN CAST(series_id AS VARCHAR) ELSE sync_status END
      FROM syncs, (SELECT unnest(['series_id', 'sync_status']) AS c)
      WHERE sync_status = 'FAILED' OR (sync_status = 'IN_PROGRESS' AND updated_at < TIMESTAMP '2024-01-31 23:00:00')
    UNION ALL SELECT 'publisherBreakdown', name || '.issue_count', CAST(issue_count AS VARCHAR) FROM ({BREAKDOWN})""")
def _(t):
    # The sections whose text SQL prints alike are compared; the whole report
    # runs as `d41_full_report`.
    report = full_report(t)
    same = F.col("section").isin(
        "conditionBreakdown", "decadeBreakdown", "fileStates", "syncStates", "syncsNeedingAttention")
    picked = (
        same
        | ((F.col("section") == "readStats") & F.col("key").isin("read", "unread"))
        | ((F.col("section") == "sessionSuccess") & (F.col("key") == "failed_sessions"))
        | ((F.col("section") == "publisherBreakdown") & F.col("key").endswith(".issue_count"))
    )
    return report.filter(picked)


def full_report(t):
    tables = {name: getattr(t, name) for name in ("issues", "missing_issues", "progress", "files", "syncs")}
    return collection_report({**tables, "series": t.series_owned}, AS_OF_EVENTS)


@q("d41_full_report")
def _(t):
    return full_report(t)

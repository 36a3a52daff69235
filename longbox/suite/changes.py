"""Queries over the change operators (inventory section 2.6)."""

from functools import reduce

from pyspark.sql import functions as F

from longbox.operators import changes as op
from longbox.plans.bindings import AS_OF, AS_OF_EVENTS
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add


def both(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def snapshots(t):
    """Two progress snapshots: some rows gone, some new, some changed."""
    old = t.progress.filter("id % 10 <> 0")
    new = t.progress.filter("id % 10 <> 1").withColumn(
        "percentage_complete", F.expr("CASE WHEN id % 10 = 2 THEN percentage_complete + 1 ELSE percentage_complete END"))
    return old, new


@q("f01_snapshot_diff", """
    SELECT session_id, CASE id % 10 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'update' END AS change
    FROM progress WHERE id % 10 IN (0, 1, 2)""")
def _(t):
    return op.snapshot_diff(*snapshots(t), "session_id")


@q("f02_snapshot_merge", """
    SELECT id, percentage_complete + CASE WHEN id % 10 = 2 THEN 1 ELSE 0 END AS percentage_complete FROM progress WHERE id % 10 <> 0""")
def _(t):
    return op.snapshot_merge(*snapshots(t), "session_id").select("id", "percentage_complete")


@q("f03_insert_issues", """
    WITH r AS (SELECT l_orderkey * 8 + l_linenumber + 100000000 AS id, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'Given' END AS title, l_linenumber AS n FROM lineitem)
    SELECT 'issue' AS kind, r.id, CASE WHEN title = '' THEN (SELECT name FROM series WHERE id = 9) || ' #' || n ELSE title END AS label FROM r
    UNION ALL SELECT 'issue', id, title FROM issues
    UNION ALL SELECT 'series', id, CAST(issues_owned_count + CASE WHEN id = 9 THEN (SELECT count(*) FROM r) ELSE 0 END AS VARCHAR) FROM series_owned
    UNION ALL SELECT 'missing', m.id, CAST(m.is_resolved OR (series_id = 9 AND comic_vine_id IN (SELECT '9-' || n FROM r)) AS VARCHAR) FROM missing_issues m""")
def _(t):
    # Every line row is requested once more, all of them for series 9.
    requests = t.lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber + 100000000 AS id", "9L AS series_id", "CAST(l_linenumber AS STRING) AS issue_number",
        "CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'Given' END AS title", "concat('9-', l_linenumber) AS comic_vine_id",
        "concat('new/', l_orderkey) AS uploaded_image_url", "md5('x') AS content_hash")
    hashes = t.lineitem.selectExpr("concat(l_suppkey, '/', l_orderkey, '.jpg') AS uploaded_image_url", "md5('y') AS content_hash")
    done = op.insert_issues(requests, t.issues, t.series, t.missing_issues, hashes)
    return both(
        done["issues"].select(F.lit("issue").alias("kind"), "id", F.col("title").alias("label")),
        done["series"].select(F.lit("series").alias("kind"), "id", F.col("issues_owned_count").cast("string").alias("label")),
        done["missing_issues"].select(F.lit("missing").alias("kind"), "id", F.col("is_resolved").cast("string").alias("label")))


@q("f04_delete_issues", """
    WITH asked AS (SELECT o_orderkey * 8 + 1 AS id FROM orders),
    gone AS (SELECT id FROM asked WHERE id IN (SELECT id FROM issues))
    SELECT 'series' AS kind, s.id, count(i.id) AS count FROM series s LEFT JOIN (SELECT * FROM issues WHERE id NOT IN (SELECT id FROM asked)) i ON i.series_id = s.id GROUP BY 2
    UNION ALL SELECT 'successful', NULL, (SELECT count(*) FROM gone)
    UNION ALL SELECT 'failed', NULL, (SELECT count(*) FROM asked) - (SELECT count(*) FROM gone)""")
def _(t):
    done = op.delete_issues(t.orders.selectExpr("o_orderkey * 8 + 1 AS id"), t.issues, t.series)
    counts = done["counts"].unpivot([], ["successful", "failed"], "kind", "count")
    return both(
        done["series"].select(F.lit("series").alias("kind"), "id", F.col("issues_owned_count").alias("count")),
        counts.select("kind", F.lit(None).cast("bigint").alias("id"), "count"))


@q("f05_update_rows", """
    SELECT id, CASE WHEN id % 5 = 0 THEN 'New ' || id ELSE name END AS name, CASE WHEN id % 5 = 0 THEN NULL ELSE publisher END AS publisher FROM series""")
def _(t):
    changes = t.series.filter("id % 5 = 0").selectExpr("id", "concat('New ', id) AS name", "CAST(NULL AS STRING) AS publisher")
    return op.update_rows(t.series, changes, "id").select("id", "name", "publisher")


@q("f05_update_uploads", """
    SELECT id, CASE id % 3 WHEN 0 THEN 's/' || id WHEN 1 THEN 't/' || id ELSE 'u/' || id END AS uploaded_image_url, id % 3 = 2 AS is_variants FROM series""")
def _(t):
    rows = t.series.selectExpr("id", "'' AS uploaded_image_url", "true AS is_variants")
    changes = t.series.selectExpr(
        "id", "CASE CAST(id % 3 AS INT) WHEN 0 THEN concat('http://h/stored_images/s/', id) WHEN 1 THEN concat('/api/image/t/', id) ELSE concat('u/', id) END AS uploaded_image_url",
        "CASE WHEN id % 3 = 2 THEN true END AS is_variants")
    return op.update_rows(rows, changes, "id", {"is_variants": False})


@q("f06_set_flag", """
    SELECT 'toggle' AS kind, id, CASE WHEN id % 4 = 0 THEN NOT dismissed ELSE dismissed END AS flag FROM progress
    UNION ALL SELECT 'set', id, is_resolved OR id % 3 = 0 FROM missing_issues""")
def _(t):
    flipped = op.set_flag(t.progress, t.progress.filter("id % 4 = 0"), "dismissed", "toggle")
    solved = op.set_flag(t.missing_issues, t.missing_issues.filter("id % 3 = 0"), "is_resolved", True)
    return both(
        flipped.select(F.lit("toggle").alias("kind"), "id", F.col("dismissed").alias("flag")),
        solved.select(F.lit("set").alias("kind"), "id", F.col("is_resolved").alias("flag")))


@q("f07_variants", """
    SELECT 'add' AS kind, id, variant_count + CASE WHEN n = 2 THEN 1 ELSE 0 END AS variants, variant_count > 0 AS is_variants FROM catalogue_issues
    UNION ALL SELECT 'remove', id, variant_count - CASE WHEN n = 2 AND variant_count > 0 THEN 1 ELSE 0 END,
      CASE WHEN n = 2 THEN variant_count > 1 ELSE variant_count > 0 END FROM catalogue_issues""")
def _(t):
    rows = t.catalogue_issues.selectExpr("id", "issue_number", "variants AS variant_covers", "size(variants) > 0 AS is_variants")
    second = rows.filter("issue_number = '2'")
    extra = second.selectExpr("id", "named_struct('id', concat(id, 'x'), 'original_url', 'u', 'caption', 'c', 'image_tags', 't') AS variant")
    more = op.variants_add(rows, extra)
    fewer = op.variants_remove(rows, second.selectExpr("id", "concat('v', id, '-1') AS variant_id"))
    return both(*[
        df.select(F.lit(kind).alias("kind"), "id", F.size("variant_covers").cast("bigint").alias("variants"), "is_variants")
        for kind, df in (("add", more), ("remove", fewer))])


@q("f08_series_from_catalogue", """
    SELECT name, start_year, CASE WHEN end_year > 1990 THEN end_year END AS end_year, CAST(id AS VARCHAR) AS comic_vine_id, CAST(id AS VARCHAR) AS ids, issues_available_count FROM series""")
def _(t):
    rows = t.series.selectExpr(
        "name", "description", "publisher", "start_year", "CASE WHEN end_year > 1990 THEN end_year ELSE 0 END AS end_year", "image_url",
        "CAST(id AS STRING) AS id", "issues_available_count AS issue_count")
    return op.series_from_catalogue(rows).select(
        "name", "start_year", "end_year", "comic_vine_id", F.array_join("comic_vine_ids", ",").alias("ids"), "issues_available_count")


@q("f09_issues_from_catalogue", """
    SELECT series_id, issue_number, name AS title, id AS comic_vine_id, CAST(TRY_CAST(cover_date AS DATE) AS VARCHAR) AS cover_date, variant_count AS variants
    FROM catalogue_issues WHERE series_id % 2 = 0""")
def _(t):
    made = op.issues_from_catalogue(t.catalogue_issues, t.series.filter("id % 2 = 0"))
    return made.select(
        "series_id", "issue_number", "title", "comic_vine_id", F.col("cover_date").cast("string").alias("cover_date"),
        F.size("variant_covers").cast("bigint").alias("variants"))


@q("f10_repair_primary", """
    SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || id WHEN 2 THEN 'b' || id ELSE 'a' || id END AS comic_vine_id FROM series""")
def _(t):
    rows = t.series.selectExpr(
        "id", "CASE CAST(id % 4 AS INT) WHEN 1 THEN 'lost' WHEN 2 THEN concat('b', id) WHEN 0 THEN 'old' END AS comic_vine_id",
        "CASE WHEN id % 4 = 0 THEN array() ELSE array(concat('a', id), concat('b', id)) END AS comic_vine_ids")
    return op.repair_primary(rows).select("id", "comic_vine_id")


@q("f11_mark_replayed", """
    WITH s AS (SELECT DISTINCT session_id FROM files WHERE CAST(session_id AS BIGINT) % 4 = 0)
    SELECT 'progress' AS kind, session_id, CASE WHEN session_id IN (SELECT session_id FROM s) THEN 'REPLAYED' ELSE state END AS state FROM progress
    UNION ALL SELECT 'progress', 'again-' || session_id, 'PROCESSING' FROM s
    UNION ALL SELECT 'files', session_id, CASE WHEN session_id IN (SELECT session_id FROM s) THEN 'REPLAYED' ELSE state END FROM files""")
def _(t):
    sessions = t.progress.filter("id % 4 = 0").selectExpr("session_id", "concat('again-', session_id) AS new_session_id")
    done = op.mark_replayed(t.progress, t.files, sessions, AS_OF)
    return both(*[df.select(F.lit(kind).alias("kind"), "session_id", "state") for kind, df in done.items()])


@q("f12_complete_files", """
    SELECT 'file' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN 'stored_' || id ELSE file_name END AS label,
      CASE WHEN id % 3 = 0 THEN 'COMPLETED' ELSE state END AS state FROM files
    UNION ALL SELECT 'reject', NULL, 'gone' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bad_request' ELSE 'not_found' END FROM documents WHERE doc_id % 3 = 1""")
def _(t):
    callbacks = t.documents.filter("doc_id % 3 <> 2").selectExpr(
        "CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN NULL ELSE CAST(doc_id % 50 AS STRING) END AS session_id",
        "CASE WHEN doc_id % 3 = 0 THEN concat(doc_id, CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END) ELSE concat('gone', doc_id) END AS original_file_name",
        "md5('h') AS file_hash", "concat('stored_', doc_id) AS stored_file_name")
    done, rejects = op.complete_files(t.files, callbacks, AS_OF_EVENTS)
    return both(
        done.select(F.lit("file").alias("kind"), F.col("id").cast("string").alias("id"), F.col("file_name").alias("label"), "state"),
        rejects.select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("file_name").alias("label"), F.col("error").alias("state")))


@q("f13_record_sync", """
    WITH latest AS (SELECT id FROM syncs QUALIFY row_number() OVER (PARTITION BY series_id, folder_path ORDER BY updated_at DESC, id DESC) = 1),
    r AS (SELECT s.*, s.id IN (SELECT id FROM latest) AS hit, series_id % 3 AS k FROM syncs s)
    SELECT id, CASE WHEN NOT hit THEN sync_status WHEN k = 0 THEN 'FAILED' WHEN k = 1 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS sync_status,
      CASE WHEN hit AND k = 1 THEN 77 ELSE total_files_count END AS total_files_count,
      CASE WHEN NOT hit THEN error_message WHEN k = 0 THEN 'down' END AS error_message,
      CAST(CASE WHEN hit AND k = 1 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_sync_timestamp END AS VARCHAR) AS last_sync_timestamp
    FROM r
    UNION ALL SELECT NULL, 'IN_PROGRESS', NULL, NULL, NULL FROM nation WHERE n_nationkey % 3 = 2
    UNION ALL SELECT NULL, 'COMPLETED', 77, NULL, '2024-02-01 00:00:00' FROM nation WHERE n_nationkey % 3 = 1""")
def _(t):
    run = ("CASE CAST(series_id % 3 AS INT) WHEN 1 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status",
           "CASE WHEN series_id % 3 = 1 THEN 77 END AS total_files", "'s' AS session_id", "CASE WHEN series_id % 3 = 0 THEN 'down' END AS error")
    known = t.syncs.select("series_id", "folder_path").distinct().selectExpr("series_id", "folder_path", *run)
    unseen = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS series_id", "'elsewhere' AS folder_path").selectExpr("series_id", "folder_path", *run)
    done = op.record_sync(t.syncs, known.unionByName(unseen), AS_OF_EVENTS)
    return done.select(
        "id", "sync_status", F.col("total_files_count").cast("bigint").alias("total_files_count"), "error_message",
        F.col("last_sync_timestamp").cast("string").alias("last_sync_timestamp"))


@q("f14_distinct_sorted", "SELECT DISTINCT publisher FROM series WHERE publisher IS NOT NULL AND publisher <> ''")
def _(t):
    return op.distinct_sorted(t.series, "publisher")


@q("f15_combine_series", """
    WITH r AS (SELECT id // 3 AS grp, id % 3 AS pos, * FROM series),
    a AS (SELECT grp, min(start_year) AS start_year, max(end_year) AS end_year, CAST(sum(issues_available_count) AS BIGINT) AS issues_available_count,
      string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, min(id) AS first_id, max(CASE WHEN grp % 2 = 0 AND pos = 1 THEN id END) AS keep FROM r GROUP BY 1)
    SELECT a.grp, a.start_year, CAST(a.end_year AS BIGINT) AS end_year, a.issues_available_count, a.ids, CAST(coalesce(keep, first_id) AS VARCHAR) AS comic_vine_id, s.name
    FROM a JOIN series s ON s.id = coalesce(keep, first_id)""")
def _(t):
    rows = t.series.selectExpr(
        "floor(id / 3) AS grp", "id % 3 AS pos", "CAST(id AS STRING) AS id", "start_year", "end_year", "issues_available_count AS issue_count",
        "name", "description", "publisher", "CASE WHEN floor(id / 3) % 2 = 0 THEN CAST(floor(id / 3) * 3 + 1 AS STRING) ELSE 'gone' END AS current_primary")
    done = op.combine_series(rows, "grp")
    return done.select(
        "grp", "start_year", F.col("end_year").cast("bigint").alias("end_year"), "issues_available_count",
        F.array_join("comic_vine_ids", ",").alias("ids"), "comic_vine_id", "name")

"""Queries over the filter operators (inventory section 2.2)."""

from pyspark.sql import functions as F

from longbox.operators import filters as op
from longbox.plans.bindings import AS_OF
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add


@q("b01_search_series", "SELECT id, name, publisher FROM series WHERE lower(name) LIKE '%ring%' OR lower(publisher) LIKE '%ring%'")
def _(t):
    return op.search_series(t.series, "RING").select("id", "name", "publisher")


@q("b02_search_text", "SELECT id, series_id, title, description FROM issues WHERE lower(title) LIKE '%issue 12%' OR lower(description) LIKE '%issue 12%'")
def _(t):
    return op.search_text(t.issues, "Issue 12").select("id", "series_id", "title", "description")


@q("b03_search_issues", """
    SELECT i.id, i.series_id, s.name AS series_name, i.issue_number, CAST(i.current_value AS DOUBLE) AS value
    FROM issues i JOIN series s ON s.id = i.series_id
    WHERE lower(i.title) LIKE '%red%' OR lower(s.name) LIKE '%red%' OR lower(i.issue_number) LIKE '%red%'
    ORDER BY i.id, i.series_id, value LIMIT 40""")
def _(t):
    found = op.search_issues(
        t.issues.withColumn("value", F.col("current_value").cast("double")), t.series, "red", 40,
        ["id", "series_id", "value"])
    return found.select("id", "series_id", "series_name", "issue_number", "value")


@q("b04_advanced_search", "SELECT id, name, publisher, start_year FROM series WHERE lower(publisher) LIKE '%brand#1%' AND start_year >= 1960 AND start_year <= 1980")
def _(t):
    return op.advanced_search(t.series, "brand#1", 1960, 1980).select("id", "name", "publisher", "start_year")


@q("b05_by_publisher_and_year", "SELECT id, name FROM series WHERE publisher = 'Brand#3' UNION ALL SELECT id, name FROM series WHERE start_year = 1975")
def _(t):
    return op.by_eq(t.series, "publisher", "Brand#3").unionByName(
        op.by_eq(t.series, "start_year", 1975)).select("id", "name")


@q("b06_by_decade", "SELECT id, name, start_year FROM series WHERE start_year BETWEEN 1970 AND 1979 ORDER BY start_year, id")
def _(t):
    return op.by_decade(t.series, 1970, 1979).select("id", "name", "start_year")


@q("b07_linked", "SELECT id, comic_vine_id FROM series WHERE comic_vine_id IS NOT NULL")
def _(t):
    return op.linked(t.series).select("id", "comic_vine_id")


@q("b08_key_and_variant_issues", """
    SELECT 'key' AS kind, id, series_id FROM issues WHERE is_key_issue
    UNION ALL SELECT 'variant', id, series_id FROM issues WHERE is_variants""")
def _(t):
    key = op.key_issues(t.issues).select(F.lit("key").alias("kind"), "id", "series_id")
    return key.unionByName(op.variant_issues(t.issues).select(F.lit("variant").alias("kind"), "id", "series_id"))


@q("b09_by_condition", "SELECT id, series_id, condition FROM issues WHERE condition = 'A'")
def _(t):
    return op.by_condition(t.issues, "A").select("id", "series_id", "condition")


@q("b10_price_between", "SELECT id, series_id, CAST(purchase_price AS DOUBLE) AS purchase_price FROM issues WHERE purchase_price BETWEEN 5000 AND 9000")
def _(t):
    return op.price_between(t.issues, 5000, 9000).select(
        "id", "series_id", F.col("purchase_price").cast("double").alias("purchase_price"))


@q("b11_profitable", "SELECT id, series_id, CAST(current_value - purchase_price AS DOUBLE) AS gain FROM issues WHERE current_value > purchase_price")
def _(t):
    return op.profitable(t.issues).select(
        "id", "series_id", (F.col("current_value") - F.col("purchase_price")).cast("double").alias("gain"))


@q("b12_missing_text", """
    SELECT least(50, count(*)) AS processed, count(*) AS total, count(*) - least(50, count(*)) AS remaining
    FROM issues WHERE description IS NULL OR description = ''""")
def _(t):
    return op.missing_text_counts(t.issues)


@q("b12_missing_text_of_series", """
    SELECT id, series_id, 'series' AS scope FROM issues WHERE series_id = 17 AND description IS NULL
    UNION ALL SELECT * FROM (SELECT id, series_id, 'batch' FROM issues WHERE description IS NULL OR description = ''
      ORDER BY id, series_id LIMIT 50)""")
def _(t):
    one = op.missing_text(t.issues, 17).select("id", "series_id", F.lit("series").alias("scope"))
    batch = op.missing_text_batch(t.issues.select("id", "series_id", "description"), ["id", "series_id"])
    return one.unionByName(batch.select("id", "series_id", F.lit("batch").alias("scope")))


@q("b12_fill_missing_text", """
    SELECT i.id, i.series_id, CASE WHEN i.description IS NULL OR i.description = '' THEN
      CASE WHEN i.title IS NOT NULL AND i.title <> '' THEN 'In "' || i.title || '", '
        ELSE 'In issue #' || i.issue_number || ' of ' || s.name || ', ' END
      || 'the story continues with new adventures and challenges. This issue promises exciting developments in the ongoing narrative. Published '
      || CAST(i.cover_date AS VARCHAR) || '.' ELSE i.description END AS description
    FROM issues i JOIN series s ON s.id = i.series_id""")
def _(t):
    return op.fill_missing_text(t.issues, t.series).select("id", "series_id", "description")


@q("b13_lookup", """
    SELECT id, series_id, comic_vine_id FROM issues
    WHERE comic_vine_id IN (SELECT comic_vine_id FROM missing_issues WHERE dismissed)""")
def _(t):
    keys = t.missing_issues.filter("dismissed")
    return op.lookup(t.issues, keys, ["comic_vine_id"]).select("id", "series_id", "comic_vine_id")


@q("b14_gcd_filter", """
    SELECT 'name' AS kind, id, name AS label FROM gcd_series WHERE lower(name) LIKE '%ring%'
    UNION ALL SELECT 'year', id, name FROM gcd_series WHERE year_began = 1977
    UNION ALL SELECT 'both', id, name FROM gcd_series WHERE lower(name) LIKE '%ring%' AND year_began = 1977
    UNION ALL SELECT 'published', id, publication_date FROM gcd_issues WHERE lower(publication_date) LIKE '%march 2001%'
    UNION ALL SELECT 'title', id, title FROM gcd_issues WHERE lower(title) LIKE '%story 7%'""")
def _(t):
    def pick(kind, df, label):
        return df.select(F.lit(kind).alias("kind"), "id", F.col(label).alias("label"))

    return (
        pick("name", op.gcd_filter(t.gcd_series, name="ring"), "name")
        .unionByName(pick("year", op.gcd_filter(t.gcd_series, year=1977), "name"))
        .unionByName(pick("both", op.gcd_filter(t.gcd_series, name="ring", year=1977), "name"))
        .unionByName(pick("published", op.gcd_filter(t.gcd_issues, publication_date="march 2001"), "publication_date"))
        .unionByName(pick("title", op.gcd_filter(t.gcd_issues, title="STORY 7"), "title"))
    )


@q("b15_gcd_by_series_year", """
    SELECT i.id, i.series_id, i.key_date FROM gcd_issues i
    WHERE i.key_date LIKE '%1999%' AND i.series_id IN (SELECT id FROM gcd_series WHERE lower(name) LIKE '%bolt%')""")
def _(t):
    return op.gcd_by_series_year(t.gcd_issues, t.gcd_series, "bolt", "1999").select("id", "series_id", "key_date")


@q("b16_gcd_active", """
    SELECT id, series_id, sort_code FROM gcd_issues WHERE deleted = 0 AND series_id = 1000042
    UNION ALL SELECT id, series_id, sort_code FROM gcd_issues WHERE deleted = 0
      AND series_id IN (SELECT id FROM gcd_series WHERE name = 'RED RING')""")
def _(t):
    one = op.gcd_active(t.gcd_issues, series_id=1000042)
    named = op.gcd_active(t.gcd_issues, t.gcd_series, name="RED RING")
    return one.unionByName(named).select("id", "series_id", F.col("sort_code").cast("bigint").alias("sort_code"))


@q("b17_gcd_in", "SELECT id, series_id, number FROM gcd_issues WHERE series_id IN (1000001, 1000002, 1000003, 1000050)")
def _(t):
    return op.gcd_in(t.gcd_issues, [1000001, 1000002, 1000003, 1000050]).select("id", "series_id", "number")


@q("b18_not_dismissed_unresolved", """
    SELECT id, comic_vine_id, dismissed, is_resolved FROM missing_issues WHERE NOT dismissed AND NOT is_resolved""")
def _(t):
    return op.unresolved(op.not_dismissed(t.missing_issues)).select("id", "comic_vine_id", "dismissed", "is_resolved")


@q("b19_new_releases", """
    SELECT id, comic_vine_id, CAST(expected_cover_date AS VARCHAR) AS expected_cover_date FROM missing_issues
    WHERE NOT dismissed AND NOT is_resolved AND expected_cover_date >= DATE '2001-09-01'
    ORDER BY expected_cover_date DESC, id""")
def _(t):
    return op.new_releases(t.missing_issues, AS_OF).select(
        "id", "comic_vine_id", F.col("expected_cover_date").cast("string").alias("expected_cover_date"))


@q("b20_recent_sessions", """
    SELECT id, state FROM progress WHERE (time_started >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY
      OR time_finished >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY) AND NOT dismissed""")
def _(t):
    return op.recent_sessions(t.progress, "2001-06-01 00:00:00").select("id", "state")


@q("b21_ledger", """
    SELECT 'series' AS kind, id, file_path FROM files WHERE series_id = 3
    UNION ALL SELECT 'state', id, file_path FROM files WHERE state = 'ERROR'
    UNION ALL SELECT 'paths', NULL, file_path FROM files WHERE series_id = 3 AND state = 'COMPLETED'
    UNION ALL SELECT 'old', id, file_path FROM files WHERE processed_at < TIMESTAMP '2024-01-05 00:00:00'
    UNION ALL SELECT 'session', id, file_path FROM files WHERE session_id = '7'""")
def _(t):
    def pick(kind, df):
        return df.select(F.lit(kind).alias("kind"), "id", "file_path")

    paths = op.completed_paths(t.files, 3).withColumn("id", F.lit(None).cast("bigint"))
    return (
        pick("series", op.ledger(t.files, series=3))
        .unionByName(pick("state", op.ledger(t.files, state="ERROR")))
        .unionByName(pick("paths", paths))
        .unionByName(pick("old", op.ledger(t.files, before="2024-01-05 00:00:00")))
        .unionByName(pick("session", op.ledger(t.files, session="7")))
    )


@q("b22_sync_filter", """
    SELECT 'status' AS kind, id FROM syncs WHERE sync_status = 'FAILED'
    UNION ALL SELECT 'old', id FROM syncs WHERE last_sync_timestamp < TIMESTAMP '2024-01-03 00:00:00'""")
def _(t):
    failed = op.sync_filter(t.syncs, status="FAILED").select(F.lit("status").alias("kind"), "id")
    return failed.unionByName(
        op.sync_filter(t.syncs, before="2024-01-03 00:00:00").select(F.lit("old").alias("kind"), "id"))


@q("b23_image_files", "SELECT id, file_name FROM files WHERE lower(file_name) LIKE '%.jpg'")
def _(t):
    return op.image_files(t.files).select("id", "file_name")


@q("b24_list_filter", """
    SELECT id, name, publisher FROM series_owned WHERE lower(name) LIKE '%e%' AND publisher <> ''
      AND issues_available_count > 0 AND issues_owned_count = issues_available_count
    UNION ALL SELECT id, name, publisher FROM series_owned WHERE publisher = 'Brand#7'""")
def _(t):
    done = op.list_filter(t.series_owned, term="E", completed=True)
    return done.unionByName(op.list_filter(t.series_owned, publisher="Brand#7")).select("id", "name", "publisher")


@q("b25_text_filter", """
    SELECT m.id, s.name AS series_name FROM missing_issues m LEFT JOIN series s ON s.id = m.series_id
    WHERE lower(s.name) LIKE '%brand#12%' OR lower(m.issue_number) LIKE '%brand#12%'
      OR lower(m.expected_issue_name) LIKE '%brand#12%' OR lower(s.publisher) LIKE '%brand#12%'""")
def _(t):
    names = t.series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"), "publisher")
    joined = t.missing_issues.join(names, "series_id", "left")
    return op.text_filter(joined, "  Brand#12 ").select("id", "series_name")


@q("b26_number_range", "SELECT id, issue_number FROM catalogue_issues WHERE n BETWEEN 3 AND 5")
def _(t):
    return op.number_range(t.catalogue_issues, 3, 5).select("id", "issue_number")


@q("b28_validate", """
    SELECT id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title is required' ELSE '' END
      || CASE WHEN length(description) > 7 THEN '|description is longer than 7' ELSE '' END AS errors
    FROM issues WHERE title IS NULL OR trim(title) = '' OR length(description) > 7""")
def _(t):
    _ok, bad = op.validate(t.issues, ["title"], {"description": 7})
    first = F.when(F.array_contains("errors", "title is required"), "title is required").otherwise("")
    second = F.when(F.array_contains("errors", "description is longer than 7"), "|description is longer than 7").otherwise("")
    return bad.select("id", F.concat(first, second).alias("errors"))


@q("b29_folder_filter", """
    SELECT id, folder FROM (SELECT id, id || '_' || replace(lower(name), ' ', '_') AS folder FROM series)
    WHERE CAST(id AS VARCHAR) LIKE '%d ri%' OR folder LIKE '%d ri%' OR replace(regexp_replace(folder, '^[0-9]+_', ''), '_', ' ') LIKE '%d ri%'""")
def _(t):
    folders = t.series.select(
        "id", F.concat("id", F.lit("_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))).alias("name"))
    return op.folder_filter(folders, "D ri").select("id", F.col("name").alias("folder"))


@q("b30_status_filter", """
    SELECT 'processing' AS kind, id FROM progress WHERE state = 'PROCESSING'
    UNION ALL SELECT 'finished', id FROM progress WHERE state IN ('COMPLETED', 'ERROR')""")
def _(t):
    active = op.status_filter(t.progress, "processing").select(F.lit("processing").alias("kind"), "id")
    return active.unionByName(op.finished_ids(t.progress).select(F.lit("finished").alias("kind"), "id"))



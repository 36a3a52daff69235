"""Queries over the ranking operators (inventory section 2.5)."""

from pyspark.sql import functions as F

from longbox.functions.natural import natural_key_a, natural_key_b
from longbox.operators import ranking as op
from longbox.plans.bindings import AS_OF_EVENTS
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add
TIES = ["id", "series_id", "value"]


def text(column):
    return F.col(column).cast("string").alias(column)


def valued(issues):
    return issues.withColumn("value", F.col("current_value").cast("double"))


@q("e01_newest_series", "SELECT id, name, CAST(created_at AS VARCHAR) AS created_at FROM series ORDER BY series.created_at DESC, id LIMIT 5")
def _(t):
    return op.newest_series(t.series).select("id", "name", text("created_at"))


@q("e02_newest_issues", """
    SELECT i.id, s.name AS series_name, i.issue_number, CAST(i.current_value AS DOUBLE) AS value FROM issues i LEFT JOIN series s ON s.id = i.series_id
    ORDER BY i.created_at DESC, i.id, i.series_id, value LIMIT 8""")
def _(t):
    return op.newest_issues(valued(t.issues), t.series, ties=TIES).select("id", "series_name", "issue_number", "value")


HMS = """CASE WHEN {0} >= 3600 THEN CASE WHEN {0} < 36000 THEN '0' ELSE '' END || CAST({0} // 3600 AS VARCHAR) || ':' ELSE '' END
  || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"""


@q("e03_recent_runs", f"""
    SELECT * FROM (SELECT 'session' AS kind, id, state AS status, {HMS.format("date_diff('second', time_started, coalesce(time_finished, TIMESTAMP '2024-02-01 00:00:00'))")} AS duration
      FROM progress ORDER BY time_started DESC, id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'sync', id, sync_status, NULL FROM syncs ORDER BY last_sync_timestamp DESC, id LIMIT 10)""")
def _(t):
    runs = op.recent_sessions(t.progress, AS_OF_EVENTS).select(
        F.lit("session").alias("kind"), "id", F.col("state").alias("status"), "duration")
    return runs.unionByName(op.recent_syncs(t.syncs).select(
        F.lit("sync").alias("kind"), "id", F.col("sync_status").alias("status"), F.lit(None).cast("string").alias("duration")))


@q("e04_sync_attention", """
    SELECT id, series_id, sync_status FROM syncs WHERE sync_status = 'FAILED'
      OR (sync_status = 'IN_PROGRESS' AND updated_at < TIMESTAMP '2024-01-31 23:00:00')""")
def _(t):
    return op.sync_attention(t.syncs, AS_OF_EVENTS).select("id", "series_id", "sync_status")


# Issue numbers of every shape, made from the line rows.
NUMBER_SPARK = """CASE CAST(series_id % 9 AS INT) WHEN 0 THEN concat('Annual ', issue_number) WHEN 1 THEN concat(issue_number, '.5')
  WHEN 2 THEN concat(issue_number, 'A') WHEN 3 THEN 'One-Shot' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN concat('X', issue_number, 'y2') ELSE issue_number END"""
NUMBER_SQL = """CASE series_id % 9 WHEN 0 THEN 'Annual ' || issue_number WHEN 1 THEN issue_number || '.5'
  WHEN 2 THEN issue_number || 'A' WHEN 3 THEN 'One-Shot' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'X' || issue_number || 'y2' ELSE issue_number END"""


@q("e05_natural_order_a", f"""
    WITH n AS (SELECT id, series_id, {NUMBER_SQL} AS number FROM issues)
    SELECT id, series_id, CASE WHEN coalesce(number, '') = '' THEN 1 ELSE 0 END AS empty,
      coalesce(TRY_CAST(nullif(regexp_extract(number, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE), 1.7976931348623157e308) AS figure, lower(number) AS label FROM n""")
def _(t):
    rows = t.issues.select("id", "series_id", F.expr(NUMBER_SPARK).alias("issue_number"))
    empty, figure, label = natural_key_a(F.col("issue_number"))
    ordered = op.natural_order_a(rows)
    return ordered.select("id", "series_id", empty.alias("empty"), figure.alias("figure"), label.alias("label"))


@q("e06_natural_order_b", f"""
    WITH n AS (SELECT id, series_id, cover_date, {NUMBER_SQL} AS number FROM issues),
    c AS (SELECT *, trim(regexp_replace(lower(number), '^(annual|special|one-shot)\\s*', '')) AS bare FROM n)
    SELECT id, series_id, CASE WHEN coalesce(number, '') = '' THEN 1 ELSE 0 END AS empty,
      coalesce(TRY_CAST(nullif(regexp_extract(bare, '^[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE), 1.7976931348623157e308) AS figure,
      CAST(cover_date AS VARCHAR) AS date, lower(number) AS label FROM c""")
def _(t):
    rows = t.issues.select("id", "series_id", "cover_date", F.expr(NUMBER_SPARK).alias("issue_number"))
    empty, figure, _null, date, label = natural_key_b(F.col("issue_number"), F.col("cover_date"))
    return op.natural_order_b(rows).select(
        "id", "series_id", empty.alias("empty"), figure.alias("figure"), date.cast("string").alias("date"), label.alias("label"))


@q("e07_recent", """
    SELECT * FROM (SELECT 'by_id' AS kind, id, series_id FROM issues ORDER BY id DESC, series_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'by_date', id, series_id FROM issues ORDER BY created_at DESC, id, series_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'series', id, NULL FROM series ORDER BY id DESC LIMIT 10)""")
def _(t):
    by_id = op.recent(t.issues, 10, ties=["series_id"]).select(F.lit("by_id").alias("kind"), "id", "series_id")
    by_date = op.recent(t.issues, 10, "created_at", ["id", "series_id"]).select(F.lit("by_date").alias("kind"), "id", "series_id")
    newest = op.recent(t.series, 10).select(F.lit("series").alias("kind"), "id", F.lit(None).cast("bigint").alias("series_id"))
    return by_id.unionByName(by_date).unionByName(newest)


@q("e08_popular", """
    SELECT s.id, s.name, count(i.id) AS issue_count FROM series s LEFT JOIN issues i ON i.series_id = s.id
    GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 12""")
def _(t):
    return op.popular(t.series, t.issues, 12).select("id", "name", "issue_count")


@q("e09_page", "SELECT id, name, (SELECT count(*) FROM series) AS total FROM series ORDER BY name, id LIMIT 25 OFFSET 75")
def _(t):
    return op.page(t.series.select("id", "name"), ["name", "id"], 3, 25)


@q("e10_latest_per", """
    SELECT session_id, event_id, CAST(ts AS VARCHAR) AS ts FROM events_bound
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY events_bound.ts DESC, event_id DESC) = 1""")
def _(t):
    return op.latest_per(t.events_bound, "session_id", "ts", ("event_id",)).select("session_id", "event_id", text("ts"))


@q("e11_latest_sync", """
    SELECT 'updated' AS kind, series_id, folder_path, id FROM syncs
    QUALIFY row_number() OVER (PARTITION BY series_id, folder_path ORDER BY updated_at DESC, id DESC) = 1
    UNION ALL
    SELECT 'since', series_id, folder_path, id FROM syncs WHERE last_sync_timestamp >= TIMESTAMP '2024-01-02 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY series_id, folder_path ORDER BY last_sync_timestamp DESC, id DESC) = 1""")
def _(t):
    def pick(kind, df):
        return df.select(F.lit(kind).alias("kind"), "series_id", "folder_path", "id")

    since = op.latest_sync(t.syncs, "last_sync_timestamp", "2024-01-02 00:00:00")
    return pick("updated", op.latest_sync(t.syncs)).unionByName(pick("since", since))


@q("e12_list_sort", """
    SELECT id, publisher, CASE WHEN issues_available_count > 0 THEN CAST(floor(issues_owned_count::DOUBLE / issues_available_count * 100 + 0.5) AS BIGINT) ELSE 0 END AS completion
    FROM series_owned""")
def _(t):
    from longbox.functions.numbers import completion_pct

    ordered = op.list_sort(t.series_owned, "completion", asc=False)
    return ordered.select(
        "id", "publisher", completion_pct(F.col("issues_owned_count"), F.col("issues_available_count")).alias("completion"))


READING = """
    SELECT i.id, i.series_id, CAST(i.current_value AS DOUBLE) AS value, i.read,
      CASE WHEN s.link_count = 1 THEN CAST(i.issue_number AS BIGINT) ELSE date_diff('day', DATE '1970-01-01', i.cover_date) END AS reading_key
    FROM issues i JOIN series s ON s.id = i.series_id"""


@q("e13_next_to_read", f"""
    SELECT series_id, id, reading_key, value FROM ({READING}) WHERE NOT read
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY reading_key, id, value) = 1""")
def _(t):
    return op.next_to_read(valued(t.issues), t.series, ["id", "value"]).select("series_id", "id", "reading_key", "value")


@q("e14_issue_order", f"SELECT series_id, id, reading_key FROM ({READING})")
def _(t):
    return op.issue_order(t.issues, t.series).select("series_id", "id", "reading_key")


@q("e15_status_order", """
    SELECT id, CASE WHEN state = 'PROCESSING' THEN 0 ELSE 1 END AS queue,
      CAST(CASE WHEN state = 'PROCESSING' THEN last_updated WHEN time_finished IS NOT NULL THEN time_finished ELSE time_started END AS VARCHAR) AS relevant_time
    FROM progress""")
def _(t):
    return op.status_order(t.progress).select("id", "queue", text("relevant_time"))


@q("e16_latest_and_recent", """
    SELECT id, series_id, row_number() OVER (ORDER BY created_at DESC, id, series_id, value) AS place
    FROM (SELECT *, CAST(current_value AS DOUBLE) AS value FROM issues) ORDER BY place LIMIT 6""")
def _(t):
    return op.latest_and_recent(valued(t.issues), ties=TIES).select("id", "series_id", "place")


@q("e17_head_per_series", """
    SELECT series_id, id, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY series_id) - 9, 0) AS hidden
    FROM (SELECT *, CAST(current_value AS DOUBLE) AS value FROM issues)
    WINDOW w AS (PARTITION BY series_id ORDER BY id, value) QUALIFY row_number() OVER w <= 9""")
def _(t):
    return op.head_per_series(valued(t.issues), 9, ["id", "value"]).select("series_id", "id", "rank", "hidden")


@q("e18_warm_set", "SELECT url_hash, CAST(last_accessed AS VARCHAR) AS last_accessed FROM features ORDER BY features.last_accessed DESC, url_hash LIMIT 100")
def _(t):
    return op.warm_set(t.features, 200).select("url_hash", text("last_accessed"))


@q("e19_cumulative_sessions", """
    WITH m AS (SELECT strftime(time_started, '%Y-%m') AS month, count(*) AS count FROM progress GROUP BY 1)
    SELECT month, count, CAST(sum(count) OVER (ORDER BY month) AS BIGINT) AS cumulative FROM m""")
def _(t):
    return op.cumulative_sessions(t.progress)


@q("e20_first_barcode", """
    WITH c AS (SELECT series_id, id, CASE WHEN id % 4 = 0 THEN '' ELSE regexp_replace(CASE WHEN id % 4 = 1 THEN NULL ELSE
      CASE WHEN id % 2 = 0 THEN '0-' ELSE '' END || lpad(CAST(id AS VARCHAR), 12, '7') END, '[^0-9]', '', 'g') END AS code FROM issues),
    n AS (SELECT series_id, id, CASE WHEN length(code) = 13 AND code[1] = '0' THEN substr(code, 2) ELSE code END AS code FROM c WHERE code <> '')
    SELECT series_id, code AS barcode FROM n QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY id, code) = 1""")
def _(t):
    scans = t.issues.selectExpr(
        "series_id", "id AS issue_order",
        "CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN NULL ELSE concat(CASE WHEN id % 2 = 0 THEN '0-' ELSE '' END, lpad(CAST(id AS STRING), 12, '7')) END AS barcode")
    return op.first_barcode(scans)


@q("e21_folder_map", """
    SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE id || '_' || replace(lower(name), ' ', '_') || '_e' END AS folder FROM series""")
def _(t):
    named = t.series.selectExpr(
        "id", "concat(name, ' é!') AS name",
        "CASE WHEN id % 6 = 0 THEN array() ELSE array(CAST(id AS STRING), 'x') END AS comic_vine_ids")
    return op.folder_map(named)

"""Queries over session progress, batch and streamed (inventory section 2.9)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from longbox.plans import jobs
from longbox.plans.bindings import AS_OF, AS_OF_EVENTS
from longbox.sources.tables import shared_folder
from longbox.streaming import arrivals, current
from longbox.streaming import progress as op
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add
WAIT_S = 300


def text(column):
    return F.col(column).cast("string").alias(column)


def streamed(t, name):
    """A stored table as a stream of its files."""
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def finish(query):
    """Wait for a stream over all there is; a stuck one is stopped and fails."""
    if not query.awaitTermination(WAIT_S):
        query.stop()
        raise TimeoutError("the stream did not finish")


def drained(t, stream, purpose):
    """Run a stream over all there is and read what it wrote."""
    folder = shared_folder(t.spark, purpose)
    # State with a timeout asks for empty triggers without end; a run that
    # should stop by itself has to do without them.
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, "false")
    try:
        query = (
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
        finish(query)
    finally:
        t.spark.conf.set(setting, before)
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


# Triggers that a stream of a query takes at least.
TRIGGERS = 3
# Files of a trigger at least; a larger trigger has one for so many rows.
FILES, FILE_ROWS = 4, 100_000


def in_triggers(t, rows, part):
    """``rows`` as a stream of ``TRIGGERS`` triggers: those whose ``part`` is 0 first, and so on."""
    folder = shared_folder(t.spark, "triggers")
    # All triggers have as many files as the smallest one can fill.
    counts = rows.agg(*[F.count_if(part == i) for i in range(TRIGGERS)]).first()
    files = max(FILES, min(counts) // FILE_ROWS)
    for i in range(TRIGGERS):
        # Files of one trigger are in no order.
        rows.filter(part == i).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


# Time-ordered slices of the events.
CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def by_time():
    return F.when(F.col("ts") < CUTS[0], 0).when(F.col("ts") < CUTS[1], 1).otherwise(2)


BY_TIME_SQL = f"CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END"


def keyed(t, purpose, schema, key="session_id"):
    return current.KeyedTable(t.spark, f"{shared_folder(t.spark, purpose)}/table", schema, key)


LATEST = "SELECT * FROM events_bound QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1"


@q("s01_latest_progress", f"SELECT session_id, event_id, stage, progress, CAST(ts AS VARCHAR) AS ts FROM ({LATEST}) x")
def _(t):
    return op.latest_progress(t.events_bound).select("session_id", "event_id", "stage", "progress", text("ts"))


@q("s01_latest_progress_stream", f"SELECT session_id, event_id, stage, progress FROM ({LATEST}) x")
def _(t):
    rows = t.events_bound
    table = keyed(t, "latest", rows.schema)
    # Late events too: a trigger may hold older ones than those before it.
    stream = in_triggers(t, rows, F.col("event_id") % TRIGGERS)
    finish(current.latest_stream(stream, table, f"{table.folder}-state"))
    return table.current().select("session_id", "event_id", "stage", "progress")


HISTORY = "SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rank FROM events_bound QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= {}"


@q("s02_history", HISTORY.format(100))
def _(t):
    return op.history(t.events_bound).select("session_id", "event_id", "rank")


@q("s02_history_stream", HISTORY.format(20))
def _(t):
    rows = t.events_bound
    table = keyed(t, "history", op.history(rows).schema)
    stream = in_triggers(t, rows, F.col("event_id") % TRIGGERS)
    finish(current.history_stream(stream, table, f"{table.folder}-state", 20))
    return table.current().select("session_id", "event_id", "rank")


OVERLAY = f"""
    WITH l AS (SELECT session_id, type, error, stage, message, progress, CAST(session_id AS INT) % 10 AS m FROM ({LATEST}) x),
    j AS (SELECT p.*, l.type, l.error, l.stage, l.message, l.progress, l.m, p.state = 'PROCESSING' AND l.m IS NOT NULL AND l.m <= 5 AS hit FROM progress p LEFT JOIN l ON l.session_id = p.session_id)
    SELECT id, CASE WHEN hit AND type IN ('ERROR', 'COMPLETED') THEN type ELSE state END AS state, CASE WHEN hit THEN coalesce(error, error_message) ELSE error_message END AS error_message,
      CAST(CASE WHEN hit THEN greatest(percentage_complete, progress) ELSE percentage_complete END AS INTEGER) AS percentage_complete, CASE WHEN hit THEN stage ELSE current_stage END AS current_stage,
      CAST(CASE WHEN hit THEN 12 ELSE total_items END AS INTEGER) AS total_items, CAST(CASE WHEN hit THEN m ELSE processed_items END AS INTEGER) AS processed_items, CAST(failed_items AS INTEGER) AS failed_items FROM j"""


def overlay_live(rows):
    return rows.withColumns({
        "ts": F.expr(f"timestamp_ntz'{AS_OF_EVENTS}' - make_dt_interval(0, 0, CAST(CAST(session_id AS INT) % 10 AS INT), 30)"),
        "props": F.expr("""concat('{"totalItems": "12", "processedItems": ', CAST(session_id AS INT) % 10, ', "failedItems": "x"}')"""),
    })


SHOWN = ["id", "state", "error_message", "percentage_complete", "current_stage", "total_items", "processed_items", "failed_items"]


@q("s03_overlay", OVERLAY)
def _(t):
    return op.overlay(t.progress, overlay_live(op.latest_progress(t.events_bound)), AS_OF_EVENTS).select(*SHOWN)


@q("s03_overlay_stream", f"SELECT * FROM ({OVERLAY}) o WHERE id IN (SELECT id FROM progress WHERE session_id IN (SELECT session_id FROM events_bound))")
def _(t):
    # Events of a session get one age here, so the event number alone says which is the latest.
    rows = overlay_live(t.events_bound.withColumn("event_id", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))))
    latest = keyed(t, "live", rows.schema)
    progress = t.progress.withColumn("status_message", F.lit(None).cast("string"))
    shown = keyed(t, "shown", progress.schema)
    stream = in_triggers(t, rows, F.col("event_id") % TRIGGERS)
    finish(current.overlay_stream(stream, lambda: progress, latest, shown, f"{shown.folder}-state", AS_OF_EVENTS))
    return shown.current().select(*SHOWN)


@q("s04_stale", """
    WITH a AS (SELECT id, date_sub('second', last_updated, TIMESTAMP '2000-06-15 00:12:30') AS s FROM progress WHERE state = 'PROCESSING')
    SELECT 'server' AS kind, id FROM a WHERE floor(s / 60.0) > 5 UNION ALL SELECT 'browser', id FROM a WHERE s > 300""")
def _(t):
    at = "2000-06-15 00:12:30"
    server = op.stale(t.progress, at).select(F.lit("server").alias("kind"), "id")
    return server.unionByName(op.stale(t.progress, at, strict=True).select(F.lit("browser").alias("kind"), "id"))


# Events squeezed into seconds, so that the rate limit has something to do.
SQUEEZED_SPARK = [
    "CAST(user_id AS STRING) AS session_id",
    "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 400000) AS DECIMAL(18, 0)) / 1000000) AS ts",
    "event_id", "CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'comparing' END AS stage", "CAST(event_id % 5 AS INT) AS progress",
    "CASE WHEN event_id % 13 = 0 THEN 'Image 1/2' ELSE 'waiting' END AS message"]
SQUEEZED = """sq AS (SELECT CAST(user_id AS VARCHAR) AS session_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(date_sub('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 400000) AS ts, event_id,
    CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'comparing' END AS stage, event_id % 5 AS progress, event_id % 13 = 0 AS image FROM events)"""


THROTTLED = f"""
    WITH RECURSIVE {SQUEEZED}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM sq),
    r AS (SELECT session_id, n, event_id, true AS sent, ts AS last_at, progress AS v, stage AS st, 1 AS c FROM n WHERE n = 1
      UNION ALL
      SELECT session_id, n, event_id, ok, CASE WHEN ok THEN ts ELSE last_at END, CASE WHEN ok THEN progress ELSE v END, CASE WHEN ok THEN stage ELSE st END, c + CASE WHEN ok THEN 1 ELSE 0 END
      FROM (SELECT n.session_id, n.n, n.event_id, n.ts, n.progress, n.stage, r.last_at, r.v, r.st, r.c,
          r.c < 5 OR n.image OR n.stage <> r.st OR abs(n.progress - r.v) >= 3 OR date_sub('microsecond', r.last_at, n.ts) >= 200000 AS ok
        FROM r JOIN n ON n.session_id = r.session_id AND n.n = r.n + 1) s)
    SELECT session_id, event_id FROM r WHERE sent"""


@q("s05_throttle", THROTTLED)
def _(t):
    return op.throttle(t.events.selectExpr(*SQUEEZED_SPARK)).select("session_id", "event_id")


@q("s05_throttle_stream", THROTTLED)
def _(t):
    kinds = ["'PROCESSING' AS type", "CAST(NULL AS STRING) AS error"]
    squeezed = streamed(t, "events").selectExpr(*SQUEEZED_SPARK, *kinds)
    return drained(t, op.throttle_stream(squeezed), "throttle").select("session_id", "event_id")


COUNTED = "CASE WHEN stage = 'view' AND event_id % 17 = 0 THEN 'All completed: Successfully processed ' || (event_id % 3) || '/5' ELSE message END"


COUNTERS = f"""
    WITH e AS (SELECT session_id, event_id, ts, row_number() OVER w AS n, CASE stage WHEN 'signup' THEN event_id % 9 + 1 END AS total,
      CASE stage WHEN 'signup' THEN event_id % 9 + 1 WHEN 'click' THEN event_id % 40 END AS cur,
      sum(CASE WHEN stage = 'purchase' THEN 1 ELSE 0 END) OVER w AS adds, sum(CASE WHEN stage = 'error' THEN 1 ELSE 0 END) OVER w AS fails,
      CASE WHEN stage = 'view' AND event_id % 17 = 0 THEN event_id % 3 END AS ok FROM events_bound WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
    s AS (SELECT *, max(CASE WHEN ok IS NOT NULL THEN n END) OVER w AS ln, first_value(total IGNORE NULLS) OVER w AS t1, nullif(max(cur) OVER w, 0) AS p FROM e WINDOW w AS (PARTITION BY session_id ORDER BY n))
    SELECT s.session_id, s.event_id, s.t1 AS total_items, s.p AS processed_items, CAST(coalesce(l.ok, 0) + s.adds - coalesce(l.adds, 0) AS BIGINT) AS successful_items,
      CAST(coalesce(5 - l.ok, 0) + s.fails - coalesce(l.fails, 0) AS BIGINT) AS failed_items
    FROM s LEFT JOIN s l ON l.session_id = s.session_id AND l.n = s.ln"""


def counted(rows):
    big = [F.col(c).cast("bigint").alias(c) for c in ("total_items", "processed_items", "successful_items", "failed_items")]
    return rows.select("session_id", "event_id", *big)


@q("s06_message_counters", COUNTERS)
def _(t):
    return counted(op.message_counters(t.events_bound.withColumn("message", F.expr(COUNTED))))


@q("s06_message_counters_stream", COUNTERS)
def _(t):
    rows = t.events_bound.withColumn("message", F.expr(COUNTED))
    table = keyed(t, "counters", t.spark.createDataFrame([], current.TRACKED).schema)
    finish(current.counters_stream(in_triggers(t, rows, by_time()), table, f"{table.folder}-out", f"{table.folder}-state"))
    return counted(t.spark.read.parquet(f"{table.folder}-out"))


LIFECYCLE = """
    WITH k AS (SELECT *, id % 3 = 0 AS fresh, id % 4 = 0 AS done, id % 5 = 0 AS err FROM progress)
    SELECT session_id, CASE WHEN err AND (NOT done OR id % 2 = 0) THEN 'ERROR' WHEN done THEN 'COMPLETED' WHEN fresh THEN 'PROCESSING' ELSE state END AS state,
      CASE WHEN fresh THEN 7 ELSE series_id END AS series_id, CASE WHEN done THEN 100 WHEN fresh THEN NULL ELSE percentage_complete END AS percentage_complete,
      CASE WHEN err THEN 'bad' WHEN fresh THEN NULL ELSE error_message END AS error_message,
      CASE WHEN done THEN '2001-12-01 00:00:00' WHEN fresh THEN NULL ELSE CAST(time_finished AS VARCHAR) END AS time_finished FROM k"""


def lifecycle_rows(t):
    """Progress known before, and the events of what comes."""
    known = t.progress.filter("id % 3 <> 0")
    blank = {c: "CAST(NULL AS INT)" for c in op.RESULT_FIELDS} | {"current_stage": "CAST(NULL AS STRING)", "status_message": "CAST(NULL AS STRING)"}

    def event(kind, rows, at, **given):
        columns = {"series_id": "CAST(7 AS BIGINT)", "started_by": "'MANUAL'", "error_message": "'bad'", **blank, **given}
        return rows.selectExpr("session_id", f"'{kind}' AS kind", f"{at} AS ts", *[f"{v} AS {c}" for c, v in columns.items()])

    day = f"timestamp_ntz'{AS_OF}'"
    done = t.progress.filter("id % 4 = 0")
    ghosts = done.withColumn("session_id", F.concat(F.lit("ghost"), "session_id"))
    events = (
        event("start", t.progress.filter("id % 3 = 0"), f"{day} - make_dt_interval(1)")
        .unionByName(event("complete", done.unionByName(ghosts), day, percentage_complete="100"))
        .unionByName(event("error", t.progress.filter("id % 5 = 0"), f"{day} + make_dt_interval(CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END)"))
    )
    # No session is both unknown and never started: those rows stay away.
    return known, events


def lifecycle(rows):
    return rows.select(
        "session_id", "state", "series_id", F.col("percentage_complete").cast("bigint").alias("percentage_complete"), "error_message", text("time_finished"))


@q("s07_apply_lifecycle", LIFECYCLE)
def _(t):
    return lifecycle(op.apply_lifecycle(*lifecycle_rows(t)))


@q("s07_lifecycle_stream", LIFECYCLE)
def _(t):
    known, events = lifecycle_rows(t)
    table = keyed(t, "progress", known.schema)
    table.upsert(-1, known, current.replaced("session_id"))
    day = F.expr(f"timestamp_ntz'{AS_OF}'")
    stream = in_triggers(t, events, F.when(F.col("ts") < day, 0).when(F.col("ts") == day, 1).otherwise(2))
    finish(current.lifecycle_stream(stream, table, f"{table.folder}-state"))
    return lifecycle(table.current())


@q("s08_auto_times", """
    SELECT session_id, CAST(min(ts) FILTER (type = 'PROCESSING') AS VARCHAR) AS time_started, CAST(min(ts) FILTER (type IN ('COMPLETED', 'ERROR')) AS VARCHAR) AS time_finished
    FROM events_bound GROUP BY 1""")
def _(t):
    return op.auto_times(t.events_bound.withColumnRenamed("type", "state")).select("session_id", text("time_started"), text("time_finished"))


@q("s09_truncate_result", """
    WITH m AS (SELECT doc_id, 1 + doc_id % 6 AS n, to_json({'top_matches': list_transform(generate_series(1, 1 + doc_id % 6), lambda i: {'i': i, 'c': repeat('x', CAST(n_chars AS INT) * 3)}), 'total_matches': 9}) AS j FROM documents)
    SELECT doc_id, CASE WHEN length(j) > 50000 AND n > 3 THEN 3 ELSE n END AS kept, coalesce(length(j) > 50000 AND n > 3, false) AS truncated, CASE WHEN length(j) > 50000 AND n > 3 THEN n END AS original FROM m""")
def _(t):
    rows = t.documents.selectExpr(
        "doc_id", "named_struct('top_matches', transform(sequence(1, CAST(1 + doc_id % 6 AS INT)), i -> named_struct('i', i, 'c', repeat('x', CAST(n_chars AS INT) * 3))), 'total_matches', 9) AS result")
    done = op.truncate_result(rows)
    return done.select(
        "doc_id", F.size("result.top_matches").cast("bigint").alias("kept"), F.coalesce("result.truncated", F.lit(False)).alias("truncated"),
        F.col("result.original_match_count").cast("bigint").alias("original"))


@q("s10_expire", "SELECT event_id FROM events_bound WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 HOUR")
def _(t):
    return op.expire(t.events_bound, "2024-01-20 00:00:00").select("event_id")


# A session expires in a trigger without events of its own, once the watermark of the
# triggers before is two hours past its last event; the last trigger has none at all.
@q("s10_expired_stream", f"""
    WITH s AS (SELECT session_id, {BY_TIME_SQL} AS part, max(ts) AS last FROM events_bound GROUP BY 1, 2),
    mark AS (SELECT p.part, max(s.last) AS mark FROM s JOIN (VALUES (0), (1), (2)) p(part) ON s.part <= p.part GROUP BY 1),
    n AS (SELECT *, lead(part, 1, 4) OVER (PARTITION BY session_id ORDER BY part) AS next FROM s)
    SELECT session_id, CAST(last AS VARCHAR) AS last FROM n JOIN mark ON mark.part = n.next - 2
    WHERE n.next - n.part >= 2 AND n.last + INTERVAL 2 HOUR <= mark.mark""")
def _(t):
    rows = t.events_bound.select("session_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = shared_folder(t.spark, "expired")
    expired = current.expired_stream(in_triggers(t, rows, by_time()), hours=2)
    finish(
        expired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    return t.spark.read.schema(expired.schema).parquet(f"{folder}/out").select("session_id", F.col("last").cast("timestamp_ntz").cast("string").alias("last"))


@q("s11_status", f"""
    WITH l AS (SELECT session_id, type, stage, progress, message, CAST(session_id AS INT) AS s FROM ({LATEST}) x),
    i AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id FROM customer)
    SELECT i.session_id, CASE WHEN s % 2 = 0 AND s % 10 <= 5 THEN 'live' WHEN s % 3 = 0 THEN 'memory' WHEN p.id % 5 <> 0 THEN 'database' ELSE 'none' END AS source,
      CASE WHEN (s % 2 = 0 AND s % 10 <= 5) OR s % 3 = 0 THEN l.stage WHEN p.id % 5 <> 0 THEN p.current_stage END AS stage,
      CAST(CASE WHEN (s % 2 = 0 AND s % 10 <= 5) OR s % 3 = 0 THEN l.progress WHEN p.id % 5 <> 0 THEN p.percentage_complete END AS INTEGER) AS progress
    FROM i LEFT JOIN l ON l.session_id = i.session_id LEFT JOIN progress p ON p.session_id = i.session_id""")
def _(t):
    latest = op.latest_progress(t.events_bound)
    live = latest.filter("CAST(session_id AS INT) % 2 = 0").withColumn(
        "ts", F.expr(f"timestamp_ntz'{AS_OF_EVENTS}' - make_dt_interval(0, 0, CAST(CAST(session_id AS INT) % 10 AS INT), 30)"))
    memory = latest.filter("CAST(session_id AS INT) % 3 = 0")
    stored = t.progress.filter("id % 5 <> 0").selectExpr(
        "session_id", "state AS type", "current_stage AS stage", "percentage_complete AS progress", "CAST(NULL AS STRING) AS message", "last_updated AS ts")
    ids = t.customer.selectExpr("CAST(c_custkey AS STRING) AS session_id")
    return op.status(live, memory, stored, ids, AS_OF_EVENTS).select("session_id", "source", "stage", "progress")


def listed(rows):
    return rows.selectExpr(
        "doc_id AS id", "CAST(substr(source, 4) AS BIGINT) AS series_id", "concat(source, '/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END) AS file_path",
        "concat(doc_id, CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END) AS file_name")


UNSEEN = "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'retry' END AS decision FROM files WHERE id % 7 <> 0 AND (id % 3 = 0 OR state = 'ERROR')"


@q("s12_arrivals", UNSEEN)
def _(t):
    folder = shared_folder(t.spark, "arrivals")
    ledger = t.files.filter("id % 3 <> 0")
    # Every listing after the first repeats files of the one before.
    rows = listed(t.documents)
    twice = rows.withColumn("part", F.col("id") % TRIGGERS).unionByName(rows.withColumn("part", F.least(F.col("id") % TRIGGERS + 1, F.lit(TRIGGERS - 1))))
    query = arrivals.arrivals(in_triggers(t, twice, F.col("part")), ledger, f"{folder}/ledger", f"{folder}/state")
    finish(query)
    return t.spark.read.parquet(f"{folder}/ledger").select("id", "decision")


@q("s13_run_job", f"""
    WITH owned AS (SELECT DISTINCT comic_vine_id FROM issues WHERE condition = 'A')
    SELECT 'missing' AS job, count(*) AS rows FROM (SELECT id FROM catalogue_issues WHERE id NOT IN (SELECT comic_vine_id FROM owned) UNION SELECT comic_vine_id FROM missing_issues)
    UNION ALL SELECT 'sync', count(*) FROM ({UNSEEN})
    UNION ALL SELECT 'reverify', count(*) FROM series""")
def _(t):
    series = t.series.withColumn("comic_vine_ids", F.array(F.col("id").cast("string")))
    tables = {
        "catalogue_issues": t.catalogue_issues, "issues": t.issues.filter("condition = 'A'"), "missing_issues": t.missing_issues, "series": series,
        "listing": listed(t.documents), "ledger": t.files.filter("id % 3 <> 0"), "catalogue": t.series.withColumn("id", F.col("id").cast("string")),
        "gcd_series": t.gcd_series}
    counts = [jobs.run_job(name, tables, AS_OF).agg(F.count("*").alias("rows")).withColumn("job", F.lit(name)) for name in ("missing", "sync", "reverify")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@q("s14_display_progress", """
    SELECT session_id, event_id, max(greatest(0, least(100, progress))) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS displayed FROM events_bound""")
def _(t):
    return op.display_progress(t.events_bound).select("session_id", "event_id", "displayed")


@q("s15_final_stats", """
    SELECT id, CAST(CASE id % 3 WHEN 0 THEN id % 40 WHEN 1 THEN 1 ELSE nullif(total_items, 0) END AS INTEGER) AS total_items,
      CAST(CASE id % 3 WHEN 0 THEN id % 7 WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END ELSE nullif(successful_items, 0) END AS INTEGER) AS successful_items,
      CAST(CASE id % 3 WHEN 0 THEN failed_items WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END ELSE nullif(failed_items, 0) END AS INTEGER) AS failed_items FROM progress""")
def _(t):
    summary = "named_struct('total_images_processed', CAST(id % 40 AS INT), 'successful_images', CAST(id % 7 AS INT), 'failed_images', CAST(NULL AS INT))"
    rows = t.progress.withColumn("result", F.expr(
        f"named_struct('summary', CASE WHEN id % 3 = 0 THEN {summary} END, 'top_matches', CASE WHEN id % 3 = 1 THEN slice(array('m'), 1, CAST(1 - id % 2 AS INT)) END)"))
    return op.final_stats(rows).select("id", "total_items", "successful_items", "failed_items")

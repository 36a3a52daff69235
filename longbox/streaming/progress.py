"""Session progress: batch operators and the stream form of the rate limit.

Events are rows of session_id, ts, event_id, stage, progress, message, type,
error and props (a JSON map of counters).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from longbox.functions.numbers import int_from_map
from longbox.functions.progress import parse_message
from longbox.functions.times import moment, seconds_between
from longbox.plans.scale import previous, running, top_per_group

TTL_MS = 2 * 60 * 60 * 1000
HISTORY = 100
FRESH_MINUTES = 5
FINAL_STATES = ("COMPLETED", "ERROR")
# Counters a live event may carry, by column.
COUNTERS = {
    "total_items": "totalItems",
    "processed_items": "processedItems",
    "successful_items": "successfulItems",
    "failed_items": "failedItems",
}
EVENT = "session_id STRING, ts TIMESTAMP_NTZ, event_id BIGINT, stage STRING, progress INT, message STRING, type STRING, error STRING"
EVENT_COLUMNS = [part.split(" ")[0] for part in EVENT.split(", ")]


def hour_slice(ts: str = "ts") -> Column:
    return F.date_trunc("HOUR", F.col(ts))


# --- latest and history ------------------------------------------------------


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest event per session, by a plain aggregate with map-side combine."""
    rest = [c for c in events.columns if c not in ("session_id", "ts", "event_id")]
    best = F.max(F.struct("ts", "event_id", *rest)).alias("_e")
    return events.groupBy("session_id").agg(best).select("session_id", "_e.*")


def history(events: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` events per session, newest first."""
    return top_per_group(events, ["session_id"], [F.desc("ts"), F.desc("event_id")], n)


# --- live overlay and status -------------------------------------------------


def age_minutes(ts: Column, as_of: str) -> Column:
    return F.floor(seconds_between(ts, moment(as_of)) / 60)


def overlay(progress: DataFrame, latest: DataFrame, as_of: str) -> DataFrame:
    """Running sessions with their fresh live event on top.

    Events older than five whole minutes do not count. A final type replaces
    the state, an error its text, the percentage never falls, and counters
    come over when they are whole numbers.
    """
    fresh = latest.filter(age_minutes(F.col("ts"), as_of) <= FRESH_MINUTES)
    live = fresh.select("session_id", F.struct("ts", "type", "error", "stage", "progress", "message", "props").alias("_l"))
    joined = progress.join(live, "session_id", "left")
    hit = (F.col("state") == "PROCESSING") & F.col("_l").isNotNull()
    counters = F.from_json("_l.props", "MAP<STRING, STRING>")
    rose = F.greatest(F.col("percentage_complete"), F.col("_l.progress"))
    new = {
        "state": F.when(F.col("_l.type").isin(*FINAL_STATES), F.col("_l.type")).otherwise(F.col("state")),
        "error_message": F.coalesce("_l.error", "error_message"),
        "percentage_complete": F.coalesce(rose, F.lit(0)),
        "current_stage": F.col("_l.stage"),
        "status_message": F.col("_l.message"),
        "last_updated": F.col("_l.ts"),
        **{c: F.coalesce(int_from_map(counters, [key]), F.col(c)) for c, key in COUNTERS.items()},
    }
    if "status_message" not in progress.columns:
        joined = joined.withColumn("status_message", F.lit(None).cast("string"))
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_l")


def stale(progress: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Running sessions idle for more than five whole minutes (server rule),
    or for more than exactly five minutes (``strict``, the browser's rule)."""
    active = progress.filter((F.col("state") == "PROCESSING") & F.col("last_updated").isNotNull())
    if strict:
        return active.filter(F.col("last_updated") < moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5)))
    return active.filter(age_minutes(F.col("last_updated"), as_of) > FRESH_MINUTES)


def status(live: DataFrame, memory: DataFrame, stored: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Status per asked session from the first source that knows it.

    Sources have session_id, type, stage, progress, message, ts; a live row
    must be fresh. Missing text is empty and a missing percentage 0.
    """
    fresh = live.filter(age_minutes(F.col("ts"), as_of) <= FRESH_MINUTES)
    out = ids.select("session_id").distinct()
    for name, df in (("live", fresh), ("memory", memory), ("database", stored)):
        row = F.struct("type", "stage", "progress", "message", "ts").alias(f"_{name}")
        out = out.join(df.select("session_id", row), "session_id", "left")
    found = F.coalesce("_live", "_memory", "_database")
    source = F.lit("none")
    for name in ("database", "memory", "live"):
        source = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(source)
    known = source != "none"
    return out.select(
        "session_id",
        source.alias("source"),
        F.when(known, found["type"]).otherwise("not_found").alias("type"),
        F.when(known, F.coalesce(found["stage"], F.lit(""))).alias("stage"),
        F.when(known, F.coalesce(found["progress"], F.lit(0))).alias("progress"),
        F.when(known, F.coalesce(found["message"], F.lit(""))).otherwise("Session not found").alias("message"),
        F.when(known, found["ts"]).alias("ts"),
    )


# --- throttling --------------------------------------------------------------

MIN_GAP_US = 200_000
MIN_JUMP = 3
FREE_UPDATES = 5
IMAGE_WORDS = ["Image ", "image ", "Processing", "Completed", "Failed"]


def important(stage: Column, progress: Column) -> Column:
    return F.coalesce(F.lower(stage).contains("completed") | (stage == "error"), F.lit(False)) | F.coalesce(
        progress >= 100, F.lit(False)
    )


def throttle(events: DataFrame) -> DataFrame:
    """Events that pass the rate limit of their session.

    An event passes when it is important, speaks of an image, changes the
    stage, jumps by 3 or more, comes 0.2 s after the last one *sent*, or when
    fewer than five were sent. What follows an event that passes for sure
    depends on that event only, and passing is sure for the first five events
    and for every one that is important, on images, of another stage than the
    event before, or 0.2 s after it. Those events cut a session into short
    runs, and only a run is walked event by event.
    """
    keys = ["session_id"]
    order = ["ts", "event_id"]
    hour = hour_slice()
    with_last = previous(events, keys, order, hour, ["stage"], "_prev")
    gap = F.timestamp_diff("MICROSECOND", F.col("_prev.ts"), F.col("ts"))
    sure = (
        F.col("_prev").isNull()
        | important(F.col("stage"), F.col("progress"))
        | F.coalesce(F.col("message").rlike("|".join(IMAGE_WORDS)), F.lit(False))
        | ~F.col("stage").eqNullSafe(F.col("_prev.stage"))
        | (gap >= MIN_GAP_US)
    )
    head = top_per_group(events.select(*keys, *order), keys, [F.col(c) for c in order], FREE_UPDATES).drop("rank")
    marked = with_last.join(head.withColumn("_free", F.lit(True)), [*keys, *order], "left")
    marked = marked.withColumn("_sure", sure | F.col("_free").isNotNull()).drop("_prev", "_free")
    start = F.when(F.col("_sure"), F.struct(*order))
    runs = running(marked, keys, [F.col(c) for c in order], hour, {"_run": ("max", start)})
    certain = runs.filter("_sure")
    doubtful = runs.filter(~F.col("_sure")).select(*keys, "_run").distinct()
    run_name = F.concat_ws("/", F.col("_run.ts").cast("string"), F.col("_run.event_id").cast("string"))
    walked = runs.join(doubtful, [*keys, "_run"], "left_semi").select(*events.columns, "_sure", run_name.alias("_run"))
    sent = (
        walked.repartition(*keys, "_run")
        .sortWithinPartitions(*keys, "_run", *order)
        .mapInPandas(_walk, walked.schema)
        .select(*events.columns)
    )
    return certain.select(*events.columns).unionByName(sent)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The unsure events that pass, from runs in order.

    A run begins with its sure event, which was sent. Only the last sent time
    and value are held, so a run of any length streams through.
    """
    sent_at = value = None
    for batch in batches:
        at = _micros(batch["ts"])
        keep = []
        for now, progress, sure in zip(at, batch["progress"].to_numpy(), batch["_sure"].to_numpy()):
            passes = not sure and (abs(progress - value) >= MIN_JUMP or now - sent_at >= MIN_GAP_US)
            keep.append(passes)
            if sure or passes:
                sent_at, value = now, progress
        yield batch[keep]


def _micros(stamps: pd.Series):
    return stamps.astype("datetime64[us]").astype("int64").to_numpy()


def _throttle_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rate limit of one session over triggers: last sent time, value, stage, count."""
    if state.hasTimedOut:
        state.remove()
        return
    sent_at, value, stage, count = state.get if state.exists else (None, None, None, 0)
    # Arrow cuts a trigger's rows of a session anywhere, so they are put in order as a whole.
    rows = pd.concat(batches, ignore_index=True).sort_values(["ts", "event_id"])
    keep = []
    for now, row in zip(_micros(rows["ts"]), rows.itertuples(index=False)):
        name = row.stage or ""
        passes = (
            count < FREE_UPDATES
            or "completed" in name.lower()
            or name == "error"
            or row.progress >= 100
            or name != stage
            or abs(row.progress - value) >= MIN_JUMP
            or now - sent_at >= MIN_GAP_US
            or any(word in (row.message or "") for word in IMAGE_WORDS)
        )
        keep.append(passes)
        if passes:
            sent_at, value, stage, count = int(now), int(row.progress), name, count + 1
    yield rows[keep][EVENT_COLUMNS]
    state.update((sent_at, value, stage, count))
    state.setTimeoutDuration(TTL_MS)


def throttle_stream(events: DataFrame) -> DataFrame:
    """The rate limit on a stream. A session is one sequence by nature, walked
    in order of time within each trigger, with a four-field state."""
    return events.select(*EVENT_COLUMNS).groupBy("session_id").applyInPandasWithState(
        _throttle_state, EVENT, "sent_at BIGINT, value INT, stage STRING, n INT", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


# --- counters and display ----------------------------------------------------


def _carried(counters: DataFrame, rows: DataFrame) -> DataFrame:
    """Counters of earlier events as a row before all ``rows`` of their session."""
    known = {"total": "total_items", "current": "processed_items", "set_success": "successful_items", "set_failed": "failed_items"}
    message = rows.schema["_m"].dataType
    fields = [
        (F.col(known[f.name]) if f.name in known else F.lit(0) if f.name.startswith("add_") else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in message
    ]
    given = {
        "session_id": F.col("session_id"),
        "ts": F.expr("timestamp_ntz'0001-01-01 00:00:00'").cast(rows.schema["ts"].dataType),
        "event_id": F.lit(-1),
        "_m": F.struct(*fields),
    }
    return counters.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def message_counters(events: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Events with the counters known after each of them.

    The first total stays; processed only grows; success and failure counts
    are set by a summary message and go up by one with each image message.
    ``carried`` holds the counters of sessions before these events, if any.
    """
    keys, order = ["session_id"], [F.col("ts"), F.col("event_id")]
    hour = hour_slice()
    rows = events.withColumn("_m", parse_message(F.col("message"), F.col("stage")))
    if carried is not None:
        old = _carried(carried, rows).withColumn("_old", F.lit(True))
        rows = rows.withColumn("_old", F.lit(False)).unionByName(old)
    place = F.struct("ts", "event_id")
    rows = running(
        rows,
        keys,
        order,
        hour,
        {
            "_total": ("min", F.when(F.col("_m.total").isNotNull(), F.struct(place.alias("at"), F.col("_m.total").alias("n")))),
            "processed_items": ("max", F.col("_m.current")),
            "_adds": ("sum", F.col("_m.add_success")),
            "_fails": ("sum", F.col("_m.add_failed")),
        },
    )
    reset = F.struct(
        place.alias("at"), F.col("_m.set_success").alias("ok"), F.col("_m.set_failed").alias("bad"),
        F.col("_adds").alias("adds"), F.col("_fails").alias("fails"),
    )
    rows = running(rows, keys, order, hour, {"_set": ("max", F.when(F.col("_m.set_success").isNotNull(), reset))})

    def since(base: str, sums: str, at: str) -> Column:
        return F.coalesce(F.col(f"_set.{base}"), F.lit(0)) + F.col(sums) - F.coalesce(F.col(f"_set.{at}"), F.lit(0))

    if carried is not None:
        rows = rows.filter(~F.col("_old")).drop("_old")
    return rows.withColumns(
        {
            "progress": F.least(F.lit(100), F.greatest(F.lit(0), F.col("progress"))),
            "status_message": F.substring(F.coalesce("message", F.lit("")), 1, 1000),
            "message": F.substring(F.coalesce("message", F.lit("")), 1, 300),
            "current_stage": F.col("_m.stage_label"),
            "total_items": F.col("_total.n"),
            "processed_items": F.when(F.col("processed_items") > 0, F.col("processed_items")),
            "successful_items": since("ok", "_adds", "adds"),
            "failed_items": since("bad", "_fails", "fails"),
        }
    ).drop("_m", "_total", "_adds", "_fails", "_set")


def display_progress(events: DataFrame) -> DataFrame:
    """Percentage to show: highest so far, capped at 100."""
    capped = F.least(F.lit(100), F.greatest(F.lit(0), F.col("progress")))
    return running(
        events, ["session_id"], [F.col("ts"), F.col("event_id")], hour_slice(), {"displayed": ("max", capped)}
    )


# --- lifecycle ---------------------------------------------------------------

RESULT_FIELDS = ["percentage_complete", "current_stage", "status_message", *COUNTERS]


def apply_lifecycle(progress: DataFrame, events: DataFrame) -> DataFrame:
    """Progress rows after start, complete and error events.

    ``events``: session_id, kind, ts, series_id, started_by, error_message and
    the result fields. A start opens a session; completing and failing touch
    known sessions only, the later of the two decides the state.
    """
    def last(kind: str, *columns: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("ts", *columns))).alias(f"_{kind}")

    found = events.groupBy("session_id").agg(
        last("start", "series_id", "started_by"), last("complete", *RESULT_FIELDS), last("error", "error_message")
    )
    joined = progress.withColumn("_known", F.lit(True)).join(found, "session_id", "full")
    started = F.col("_known").isNull() & F.col("_start").isNotNull()
    exists = F.col("_known").isNotNull() | started
    done, failed = F.col("_complete").isNotNull(), F.col("_error").isNotNull()
    failed_last = failed & (~done | (F.col("_error.ts") >= F.col("_complete.ts")))
    new = {
        "state": F.when(failed_last, "ERROR").when(done, "COMPLETED").when(started, "PROCESSING").otherwise(F.col("state")),
        "time_started": F.coalesce("time_started", "_start.ts"),
        "time_finished": F.when(done, F.col("_complete.ts")).otherwise(F.col("time_finished")),
        "series_id": F.coalesce("series_id", "_start.series_id"),
        "started_by": F.coalesce("started_by", "_start.started_by"),
        "error_message": F.when(failed, F.col("_error.error_message")).otherwise(F.col("error_message")),
        **{c: F.coalesce(f"_complete.{c}", c) for c in RESULT_FIELDS if c in progress.columns},
    }
    return joined.filter(exists).withColumns(new).select(*progress.columns)


def auto_times(changes: DataFrame) -> DataFrame:
    """First time each session was saved as running, and as finished."""
    state = F.col("state")
    return changes.groupBy("session_id").agg(
        F.min(F.when(state == "PROCESSING", F.col("ts"))).alias("time_started"),
        F.min(F.when(state.isin(*FINAL_STATES), F.col("ts"))).alias("time_finished"),
    )


RESULT_LIMIT, KEPT_MATCHES = 50_000, 3


def truncate_result(df: DataFrame, column: str = "result") -> DataFrame:
    """Results whose JSON is too long keep three matches and say so."""
    result = F.col(column)
    n = F.coalesce(F.size(f"{column}.top_matches"), F.lit(0))
    cut = (F.length(F.to_json(result)) > RESULT_LIMIT) & (n > KEPT_MATCHES)
    matches = F.when(cut, F.slice(f"{column}.top_matches", 1, KEPT_MATCHES)).otherwise(F.col(f"{column}.top_matches"))
    return df.withColumn(
        column,
        result.withField("top_matches", matches)
        .withField("truncated", F.when(cut, True))
        .withField("original_match_count", F.when(cut, n)),
    )


def expire(sessions: DataFrame, as_of: str, hours: int = 2) -> DataFrame:
    """Sessions whose last event is not older than the maximum age."""
    return sessions.filter(F.col("ts") >= moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def final_stats(df: DataFrame, column: str = "result") -> DataFrame:
    """Final counters: from the summary of a multi-image result, from the
    matches of a single one, else the tracked columns (unless 0)."""
    summary, matches = F.col(f"{column}.summary"), F.col(f"{column}.top_matches")
    multi = summary.isNotNull()
    single = ~multi & matches.isNotNull()
    hit = F.when(F.size(matches) > 0, 1).otherwise(0)

    def pick(tracked: str, field: str, alone: Column) -> Column:
        own = F.col(tracked)
        return (
            F.when(multi, F.coalesce(summary[field], own))
            .when(single, alone)
            .otherwise(F.when(own != 0, own))
        )

    return df.withColumns(
        {
            "total_items": pick("total_items", "total_images_processed", F.lit(1)),
            "successful_items": pick("successful_items", "successful_images", hit),
            "failed_items": pick("failed_items", "failed_images", 1 - hit),
            "processed_items": pick("processed_items", "total_images_processed", F.lit(1)),
            "percentage_complete": F.lit(100),
            "current_stage": F.lit("COMPLETED"),
            "status_message": F.lit("Processing completed successfully"),
        }
    )

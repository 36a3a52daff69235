import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from longbox.plans.scale import previous, running, top_per_group
from longbox.streaming import progress as op

START = dt.datetime(2024, 1, 1, 0, 59, 58)
EVENT = "session_id STRING, ts TIMESTAMP_NTZ, event_id BIGINT, stage STRING, progress INT, message STRING"


def walk(events):
    """The rate limit, event by event."""
    state, sent = {}, set()
    for s, ts, i, stage, value, message in sorted(events, key=lambda e: (e[1], e[2])):
        at, last, name, n = state.get(s, (None, None, None, 0))
        if (n < 5 or "completed" in stage.lower() or stage == "error" or value >= 100 or stage != name or abs(value - last) >= 3
                or (ts - at).total_seconds() >= 0.2 or any(w in message for w in ("Image ", "image ", "Processing", "Completed", "Failed"))):
            state[s] = (ts, value, stage, n + 1)
            sent.add(i)
    return sent


def noisy(seed, n=400):
    rng, at, out = random.Random(seed), START, []
    for i in range(n):
        at += dt.timedelta(milliseconds=rng.choice([10, 30, 60, 90, 200, 250]))
        out.append((rng.choice("ab"), at, i, rng.choice(["x"] * 30 + ["y", "error"]), rng.choice([1, 2, 3, 4, 5, 100] if rng.random() < 0.1 else [1, 2, 3]), rng.choice(["w"] * 20 + ["Image 1/2"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_equals_the_walk(spark, seed):
    events = noisy(seed)
    got = [r["event_id"] for r in op.throttle(spark.createDataFrame(events, EVENT)).collect()]
    assert len(got) == len(set(got)) and set(got) == walk(events)


def test_throttle_steps(spark):
    def at(*ms):
        return START + dt.timedelta(milliseconds=sum(ms))

    rows = [("a", at(i), i, "x", 0, "w") for i in range(6)]  # the sixth comes too soon
    rows += [("a", at(104), 6, "x", 2, "w"), ("a", at(105), 7, "x", 3, "w"), ("a", at(304), 8, "x", 3, "w"), ("a", at(305), 9, "x", 3, "w"), ("a", at(306), 10, "y", 3, "w")]
    assert {r["event_id"] for r in op.throttle(spark.createDataFrame(rows, EVENT)).collect()} == {0, 1, 2, 3, 4, 7, 9, 10}


def test_running_matches_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame(noisy(3), EVENT)
    order = [F.col("ts"), F.col("event_id")]
    got = running(df, ["session_id"], order, F.date_trunc("SECOND", F.col("ts")), {
        "s": ("sum", F.col("progress")), "hi": ("max", F.col("progress")), "lo": ("min", F.col("progress"))})
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("event_id", F.sum("progress").over(w).alias("s"), F.max("progress").over(w).alias("hi"), F.min("progress").over(w).alias("lo"))
    assert sorted(map(tuple, got.select("event_id", "s", "hi", "lo").collect())) == sorted(map(tuple, wanted.collect()))
    before = previous(df, ["session_id"], ["ts", "event_id"], F.date_trunc("SECOND", F.col("ts")), ["stage"], "p")
    lag = df.select("event_id", F.lag("event_id").over(Window.partitionBy("session_id").orderBy(*order)).alias("p"))
    assert sorted(map(str, map(tuple, before.select("event_id", "p.event_id").collect()))) == sorted(map(str, map(tuple, lag.collect())))


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = top_per_group(spark.range(1000).withColumn("k", F.col("id") % 2), ["k"], [F.desc("id")], 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and sorted(r["id"] for r in df.collect()) == [998, 999]


def test_message_counters(spark):
    messages = ["Processing 5 uploaded images", "Completed image 1/5", "Failed image 2/5", "All completed: Successfully processed 4/5", "Completed image 5/5", "Image 3/9"]
    rows = [("a", START + dt.timedelta(seconds=i), i, "x", 150 if i == 0 else -5, m) for i, m in enumerate(messages)]
    got = op.message_counters(spark.createDataFrame(rows, EVENT)).orderBy("event_id").collect()
    assert [(r["total_items"], r["processed_items"], r["successful_items"], r["failed_items"]) for r in got] == [
        (5, 5, 0, 0), (5, 5, 1, 0), (5, 5, 1, 1), (5, 5, 4, 1), (5, 5, 5, 1), (5, 5, 5, 1)]
    assert (got[0]["progress"], got[1]["progress"]) == (100, 0)


def test_overlay_and_stale(spark):
    as_of = "2024-01-01 12:00:00"
    ddl = "id BIGINT, session_id STRING, state STRING, error_message STRING, percentage_complete INT, current_stage STRING, total_items INT, processed_items INT, successful_items INT, failed_items INT, last_updated TIMESTAMP_NTZ"
    at = lambda m, s: dt.datetime(2024, 1, 1, 12) - dt.timedelta(minutes=m, seconds=s)
    rows = [(i, str(i), "PROCESSING" if i < 4 else "COMPLETED", None, 50, "old", 1, 1, 1, 1, t) for i, t in enumerate([at(5, 59), at(6, 0), at(5, 0), at(0, 1), at(9, 0)])]
    table = spark.createDataFrame(rows, ddl)
    events = [(str(i), t, typ, err, "new", pct, "m", '{"totalItems": "7", "failedItems": "x"}') for i, (t, typ, err, pct) in enumerate(
        [(at(5, 59), "ERROR", "bad", 20), (at(6, 0), "ERROR", "bad", 90), (at(1, 0), "strange", None, 80), (at(1, 0), "COMPLETED", None, None), (at(1, 0), "ERROR", "bad", 99)])]
    latest = spark.createDataFrame(events, "session_id STRING, ts TIMESTAMP_NTZ, type STRING, error STRING, stage STRING, progress INT, message STRING, props STRING")
    got = {r["id"]: (r["state"], r["error_message"], r["percentage_complete"], r["current_stage"], r["total_items"], r["failed_items"]) for r in op.overlay(table, latest, as_of).collect()}
    assert got == {0: ("ERROR", "bad", 50, "new", 7, 1), 1: ("PROCESSING", None, 50, "old", 1, 1), 2: ("PROCESSING", None, 80, "new", 7, 1),
                   3: ("COMPLETED", None, 50, "new", 7, 1), 4: ("COMPLETED", None, 50, "old", 1, 1)}
    assert sorted(r["id"] for r in op.stale(table, as_of).collect()) == [1]
    assert sorted(r["id"] for r in op.stale(table, as_of, strict=True).collect()) == [0, 1]


def test_throttle_stream_does_not_depend_on_arrow_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.createDataFrame(
        [("s", i, 5 if i % 9 else 9, "waiting", "comparing") for i in range(300)],
        "session_id STRING, event_id BIGINT, progress INT, message STRING, stage STRING",
    ).selectExpr(
        "session_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, CAST(event_id AS DECIMAL(18, 6)) * 0.03) AS ts",
        "event_id", "stage", "progress", "message", "'PROCESSING' AS type", "CAST(NULL AS STRING) AS error")
    wanted = sorted(r["event_id"] for r in op.throttle(events).collect())
    events.orderBy(F.desc("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = op.throttle_stream(own.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    assert sorted(r["event_id"] for r in own.table("throttled").collect()) == wanted and 5 < len(wanted) < 300

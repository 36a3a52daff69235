import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from longbox.streaming import arrivals, current
from longbox.streaming import progress as op

START = dt.datetime(2024, 1, 1)
EVENT = "session_id STRING, ts TIMESTAMP_NTZ, event_id BIGINT, stage STRING, progress INT, message STRING, type STRING, error STRING, props STRING"


def events(seed, n=300):
    draw = random.Random(seed)
    words = ["Processing image 3/9", "waiting", "Image 1/2", "Successfully processed 2/5", None, "Failed to process x"]
    rows = [
        (draw.choice("aaaabc"), START + dt.timedelta(seconds=20 * i), i, draw.choice(["x", "comparing", "error"]), draw.randrange(101), draw.choice(words), "PROCESSING", None, None)
        for i in range(n)
    ]
    return rows


class Folder:
    """Rows given trigger by trigger to a stream that goes on where it stopped."""

    def __init__(self, spark, path, ddl):
        self.spark, self.path, self.ddl = spark, str(path), ddl

    def add(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self.spark.readStream.schema(self.ddl).parquet(f"{self.path}/in")


def done(query):
    assert query.awaitTermination(120)


def parts(rows, seed, n=3):
    """Time-ordered slices, each in no order."""
    size = len(rows) // n
    out = [rows[i * size : (i + 1) * size if i < n - 1 else None] for i in range(n)]
    for part in out:
        random.Random(seed).shuffle(part)
    return out


def test_latest_and_history_after_three_triggers(spark, tmp_path):
    rows = events(1)
    random.Random(2).shuffle(rows)
    whole = spark.createDataFrame(rows, EVENT)
    folder = Folder(spark, tmp_path, EVENT)
    latest = current.KeyedTable(spark, f"{tmp_path}/latest", whole.schema, "session_id", 4)
    history = current.KeyedTable(spark, f"{tmp_path}/history", op.history(whole, 7).schema, "session_id", 4)
    for part in parts(rows, 3):
        stream = folder.add(part)
        done(current.latest_stream(stream, latest, f"{tmp_path}/c1"))
        done(current.history_stream(stream, history, f"{tmp_path}/c2", 7))
    def got(df):
        return sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert got(latest.current()) == got(op.latest_progress(whole)) and latest.current().count() == 3
    assert got(history.current()) == got(op.history(whole, 7)) and history.current().count() == 21
    assert len(latest._children("manifest", "batch=")) == 2


def test_counters_equal_the_batch_form(spark, tmp_path):
    rows = events(4)
    folder = Folder(spark, tmp_path, EVENT)
    schema = spark.createDataFrame([], current.TRACKED).schema
    table = current.KeyedTable(spark, f"{tmp_path}/t", schema, "session_id", 4)
    for part in parts(rows, 5):
        done(current.counters_stream(folder.add(part), table, f"{tmp_path}/out", f"{tmp_path}/c"))
    names = ["event_id", "total_items", "processed_items", "successful_items", "failed_items"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*names).collect()
    wanted = op.message_counters(spark.createDataFrame(rows, EVENT)).select(*names).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, wanted), key=lambda r: r[0])
    assert table.current().count() == 3


LIFE = "session_id STRING, kind STRING, ts TIMESTAMP_NTZ, series_id BIGINT, started_by STRING, error_message STRING, percentage_complete INT, " \
    "current_stage STRING, status_message STRING, total_items INT, processed_items INT, successful_items INT, failed_items INT"
PROGRESS = "session_id STRING, state STRING, time_started TIMESTAMP_NTZ, time_finished TIMESTAMP_NTZ, series_id BIGINT, started_by STRING, error_message STRING, percentage_complete INT"


def test_a_trigger_run_again_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], PROGRESS).schema
    table = current.KeyedTable(spark, f"{tmp_path}/t", schema, "session_id", 2)
    at = [START + dt.timedelta(minutes=i) for i in range(9)]
    triggers = [
        [("a", "start", at[0], 7, "x", None, None), ("b", "start", at[1], 8, "x", None, None)],
        [("a", "complete", at[2], None, None, None, 100), ("ghost", "complete", at[2], None, None, None, 100)],
        [("b", "error", at[3], None, None, "bad", None)],
    ]
    for n, rows in enumerate(triggers):
        changes = spark.createDataFrame([(*row, *(None,) * 6) for row in rows], LIFE)
        table.upsert(n, changes, op.apply_lifecycle)
        first = sorted(map(repr, table.current().collect()))
        # Killed before the manifest was written, or after: the rerun gives the same.
        table.upsert(n, changes, op.apply_lifecycle)
        assert sorted(map(repr, table.current().collect())) == first
    got = {r["session_id"]: (r["state"], r["error_message"], r["percentage_complete"]) for r in table.current().collect()}
    assert got == {"a": ("COMPLETED", None, 100), "b": ("ERROR", "bad", None)}


def test_a_killed_trigger_leaves_the_version_before(spark, tmp_path):
    schema = spark.createDataFrame([], "session_id STRING, n INT").schema
    table = current.KeyedTable(spark, f"{tmp_path}/t", schema, "session_id", 2)
    one, two = (spark.createDataFrame([("a", n), (str(n), n)], schema) for n in (1, 2))
    table.upsert(0, one, current.replaced("session_id"))

    def broken(held, new):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        table.upsert(1, two, broken)
    assert sorted(map(tuple, table.current().collect())) == [("1", 1), ("a", 1)]
    table.upsert(1, two, current.replaced("session_id"))
    assert sorted(map(tuple, table.current().collect())) == [("1", 1), ("2", 2), ("a", 2)]


def test_overlay_sees_rows_stored_since(spark, tmp_path):
    stored_ddl = "session_id STRING, state STRING, error_message STRING, percentage_complete INT, current_stage STRING, status_message STRING, last_updated TIMESTAMP_NTZ, " \
        "total_items INT, processed_items INT, successful_items INT, failed_items INT"
    blank = (None,) * 9
    spark.createDataFrame([("a", "PROCESSING", *blank)], stored_ddl).write.parquet(f"{tmp_path}/stored")

    def stored():
        return spark.read.schema(stored_ddl).parquet(f"{tmp_path}/stored")

    folder = Folder(spark, tmp_path, EVENT)
    latest = current.KeyedTable(spark, f"{tmp_path}/latest", spark.createDataFrame([], EVENT).schema, "session_id", 2)
    shown = current.KeyedTable(spark, f"{tmp_path}/shown", stored().schema, "session_id", 2)

    def trigger(*rows):
        stream = folder.add([(s, START, i, "x", p, "m", "PROCESSING", None, None) for s, i, p in rows])
        done(current.overlay_stream(stream, stored, latest, shown, f"{tmp_path}/c", "2024-01-01 00:01:00"))
        return {r["session_id"]: r["percentage_complete"] for r in shown.current().collect()}

    assert trigger(("a", 1, 10), ("b", 2, 20)) == {"a": 10}
    spark.createDataFrame([("b", "PROCESSING", *blank)], stored_ddl).write.mode("append").parquet(f"{tmp_path}/stored")
    assert trigger(("b", 3, 30)) == {"a": 10, "b": 30}
    assert trigger(("b", 0, 5)) == {"a": 10, "b": 30}


def test_expired_sessions_come_out_once(spark, tmp_path):
    ddl = "session_id STRING, ts TIMESTAMP"
    folder = Folder(spark, tmp_path, ddl)
    utc = START.replace(tzinfo=dt.timezone.utc)

    def trigger(*rows):
        stream = folder.add([(s, utc + dt.timedelta(hours=h)) for s, h in rows])
        query = (
            current.expired_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        )
        done(query)
        out = spark.read.schema("session_id STRING, last TIMESTAMP").parquet(f"{tmp_path}/out")
        hour = F.timestamp_diff("HOUR", F.lit(utc).cast("timestamp"), F.col("last"))
        return sorted((r[0], r[1]) for r in out.select("session_id", hour).collect())

    assert trigger(("a", 0), ("b", 1), ("a", 1)) == []
    assert trigger(("b", 3), ("c", 3)) == [("a", 1)]
    assert trigger(("c", 9), ("a", 9)) == [("a", 1), ("b", 3)]


def test_arrivals_once_over_triggers(spark, tmp_path):
    ddl = "id BIGINT, series_id BIGINT, file_path STRING, file_name STRING"
    ledger = spark.createDataFrame([(1, "x/1.jpg", "COMPLETED"), (1, "x/2.jpg", "ERROR")], "series_id BIGINT, file_path STRING, state STRING")
    folder = Folder(spark, tmp_path, ddl)
    for names in (["1.jpg", "2.jpg", "3.jpg"], ["2.jpg", "3.jpg", "4.jpg", "a.txt"], ["4.jpg", "4.jpg"]):
        stream = folder.add([(i, 1, f"x/{name}", name) for i, name in enumerate(names)])
        done(arrivals.arrivals(stream, ledger, f"{tmp_path}/out", f"{tmp_path}/c"))
    got = sorted((r["file_path"], r["decision"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("x/2.jpg", "retry", "PROCESSING"), ("x/3.jpg", "new", "PROCESSING"), ("x/4.jpg", "new", "PROCESSING")]

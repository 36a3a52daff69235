"""Keyed tables that streams keep current, trigger by trigger.

A trigger's rows are merged into the table by plain DataFrame operators, so a
session of any size is shuffled and sorted by Spark; what is carried from trigger
to trigger is a bounded row set per key. A trigger that is run again after a
failure starts from the same earlier version and gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from longbox.streaming import progress as op

BUCKETS = 16
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Rows by key in hash buckets, of which a trigger rewrites those it touches.

    Layout: ``version=N/bucket=B`` are the rows that trigger N wrote,
    ``manifest/batch=N`` names each bucket's version after it. Writing the
    manifest commits the trigger. Those of the last two triggers stay, with the
    versions they name; older ones are deleted.
    """

    MANIFEST = "bucket INT, version BIGINT"

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, name: str, prefix: str) -> list[int]:
        path, store = self._path(name)
        if not store.exists(path):
            return []
        names = [status.getPath().getName() for status in store.listStatus(path)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _manifest(self, batch: int) -> dict[int, int]:
        """Version of each bucket; one row a bucket, so never more than ``buckets``."""
        path, store = self._path(f"manifest/batch={batch}/_SUCCESS")
        if not store.exists(path):
            return {}
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest/batch={batch}").collect()
        return {row["bucket"]: row["version"] for row in rows}

    def _versions(self, before: int | None) -> dict[int, int]:
        for batch in reversed(self._children("manifest", "batch=")):
            if (before is None or batch < before) and (found := self._manifest(batch)):
                return found
        return {}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/version={version}/bucket={bucket}" for bucket, version in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def current(self, before: int | None = None) -> DataFrame:
        """All rows, or those before trigger ``before``."""
        return self._rows(self._versions(before))

    def upsert(self, batch_id: int, changes: DataFrame, merge: Merge) -> None:
        """Rows of ``changes`` merged into those of their buckets: ``merge(held, changes)``."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        changes = changes.withColumn("_bucket", bucket).persist()
        try:
            touched = [row[0] for row in changes.select("_bucket").distinct().collect()]
            versions = self._versions(batch_id)
            held = self._rows({b: v for b, v in versions.items() if b in touched})
            merged = merge(held, changes.drop("_bucket")).select(*self.schema.names).withColumn("bucket", bucket)
            written = merged.hint("rebalance", "bucket").write.mode("overwrite")
            written.partitionBy("bucket").parquet(f"{self.folder}/version={batch_id}")
        finally:
            changes.unpersist()
        now = {b: v for b, v in versions.items() if b not in touched}
        now |= {b: batch_id for b in self._children(f"version={batch_id}", "bucket=")}
        rows = self.spark.createDataFrame(sorted(now.items()), self.MANIFEST).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")
        self._clean(batch_id, set(now.values()) | set(versions.values()))

    def _clean(self, batch_id: int, named: set[int]) -> None:
        earlier = [b for b in self._children("manifest", "batch=") if b < batch_id]
        old = [f"manifest/batch={b}" for b in earlier[:-1]]
        old += [f"version={v}" for v in self._children(".", "version=") if v < batch_id and v not in named]
        for name in old:
            path, store = self._path(name)
            store.delete(path, True)


def start(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``handle`` on each trigger over all there is."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_stream(events: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep the latest event of each session in ``table``: one row a session."""

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        return op.latest_progress(held.unionByName(new))

    return start(events, checkpoint, lambda batch, n: table.upsert(n, op.latest_progress(batch), merge))


def history_stream(events: DataFrame, table: KeyedTable, checkpoint: str, n: int = op.HISTORY) -> StreamingQuery:
    """Keep the last ``n`` events of each session in ``table``, with their rank."""

    def last(rows: DataFrame) -> DataFrame:
        return op.history(rows, n)

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        return last(held.unionByName(new).drop("rank"))

    return start(events, checkpoint, lambda batch, i: table.upsert(i, last(batch), merge))


TRACKED = "session_id STRING, total_items INT, processed_items INT, successful_items BIGINT, failed_items BIGINT"


def counters_stream(events: DataFrame, table: KeyedTable, out: str, checkpoint: str) -> StreamingQuery:
    """Events with the counters known after each, to ``out``, a folder per trigger.

    ``table`` (``TRACKED``) carries one row of counters per session over triggers.
    Within a trigger events count in order of time, whatever order they come in.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch={batch_id}"
        carried = table.current(before=batch_id).join(batch.select("session_id").distinct(), "session_id", "left_semi")
        op.message_counters(batch, carried).write.mode("overwrite").parquet(path)
        counted = batch.sparkSession.read.parquet(path)
        values = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "session_id"]
        newest = F.max_by(F.struct(*values), F.struct("ts", "event_id")).alias("_c")
        tracked = counted.groupBy("session_id").agg(newest).select("session_id", "_c.*")
        table.upsert(batch_id, tracked, replaced("session_id"))

    return start(events, checkpoint, handle)


def replaced(key: str) -> Merge:
    """Merge that puts new rows in place of those held with the same key."""
    return lambda held, new: held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def lifecycle_stream(events: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Apply start, complete and error events to the progress rows of ``table``."""
    return start(events, checkpoint, lambda batch, n: table.upsert(n, batch, op.apply_lifecycle))


def overlay_stream(
    events: DataFrame, stored: Callable[[], DataFrame], latest: KeyedTable, shown: KeyedTable, checkpoint: str, as_of: str
) -> StreamingQuery:
    """Keep running sessions with their live event on top in ``shown``.

    ``stored`` reads the progress rows anew in each trigger, so sessions saved since
    the last one are seen. Sessions touched by a trigger are shown again.
    """

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        return op.latest_progress(held.unionByName(new))

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest.upsert(batch_id, op.latest_progress(batch), merge)
        touched = batch.select("session_id").distinct()
        live = latest.current(before=batch_id + 1).join(touched, "session_id", "left_semi")
        rows = stored().join(touched, "session_id", "left_semi")
        shown.upsert(batch_id, op.overlay(rows, live, as_of), replaced("session_id"))

    return start(events, checkpoint, handle)


# --- expiry by timers --------------------------------------------------------

LAST = "last TIMESTAMP, timer BIGINT"


class _Expiry(StatefulProcessor):
    """State of one session: its last event and the timer set for it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        last = max([batch["ts"].max() for batch in rows] + ([pd.Timestamp(held[0])] if held else []))
        if held:
            self.handle.deleteTimer(held[1])
        timer = last.value // 1_000_000 + self.idle_ms
        self.handle.registerTimer(timer)
        self.state.update((last.to_pydatetime(), timer))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"session_id": [key[0]], "last": [last]})

    def close(self) -> None:
        pass


def expired_stream(events: DataFrame, hours: int = 2, delay: str = "0 seconds") -> DataFrame:
    """(session_id, last) of each session without an event for ``hours``.

    ``events``: session_id, ts (TIMESTAMP). A timer per session runs on the
    watermark; an expired session leaves the state and comes out once. An event
    after that opens the session anew. Only the latest event of an Arrow batch is
    shuffled, so a session that floods the stream stays small.
    """

    def latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("session_id", as_index=False)["ts"].max()

    reduced = events.select("session_id", "ts").mapInPandas(latest, "session_id STRING, ts TIMESTAMP")
    return reduced.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(
        _Expiry(hours * 3_600_000), "session_id STRING, last TIMESTAMP", "Append", "EventTime"
    )

"""One key with two fifths of all rows: same results, spread over tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from longbox.operators.matching import pair_blocks
from longbox.plans.scale import running


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(spark, n=20_000):
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 5 < 2 THEN 'hot' ELSE concat('k', id % 97) END AS k",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts", "id % 7 AS v")


def test_running_values_of_a_hot_key_use_many_tasks(uncoalesced):
    df = skewed(uncoalesced)
    got = running(df, ["k"], [F.col("ts")], F.date_trunc("HOUR", F.col("ts")), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    tasks = got.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    assert got.select("id", "s", "m").exceptAll(wanted).isEmpty() and got.count() == wanted.count()


def test_a_hot_session_is_many_blocks(spark):
    ddl = "session_id STRING, image_id BIGINT, role STRING, detector STRING, kp_id BIGINT"
    rows = [("hot", i % 50, "query" if i % 50 < 5 else "candidate", "sift", i) for i in range(1000)] + [("cold", 0, "query", "sift", 1)]
    got = {r["session_id"]: (r["query_blocks"], r["candidate_blocks"], r["image_pairs"]) for r in pair_blocks(spark.createDataFrame(rows, ddl), 100).collect()}
    assert got == {"hot": (1, 9, 225), "cold": (1, 0, 0)}

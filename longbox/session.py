"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the plans rely on. AQE splits skewed join partitions and coalesces
# small ones. Nothing is broadcast by hand outside ``longbox.llm``: Spark does so
# only for a side below its size threshold, by estimate or as measured at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State of streams lies on disk, not in the heap of executors.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "longbox", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; cluster values come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder named by the cluster; ``fallback`` only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or fallback

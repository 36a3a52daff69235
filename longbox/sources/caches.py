"""Presets and the feature cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import url_hash
from longbox.sources.documents import retain

PRESETS = (
    "presets MAP<STRING, STRUCT<image_size: INT, max_workers: INT, detectors: MAP<STRING, INT>, "
    "feature_weights: MAP<STRING, DOUBLE>, options: MAP<STRING, BOOLEAN>>>, performance_level STRING"
)
DEFAULT_LEVEL = "balanced"


def load_presets(df: DataFrame, column: str = "config") -> DataFrame:
    """(preset, detector, n, weight, image_size, max_workers, options) rows."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_json(column, PRESETS).alias("_c"))
    presets = parsed.select(*keep, F.explode("_c.presets").alias("preset", "_p"))
    return presets.select(*keep, "preset", "_p", F.explode("_p.detectors").alias("detector", "n")).select(
        *keep,
        "preset",
        "detector",
        "n",
        F.try_element_at(F.col("_p.feature_weights"), F.col("detector")).alias("weight"),
        "_p.image_size",
        "_p.max_workers",
        "_p.options",
    )


def select_preset(presets: DataFrame, environment: str | None, configured: str | None) -> DataFrame:
    """Rows of the level in force: environment, else configuration, else balanced."""
    level = (environment or "").lower() or configured or DEFAULT_LEVEL
    return presets.filter(F.col("preset") == level)


def retain_cache(images: DataFrame, features: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(images, features) without images unused for ``days`` and their features.

    Images whose last use is unknown stay.
    """
    known = retain(images, "last_accessed", as_of, days)
    kept = known.unionByName(images.filter(F.col("last_accessed").isNull()))
    gone = images.join(kept.select("url_hash"), "url_hash", "left_anti").select("url_hash")
    return kept, features.join(gone, "url_hash", "left_anti")


def feature_misses(candidates: DataFrame, cache: DataFrame, cache_only: bool = False) -> DataFrame:
    """Distinct candidate urls with ``cached``; what is not must be computed.

    In cache-only mode the misses are dropped instead.
    """
    keyed = candidates.select("url").distinct().withColumn("url_hash", url_hash(F.col("url")))
    held = cache.select("url_hash").distinct().withColumn("_hit", F.lit(True))
    joined = keyed.join(held, "url_hash", "left").withColumn("cached", F.col("_hit").isNotNull()).drop("_hit")
    return joined.filter("cached") if cache_only else joined

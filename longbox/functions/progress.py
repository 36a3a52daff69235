"""Fields hidden in progress messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longbox.functions.text import capitalised

# Stage names and their labels.
STAGE_LABELS = {
    "processing_data": "Processing Data",
    "initializing_matcher": "Initializing Matcher",
    "extracting_features": "Extracting Features",
    "comparing_images": "Comparing Images",
    "processing_results": "Processing Results",
    "finalizing": "Finalizing Results",
    "completed": "COMPLETED",
}
# Message patterns.
TOTAL_PATTERN = r"(\d+)\s+(?:uploaded\s+)?images?|Image\s+\d+/(\d+)"
CURRENT_PATTERN = r"Image\s+(\d+)/\d+|candidate\s+(\d+)/\d+|Processing\s+(\d+)"
SUCCESS_PATTERN = r"Successfully processed (\d+)/(\d+)"


def _group(message: Column, pattern: str, *groups: int) -> Column:
    found = [F.regexp_extract(message, pattern, g) for g in groups]
    return F.coalesce(*[F.when(f != "", f).try_cast("int") for f in found])


def stage_label(stage: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, label in STAGE_LABELS.items():
        known = F.when(stage == name, label).otherwise(known)
    other = F.when(stage != "", capitalised(F.lower(F.replace(stage, F.lit("_"), F.lit(" "))), r"(?<!\p{L})(?=\p{L})"))
    return F.coalesce(known, other)


def parse_message(message: Column, stage: Column) -> Column:
    """Struct of what one message says by itself; running totals come later."""
    text = F.coalesce(message, F.lit(""))
    low = F.lower(text)
    bad = low.contains("failed") | low.contains("error")
    done = low.contains("completed") & ~bad
    ok = F.when(done, _group(text, SUCCESS_PATTERN, 1))
    of = F.when(done, _group(text, SUCCESS_PATTERN, 2))
    image = low.contains("image ")
    return F.struct(
        _group(text, TOTAL_PATTERN, 1, 2).alias("total"),
        _group(text, CURRENT_PATTERN, 1, 2, 3).alias("current"),
        ok.alias("set_success"),
        (of - ok).alias("set_failed"),
        F.when(done & ok.isNull() & image, 1).otherwise(0).alias("add_success"),
        F.when(bad & image, 1).otherwise(0).alias("add_failed"),
        F.when(text != "", stage_label(stage)).alias("stage_label"),
    )

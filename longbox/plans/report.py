"""The whole statistics report as one (section, key, value) frame."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.operators import aggregates as agg
from longbox.operators import ranking
from longbox.sources.tables import shared_folder


def _cells(section: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of ``df`` as cells: ``<key value>.<column>`` → text of the value."""
    names = [c for c in df.columns if c != key]
    label = (lambda c: F.concat_ws(".", F.col(key).cast("string"), F.lit(c))) if key else F.lit
    cells = [F.struct(label(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names]
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))


def _written(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared folder and read back."""
    folder = shared_folder(df.sparkSession, "facts")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def collection_report(tables: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """All statistics sections.

    The issues are the large table: they are read once into facts per (series,
    condition, month), which are written to the shared folder for the sections
    made from them, and once more for the newest issues.
    """
    series, issues, missing = tables["series"], tables["issues"], tables["missing_issues"]
    progress, files, syncs = tables["progress"], tables["files"], tables["syncs"]
    facts = _written(agg.issue_facts(issues, ["series_id", "condition", agg.first_day()]))

    def counts(key: str, name: str) -> DataFrame:
        return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias(name))

    per_series = counts("series_id", "issue_count")
    sections = [
        _cells("overview", agg.overview_of(series, facts, missing)),
        _cells("publisherBreakdown", agg.publisher_breakdown_of(series, per_series), "name"),
        _cells("decadeBreakdown", agg.decades(series), "decade"),
        _cells("conditionBreakdown", counts("condition", "count"), "condition"),
        _cells("topSeriesByIssueCount", agg.top_names(agg.counts_per_name(per_series, series)), "name"),
        _cells("collectionGrowth", agg.growth_of(counts("first_day", "added"), as_of), "month"),
        _cells("completionStats", agg.completion(series)),
        _cells("topSeriesCompletion", agg.completion_rank(series), "id"),
        _cells("leastCompleteSeriesCompletion", agg.completion_rank(series, least=True), "id"),
        _cells("valueAnalysis", agg.values_of(facts, series)),
        _cells("newestSeries", ranking.newest_series(series).select("id", "name", "publisher"), "id"),
        _cells(
            "newestIssues",
            ranking.newest_issues(issues, series, ties=["id", "series_id"]).select("id", "series_name", "issue_number"),
            "id",
        ),
        _cells("readStats", agg.read_stats_of(facts)),
        _cells("sessionDistribution", agg.session_dist(progress).select(
            F.concat_ws(".", "kind", "key").alias("key_"), "count"), "key_"),
        _cells("sessionDurations", agg.durations(progress)),
        _cells("sessionSuccess", agg.success_rate(progress)),
        _cells("sessionItems", agg.items(progress)),
        _cells("processingByDayOfWeek", agg.by_weekday(progress), "weekday"),
        _cells("processingByMonth", agg.by_month(progress), "month"),
        _cells("recentSessions", ranking.recent_sessions(progress, as_of).select("session_id", "state", "duration"), "session_id"),
        _cells("fileStats", agg.file_stats(files)),
        _cells("fileStates", agg.file_states(files), "state"),
        _cells("filesPerDay", agg.files_per_day(files, as_of), "day"),
        _cells("syncStats", agg.sync_stats(syncs)),
        _cells("syncStates", agg.sync_states(syncs), "sync_status"),
        _cells("recentSyncs", ranking.recent_syncs(syncs).select("id", "series_id", "sync_status"), "id"),
        _cells("syncsNeedingAttention", ranking.sync_attention(syncs, as_of).select("id", "series_id", "sync_status"), "id"),
    ]
    return reduce(DataFrame.unionByName, sections)

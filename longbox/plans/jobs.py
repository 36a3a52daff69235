"""Scheduled work as batch jobs over all series at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from longbox.operators import joins
from longbox.streaming.arrivals import unseen


def run_job(name: str, tables: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """``missing`` (daily), ``sync`` (daily) or ``reverify`` (weekly)."""
    if name == "missing":
        return joins.reconcile_missing(
            tables["catalogue_issues"], tables["issues"], tables["missing_issues"], tables["series"], as_of
        )
    if name == "sync":
        return unseen(tables["listing"], tables["ledger"])
    if name == "reverify":
        return joins.reverify_series(
            tables["series"], tables["catalogue"], tables["gcd_series"], tables["catalogue_issues"], as_of
        )
    raise ValueError(f"unknown job {name}")

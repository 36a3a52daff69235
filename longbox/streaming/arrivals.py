"""File arrivals: repeated folder listings against the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from longbox.operators.filters import image_files
from longbox.operators.joins import new_files


def unseen(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Image files of a listing that are new or to be tried again, once each."""
    once = image_files(listing).dropDuplicates(["series_id", "file_path"])
    return new_files(once, ledger).filter(F.col("decision") != "skip")


def arrivals(listings: DataFrame, ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add each unseen file of a stream of listings to the ledger at ``path`` as running.

    The keys of files seen are state of the stream (in RocksDB, if the session says
    so), so a trigger reads its listing and ``ledger`` and no earlier output. The
    sink commits each trigger's files once, also when it is run again.
    """
    found = unseen(listings, ledger).withColumn("state", F.lit("PROCESSING"))
    return (
        found.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Typed table folders, bulk copies, and column types from data."""

from __future__ import annotations

import logging
import os
import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.schemas import SCHEMAS
from longbox.session import checkpoint_dir

log = logging.getLogger(__name__)


def load_tables(
    spark: SparkSession, folder: str, schemas: dict[str, str] = SCHEMAS
) -> dict[str, DataFrame]:
    """Every table under its explicit schema; no inference, no extra file scan."""
    return {name: spark.read.schema(s).parquet(f"{folder}/{name}.parquet") for name, s in schemas.items()}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors reach; the machine's own only in local mode."""
    named = checkpoint_dir(spark)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix=f"longbox-{purpose}-")
    job = f"{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"
    return f"{named.rstrip('/')}/{purpose}-{job}"


@dataclass
class ParquetStore:
    """Tables as Parquet folders."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def has(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def write(self, table: str, df: DataFrame, replace: bool) -> None:
        # Truncating and replacing are the same for a folder of files.
        df.write.mode("overwrite").parquet(self.path(table))


@dataclass
class JdbcStore:
    """Tables of a relational database, read and written in parallel.

    ``partitions`` gives (column, lower, upper, tasks) per large table.
    """

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)
    partitions: dict[str, tuple[str, str, str, int]] = field(default_factory=dict)
    batch: int = 10_000

    def _reader(self, query: str):
        return self.spark.read.format("jdbc").option("url", self.url).options(**self.options).option("dbtable", query)

    def has(self, table: str) -> bool:
        """Whether the database lists the table; anything that goes wrong is raised."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for key, value in self.options.items():
            properties.setProperty(key, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            names = connection.getMetaData().getTables(None, None, "%", None)
            found = False
            while not found and names.next():
                found = names.getString("TABLE_NAME").lower() == table.split(".")[-1].lower()
            return found
        finally:
            connection.close()

    def read(self, table: str) -> DataFrame:
        reader = self._reader(table)
        if table in self.partitions:
            column, lower, upper, tasks = self.partitions[table]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", str(tasks))
            )
        return reader.load()

    def write(self, table: str, df: DataFrame, replace: bool) -> None:
        writer = df.write.format("jdbc").option("url", self.url).options(**self.options)
        writer = writer.option("dbtable", table).option("batchsize", str(self.batch))
        # Truncate keeps the table's definition, replacing drops it.
        writer.option("truncate", str(not replace).lower()).mode("overwrite").save()


def copy_tables(
    source: ParquetStore | JdbcStore,
    target: ParquetStore | JdbcStore,
    tables: list[str],
    replace: bool = False,
    transform: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """Copy the chosen tables; (table, status, rows_read, rows_written)."""
    spark = target.spark
    outcome = []
    for table in tables:
        if not source.has(table):
            log.warning("table %s is not in the source", table)
            outcome.append((table, "missing", None, None))
            continue
        df = source.read(table)
        target.write(table, transform(table, df), replace)
        counts = df.count(), target.read(table).count()
        outcome.append((table, "copied" if counts[0] == counts[1] else "mismatch", *counts))
    return spark.createDataFrame(outcome, "table STRING, status STRING, rows_read BIGINT, rows_written BIGINT")


def infer_types(df: DataFrame, primary_keys: tuple[str, ...] = ()) -> DataFrame:
    """(column, type) from all values, in one pass with one row per task.

    Whole numbers give BIGINT, only 0 and 1 INTEGER, ISO dates DATE, anything
    else and nothing at all TEXT. A whole-number primary key is a BIGINT.
    """

    def every(column: str, pattern: str) -> Column:
        return F.bool_and(F.trim(F.col(column).cast("string")).rlike(pattern))

    facts = []
    for c in df.columns:
        facts += [
            every(c, r"^[+-]?\d+$").alias(f"{c}|int"),
            every(c, r"^[01]$").alias(f"{c}|bit"),
            every(c, r"^\d{4}-\d{2}-\d{2}").alias(f"{c}|date"),
        ]
    row = df.agg(*facts)

    def kind(c: str) -> Column:
        whole = F.when(F.col(f"`{c}|bit`") & F.lit(c not in primary_keys), "INTEGER").otherwise("BIGINT")
        return F.when(F.col(f"`{c}|int`"), whole).when(F.col(f"`{c}|date`"), "DATE").otherwise("TEXT")

    pairs = [F.struct(F.lit(c).alias("column"), kind(c).alias("type")) for c in df.columns]
    return row.select(F.inline(F.array(*pairs)))


# Declared column types and the types they become.
DECLARED_TYPES = {
    "integer": ("INTEGER", "bigint"),
    "longtext": ("TEXT", "string"),
    "text": ("TEXT", "string"),
    "datetime": ("TIMESTAMP", "timestamp_ntz"),
    "decimal(10,3)": ("DECIMAL(10,3)", "decimal(10,3)"),
}


def declared_type(name: str) -> tuple[str, str]:
    """(target type, Spark type) of a declared type; unknown ones are TEXT."""
    if re.fullmatch(r"varchar\(\d+\)", name.lower()):
        return name.upper(), "string"
    return DECLARED_TYPES.get(name.lower(), ("TEXT", "string"))


def apply_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Cast columns to their declared types; what does not fit becomes null."""
    return df.select(
        *[F.col(c).try_cast(declared_type(mapping[c])[1]).alias(c) if c in mapping else F.col(c) for c in df.columns]
    )

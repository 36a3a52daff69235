"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame

from longbox.sources.tables import shared_folder


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet, with its writer's options, and read back: a cut in its lineage.

    The table lies below ``spark.checkpoint.dir`` and so outlives any executor.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_output(folder: str, name: str):
    """A new binary file below a shared folder, for a task to write; any store Arrow knows."""
    store, path = FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}", compression=None)


def open_input(path: str):
    """A binary file below a shared folder, to be read from front to back."""
    store, name = FileSystem.from_uri(path)
    return store.open_input_stream(name, compression=None)


def task_name(suffix: str) -> str:
    """A file name of this attempt of this task alone.

    What a lost attempt has written is in no list of files and so never read.
    """
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}-{suffix}"


def one_task_each(files: DataFrame) -> DataFrame:
    """A list of files dealt out to as many tasks as there are files."""
    return files.repartition(max(1, files.count()))

"""Plan pieces that stay parallel when one key holds a third of all rows.

A window partitioned by such a key would sort that third in one task. The
pieces below cut each key into slices of the ordering column instead: slices
are aggregated first (map-side combine), a window runs over the few slice
totals, and the fine-grained window runs per (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def _sliced(df: DataFrame, slice_by: Column) -> DataFrame:
    return df.withColumn(SLICE, slice_by)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    measures: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add running ``sum``, ``max`` or ``min`` columns per key, in ``order``.

    ``slice_by`` must rise with ``order`` (say, the hour of the timestamp).
    """
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}
    totals = _sliced(df, slice_by).groupBy(*keys, SLICE).agg(
        *[aggs[kind](column).alias(name) for name, (kind, column) in measures.items()]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *keys,
        SLICE,
        *[aggs[kind](name).over(before).alias(f"_before_{name}") for name, (kind, _) in measures.items()],
    )
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _sliced(df, slice_by).join(prefix, [*keys, SLICE], "left")
    added = {}
    for name, (kind, column) in measures.items():
        local, earlier = aggs[kind](column).over(inside), F.col(f"_before_{name}")
        if kind == "sum":
            added[name] = F.coalesce(earlier, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            added[name] = (F.greatest if kind == "max" else F.least)(earlier, local)
    return joined.withColumns(added).drop(SLICE, *[f"_before_{name}" for name in measures])


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    value: list[str],
    name: str,
) -> DataFrame:
    """Add struct ``name`` of the ``value`` columns of the row before this one."""
    entry = F.struct(*order, *[v for v in value if v not in order])
    lasts = _sliced(df, slice_by).groupBy(*keys, SLICE).agg(F.max(entry).alias("_last"))
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    prefix = lasts.select(*keys, SLICE, F.lag("_last").over(by_slice).alias("_earlier"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    joined = _sliced(df, slice_by).join(prefix, [*keys, SLICE], "left")
    return joined.withColumn(
        name, F.coalesce(F.lag(entry).over(inside), F.col("_earlier"))
    ).drop(SLICE, "_earlier")


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key. Spark prunes to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= n)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: shuffled and merged, never broadcast.

    Spark guesses a side's size from its files; it does not see how many rows an
    explode makes of one, nor how well the files are compressed.
    """
    return df.hint("merge")


def one_row(spark_df: DataFrame, *columns: Column) -> Column:
    """Scalar subquery: struct of aggregates over a whole frame."""
    return spark_df.agg(F.struct(*columns).alias("row")).scalar()


def total(df: DataFrame, column: Column) -> Column:
    """Scalar subquery of one aggregate over a whole frame."""
    return df.agg(column.alias("value")).scalar()


def single(spark) -> DataFrame:
    """One row to hang scalar subqueries on."""
    return spark.range(1).select()


def order_by(df: DataFrame, *keys: Column) -> DataFrame:
    """Sort on computed keys, computed once per row.

    A sort on an expression evaluates it at every comparison; as columns of
    their own the keys cost one evaluation and are dropped afterwards.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    return keyed.orderBy(*names).drop(*names)

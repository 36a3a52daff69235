import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from longbox import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.build(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values, one result per value."""

    def apply(fn, values, ddl="STRING"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {ddl}")
        return [row[0] for row in df.orderBy("i").select(fn(df["v"]).alias("r")).collect()]

    return apply

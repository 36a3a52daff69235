import __spark_entry__ as entry_module


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["name", "series_count", "issue_count", "percentage"] and df.count() > 0

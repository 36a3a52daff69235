"""A sample of registered queries against their SQL on the smallest folder.

`tools/check.py` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry_module
from longbox.plans.bindings import RAW

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a05_parse_series_json", "a09_parse_listing_xml", "a15_read_results", "b25_text_filter", "c07_reconcile_missing", "c12_reverify_issues",
    "d02_publisher_breakdown", "d10_values", "e13_next_to_read", "f13_record_sync", "h01_make_readable", "h04_normalize_name", "m16_classify", "s03_overlay", "s12_arrivals"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, oracle, name):
    df = entry_module.queries()[name](spark, FOLDER)
    cursor = oracle.execute(entry_module.oracle_sql()[name])
    wanted = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == wanted

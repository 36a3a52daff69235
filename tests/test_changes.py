import datetime as dt

import pytest

from longbox.operators import changes, joins
from longbox.sources import caches, catalogue, documents, listings, tables

AS_OF = "2024-02-01 00:00:00"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_gcd_match_duplicates_and_wildcards(spark):
    ours = spark.createDataFrame([(1, "Red", 1990, 5), (2, "A%z", 1990, 5), (3, "None", 1, 1)], "id BIGINT, name STRING, start_year INT, issues_available_count INT")
    dump = spark.createDataFrame([(12, "RED", 1990, 5), (11, "red", 1990, 5), (13, "a-z", 1990, 5), (14, "RED", 1991, 5)], "id BIGINT, name STRING, year_began INT, issue_count INT")
    pick = lambda df: rows(df.select("id", "gcd_id", "candidates"))
    assert pick(joins.match_gcd_series(ours, dump)) == [(1, 11, 2), (2, None, None), (3, None, None)]
    assert pick(joins.match_gcd_series(ours, dump, like=True)) == [(1, 11, 2), (2, 13, 1), (3, None, None)]


def test_reconcile_missing(spark):
    cat = spark.createDataFrame([
        (1, "a", "1", "", "", "i"), (1, "b", "2", "B", "null", "i"), (1, "c", "3", "C", "2024-01-01", "i"), (1, "d", "4", "D", None, "i"), (1, "e", "5", "E", None, "i")],
        "series_id BIGINT, id STRING, issue_number STRING, name STRING, cover_date STRING, image_url STRING")
    owned = spark.createDataFrame([(1, "d"), (1, "e"), (1, None)], "series_id BIGINT, comic_vine_id STRING")
    known = spark.createDataFrame([(1, "b", "2", "old", None, "i", True, False), (1, "d", "4", "D", None, "i", False, True), (1, "z", "9", "Z", None, "i", False, False)],
        "series_id BIGINT, comic_vine_id STRING, issue_number STRING, expected_issue_name STRING, expected_cover_date DATE, image_url STRING, is_resolved BOOLEAN, dismissed BOOLEAN")
    series = spark.createDataFrame([(1, "S")], "id BIGINT, name STRING")
    done = joins.reconcile_missing(cat, owned, known, series, AS_OF)
    got = {r["comic_vine_id"]: (r["action"], r["is_resolved"], r["expected_issue_name"], r["expected_cover_date"]) for r in done.collect()}
    assert got == {
        "a": ("inserted", False, "S #1", None), "b": ("updated", False, "old", None), "c": ("inserted", False, "C", dt.date(2024, 1, 1)),
        "d": ("resolved", True, "D", None), "z": ("kept", False, "Z", None)}


def test_unowned_or(spark):
    cat = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "3")], "series_id BIGINT, id STRING, issue_number STRING")
    owned = spark.createDataFrame([(1, "a", "7"), (1, None, "2"), (1, "zz", "3")], "series_id BIGINT, comic_vine_id STRING, issue_number STRING")
    assert [r["id"] for r in joins.unowned_or(cat, owned).collect()] == ["c"]


def test_new_files_and_no_candidates(spark):
    listing = spark.createDataFrame([(1, p, p) for p in "abcd"], "series_id BIGINT, file_path STRING, file_name STRING")
    ledger = spark.createDataFrame([(1, "a", "a", "COMPLETED"), (1, "b", "b", "PROCESSING"), (1, "c", "c", "ERROR")], "series_id BIGINT, file_path STRING, file_name STRING, state STRING")
    new = joins.new_files(listing, ledger)
    assert {r["file_path"]: r["decision"] for r in new.collect()} == {"a": "skip", "b": "skip", "c": "retry", "d": "new"}
    series = spark.createDataFrame([(1, 5, 5)], "id BIGINT, issues_owned_count INT, issues_available_count INT")
    after = joins.record_no_candidates(new, series, ledger)
    assert {r["file_path"]: r["state"] for r in after.collect()} == {"a": "COMPLETED", "b": "PROCESSING", "c": "COMPLETED", "d": "COMPLETED"}


def test_dedupe_upload_without_url(spark):
    req = spark.createDataFrame([(1, None, "h"), (2, "s/f", "h"), (3, "s/f", "other"), (4, "flat", "h")], "request_id BIGINT, uploaded_image_url STRING, content_hash STRING")
    issues = spark.createDataFrame([(7, None), (5, "s/f"), (6, "s/f"), (8, "flat")], "id BIGINT, uploaded_image_url STRING")
    hashes = spark.createDataFrame([("s/f", "h"), ("flat", "h")], "uploaded_image_url STRING, content_hash STRING")
    got = {r["request_id"]: r["reuse_id"] for r in joins.dedupe_upload(req, issues, hashes).collect()}
    assert got == {1: 7, 2: 5, 3: None, 4: None}


def test_insert_needs_one_known_series(spark):
    series = spark.createDataFrame([(1, "S"), (2, "T")], "id BIGINT, name STRING")
    ddl = "id BIGINT, series_id BIGINT, issue_number STRING, title STRING, comic_vine_id STRING, uploaded_image_url STRING, content_hash STRING"
    issues = spark.createDataFrame([], "id BIGINT, series_id BIGINT, issue_number STRING, title STRING, comic_vine_id STRING, uploaded_image_url STRING")
    missing = spark.createDataFrame([(1, "c", False)], "series_id BIGINT, comic_vine_id STRING, is_resolved BOOLEAN")
    hashes = spark.createDataFrame([], "uploaded_image_url STRING, content_hash STRING")
    run = lambda r: changes.insert_issues(spark.createDataFrame(r, ddl), issues, series, missing, hashes)
    done = run([(9, 1, "1", "", "c", "u/1", "h")])
    assert rows(done["issues"].select("id", "title")) == [(9, "S #1")]
    assert rows(done["missing_issues"].select("is_resolved")) == [(True,)]
    with pytest.raises(Exception, match="same series"):
        run([(9, 1, "1", "", "c", "u", "h"), (8, 2, "1", "", "c", "u", "h")])["issues"].collect()
    with pytest.raises(Exception, match="not found"):
        run([(9, 3, "1", "", "c", "u", "h")])["issues"].collect()


def test_snapshot_diff_is_null_safe(spark):
    ddl = "k STRING, a STRING"
    old = spark.createDataFrame([("same", None), ("null", None), ("gone", "x")], ddl)
    new = spark.createDataFrame([("same", None), ("null", "x"), ("new", None)], ddl)
    assert rows(changes.snapshot_diff(old, new, "k", ["a"])) == [("gone", "remove"), ("new", "add"), ("null", "update")]
    assert rows(changes.snapshot_merge(old, new, "k")) == [("gone", "x"), ("null", "x"), ("same", None)]


def test_repair_primary(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), ("x", ["a", "b"]), ("x", []), (None, ["a"])], "comic_vine_id STRING, comic_vine_ids ARRAY<STRING>")
    assert [r[0] for r in changes.repair_primary(df).collect()] == ["a", "a", None, "a"]


def test_list_codec(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, " "), (3, "[]"), (4, '["a"]')], "i INT, v STRING")
    assert [r[0] for r in df.orderBy("i").select(documents.decode_list(F.col("v"), "ARRAY<STRING>")).collect()] == [[], [], [], ["a"]]
    bad = spark.createDataFrame([("[",)], "v STRING")
    with pytest.raises(Exception):
        bad.select(documents.decode_list(F.col("v"), "ARRAY<STRING>")).collect()


def test_series_json_branches(spark):
    body = '{"results": [{"resource_type": "issue", "id": 1}, {"resource_type": "volume", "id": 2, "name": null, "start_year": "x", "end_year": 0, "publisher": null}]}'
    got = catalogue.parse_series_json(spark.createDataFrame([(body,), ("{",)], "b STRING"), "b").collect()
    assert len(got) == 1
    assert (got[0]["id"], got[0]["name"], got[0]["start_year"], got[0]["end_year"], got[0]["publisher"], got[0]["image_url"]) == ("2", "null", 0, None, "", None)


def test_listing_xml(spark):
    xml = """<?xml version="1.0"?><d:multistatus xmlns:d="DAV:"><d:response><d:href>/r/f/</d:href><d:propstat><d:prop><d:getetag>"x"</d:getetag></d:prop></d:propstat></d:response>
      <d:response><d:href>/r/f/a%20b.jpg</d:href><d:propstat><d:prop><d:getetag>"e"</d:getetag><d:getcontentlength></d:getcontentlength><d:getlastmodified></d:getlastmodified></d:prop></d:propstat></d:response></d:multistatus>"""
    df = spark.createDataFrame([("/r/f", xml)], "folder STRING, body STRING")
    got = listings.parse_listing_xml(df, "body", "folder", "/r/").collect()
    assert [(r["file_name"], r["file_etag"], r["file_size"], r["file_last_modified"], r["file_path"]) for r in got] == [("a%20b.jpg", "e", None, None, "f/a%20b.jpg")]


def test_read_results_from_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"series_name": "S", "results": []}')
    (tmp_path / "nul.json").write_text('{"series_name": "S\x00"}')
    (tmp_path / "bad.json").write_text('{"series_name": ')
    got = {r["session_id"]: (r["outcome"], r["series_name"]) for r in documents.read_results(spark, str(tmp_path), AS_OF).collect()}
    assert got == {"good": ("loaded", "S"), "nul": ("repaired", "S"), "bad": ("corrupted", "Unknown (Corrupted Data)")}


def test_copy_tables(spark, tmp_path):
    source, target = tables.ParquetStore(spark, str(tmp_path / "a")), tables.ParquetStore(spark, str(tmp_path / "b"))
    source.write("t", spark.range(5), True)
    target.write("t", spark.range(9), True)
    assert rows(tables.copy_tables(source, target, ["t", "u"])) == [("t", "copied", 5, 5), ("u", "missing", None, None)]


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "0", "2024-01-01", "1"), ("22", None, "2024-01-02 x", "a")], "a STRING, b STRING, c STRING, d STRING")
    assert dict(rows(tables.infer_types(df))) == {"a": "BIGINT", "b": "INTEGER", "c": "DATE", "d": "TEXT"}


def test_presets(spark):
    config = '{"presets": {"balanced": {"image_size": 1, "detectors": {"sift": 5}}, "fast": {"image_size": 2, "detectors": {"orb": 5}}}}'
    presets = caches.load_presets(spark.createDataFrame([(config,)], "config STRING"))
    pick = lambda *a: [r["detector"] for r in caches.select_preset(presets, *a).collect()]
    assert (pick(None, None), pick("", "fast"), pick("FAST", "balanced")) == (["sift"], ["orb"], ["orb"])


def test_result_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(2400).coalesce(1).selectExpr(
        "CASE WHEN id >= 400 THEN 'large' WHEN id >= 4 THEN CAST(id DIV 2 AS STRING) END AS session_id",
        "CAST(id AS INT) AS source_image_index", "array(named_struct('url', 'u')) AS matches")
    documents.write_results(rows, str(tmp_path))
    files = [p.relative_to(tmp_path) for p in tmp_path.rglob("part-*.json")]
    assert len({p.name[:10] for p in files}) > 1 and len([p for p in files if p.parent.name == "session_id=large"]) > 1
    assert len({p.parent for p in files}) == 200 and len(files) < 200 + 4
    back = documents.read_images(spark, str(tmp_path), rows.schema)
    assert sorted(back.collect(), key=lambda r: r["source_image_index"]) == sorted(
        [tuple(r) for r in rows.select(*back.columns).collect()], key=lambda r: r[back.columns.index("source_image_index")])

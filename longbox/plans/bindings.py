"""The catalogue's tables, bound to a folder of Parquet tables.

The test folders hold no catalogue data, so each catalogue table is a
projection of one of theirs. ``SPARK`` gives it to Spark; ``ORACLE`` says the
same in plain SQL for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-01 00:00:00"
AS_OF_EVENTS = "2024-02-01 00:00:00"
RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in RAW:
        return raw(spark, folder, name)
    return SPARK[name](spark, folder)


def _series(spark, folder):
    return raw(spark, folder, "part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        "p_brand AS publisher",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(p_type, ' ', p_name) END AS description",
        "1950 + p_size AS start_year",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1950 + p_size + CAST(p_partkey % 10 AS INT) END AS end_year",
        "concat('img/s/', p_partkey) AS image_url",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END AS comic_vine_id",
        "CAST(1 + p_partkey % 2 AS INT) AS link_count",
        "timestamp_ntz'1999-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 1000 AS INT)) AS created_at",
        "p_size AS issues_available_count",
    )


def _series_owned(spark, folder):
    owned = raw(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count("*").cast("int").alias("issues_owned_count")
    )
    return _series(spark, folder).join(owned, "id", "left").fillna(0, ["issues_owned_count"])


def _issues(spark, folder):
    price = "CAST(l_extendedprice AS DECIMAL(12,2))"
    return raw(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS id",
        "l_partkey AS series_id",
        "CAST(l_linenumber AS STRING) AS issue_number",
        "CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN '' ELSE concat('Issue ', l_orderkey) END AS title",
        "CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN '' ELSE concat('Text ', l_suppkey) END AS description",
        "l_suppkey % 2 = 0 AS generated_description",
        "CAST(l_shipdate AS DATE) AS cover_date",
        "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('img/', l_partkey, '-', l_linenumber) END AS image_url",
        "l_returnflag AS condition",
        f"CAST({price} * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS purchase_price",
        f"CAST({price} AS DECIMAL(10,2)) AS current_value",
        "concat(l_partkey, '-', l_linenumber) AS comic_vine_id",
        "l_discount >= 0.09 AS is_key_issue",
        "l_tax >= 0.05 AS is_variants",
        "l_shipdate AS created_at",
        "l_linestatus = 'F' AS read",
        "concat(l_suppkey, '/', l_orderkey, '.jpg') AS uploaded_image_url",
        "CAST(l_orderkey AS STRING) AS session_id",
    )


def _progress(spark, folder):
    return raw(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        "CAST(o_orderkey AS STRING) AS session_id",
        "o_custkey AS series_id",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'ERROR' END AS state",
        "o_orderdate AS time_started",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 5000) END AS time_finished",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MANUAL' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'AUTOMATIC' END AS started_by",
        "CAST(o_orderkey % 101 AS INT) AS percentage_complete",
        "concat('stage_', o_orderkey % 4) AS current_stage",
        "CASE WHEN o_orderstatus = 'P' THEN concat('failure ', o_orderkey % 7) END AS error_message",
        "CAST(o_orderkey % 50 AS INT) AS total_items",
        "CAST(o_orderkey % 40 AS INT) AS processed_items",
        "CAST(o_orderkey % 30 AS INT) AS successful_items",
        "CAST(o_orderkey % 10 AS INT) AS failed_items",
        "o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 20 AS INT), 0) AS last_updated",
        "o_orderkey % 9 = 0 AS dismissed",
    )


def _files(spark, folder):
    labels = raw(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return raw(spark, folder, "documents").join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id",
        "CAST(substr(source, 4) AS BIGINT) AS series_id",
        "concat(source, '/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END) AS file_path",
        "concat(doc_id, CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END) AS file_name",
        "md5(CAST(doc_id AS STRING)) AS file_etag",
        "n_chars AS file_size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 1000 AS INT)) AS processed_at",
        "CASE quality WHEN 1 THEN 'COMPLETED' WHEN 0 THEN 'ERROR' ELSE 'PROCESSING' END AS state",
        "CAST(doc_id % 50 AS STRING) AS session_id",
    )


def _syncs(spark, folder):
    return raw(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id",
        "CAST(s_nationkey AS BIGINT) AS series_id",
        "concat('folder_', s_suppkey % 3) AS folder_path",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(s_suppkey % 700 AS INT)) AS last_sync_timestamp",
        "CAST(s_suppkey % 100 AS INT) AS total_files_count",
        "element_at(array('PENDING', 'IN_PROGRESS', 'COMPLETED', 'FAILED', 'EMPTY'), CAST(s_suppkey % 5 AS INT) + 1) AS sync_status",
        "CASE WHEN s_suppkey % 5 = 3 THEN concat('broken ', s_suppkey) END AS error_message",
        "timestamp_ntz'2024-01-31 22:00:00' + make_dt_interval(0, 0, CAST(s_suppkey % 120 AS INT)) AS updated_at",
    )


def _catalogue_issues(spark, folder):
    numbered = raw(spark, folder, "part").selectExpr(
        "p_partkey", "p_name", "explode(sequence(1, 7)) AS n"
    )
    return numbered.selectExpr(
        "concat(p_partkey, '-', n) AS id",
        "p_partkey AS series_id",
        "CAST(n AS STRING) AS issue_number",
        "CASE WHEN n = 3 THEN '' ELSE concat(p_name, ' ', n) END AS name",
        "concat('About ', p_name) AS description",
        "CASE WHEN (p_partkey + n) % 10 = 0 THEN 'null' WHEN (p_partkey + n) % 10 = 1 THEN '' "
        "ELSE CAST(date_add(DATE'1999-01-01', CAST((p_partkey * 7 + n) % 1200 AS INT)) AS STRING) END AS cover_date",
        "concat('img/', p_partkey, '-', n) AS image_url",
        "transform(CASE WHEN (p_partkey + n) % 3 = 0 THEN array() ELSE sequence(1, CAST((p_partkey + n) % 3 AS INT)) END, "
        "k -> named_struct('id', concat('v', p_partkey, '-', n, '-', k), "
        "'original_url', concat('img/v/', p_partkey, '-', n, '-', k), "
        "'caption', concat('Cover ', k), 'image_tags', 'All Images')) AS variants",
    )


def _missing_issues(spark, folder):
    return raw(spark, folder, "part").selectExpr(
        "p_partkey", "p_name", "explode(sequence(1, 7)) AS n"
    ).filter("(p_partkey + n) % 4 = 0").selectExpr(
        "p_partkey * 8 + n AS id",
        "concat(p_partkey, '-', n) AS comic_vine_id",
        "p_partkey AS series_id",
        "CAST(n AS STRING) AS issue_number",
        "concat(p_name, ' ', n) AS expected_issue_name",
        "CASE WHEN n = 5 THEN NULL ELSE date_add(DATE'2001-06-01', CAST((p_partkey * 7 + n) % 300 AS INT)) END AS expected_cover_date",
        "n % 2 = 0 AS is_resolved",
        "p_partkey % 5 = 0 AS dismissed",
        "concat('img/', p_partkey, '-', n) AS image_url",
        "timestamp_ntz'2001-11-01 00:00:00' + make_dt_interval(CAST(p_partkey % 40 AS INT)) AS created_at",
    )


def _gcd_series(spark, folder):
    return raw(spark, folder, "part").selectExpr(
        "p_partkey + 1000000 AS id",
        "upper(p_name) AS name",
        "1950 + p_size AS year_began",
        "p_size AS issue_count",
        "0 AS deleted",
    )


def _gcd_issues(spark, folder):
    return raw(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS id",
        "CAST(l_linenumber AS STRING) AS number",
        "l_partkey + 1000000 AS series_id",
        "date_format(l_shipdate, 'MMMM yyyy') AS publication_date",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS key_date",
        "l_linenumber AS sort_code",
        "concat('Story ', l_suppkey) AS title",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS deleted",
    )


def _events_bound(spark, folder):
    return raw(spark, folder, "events").selectExpr(
        "event_id",
        "CAST(user_id AS STRING) AS session_id",
        "ts",
        "event_type AS stage",
        "CAST(least(100, floor(value)) AS INT) AS progress",
        "CASE event_type WHEN 'error' THEN concat('Failed image ', event_id % 9 + 1, '/9') "
        "WHEN 'purchase' THEN concat('Completed image ', event_id % 9 + 1, '/9') "
        "WHEN 'signup' THEN concat('Processing ', event_id % 9 + 1, ' uploaded images') "
        "WHEN 'click' THEN concat('candidate ', event_id % 40, '/40') ELSE 'waiting' END AS message",
        "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' AND value > 60 THEN 'COMPLETED' ELSE 'PROCESSING' END AS type",
        "CASE WHEN event_type = 'error' THEN concat('failure ', event_id % 7) END AS error",
        "props",
    )


def _images(spark, folder):
    return raw(spark, folder, "documents").selectExpr(
        "md5(concat(source, '/', doc_id)) AS url_hash",
        "concat(source, '/', doc_id) AS url",
        "n_chars AS file_size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 1000 AS INT)) AS last_accessed",
    )


def _features(spark, folder):
    return raw(spark, folder, "documents").filter("doc_id % 10 <> 0").selectExpr(
        "md5(concat(source, '/', doc_id)) AS url_hash",
        "concat(source, '/', doc_id) AS url",
        "CAST(n_chars % 3 AS INT) AS sift_count",
        "CAST(n_chars % 5 AS INT) AS orb_count",
        "CAST(n_chars % 7 AS INT) AS akaze_count",
        "CAST(n_chars % 2 AS INT) AS kaze_count",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 1000 AS INT)) AS last_accessed",
    )


def _descriptors(spark, folder):
    return raw(spark, folder, "embeddings").selectExpr(
        "CAST(floor(vec_id / 250) AS STRING) AS session_id",
        "CAST(floor(vec_id / 50) AS BIGINT) AS image_id",
        "CASE WHEN floor(vec_id / 50) % 5 = 0 THEN 'query' ELSE 'candidate' END AS role",
        "element_at(array('sift', 'orb', 'akaze', 'kaze'), CAST(vec_id % 4 AS INT) + 1) AS detector",
        "vec_id AS kp_id",
        "CAST(embedding[0] AS DOUBLE) * 100 AS x",
        "CAST(embedding[1] AS DOUBLE) * 100 AS y",
        "transform(embedding, e -> CAST(e AS DOUBLE) * 40) AS descriptor",
        "transform(sequence(0, 3), w -> aggregate(slice(embedding, w * 16 + 1, 16), 0L, "
        "(acc, e) -> acc * 2 + CASE WHEN e > 0 THEN 1L ELSE 0L END)) AS bits",
    )


SPARK = {
    "series": _series,
    "series_owned": _series_owned,
    "issues": _issues,
    "progress": _progress,
    "files": _files,
    "syncs": _syncs,
    "catalogue_issues": _catalogue_issues,
    "missing_issues": _missing_issues,
    "gcd_series": _gcd_series,
    "gcd_issues": _gcd_issues,
    "events_bound": _events_bound,
    "images": _images,
    "features": _features,
    "descriptors": _descriptors,
}

ORACLE = {
    "series": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS publisher,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || ' ' || p_name END AS description,
          1950 + p_size AS start_year,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1950 + p_size + p_partkey % 10 END AS end_year,
          'img/s/' || p_partkey AS image_url,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS comic_vine_id,
          1 + p_partkey % 2 AS link_count,
          TIMESTAMP '1999-01-01 00:00:00' + to_days(CAST(p_partkey % 1000 AS INTEGER)) AS created_at,
          p_size AS issues_available_count
        FROM part""",
    "series_owned": """
        SELECT s.*, coalesce(o.n, 0) AS issues_owned_count FROM series s
        LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) o ON o.l_partkey = s.id""",
    "issues": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS series_id,
          CAST(l_linenumber AS VARCHAR) AS issue_number,
          CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN '' ELSE 'Issue ' || l_orderkey END AS title,
          CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN '' ELSE 'Text ' || l_suppkey END AS description,
          l_suppkey % 2 = 0 AS generated_description,
          CAST(l_shipdate AS DATE) AS cover_date,
          CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'img/' || l_partkey || '-' || l_linenumber END AS image_url,
          l_returnflag AS condition,
          CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS purchase_price,
          CAST(l_extendedprice AS DECIMAL(10,2)) AS current_value,
          l_partkey || '-' || l_linenumber AS comic_vine_id,
          l_discount >= 0.09 AS is_key_issue, l_tax >= 0.05 AS is_variants,
          l_shipdate AS created_at, l_linestatus = 'F' AS read,
          l_suppkey || '/' || l_orderkey || '.jpg' AS uploaded_image_url,
          CAST(l_orderkey AS VARCHAR) AS session_id
        FROM lineitem""",
    "progress": """
        SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS session_id, o_custkey AS series_id,
          CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'ERROR' END AS state,
          o_orderdate AS time_started,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 5000) END AS time_finished,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MANUAL' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'AUTOMATIC' END AS started_by,
          o_orderkey % 101 AS percentage_complete, 'stage_' || (o_orderkey % 4) AS current_stage,
          CASE WHEN o_orderstatus = 'P' THEN 'failure ' || (o_orderkey % 7) END AS error_message,
          o_orderkey % 50 AS total_items, o_orderkey % 40 AS processed_items,
          o_orderkey % 30 AS successful_items, o_orderkey % 10 AS failed_items,
          o_orderdate + to_minutes(o_orderkey % 20) AS last_updated, o_orderkey % 9 = 0 AS dismissed
        FROM orders""",
    "files": """
        SELECT d.doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS series_id,
          source || '/' || d.doc_id || CASE WHEN d.doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END AS file_path,
          d.doc_id || CASE WHEN d.doc_id % 7 = 0 THEN '.txt' ELSE '.JPG' END AS file_name,
          md5(CAST(d.doc_id AS VARCHAR)) AS file_etag, n_chars AS file_size,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id % 1000) AS processed_at,
          CASE quality WHEN 1 THEN 'COMPLETED' WHEN 0 THEN 'ERROR' ELSE 'PROCESSING' END AS state,
          CAST(d.doc_id % 50 AS VARCHAR) AS session_id
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""",
    "syncs": """
        SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS series_id, 'folder_' || (s_suppkey % 3) AS folder_path,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey % 700) AS last_sync_timestamp,
          s_suppkey % 100 AS total_files_count,
          CASE s_suppkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED' ELSE 'EMPTY' END AS sync_status,
          CASE WHEN s_suppkey % 5 = 3 THEN 'broken ' || s_suppkey END AS error_message,
          TIMESTAMP '2024-01-31 22:00:00' + to_minutes(s_suppkey % 120) AS updated_at
        FROM supplier""",
    "catalogue_issues": """
        SELECT p_partkey || '-' || n AS id, p_partkey AS series_id, CAST(n AS VARCHAR) AS issue_number,
          CASE WHEN n = 3 THEN '' ELSE p_name || ' ' || n END AS name, 'About ' || p_name AS description,
          CASE WHEN (p_partkey + n) % 10 = 0 THEN 'null' WHEN (p_partkey + n) % 10 = 1 THEN ''
            ELSE CAST(DATE '1999-01-01' + CAST((p_partkey * 7 + n) % 1200 AS INTEGER) AS VARCHAR) END AS cover_date,
          'img/' || p_partkey || '-' || n AS image_url, (p_partkey + n) % 3 AS variant_count,
          p_partkey AS part_id, n
        FROM part, (SELECT unnest(generate_series(1, 7)) AS n)""",
    "missing_issues": """
        SELECT p_partkey * 8 + n AS id, p_partkey || '-' || n AS comic_vine_id, p_partkey AS series_id,
          CAST(n AS VARCHAR) AS issue_number, p_name || ' ' || n AS expected_issue_name,
          CASE WHEN n = 5 THEN NULL ELSE DATE '2001-06-01' + CAST((p_partkey * 7 + n) % 300 AS INTEGER) END AS expected_cover_date,
          n % 2 = 0 AS is_resolved, p_partkey % 5 = 0 AS dismissed, 'img/' || p_partkey || '-' || n AS image_url,
          TIMESTAMP '2001-11-01 00:00:00' + to_days(CAST(p_partkey % 40 AS INTEGER)) AS created_at
        FROM part, (SELECT unnest(generate_series(1, 7)) AS n) WHERE (p_partkey + n) % 4 = 0""",
    "gcd_series": """
        SELECT p_partkey + 1000000 AS id, upper(p_name) AS name, 1950 + p_size AS year_began,
          p_size AS issue_count, 0 AS deleted FROM part""",
    "gcd_issues": """
        SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_linenumber AS VARCHAR) AS number,
          l_partkey + 1000000 AS series_id, strftime(l_shipdate, '%B %Y') AS publication_date,
          CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS key_date, l_linenumber AS sort_code,
          'Story ' || l_suppkey AS title, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS deleted
        FROM lineitem""",
    "events_bound": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ts, event_type AS stage,
          CAST(least(100, floor(value)) AS INTEGER) AS progress,
          CASE event_type WHEN 'error' THEN 'Failed image ' || (event_id % 9 + 1) || '/9'
            WHEN 'purchase' THEN 'Completed image ' || (event_id % 9 + 1) || '/9'
            WHEN 'signup' THEN 'Processing ' || (event_id % 9 + 1) || ' uploaded images'
            WHEN 'click' THEN 'candidate ' || (event_id % 40) || '/40' ELSE 'waiting' END AS message,
          CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' AND value > 60 THEN 'COMPLETED' ELSE 'PROCESSING' END AS type,
          CASE WHEN event_type = 'error' THEN 'failure ' || (event_id % 7) END AS error, props
        FROM events""",
    "images": """
        SELECT md5(source || '/' || doc_id) AS url_hash, source || '/' || doc_id AS url, n_chars AS file_size,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 1000) AS last_accessed FROM documents""",
    "features": """
        SELECT md5(source || '/' || doc_id) AS url_hash, source || '/' || doc_id AS url,
          n_chars % 3 AS sift_count, n_chars % 5 AS orb_count, n_chars % 7 AS akaze_count, n_chars % 2 AS kaze_count,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 1000) AS last_accessed
        FROM documents WHERE doc_id % 10 <> 0""",
    "descriptors": """
        SELECT CAST(vec_id // 250 AS VARCHAR) AS session_id, vec_id // 50 AS image_id,
          CASE WHEN (vec_id // 50) % 5 = 0 THEN 'query' ELSE 'candidate' END AS role,
          ['sift', 'orb', 'akaze', 'kaze'][CAST(vec_id % 4 AS INTEGER) + 1] AS detector, vec_id AS kp_id,
          CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y,
          list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 40) AS descriptor
        FROM embeddings""",
}


def with_ctes(sql: str) -> str:
    """Put the bound tables that ``sql`` names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in ORACLE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({ORACLE[name]})" for name in needed)
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"WITH {ctes}\n{body}"

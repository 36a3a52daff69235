"""Explicit schemas of the catalogue tables, as DDL text for the readers."""

from __future__ import annotations

CANDIDATE_COVER = (
    "STRUCT<name: STRING, issueNumber: STRING, comicVineId: STRING, urls: ARRAY<STRING>, "
    "error: STRING, parentComicVineId: STRING>"
)
VARIANT_COVER = "STRUCT<id: STRING, originalUrl: STRING, caption: STRING, imageTags: STRING>"

SCHEMAS: dict[str, str] = {
    "series": (
        "id BIGINT, name STRING, description STRING, publisher STRING, start_year INT, end_year INT, "
        "image_url STRING, comic_vine_id STRING, comic_vine_ids ARRAY<STRING>, gcd_ids ARRAY<STRING>, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, last_cached_covers TIMESTAMP_NTZ, "
        "last_reverification TIMESTAMP_NTZ, cached_cover_urls STRING, generated_description BOOLEAN, "
        "issues_available_count INT, issues_owned_count INT, barcode STRING"
    ),
    "issues": (
        "id BIGINT, issue_number STRING, title STRING, description STRING, cover_date DATE, image_url STRING, "
        "condition STRING, purchase_price DECIMAL(10,2), current_value DECIMAL(10,2), purchase_date DATE, "
        "notes STRING, comic_vine_id STRING, gcd_ids ARRAY<STRING>, variant_covers STRING, is_variants BOOLEAN, "
        "is_key_issue BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, series_id BIGINT, "
        "generated_description BOOLEAN, read BOOLEAN, uploaded_image_url STRING, session_id STRING"
    ),
    "missing_issues": (
        "id BIGINT, comic_vine_id STRING, series_id BIGINT, issue_number STRING, expected_issue_name STRING, "
        "expected_cover_date DATE, is_resolved BOOLEAN, image_url STRING, resolved_at TIMESTAMP_NTZ, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, last_checked TIMESTAMP_NTZ, dismissed BOOLEAN"
    ),
    "progress_data": (
        "id BIGINT, state STRING, session_id STRING, time_started TIMESTAMP_NTZ, time_finished TIMESTAMP_NTZ, "
        "series_id BIGINT, percentage_complete INT, current_stage STRING, status_message STRING, "
        "error_message STRING, total_items INT, processed_items INT, successful_items INT, failed_items INT, "
        "last_updated TIMESTAMP_NTZ, started_by STRING, dismissed BOOLEAN"
    ),
    "processed_files": (
        "id BIGINT, series_id BIGINT, file_path STRING, file_name STRING, file_etag STRING, file_size BIGINT, "
        "file_last_modified TIMESTAMP_NTZ, processed_at TIMESTAMP_NTZ, processing_status STRING, "
        "session_id STRING, error_message STRING"
    ),
    "series_sync_status": (
        "id BIGINT, series_id BIGINT, folder_path STRING, last_sync_timestamp TIMESTAMP_NTZ, "
        "total_files_count INT, sync_status STRING, error_message STRING, created_at TIMESTAMP_NTZ, "
        "updated_at TIMESTAMP_NTZ, session_id STRING"
    ),
    "gcd_series": (
        "id BIGINT, name STRING, year_began INT, year_ended INT, issue_count INT, deleted INT"
    ),
    "gcd_issue": (
        "id BIGINT, number STRING, series_id BIGINT, publication_date STRING, key_date STRING, sort_code INT, "
        "title STRING, deleted INT, page_count DECIMAL(10,3)"
    ),
    "cached_images": (
        "url_hash STRING, url STRING, file_path STRING, file_size BIGINT, created_at TIMESTAMP_NTZ, "
        "last_accessed TIMESTAMP_NTZ"
    ),
    "cached_features": (
        "url_hash STRING, url STRING, sift_count INT, orb_count INT, akaze_count INT, kaze_count INT, "
        "processing_time DOUBLE, image_shape STRING, was_cropped BOOLEAN, created_at TIMESTAMP_NTZ, "
        "last_accessed TIMESTAMP_NTZ"
    ),
}

# The domains of the enum columns.
ENUMS = {
    "condition": ["MINT", "NEAR_MINT", "VERY_FINE", "FINE", "VERY_GOOD", "GOOD", "FAIR", "POOR"],
    "state": ["PROCESSING", "COMPLETED", "REPLAYED", "QUEUE", "ERROR"],
    "started_by": ["MANUAL", "AUTOMATIC"],
    "sync_status": ["PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "EMPTY"],
}

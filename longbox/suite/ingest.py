"""Queries over sources, sinks and parsers (inventory section 2.1).

The stored responses these parse are written by Spark from the given tables,
one response per row, so their number grows with the tables.
"""

from pyspark.sql import functions as F

from longbox.plans.bindings import AS_OF_EVENTS
from longbox.schemas import CANDIDATE_COVER
from longbox.sources import caches, catalogue, documents, listings, pages, tables
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add
BASE = "https://site.example"

TYPED = {
    "part": ("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
}


@q("a01_load_tables", """
    SELECT 'part' AS name, count(*) AS rows, CAST(max(p_size) AS VARCHAR) AS top FROM part
    UNION ALL SELECT 'orders', count(*), CAST(max(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT 'lineitem', count(*), CAST(max(l_shipdate) AS VARCHAR) FROM lineitem""")
def _(t):
    loaded = tables.load_tables(t.spark, t.folder, TYPED)
    tops = {"part": "p_size", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    parts = [
        loaded[n].agg(F.count("*").alias("rows"), F.max(c).cast("string").alias("top")).withColumn("name", F.lit(n))
        for n, c in tops.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@q("a02_copy_tables", """
    SELECT 'orders' AS "table", 'copied' AS status, count(*) AS rows_read, count(*) AS rows_written FROM orders
    UNION ALL SELECT 'part', 'copied', count(*), count(*) FROM part
    UNION ALL SELECT 'nowhere', 'missing', NULL, NULL""")
def _(t):
    source = tables.ParquetStore(t.spark, t.folder)
    target = tables.ParquetStore(t.spark, tables.shared_folder(t.spark, "copy"))
    return tables.copy_tables(source, target, ["orders", "part", "nowhere"], replace=True)


@q("a03_infer_types", """
    SELECT * FROM (VALUES ('id', 'BIGINT'), ('bit', 'INTEGER'), ('number', 'BIGINT'), ('day', 'DATE'), ('words', 'TEXT'), ('nothing', 'TEXT')) v("column", "type")""")
def _(t):
    rows = t.lineitem.selectExpr(
        "l_orderkey % 2 AS id", "CAST(l_orderkey % 2 AS STRING) AS bit", "concat(' ', l_partkey) AS number", "CAST(l_shipdate AS STRING) AS day",
        "concat(l_partkey, CASE WHEN l_orderkey = 1 THEN 'x' ELSE '' END) AS words", "CAST(NULL AS STRING) AS nothing")
    return tables.infer_types(rows, primary_keys=("id",))


@q("a04_apply_types", """
    SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity::DOUBLE END AS pages, CAST(l_shipdate AS VARCHAR) AS at, l_returnflag AS flag FROM lineitem""")
def _(t):
    texts = t.lineitem.selectExpr(
        "CAST(l_orderkey AS STRING) AS id", "CASE WHEN l_linenumber = 1 THEN 'many' ELSE CAST(l_quantity AS STRING) END AS pages",
        "CAST(l_shipdate AS STRING) AS at", "l_returnflag AS flag")
    typed = tables.apply_types(texts, {"id": "INTEGER", "pages": "decimal(10,3)", "at": "datetime", "flag": "varchar(50)"})
    return typed.select("id", F.col("pages").cast("double").alias("pages"), F.col("at").cast("string").alias("at"), "flag")


VOLUME = """concat('{"resource_type": "volume", "id": ', p_partkey, ', "name": "', p_name, '", "description": "<p>', p_type, ' &amp; more.</p>Next", "count_of_issues": ', p_size,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN ', "publisher": null' ELSE concat(', "publisher": {"id": 3, "name": "', p_brand, '"}') END,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(', "start_year": "', 1950 + p_size, '"') END,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN ', "end_year": null' WHEN 1 THEN ', "end_year": 0' WHEN 2 THEN '' ELSE concat(', "end_year": ', 1960 + p_size) END,
  CASE WHEN p_partkey % 2 = 0 THEN concat(', "image": {"medium_url": "img/', p_partkey, '"}') ELSE '' END, '}')"""
VOLUME_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, {description} AS description, {count} AS issue_count,
  CASE p_partkey % 3 WHEN 0 THEN {missing} WHEN 1 THEN '' ELSE p_brand END AS publisher, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1950 + p_size END AS start_year,
  CASE WHEN p_partkey % 5 > 2 THEN 1960 + p_size END AS end_year, CASE WHEN p_partkey % 2 = 0 THEN 'img/' || p_partkey END AS image_url FROM part"""
NICE, RAW_TEXT = "p_type || ' & more.\n\nNext'", "'<p>' || p_type || ' &amp; more.</p>Next'"
SERIES_COLUMNS = ["id", "name", "description", "issue_count", "publisher", "start_year", "end_year", "image_url"]


@q("a05_parse_series_json", VOLUME_SQL.format(description=NICE, count="p_size", missing="NULL"))
def _(t):
    body = f"""concat('{{"status_code": 1, "results": [', {VOLUME}, ', {{"resource_type": "issue", "id": 5}}]}}') AS body"""
    return catalogue.parse_series_json(t.part.selectExpr(body), "body").select(*SERIES_COLUMNS)


@q("a06_parse_volumes_json", "SELECT 'list' AS kind, * FROM (" + VOLUME_SQL.format(description=RAW_TEXT, count="NULL::INTEGER", missing="''")
   + ") UNION ALL SELECT 'single', * FROM (" + VOLUME_SQL.format(description=NICE, count="p_size", missing="NULL") + ")")
def _(t):
    many = t.part.selectExpr(f"""concat('{{"results": [', {VOLUME}, ']}}') AS body""")
    one = t.part.selectExpr(f"""concat('{{"results": ', {VOLUME}, '}}') AS body""")
    parsed = catalogue.parse_volumes_json(many, "body").withColumn("kind", F.lit("list"))
    single = catalogue.parse_volumes_json(one, "body", single=True).withColumn("kind", F.lit("single"))
    return parsed.unionByName(single).select("kind", *SERIES_COLUMNS)


# Issue responses of a series, from its catalogue rows.
ISSUE = """concat('{"id": "', id, '", "issue_number": "', issue_number, '", "name": ', CASE WHEN name = '' THEN 'null' ELSE concat('"', name, '"') END,
  ', "description": "<b>', description, '</b>", "cover_date": ', CASE WHEN cover_date = 'null' THEN 'null' ELSE concat('"', cover_date, '"') END,
  ', "image": {"medium_url": "', image_url, '"}',
  CASE WHEN size(variants) = 0 THEN '' ELSE concat(', "associated_images": ', to_json(variants)) END, '}')"""
ISSUE_SQL = """SELECT {head} id, issue_number, CASE WHEN name = '' THEN 'null' ELSE name END AS name, description, cover_date, image_url,
  CASE WHEN variant_count > 0 THEN 'img/v/' || id || '-' || variant_count END AS last_variant FROM catalogue_issues"""


def issue_columns(df, *head):
    last = F.try_element_at(F.transform("variants", lambda v: v["original_url"]), F.lit(-1))
    return df.select(*head, "id", "issue_number", "name", "description", "cover_date", "image_url", last.alias("last_variant"))


@q("a07_parse_issues_json", ISSUE_SQL.format(head="'list' AS kind,") + " UNION ALL " + ISSUE_SQL.format(head="'single' AS kind,"))
def _(t):
    rows = t.catalogue_issues.selectExpr("*", f"{ISSUE} AS item")
    many = rows.selectExpr("""concat('{"results": [', item, ']}') AS body""")
    one = rows.selectExpr("""concat('{"results": ', item, '}') AS body""")
    return issue_columns(catalogue.parse_issues_json(many, "body").withColumn("kind", F.lit("list")), "kind").unionByName(
        issue_columns(catalogue.parse_issues_json(one, "body", single=True).withColumn("kind", F.lit("single")), "kind"))


@q("a08_union_pages", """
    SELECT series_id AS volume_id, id, issue_number FROM catalogue_issues WHERE NOT (series_id % 2 = 0 AND n > 5)""")
def _(t):
    # Pages of three issues; even volumes lose the fifth issue's neighbour, so
    # their second page is short and the third one does not count.
    rows = t.catalogue_issues.selectExpr("series_id AS volume_id", "CAST(issue_number AS INT) AS n", f"{ISSUE} AS item")
    rows = rows.withColumn("page", F.floor((F.col("n") - 1) / 3)).filter("NOT (volume_id % 2 = 0 AND n = 6)")
    # A page is a response of at most three issues.
    bodies = rows.groupBy("volume_id", "page").agg(
        F.concat(F.lit('{"results": ['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("body"))
    return catalogue.union_pages(bodies, size=3).select("volume_id", "id", "issue_number")


XML = """concat('<?xml version="1.0"?><d:multistatus xmlns:d="DAV:"><d:response><d:href>/dav/box/', source, '/</d:href><d:propstat><d:prop><d:getetag>"f', doc_id, '"</d:getetag>',
  '<d:getlastmodified>Mon, 01 Jan 2024 00:00:00 GMT</d:getlastmodified></d:prop><d:status>HTTP/1.1 200 OK</d:status></d:propstat></d:response>',
  '<d:response><d:href>/dav/box/', source, '/', doc_id, '.jpg</d:href><d:propstat><d:prop><d:getlastmodified>', date_format(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 1000 AS INT)), 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT</d:getlastmodified>',
  '<d:getcontentlength>', n_chars, '</d:getcontentlength><d:getcontenttype>image/jpeg</d:getcontenttype><d:getetag>"e', doc_id, '"</d:getetag></d:prop></d:propstat>',
  '<d:propstat><d:prop><d:quota/></d:prop><d:status>HTTP/1.1 404 Not Found</d:status></d:propstat></d:response>',
  '<d:response><d:href>/dav/box/', source, '/notes.txt</d:href><d:propstat><d:prop><d:getetag>"n"</d:getetag></d:prop></d:propstat></d:response></d:multistatus>')"""


@q("a09_parse_listing_xml", """
    SELECT doc_id, source || '/' || doc_id || '.jpg' AS file_path, doc_id || '.jpg' AS file_name, 'e' || doc_id AS file_etag, n_chars AS file_size, 'image/jpeg' AS content_type,
      CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 1000) AS VARCHAR) AS modified FROM documents
    UNION ALL SELECT doc_id, source || '/notes.txt', 'notes.txt', 'n', NULL, '', NULL FROM documents""")
def _(t):
    rows = t.documents.selectExpr("doc_id", "concat('/dav/box/', source) AS folder", f"{XML} AS body")
    files = listings.parse_listing_xml(rows, "body", "folder", "/dav/box/")
    return files.select(
        "doc_id", "file_path", "file_name", "file_etag", "file_size", "content_type", F.col("file_last_modified").cast("string").alias("modified"))


@q("a09_folder_info", """SELECT doc_id, '"f' || doc_id || '"' AS etag, '2024-01-01 00:00:00' AS modified FROM documents""")
def _(t):
    rows = t.documents.selectExpr("doc_id", "concat('/dav/box/', source, '/') AS folder", f"{XML} AS body")
    return listings.folder_info(rows, "body", "folder").select(
        "doc_id", F.col("folder_etag").alias("etag"), F.col("folder_last_modified").cast("string").alias("modified"))


@q("a10_extract_cover_links", """
    SELECT page_id AS search_id, n AS row_at, k AS link_at, 'https://site.example/covers/' || page_id || '/' || k || '.jpg' AS image_url
    FROM pages, (SELECT unnest([0, 1, 2]) AS n), (SELECT unnest([0, 1]) AS k)
    WHERE CASE page_id % 3 WHEN 0 THEN n = 0 WHEN 1 THEN n = 1 ELSE n = 2 END""")
def _(t):
    # The whole stored page surrounds every link that is followed.
    searches = t.pages.selectExpr(
        "page_id AS search_id", "CAST(1 + page_id % 3 AS STRING) AS issue_number",
        "concat(html, '<a class=\"x\" href=\"/series/', page_id, '/\">S</a><a href=\"/series/none/\">no</a>') AS html")
    number = "concat('<tr><td> #', n, ' </td><td><a href=\"/covers/', page_id, '/a/\">a</a><a href=\"/covers/', page_id, '/b/\">b</a></td></tr>')"
    series = t.pages.selectExpr(
        f"concat('{BASE}/series/', page_id, '/') AS url",
        f"concat(html, '<table class=\"wide listing\"><tr><th>No</th></tr>', array_join(transform(array(1, 2, 3), n -> {number}), ''), '</table>') AS html")
    covers = t.pages.selectExpr("page_id", "html", "explode(array(0, 1)) AS k").selectExpr(
        f"concat('{BASE}/covers/', page_id, CASE WHEN k = 0 THEN '/a/' ELSE '/b/' END) AS url",
        "concat(html, '<img src=\"/logo.png\"><img alt=\"c\" src=\"/covers/', page_id, '/', k, '.jpg\">') AS html")
    found = pages.extract_cover_links(searches, series.unionByName(covers), BASE)
    # Row 0 of each listing is its head, so the data rows count from 1.
    return found.select("search_id", (F.col("row_at") - 1).alias("row_at"), "link_at", "image_url")


IMAGES = """concat('<title>Covers :: Page ', page_id, '</title>', html, '<img src="/a/', page_id, '.png" alt="A cover"><div class="cover big"><img src="//cdn/', page_id, '.png"></div>',
  '<img class="cover_img" src="rel/', page_id, '.png"><img src="/x/covers_by_id/', page_id, '.png"><img src="http://h/covers/1.png"><img src="/x/covers_by_id/', page_id, '.png"><img src="/other.png">')"""


@q("a11_extract_images", """
    SELECT page_id, 'Page ' || page_id AS name, 'https://site.example/x/covers_by_id/' || page_id || '.png https://site.example/rel/' || page_id || '.png http://h/covers/1.png https://cdn/'
      || page_id || '.png https://site.example/a/' || page_id || '.png' AS urls FROM pages""")
def _(t):
    rows = pages.extract_images(t.pages.selectExpr("page_id", f"{IMAGES} AS html"), BASE)
    return rows.select("page_id", "name", F.array_join("urls", " ").alias("urls"))


@q("a12_extract_result_links", """SELECT page_id, 'http://r/1?a=1&b=2 http://r/2 http://r/4 http://r/5' AS urls FROM pages""")
def _(t):
    found = "concat(html, '<a class=\"result-images-source\" href=\"http://r/1?a=1&amp;b=2\">', array_join(transform(array(2, 3, 4, 5, 6), n -> concat('<a class=\"result-images-source\" href=\"', CASE WHEN n = 3 THEN ' ' ELSE concat('http://r/', n) END, '\">x</a>')), '')) AS html"
    rows = pages.extract_result_links(t.pages.selectExpr("page_id", found))
    return rows.select("page_id", F.array_join("urls", " ").alias("urls"))


@q("a13_list_codec", """
    SELECT id, variant_count = 0 AS is_null, variant_count AS size, CASE WHEN variant_count > 0 THEN 'v' || id || '-1' END AS first FROM catalogue_issues""")
def _(t):
    covers = F.expr("transform(variants, v -> named_struct('name', '', 'issueNumber', issue_number, 'comicVineId', v.id, 'urls', array(v.original_url), 'error', CAST(NULL AS STRING), 'parentComicVineId', id))")
    text = t.catalogue_issues.select("id", documents.encode_list(covers).alias("text"))
    back = text.select("id", "text", documents.decode_list(F.col("text"), f"ARRAY<{CANDIDATE_COVER}>").alias("list"))
    return back.select(
        "id", F.col("text").isNull().alias("is_null"), F.size("list").cast("bigint").alias("size"),
        F.try_element_at("list", F.lit(1))["comicVineId"].alias("first"))


def result_images(t):
    """Image rows of result documents, ten to a session."""
    return t.documents.selectExpr(
        "CAST(floor(doc_id / 10) AS STRING) AS session_id", "CAST(doc_id % 10 AS INT) AS source_image_index", "concat(doc_id, '.jpg') AS image_name",
        "array(named_struct('url', concat('img/', doc_id), 'similarity', n_chars / 20000.0D)) AS matches", "doc_id")


@q("a14_write_results", """
    SELECT CAST(doc_id // 10 AS VARCHAR) AS session_id, doc_id % 10 AS source_image_index, doc_id || '.jpg' AS image_name, 'img/' || doc_id AS url FROM documents""")
def _(t):
    path = tables.shared_folder(t.spark, "results")
    rows = result_images(t).drop("doc_id")
    documents.write_results(rows, path)
    back = documents.read_images(t.spark, path, rows.schema)
    return back.select("session_id", F.col("source_image_index").cast("bigint").alias("source_image_index"), "image_name", F.col("matches")[0]["url"].alias("url"))


DOC = """concat('{"session_id": "', doc_id, '", "timestamp": "2024-01-', lpad(1 + doc_id % 28, 2, '0'), 'T00:00:00", "series_name": "', lang, ' ', source, '", "total_images": ', n_chars,
  ', "overall_success": ', doc_id % 2 = 0, ', "best_similarity": 0.5, "results": [{"image_name": "', doc_id, '.jpg", "matches": [{"similarity": 0.7, "url": "u"}]}]')"""


def stored_documents(t):
    """A third whole, a third with stray characters, a third cut short."""
    nul = "char(0)"
    return t.documents.selectExpr(
        "CAST(doc_id AS STRING) AS session_id",
        f"CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat({DOC}, ', \"year\": 1999}}') WHEN 1 THEN concat({DOC}, ', \"status\": \"do', {nul}, 'ne', '�', '\"}}') ELSE {DOC} END AS body")


@q("a15_read_results", """
    SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE doc_id % 3 WHEN 0 THEN 'loaded' WHEN 1 THEN 'repaired' ELSE 'corrupted' END AS outcome,
      CASE WHEN doc_id % 3 = 2 THEN 'Unknown (Corrupted Data)' ELSE lang || ' ' || source END AS series_name, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE n_chars END AS total_images,
      CASE doc_id % 3 WHEN 1 THEN 'done' WHEN 2 THEN 'corrupted' END AS status, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END AS results
    FROM documents""")
def _(t):
    read = documents.repair_results(stored_documents(t), "body", AS_OF_EVENTS)
    return read.select(
        "session_id", "outcome", "series_name", F.col("total_images").cast("bigint").alias("total_images"), "status",
        F.size("results").alias("results"))


@q("a16_list_results", """
    SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 3 = 2 THEN '2024-02-01 00:00:00' ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || 'T00:00:00' END AS timestamp,
      CASE doc_id % 3 WHEN 0 THEN 1999 END AS year, CASE WHEN doc_id % 3 = 2 THEN false ELSE doc_id % 2 = 0 END AS overall_success,
      CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'done' ELSE 'corrupted' END AS status, 0 AS successful_matches
    FROM documents""")
def _(t):
    listed = documents.list_results(documents.repair_results(stored_documents(t), "body", AS_OF_EVENTS))
    return listed.select("session_id", "timestamp", "year", "overall_success", "status", "successful_matches")


@q("a17_migrate_inline", """
    WITH d AS (SELECT doc_id, text, lang, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0)
    SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 4 = 1 THEN '/stored_images/' || doc_id || '/query_' || h || '.png' ELSE 'old' END AS name,
      CASE WHEN doc_id % 4 = 3 THEN '/stored_images/' || doc_id || '/query_' || sha256(lang) || '.jpg' END AS query, NULL AS size FROM d WHERE doc_id % 4 IN (1, 3)
    UNION ALL SELECT 'store', CAST(doc_id AS VARCHAR), 'query_' || h || '.png', NULL, octet_length(encode(text)) FROM d WHERE doc_id % 4 = 1
    UNION ALL SELECT 'store', CAST(doc_id AS VARCHAR), 'query_' || sha256(lang) || '.jpg', NULL, octet_length(encode(lang)) FROM d WHERE doc_id % 4 = 3""")
def _(t):
    rows = t.documents.selectExpr(
        "CAST(doc_id AS STRING) AS session_id", "CASE WHEN doc_id % 4 = 3 THEN base64(CAST(lang AS BINARY)) END AS query_image_base64",
        "array(named_struct('image_name', concat(doc_id, '.png'), 'image_base64', CASE WHEN doc_id % 4 = 1 THEN concat('data:image/png;base64,', base64(CAST(text AS BINARY))) END, 'image_url', 'old')) AS results")
    done, stored = documents.migrate_inline(rows)
    return done.select(
        F.lit("document").alias("kind"), "session_id", F.col("results")[0]["image_url"].alias("name"), F.col("query_image_url").alias("query"), F.lit(None).cast("int").alias("size")
    ).unionByName(stored.select(
        F.lit("store").alias("kind"), "session_id", F.col("stored_name").alias("name"), F.lit(None).cast("string").alias("query"), F.length("content").alias("size")))


@q("a18_store_names", """
    SELECT DISTINCT CAST(doc_id % 5 AS VARCHAR) AS session_id, 'query_' || sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.gif' ELSE '.jpg' END AS stored_name FROM documents
    EXCEPT SELECT CAST(doc_id % 5 AS VARCHAR), 'query_' || sha256(text) || '.gif' FROM documents WHERE doc_id % 6 = 0""")
def _(t):
    rows = t.documents.selectExpr(
        "CAST(doc_id % 5 AS STRING) AS session_id", "CASE WHEN doc_id % 2 = 0 THEN 'a.b.gif' ELSE 'plain' END AS image_name", "CAST(text AS BINARY) AS content")
    store = t.documents.filter("doc_id % 6 = 0").selectExpr("CAST(doc_id % 5 AS STRING) AS session_id", "concat('query_', sha2(text, 256), '.gif') AS stored_name")
    return documents.store_names(rows, store).select("session_id", "stored_name")


@q("a19_patch_results", """
    SELECT 'doc' AS kind, session_id, CASE WHEN id % 3 = 0 THEN 'P' || id ELSE 'S' || series_id END AS series_name, CASE WHEN id % 3 < 2 THEN 2000 ELSE 1990 END AS year FROM progress
    UNION ALL SELECT 'bad', session_id, '400', NULL FROM progress WHERE id % 3 = 2
    UNION ALL SELECT 'bad', 'gone' || id, '404', 2000 FROM progress WHERE id % 5 = 0""")
def _(t):
    docs = t.progress.selectExpr("session_id", "concat('S', series_id) AS series_name", "1990 AS year")
    patches = t.progress.selectExpr(
        "session_id", "CASE WHEN id % 3 = 0 THEN concat('P', id) WHEN id % 3 = 1 THEN '' END AS series_name", "CASE WHEN id % 3 < 2 THEN 2000 END AS year")
    lost = t.progress.filter("id % 5 = 0").selectExpr("concat('gone', id) AS session_id", "'x' AS series_name", "2000 AS year")
    done, bad = documents.patch_results(docs, patches.unionByName(lost))
    return done.select(F.lit("doc").alias("kind"), "session_id", "series_name", "year").unionByName(
        bad.select(F.lit("bad").alias("kind"), "session_id", F.col("code").cast("string").alias("series_name"), "year"))


@q("a20_backfill", """
    SELECT CASE WHEN series_id >= (SELECT count(*) FROM part) OR id % 7 = 0 THEN 'skipped' WHEN id % 2 = 0 THEN 'updated' ELSE 'failed' END AS outcome, count(*) AS count FROM progress GROUP BY 1""")
def _(t):
    sessions = t.progress.withColumn("session_id", F.expr("CASE WHEN id % 7 = 0 THEN ' ' ELSE session_id END"))
    return documents.backfill(sessions, t.series, t.progress.filter("id % 2 = 0"))


@q("a21_presets", """
    SELECT p_partkey AS id, 'balanced' AS preset, d AS detector, n, CASE WHEN d = 'kaze' THEN NULL ELSE 0.25::DOUBLE END AS weight, 1000 AS image_size FROM part,
      (SELECT unnest(['sift', 'orb', 'kaze']) AS d, unnest([1500, 1500, 400]) AS n)""")
def _(t):
    config = """concat('{"performance_level": "fast", "presets": {"balanced": {"image_size": 1000, "max_workers": 4, "detectors": {"sift": 1500, "orb": 1500, "kaze": 400}, "feature_weights": {"sift": 0.25, "orb": 0.25}, "options": {"use_advanced_matching": true}}, "fast": {"image_size": ', p_size, ', "max_workers": 1, "detectors": {"orb": 500}, "options": {}}}}') AS config"""
    rows = caches.load_presets(t.part.selectExpr("p_partkey AS id", config))
    return caches.select_preset(rows, "Balanced", "fast").select("id", "preset", "detector", "n", "weight", "image_size")


@q("a22_purge_and_retain", """
    SELECT 'purge' AS kind, id FROM files WHERE CAST(session_id AS INT) % 2 = 1
    UNION ALL SELECT 'retain', id FROM files WHERE processed_at >= TIMESTAMP '2024-01-25 00:00:00'""")
def _(t):
    ids = t.files.filter("CAST(session_id AS INT) % 2 = 0").select("session_id")
    left = documents.purge_sessions(t.files, ids).select(F.lit("purge").alias("kind"), "id")
    return left.unionByName(documents.retain(t.files, "processed_at", AS_OF_EVENTS).select(F.lit("retain").alias("kind"), "id"))


@q("a23_retain_cache", """
    SELECT 'image' AS kind, url_hash FROM images WHERE last_accessed >= TIMESTAMP '2024-01-27 00:00:00' - INTERVAL 14 DAY
    UNION ALL SELECT 'features', f.url_hash FROM features f WHERE f.last_accessed >= TIMESTAMP '2024-01-27 00:00:00' - INTERVAL 14 DAY""")
def _(t):
    images, features = caches.retain_cache(t.images, t.features, "2024-01-27 00:00:00", 14)
    return images.select(F.lit("image").alias("kind"), "url_hash").unionByName(features.select(F.lit("features").alias("kind"), "url_hash"))


@q("a24_feature_misses", """
    SELECT 'all' AS kind, source || '/' || doc_id AS url, doc_id % 10 <> 0 AS cached FROM documents
    UNION ALL SELECT 'all', 'new/' || doc_id, false FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT 'cache_only', source || '/' || doc_id, true FROM documents WHERE doc_id % 10 <> 0""")
def _(t):
    # Every url is asked for twice.
    known = t.documents.selectExpr("concat(source, '/', doc_id) AS url")
    new = t.documents.filter("doc_id % 5 = 0").selectExpr("concat('new/', doc_id) AS url")
    asked = known.unionByName(new)
    both = caches.feature_misses(asked.unionByName(asked), t.features).select(F.lit("all").alias("kind"), "url", "cached")
    return both.unionByName(
        caches.feature_misses(asked, t.features, cache_only=True).select(F.lit("cache_only").alias("kind"), "url", "cached"))


@q("a25_parse_gcd_api", """
    SELECT 'series' AS kind, p_partkey AS id, p_name AS name, 2 AS n, p_partkey || ',' || (p_partkey + 1) AS detail FROM part
    UNION ALL SELECT 'issue', p_partkey, p_name, 1, 'Story ' || p_brand FROM part""")
def _(t):
    series = t.part.selectExpr("p_partkey AS pid", """concat('{"name": "', p_name, '", "year_began": 1990, "active_issues": ["https://site.example/api/issue/', p_partkey, '/?format=json", "https://site.example/api/issue/', p_partkey + 1, '/?format=json"]}') AS body""")
    issue = t.part.selectExpr("p_partkey AS pid", """concat('{"series_name": "', p_name, '", "price": "1.00", "story_set": [{"type": "story", "title": "Story ', p_brand, '", "sequence_number": 0}]}') AS body""")
    a = catalogue.parse_gcd_api(series, "body")
    b = catalogue.parse_gcd_api(issue, "body", "issue")
    return a.select(
        F.lit("series").alias("kind"), F.col("pid").alias("id"), "name", F.col("issue_count").alias("n"), F.array_join(F.col("issue_ids").cast("array<string>"), ",").alias("detail")
    ).unionByName(b.select(
        F.lit("issue").alias("kind"), F.col("pid").alias("id"), F.col("series_name").alias("name"), F.size("story_set").alias("n"), F.col("story_set")[0]["title"].alias("detail")))

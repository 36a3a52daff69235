"""Queries over the reconciliation joins (inventory section 2.3)."""

from pyspark.sql import functions as F

from longbox.operators import joins as op
from longbox.plans.bindings import AS_OF
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add


def kept_issues(t):
    """The collection without its rarer half, so that gaps are plenty."""
    return t.issues.filter("condition = 'A'")


KEPT = "SELECT DISTINCT comic_vine_id FROM issues WHERE condition = 'A'"


@q("c01_series_with_issues", """
    SELECT s.id, s.name, i.id AS issue_id, i.issue_number FROM series s LEFT JOIN issues i ON i.series_id = s.id""")
def _(t):
    return op.series_with_issues(t.series.select("id", "name"), t.issues).drop("title")


@q("c02_with_series", """
    SELECT i.id, i.series_id, coalesce(s.name, 'Unknown') AS series_name, s.publisher AS series_publisher FROM issues i
    LEFT JOIN (SELECT * FROM series WHERE id % 5 <> 0) s ON s.id = i.series_id""")
def _(t):
    some = t.series.filter("id % 5 <> 0")
    return op.with_series(t.issues.select("id", "series_id"), some, ("name", "publisher"))


@q("c03_match_gcd_series", """
    SELECT s.id, min(g.id) AS gcd_id, nullif(count(g.id), 0) AS candidates FROM series s
    LEFT JOIN gcd_series g ON lower(g.name) = lower(s.name) AND g.year_began = s.start_year AND g.issue_count = s.issues_available_count
    GROUP BY 1""")
def _(t):
    return op.match_gcd_series(t.series, t.gcd_series).select("id", "gcd_id", "candidates")


@q("c03_match_gcd_series_like", """
    WITH p AS (SELECT id, CASE WHEN id % 3 = 0 THEN replace(name, ' ', '%') ELSE name END AS name, start_year, issues_available_count FROM series)
    SELECT p.id, min(g.id) AS gcd_id, nullif(count(g.id), 0) AS candidates FROM p
    LEFT JOIN gcd_series g ON g.name ILIKE p.name AND g.year_began = p.start_year AND g.issue_count = p.issues_available_count
    GROUP BY 1""")
def _(t):
    patterns = t.series.withColumn("name", F.expr("CASE WHEN id % 3 = 0 THEN replace(name, ' ', '%') ELSE name END"))
    return op.match_gcd_series(patterns, t.gcd_series, like=True).select("id", "gcd_id", "candidates")


@q("c04_map_gcd_issues", """
    SELECT w.series_id, w.issue_number, g.id AS gcd_issue_id FROM (SELECT DISTINCT series_id, issue_number FROM issues) w
    JOIN gcd_issues g ON g.series_id = w.series_id + 1000000 AND g.number = w.issue_number""")
def _(t):
    links = t.series.selectExpr("id AS series_id", "id + 1000000 AS gcd_series_id")
    return op.map_gcd_issues(t.issues, links, t.gcd_issues)


@q("c05_missing", f"SELECT id, series_id FROM catalogue_issues WHERE id NOT IN ({KEPT})")
def _(t):
    return op.missing(t.catalogue_issues, kept_issues(t)).select("id", "series_id")


@q("c06_added", f"SELECT id, series_id FROM catalogue_issues WHERE id IN ({KEPT})")
def _(t):
    return op.added(t.catalogue_issues, kept_issues(t)).select("id", "series_id")


@q("c07_reconcile_missing", f"""
    WITH owned AS ({KEPT}), l AS (SELECT c.*, s.name AS sname, c.id IN (SELECT comic_vine_id FROM owned) AS have
      FROM catalogue_issues c JOIN series s ON s.id = c.series_id WHERE c.series_id % 5 <> 4),
    j AS (SELECT coalesce(l.series_id, m.series_id) AS series_id, coalesce(l.id, m.comic_vine_id) AS comic_vine_id, l.id AS lid, m.id AS mid, have, m.is_resolved AS was,
      coalesce(m.expected_issue_name, CASE WHEN l.name <> '' THEN l.name ELSE sname || ' #' || l.issue_number END) AS expected_issue_name,
      CASE WHEN m.id IS NULL THEN TRY_CAST(l.cover_date AS DATE) ELSE m.expected_cover_date END AS d
      FROM l FULL JOIN missing_issues m ON m.comic_vine_id = l.id)
    SELECT series_id, comic_vine_id, expected_issue_name, CAST(d AS VARCHAR) AS expected_cover_date,
      CASE WHEN lid IS NOT NULL AND NOT have THEN false WHEN mid IS NOT NULL AND have AND NOT was THEN true ELSE was END AS is_resolved,
      CASE WHEN lid IS NOT NULL AND NOT have THEN '2001-12-01 00:00:00' END AS last_checked,
      CASE WHEN mid IS NULL THEN 'inserted' WHEN lid IS NOT NULL AND NOT have THEN 'updated' WHEN have AND NOT was THEN 'resolved' ELSE 'kept' END AS action
    FROM j WHERE mid IS NOT NULL OR NOT have""")
def _(t):
    listed = t.catalogue_issues.filter("series_id % 5 <> 4")
    done = op.reconcile_missing(listed, kept_issues(t), t.missing_issues, t.series, AS_OF)
    return done.select(
        "series_id", "comic_vine_id", "expected_issue_name", F.col("expected_cover_date").cast("string").alias("expected_cover_date"),
        "is_resolved", F.col("last_checked").cast("string").alias("last_checked"), "action")


@q("c08_candidate_covers", f"""
    WITH c AS (SELECT * FROM catalogue_issues WHERE id NOT IN ({KEPT}))
    SELECT series_id, issue_number, id AS comic_vine_id, image_url AS url, NULL AS parent_comic_vine_id FROM c
    UNION ALL
    SELECT series_id, issue_number, 'v' || part_id || '-' || n || '-' || k, 'img/v/' || part_id || '-' || n || '-' || k, id
    FROM (SELECT *, unnest(generate_series(1, variant_count)) AS k FROM c)""")
def _(t):
    covers = op.candidate_covers(t.catalogue_issues, kept_issues(t))
    return covers.select("series_id", "issue_number", "comic_vine_id", F.col("urls")[0].alias("url"), "parent_comic_vine_id")


@q("c09_unowned_or", """
    WITH o AS (SELECT series_id, issue_number, CASE WHEN id % 2 = 0 THEN comic_vine_id END AS cv FROM issues WHERE condition = 'A')
    SELECT c.id FROM catalogue_issues c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.cv = c.id AND o.series_id = c.series_id)
      AND NOT EXISTS (SELECT 1 FROM o WHERE o.cv IS NULL AND o.series_id = c.series_id AND o.issue_number = c.issue_number)""")
def _(t):
    owned = kept_issues(t).withColumn("comic_vine_id", F.expr("CASE WHEN id % 2 = 0 THEN comic_vine_id END"))
    return op.unowned_or(t.catalogue_issues, owned).select("id")


@q("c10_flag_owned", f"SELECT id, comic_vine_id, comic_vine_id IN ({KEPT}) AS owned FROM missing_issues")
def _(t):
    return op.flag_owned(t.missing_issues, kept_issues(t)).select("id", "comic_vine_id", "owned")


@q("c11_enrich", """
    WITH r AS (SELECT id, series_id, CASE id % 5 WHEN 0 THEN 'img/' || series_id || '-dup' WHEN 1 THEN 'nope' ELSE 'img/' || comic_vine_id END AS url FROM issues),
    c AS (SELECT id, series_id, issue_number, name, 'img/' || series_id || '-' || issue_number AS url FROM catalogue_issues
      UNION ALL SELECT id, series_id, issue_number, name, 'img/' || series_id || '-dup' FROM catalogue_issues WHERE issue_number = '7')
    SELECT r.id, r.url, coalesce(c.name, 'Unknown') AS comic_name, coalesce(c.issue_number, 'Unknown') AS issue_number, c.id AS comic_vine_id, '' AS cover_error
    FROM r LEFT JOIN c ON c.url = r.url""")
def _(t):
    results = t.issues.selectExpr(
        "id", "CASE CAST(id % 5 AS INT) WHEN 0 THEN concat('img/', series_id, '-dup') WHEN 1 THEN 'nope' ELSE concat('img/', comic_vine_id) END AS url")
    covers = t.catalogue_issues.selectExpr(
        "series_id * 8 + CAST(issue_number AS INT) AS position", "id AS comic_vine_id", "CAST(NULL AS STRING) AS parent_comic_vine_id",
        "issue_number", "name", "CAST(NULL AS STRING) AS error", "array(image_url, concat('img/', series_id, '-dup'), '') AS urls")
    return op.enrich(results, covers).select("id", "url", "comic_name", "issue_number", "comic_vine_id", "cover_error")


@q("c12_reverify_issues", """
    WITH j AS (SELECT i.*, c.id AS cid, TRY_CAST(c.cover_date AS DATE) AS d, c.image_url AS cimg, c.name AS cname, c.description AS ctext, c.variant_count AS v
      FROM issues i LEFT JOIN (SELECT * FROM catalogue_issues WHERE series_id % 6 <> 0) c ON c.id = i.comic_vine_id),
    f AS (SELECT *, cid IS NOT NULL AND d IS NOT NULL AND d <> cover_date AS nd, cid IS NOT NULL AND image_url IS NULL AS ni,
      cid IS NOT NULL AND coalesce(title, '') = '' AS nt, cid IS NOT NULL AND (coalesce(description, '') = '' OR generated_description) AS nx,
      cid IS NOT NULL AND v > 0 AS nv FROM j)
    SELECT id, series_id, CASE WHEN nd OR ni OR nt OR nx OR nv THEN 'updated' ELSE 'skipped' END AS outcome,
      CAST(CASE WHEN nd THEN d ELSE cover_date END AS VARCHAR) AS cover_date, CASE WHEN ni THEN cimg ELSE image_url END AS image_url,
      CASE WHEN nt THEN cname ELSE title END AS title, CASE WHEN nx THEN ctext ELSE description END AS description,
      CASE WHEN nx THEN false ELSE generated_description END AS generated_description, CASE WHEN nv THEN v ELSE 0 END AS variants, is_variants
    FROM f""")
def _(t):
    done = op.reverify_issues(t.issues, t.catalogue_issues.filter("series_id % 6 <> 0"))
    return done.select(
        "id", "series_id", "outcome", F.col("cover_date").cast("string").alias("cover_date"), "image_url", "title", "description",
        "generated_description", F.size(F.coalesce("variant_covers", F.array())).cast("bigint").alias("variants"), "is_variants")


@q("c13_reverify_series", """
    WITH l AS (SELECT id, id AS link, 0 AS pos FROM series UNION ALL SELECT id, id + 1, 1 FROM series WHERE id % 2 = 1),
    g AS (SELECT lower(name) AS n, year_began AS y, issue_count AS c, min(id) AS gid FROM gcd_series GROUP BY 1, 2, 3),
    m AS (SELECT l.id, l.pos, s.*, g.gid FROM l JOIN series s ON s.id = l.link
      LEFT JOIN g ON g.n = lower(s.name) AND g.y = s.start_year AND g.c = s.issues_available_count),
    a AS (SELECT id, sum(issues_available_count) AS cnt, min(start_year) AS sy, max(end_year) AS ey, string_agg(CAST(gid AS VARCHAR), ',' ORDER BY pos) AS gcd FROM m GROUP BY 1),
    y AS (SELECT series_id, max(coalesce(year(TRY_CAST(cover_date AS DATE)), TRY_CAST(substr(cover_date, 1, 4) AS INT))) AS ly FROM catalogue_issues GROUP BY 1)
    SELECT s.id, CAST(a.cnt AS BIGINT) AS issues_available_count, coalesce(a.sy, s.start_year) AS start_year,
      CAST(coalesce(a.ey, CASE WHEN 2003 - y.ly >= 2 THEN y.ly END, s.end_year) AS BIGINT) AS end_year, coalesce(a.gcd, '') AS gcd_ids
    FROM series s LEFT JOIN a ON a.id = s.id LEFT JOIN y ON y.series_id = s.id""")
def _(t):
    series = t.series.withColumn(
        "comic_vine_ids", F.expr("CASE WHEN link_count = 1 THEN array(CAST(id AS STRING)) ELSE array(CAST(id AS STRING), CAST(id + 1 AS STRING)) END"))
    catalogue = t.series.withColumn("id", F.col("id").cast("string"))
    done = op.reverify_series(series, catalogue, t.gcd_series, t.catalogue_issues, "2003-06-01 00:00:00")
    return done.select(
        "id", F.col("issues_available_count").cast("bigint").alias("issues_available_count"), "start_year",
        F.col("end_year").cast("bigint").alias("end_year"), F.array_join("gcd_ids", ",").alias("gcd_ids"))


def listing(t):
    """Remote listing: all documents; the ledger knows two thirds of them."""
    files = t.files.drop("state", "session_id", "processed_at")
    return files, t.files.filter("id % 3 <> 0")


DECIDED = """SELECT f.*, CASE WHEN id % 3 = 0 THEN 'new' WHEN state IN ('COMPLETED', 'PROCESSING') THEN 'skip' ELSE 'retry' END AS decision FROM files f"""


@q("c14_new_files", f"SELECT id, file_path, decision FROM ({DECIDED})")
def _(t):
    files, ledger = listing(t)
    return op.new_files(files, ledger).select("id", "file_path", "decision")


@q("c15_record_no_candidates", f"""
    WITH d AS ({DECIDED}), own AS (SELECT id FROM series_owned WHERE issues_owned_count >= issues_available_count)
    SELECT id, 'COMPLETED' AS state, 'Image was processed while there were no available candidates' AS error_message
      FROM d WHERE decision <> 'skip' AND series_id IN (SELECT id FROM own)
    UNION ALL SELECT id, state, NULL FROM d WHERE decision <> 'new' AND NOT (decision = 'retry' AND series_id IN (SELECT id FROM own))""")
def _(t):
    files, ledger = listing(t)
    return op.record_no_candidates(op.new_files(files, ledger), t.series_owned, ledger).select("id", "state", "error_message")


@q("c16_pick", """
    SELECT p_partkey AS pos, c.id, c.name FROM part JOIN catalogue_issues c ON c.id = (p_partkey * 3) || '-' || (p_partkey % 9)""")
def _(t):
    requested = t.part.selectExpr("p_partkey AS pos", "concat(p_partkey * 3, '-', p_partkey % 9) AS id")
    return op.pick(t.catalogue_issues, requested).select("pos", "id", "name")


@q("c17_dedupe_upload", """
    WITH h AS (SELECT uploaded_image_url AS u, min(id) AS held FROM issues GROUP BY 1)
    SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 < 2 THEN held END AS reuse_id FROM orders
    LEFT JOIN h ON h.u = (o_custkey % 100) || '/' || o_orderkey || '.jpg'""")
def _(t):
    requests = t.orders.selectExpr(
        "o_orderkey AS request_id", "concat(o_custkey % 100, '/', o_orderkey, '.jpg') AS uploaded_image_url", "md5(CAST(o_orderkey % 2 AS STRING)) AS content_hash")
    hashes = t.lineitem.selectExpr("concat(l_suppkey, '/', l_orderkey, '.jpg') AS uploaded_image_url", "md5(CAST(l_orderkey % 4 AS STRING)) AS content_hash")
    return op.dedupe_upload(requests, t.issues, hashes).select("request_id", "reuse_id")


@q("c18_cascade_delete", """
    SELECT 'issues' AS kind, count(*) AS count FROM issues WHERE series_id % 4 <> 1
    UNION ALL SELECT 'missing', count(*) FROM missing_issues WHERE series_id % 4 <> 1
    UNION ALL SELECT 'progress', count(*) FROM progress WHERE series_id NOT IN (SELECT id FROM series WHERE id % 4 = 1)
    UNION ALL SELECT 'files', count(*) FROM files WHERE series_id NOT IN (SELECT id FROM series WHERE id % 4 = 1)
    UNION ALL SELECT 'syncs', count(*) FROM syncs WHERE series_id NOT IN (SELECT id FROM series WHERE id % 4 = 1)
    UNION ALL SELECT 'series', count(*) FROM series WHERE id % 4 <> 1""")
def _(t):
    from functools import reduce

    tables = {"issues": t.issues, "missing": t.missing_issues, "progress": t.progress, "files": t.files, "syncs": t.syncs, "series": t.series}
    left = op.cascade_delete(tables, t.series.filter("id % 4 = 1"), {"series": "id"})
    counts = [df.agg(F.count("*").alias("count")).withColumn("kind", F.lit(name)) for name, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@q("c19_missing_with_series", """
    SELECT m.id, s.name AS series_name, s.publisher FROM missing_issues m LEFT JOIN series s ON s.id = m.series_id""")
def _(t):
    return op.missing_with_series(t.missing_issues, t.series).select("id", "series_name", "publisher")


@q("c20_variants_by_issue", """
    SELECT series_id, issue_number, variant_count AS urls FROM catalogue_issues WHERE variant_count > 0""")
def _(t):
    links = t.catalogue_issues.selectExpr("series_id", "issue_number", "transform(variants, v -> v.original_url) AS urls")
    return op.variants_by_issue(t.catalogue_issues, links).select(
        "series_id", "issue_number", F.size("urls").cast("bigint").alias("urls"))


@q("c21_unlinked", "SELECT id, name, start_year FROM series WHERE id % 3 <> 0")
def _(t):
    return op.unlinked(t.series, t.series.filter("id % 3 = 0")).select("id", "name", "start_year")

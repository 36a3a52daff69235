"""Queries over cover matching and review (inventory section 2.8)."""

from pyspark.sql import functions as F

from longbox.functions.numbers import round_half_up
from longbox.operators import filters, joins
from longbox.operators import matching as op
from longbox.operators import review
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add
# The test descriptors are nearly orthogonal, so a milder ratio keeps matches.
RATIO = 0.97
BLOCK = 16


def six(column, name=None):
    return round_half_up(F.col(column), 6).alias(name or column)


R6 = "floor(({}) * 1000000 + 0.5) / 1000000"
NN = """nn AS (
    SELECT *, row_number() OVER (PARTITION BY query_kp, candidate_id ORDER BY d, candidate_kp) AS r FROM (
      SELECT a.session_id, a.detector, a.image_id AS query_id, a.kp_id AS query_kp, a.x AS qx, a.y AS qy, b.image_id AS candidate_id, b.kp_id AS candidate_kp, b.x, b.y,
        CASE WHEN a.detector IN ('orb', 'akaze') THEN CAST(list_sum(list_transform(list_zip(a.descriptor, b.descriptor), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS DOUBLE)
          ELSE list_distance(a.descriptor, b.descriptor) END AS d
      FROM descriptors a JOIN descriptors b ON a.session_id = b.session_id AND a.detector = b.detector AND a.role = 'query' AND b.role = 'candidate'))"""
COUNTS = "cnt AS (SELECT session_id, detector, image_id, count(*) AS n FROM descriptors GROUP BY ALL)"
GOOD = f"""good AS (
    SELECT a.session_id, a.detector, a.query_id, a.candidate_id, a.query_kp, a.qx, a.qy, a.candidate_kp, a.x, a.y, a.d AS d1, b.d AS d2,
      cq.n AS nq, cc.n AS nc FROM nn a
    JOIN nn b ON a.query_kp = b.query_kp AND a.candidate_id = b.candidate_id AND a.r = 1 AND b.r = 2
    JOIN cnt cq ON cq.session_id = a.session_id AND cq.detector = a.detector AND cq.image_id = a.query_id
    JOIN cnt cc ON cc.session_id = a.session_id AND cc.detector = a.detector AND cc.image_id = a.candidate_id
    WHERE a.d < {RATIO} * b.d AND cq.n >= CASE WHEN a.detector = 'akaze' THEN 5 ELSE 8 END AND cc.n >= CASE WHEN a.detector = 'akaze' THEN 5 ELSE 8 END)"""
GEO = """geo AS (
    SELECT session_id, detector, query_id, candidate_id, sum(n) AS good, max(n) AS modal, sum(s) / sum(n) AS mean, any_value(least(nq, nc)) AS total FROM (
      SELECT session_id, detector, query_id, candidate_id, floor((x - qx) / 10) AS dx, floor((y - qy) / 10) AS dy, count(*) AS n, sum(d1) AS s, any_value(nq) AS nq, any_value(nc) AS nc
      FROM good GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4),
  geos AS (SELECT *, CASE WHEN good >= 8 THEN modal::DOUBLE / good ELSE least(1.0::DOUBLE, good::DOUBLE / 20) END AS geometric FROM geo)"""
SCORE = """score AS (
    SELECT session_id, detector, query_id, candidate_id, good, geometric, good::DOUBLE / total + geometric * 0.3::DOUBLE
      + CASE detector WHEN 'sift' THEN greatest(0::DOUBLE, (200 - mean) / 200) * 0.2 WHEN 'kaze' THEN greatest(0::DOUBLE, (150 - mean) / 150) * 0.2 ELSE 0 END AS similarity FROM geos),
  w AS (SELECT unnest(['sift', 'orb', 'akaze', 'kaze']) AS detector, unnest([0.25, 0.25, 0.4, 0.1])::DOUBLE AS w)"""
FUSED = """fb AS (
    SELECT session_id, query_id, candidate_id, sum(similarity * w) / sum(w) AS base, avg(geometric) AS g, count(*) AS n FROM score JOIN w USING (detector) GROUP BY 1, 2, 3),
  fused AS (SELECT session_id, query_id, candidate_id, least(0.95::DOUBLE, base + g * 0.3::DOUBLE + 0.08::DOUBLE * (n - 1) * (0.3 + 0.7 * base)) AS similarity FROM fb)"""
RANKED = """img AS (SELECT DISTINCT session_id, image_id, role FROM descriptors),
  pairs AS (SELECT a.session_id, a.image_id AS query_id, b.image_id AS candidate_id, coalesce(f.similarity, 0) AS similarity FROM img a
    JOIN img b ON a.session_id = b.session_id AND a.role = 'query' AND b.role = 'candidate'
    LEFT JOIN fused f ON f.session_id = a.session_id AND f.query_id = a.image_id AND f.candidate_id = b.image_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY similarity DESC, candidate_id) AS rank,
    count(*) OVER (PARTITION BY session_id, query_id) AS total_matches FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id, query_id ORDER BY similarity DESC, candidate_id) <= 3)"""


def upto(*parts):
    return "WITH " + ",\n".join(parts) + "\n"


ALL = upto(NN, COUNTS, GOOD, GEO, SCORE, FUSED, RANKED)


def scores(t):
    return op.match_images(t.descriptors, ratio=RATIO, block=BLOCK)


def images(t):
    return t.descriptors.select("session_id", "image_id", "role").distinct()


def ranked(t):
    return op.rank_matches(scores(t), images(t), 3)


@q("m01_weights", """
    WITH e AS (SELECT p_partkey AS preset, d, CASE WHEN p_partkey % 2 = 0 THEN w ELSE (p_size % 5)::DOUBLE / 10 END AS w FROM part,
      (SELECT unnest(['sift', 'orb', 'akaze', 'kaze']) AS d, unnest([0.25, 0.25, 0.4, 0.1])::DOUBLE AS w, unnest([0, 1, 2, 3]) AS i) WHERE p_partkey % 4 <> i)
    SELECT CAST(preset AS VARCHAR) AS preset, d AS detector, floor(CASE WHEN sum(w) OVER (PARTITION BY preset) > 0 THEN w / sum(w) OVER (PARTITION BY preset) ELSE w END * 1000000 + 0.5) / 1000000 AS weight FROM e""")
def _(t):
    presets = t.part.selectExpr(
        "CAST(p_partkey AS STRING) AS preset", "CASE WHEN p_partkey % 2 = 1 THEN p_size % 5 / 10.0D END AS weight", "p_partkey",
        "posexplode(array('sift', 'orb', 'akaze', 'kaze')) AS (i, detector)").selectExpr("preset", "detector", "weight", "CASE WHEN p_partkey % 4 = i THEN 0 ELSE 500 END AS n")
    return op.weights(presets).select("preset", "detector", six("weight"))


@q("m02_pair_blocks", """
    SELECT session_id, detector, count(*) FILTER (role = 'query') AS query_descriptors, count(*) FILTER (role = 'candidate') AS candidate_descriptors,
      count(DISTINCT image_id) FILTER (role = 'query') * count(DISTINCT image_id) FILTER (role = 'candidate') AS image_pairs FROM descriptors GROUP BY 1, 2""")
def _(t):
    return op.pair_blocks(t.descriptors).select("session_id", "detector", "query_descriptors", "candidate_descriptors", "image_pairs")


@q("m03_knn", upto(NN) + f"SELECT session_id, detector, query_id, candidate_id, query_kp, candidate_kp, r AS rank, {R6.format('d')} AS distance FROM nn WHERE r <= 2")
def _(t):
    found = op.knn(t.descriptors, 2, BLOCK)
    return found.select("session_id", "detector", "query_id", "candidate_id", "query_kp", "candidate_kp", "rank", six("distance"))


# An image here has fewer points than a search compares, so small blocks don't cut it further.
FOREST_BLOCK = 2048


@q("m04_knn_approx", upto(NN) + """SELECT detector, count(*) AS n_exact, true AS recalled FROM nn
    WHERE r <= 2 AND detector NOT IN ('orb', 'akaze') GROUP BY 1""")
def _(t):
    real = t.descriptors.filter(~F.col("detector").isin(*op.HAMMING))
    measured = op.recall(op.knn_approx(real, 2, FOREST_BLOCK), op.knn(real, 2, BLOCK))
    return measured.select("detector", "n_exact", (F.col("recall") >= 0.9).alias("recalled"))


@q("m05_score_simple", upto(NN, COUNTS) + f"""
    , n1 AS (SELECT a.session_id, a.detector, a.query_id, a.candidate_id, count(*) FILTER (d < 50) AS good, any_value(least(cq.n, cc.n)) AS total FROM nn a
      JOIN cnt cq ON cq.session_id = a.session_id AND cq.detector = a.detector AND cq.image_id = a.query_id
      JOIN cnt cc ON cc.session_id = a.session_id AND cc.detector = a.detector AND cc.image_id = a.candidate_id WHERE r = 1 GROUP BY 1, 2, 3, 4),
    w AS (SELECT unnest(['sift', 'orb', 'akaze', 'kaze']) AS detector, unnest([0.25, 0.25, 0.4, 0.1])::DOUBLE AS w)
    SELECT session_id, query_id, candidate_id, {R6.format('sum(good::DOUBLE / total * w) / sum(w)')} AS similarity FROM n1 JOIN w USING (detector) GROUP BY 1, 2, 3 HAVING sum(good) > 0""")
def _(t):
    return op.score_simple(t.descriptors, block=BLOCK).select(*op.PAIR, six("similarity"))


@q("m06_ratio_test", upto(NN, COUNTS, GOOD) + f"SELECT session_id, detector, query_id, candidate_id, query_kp, candidate_kp, {R6.format('d1')} AS d1, {R6.format('d2')} AS d2 FROM good")
def _(t):
    good = op.ratio_test(t.descriptors, RATIO, BLOCK)
    return good.select(*op.PAIR, "detector", "query_kp", F.col("kp1").alias("candidate_kp"), six("d1"), six("d2"))


@q("m07_geometric", upto(NN, COUNTS, GOOD, GEO) + f"SELECT session_id, detector, query_id, candidate_id, CAST(good AS BIGINT) AS good, {R6.format('geometric')} AS geometric FROM geos")
def _(t):
    return op.geometric(op.ratio_test(t.descriptors, RATIO, BLOCK)).select(*op.PAIR, "detector", "good", six("geometric"))


@q("m08_detector_score", upto(NN, COUNTS, GOOD, GEO, SCORE) + f"SELECT session_id, detector, query_id, candidate_id, CAST(good AS BIGINT) AS good, {R6.format('similarity')} AS similarity FROM score")
def _(t):
    scored = op.detector_score(t.descriptors, op.ratio_test(t.descriptors, RATIO, BLOCK))
    return scored.select(*op.PAIR, "detector", "good", six("similarity"))


@q("m09_fuse", upto(NN, COUNTS, GOOD, GEO, SCORE, FUSED) + f"SELECT session_id, query_id, candidate_id, {R6.format('similarity')} AS similarity FROM fused")
def _(t):
    return scores(t).select(*op.PAIR, six("similarity"))


@q("m10_pair_status", ALL + f"""
    SELECT session_id, query_id, candidate_id, CASE candidate_id % 3 WHEN 0 THEN 'processing_error' WHEN 1 THEN 'failed_features' ELSE 'success' END AS status,
      CASE WHEN candidate_id % 3 = 2 THEN {R6.format('similarity')} ELSE 0 END AS similarity FROM ranked""")
def _(t):
    facts = images(t).filter("role = 'candidate'").selectExpr(
        "session_id", "image_id AS candidate_id", "CASE WHEN image_id % 3 = 2 THEN 9 ELSE 0 END AS features", "CASE WHEN image_id % 3 = 0 THEN 'boom' END AS error")
    return op.pair_status(ranked(t), facts).select(*op.PAIR, "status", six("similarity"))


@q("m11_rank_matches", ALL + f"SELECT session_id, query_id, candidate_id, rank, total_matches, {R6.format('similarity')} AS similarity FROM ranked")
def _(t):
    return ranked(t).select(*op.PAIR, "rank", "total_matches", six("similarity"))


@q("m12_run_summary", """
    WITH i AS (SELECT o_custkey AS s, count(*) AS n, count(*) FILTER (o_orderkey % 3 > 0) AS ok, CAST(sum(o_orderkey % 3) AS BIGINT) AS m FROM orders GROUP BY 1),
    c AS (SELECT series_id AS s, count(*) AS covers, CAST(sum(1 + variant_count) AS BIGINT) AS urls FROM catalogue_issues GROUP BY 1)
    SELECT CAST(i.s AS VARCHAR) AS session_id, n AS total_images_processed, ok AS successful_images, n - ok AS failed_images, m AS total_matches_all_images,
      coalesce(covers, 0) AS total_covers_processed, coalesce(urls, 0) AS total_urls_processed FROM i LEFT JOIN c ON c.s = i.s""")
def _(t):
    runs = t.orders.selectExpr("CAST(o_custkey AS STRING) AS session_id", "o_orderkey % 3 AS total_matches")
    covers = t.catalogue_issues.selectExpr(
        "CAST(series_id AS STRING) AS session_id", "concat(array(image_url), transform(variants, v -> v.original_url)) AS urls")
    return op.run_summary(runs, covers)


@q("m13_result_docs", ALL + f"""
    , d AS (SELECT i.session_id, i.image_id, i.image_id % 10 = 5 AS bad, max(similarity) AS best, count(candidate_id) AS n, count(*) FILTER (similarity >= 0.4) AS above
      FROM img i LEFT JOIN ranked r ON r.session_id = i.session_id AND r.query_id = i.image_id AND i.image_id % 10 <> 5 WHERE i.role = 'query' GROUP BY 1, 2, 3)
    SELECT 'image' AS kind, session_id, image_id, n > 0 AS success, {R6.format('coalesce(best, 0)')} AS best_similarity, n AS matches FROM d
    UNION ALL SELECT 'multi', session_id, NULL, bool_or(n > 0), {R6.format('coalesce(max(best), 0)')}, count(*) FILTER (n > 0) FROM d GROUP BY session_id
    UNION ALL SELECT 'single', session_id, NULL, sum(above) > 0, {R6.format('coalesce(max(best), 0)')}, CAST(sum(above) AS BIGINT) FROM d GROUP BY session_id""")
def _(t):
    queries = images(t).filter("role = 'query'").selectExpr(
        "session_id", "image_id AS query_id", "concat(image_id, '.jpg') AS image_name", "CASE WHEN image_id % 10 = 5 THEN 'boom' END AS error")
    good = ranked(t).join(queries.filter("error IS NULL").select("session_id", "query_id"), ["session_id", "query_id"], "left_semi")
    sessions, docs = op.result_docs(good, queries, 0.4)
    single, _docs = op.result_docs(good, queries, 0.4, multi=False)
    out = docs.select(
        F.lit("image").alias("kind"), "session_id", F.col("query_id").alias("image_id"), F.col("match_success").alias("success"), six("best_similarity"),
        F.coalesce(F.size("matches"), F.lit(0)).cast("bigint").alias("matches"))
    for kind, df in (("multi", sessions), ("single", single)):
        out = out.unionByName(df.select(
            F.lit(kind).alias("kind"), "session_id", F.lit(None).cast("bigint").alias("image_id"), F.col("overall_success").alias("success"), six("best_similarity"),
            F.col("successful_matches").alias("matches")))
    return out


@q("m14_evaluation", """
    WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey % 7 <> 0 AS ok, (o_orderkey % 100)::DOUBLE / 100 AS s FROM orders)
    SELECT session_id, count(*) FILTER (ok AND s >= 0.55) AS successful_matches, count(*) FILTER (ok AND s < 0.55) AS no_matches, count(*) FILTER (NOT ok) AS failed_uploads,
      coalesce(max(s) FILTER (ok AND s >= 0.55), 0) AS best_similarity, count(*) FILTER (ok AND s >= 0.55) > 0 AS overall_success FROM i GROUP BY 1""")
def _(t):
    rows = t.orders.selectExpr("CAST(o_custkey AS STRING) AS session_id", "o_orderkey % 7 <> 0 AS api_success", "o_orderkey % 100 / 100.0D AS best_similarity")
    return op.evaluation(rows, 0.55)


# --- review: matches made from the line rows, 35 images per session ----------

MATCHES = """mt AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, CASE WHEN l_orderkey % 20 = 0 THEN 0 ELSE l_partkey % 30 END AS idx,
    ((l_orderkey * 7919 + l_linenumber * 31) % 1000)::DOUBLE / 1000 AS similarity, l_partkey || '-' || l_linenumber AS cv,
    CASE WHEN l_orderkey % 6 = 0 THEN 'img/v/' || l_partkey || '-' || l_linenumber || '-1' ELSE 'img/' || l_partkey || '-' || l_linenumber END AS url,
    CASE WHEN l_orderkey % 6 = 0 THEN l_partkey || '-' || l_linenumber END AS parent FROM lineitem)"""
CLASSED = """im AS (SELECT CAST(s_suppkey AS VARCHAR) AS session_id, i AS idx FROM supplier, (SELECT unnest(generate_series(0, 34)) AS i)),
    best AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY session_id, idx ORDER BY similarity DESC, url) = 1),
    cl AS (SELECT im.session_id, im.idx, best.similarity, best.cv, best.url, best.parent, CASE WHEN best.url IS NULL THEN 'no_match' ELSE 'pending' END AS status,
      CASE WHEN similarity >= 0.99 THEN 'high' WHEN similarity >= 0.9 THEN 'medium' ELSE 'low' END AS confidence
      FROM im LEFT JOIN best ON best.session_id = im.session_id AND best.idx = im.idx)"""


def matches(t):
    return t.lineitem.selectExpr(
        "CAST(l_suppkey AS STRING) AS session_id", "CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE CAST(l_partkey % 30 AS INT) END AS source_image_index",
        "concat('name', l_partkey % 30) AS source_image_name", "(l_orderkey * 7919 + l_linenumber * 31) % 1000 / 1000.0D AS similarity",
        "CASE WHEN l_orderkey % 6 = 0 THEN concat('img/v/', l_partkey, '-', l_linenumber, '-1') ELSE concat('img/', l_partkey, '-', l_linenumber) END AS url",
        "concat('C', l_partkey) AS comic_name", "CAST(l_linenumber AS STRING) AS issue_number",
        "CASE WHEN l_orderkey % 6 = 0 THEN concat('v', l_partkey, '-', l_linenumber, '-1') ELSE concat(l_partkey, '-', l_linenumber) END AS comic_vine_id",
        "CASE WHEN l_orderkey % 6 = 0 THEN concat(l_partkey, '-', l_linenumber) END AS parent_comic_vine_id")


def classified(t):
    shown = t.supplier.selectExpr("CAST(s_suppkey AS STRING) AS session_id", "explode(sequence(0, 34)) AS source_image_index").withColumn(
        "image_name", F.concat(F.lit("Image "), F.col("source_image_index")))
    return review.classify(matches(t), shown, 0.99, 0.9)


def reviewed(t):
    return review.apply_rules(review.apply_rules(classified(t), "reject_low"), "accept_all")


@q("m15_group_matches", upto(MATCHES) + "SELECT session_id, idx AS source_image_index, count(*) AS match_count, max(similarity) AS best FROM mt GROUP BY 1, 2")
def _(t):
    grouped = review.image_groups(matches(t))
    best = review.group_matches(matches(t)).groupBy("session_id", "source_image_index").agg(F.max("similarity").alias("best"))
    return grouped.join(best, ["session_id", "source_image_index"]).drop("name")


@q("m15_ordered_matches", upto(MATCHES) + "SELECT session_id, idx AS source_image_index, similarity, url FROM mt")
def _(t):
    return review.group_matches(matches(t)).select("session_id", "source_image_index", "similarity", "url")


@q("m16_classify", upto(MATCHES, CLASSED) + "SELECT session_id, idx AS source_image_index, status, confidence, similarity, url, parent IS NOT NULL AS is_variant FROM cl")
def _(t):
    return classified(t).select(
        "session_id", "source_image_index", "status", "confidence", F.col("best_match.similarity").alias("similarity"), F.col("best_match.url").alias("url"), "is_variant")


RULED = "CASE WHEN status = 'no_match' THEN status WHEN confidence = 'low' THEN 'rejected' ELSE 'auto_accepted' END"


@q("m17_apply_rules", upto(MATCHES, CLASSED) + f"SELECT session_id, idx AS source_image_index, {RULED} AS status, CASE WHEN confidence <> 'low' THEN url END AS selected FROM cl")
def _(t):
    return reviewed(t).select("session_id", "source_image_index", "status", F.col("selected_match.url").alias("selected"))


@q("b27_review_filter", upto(MATCHES, CLASSED) + f"SELECT session_id, idx AS source_image_index FROM cl WHERE {RULED} = 'auto_accepted' AND confidence = 'high'")
def _(t):
    return filters.review_filter(reviewed(t), "auto_selected", "high").select("session_id", "source_image_index")


@q("m18_review_stats", upto(MATCHES, CLASSED) + f"""
    , r AS (SELECT *, {RULED} AS st FROM cl)
    SELECT session_id, count(*) AS total_images, count(*) FILTER (st = 'auto_accepted') AS total_accepted, count(*) FILTER (st = 'rejected') AS rejected,
      count(*) FILTER (st = 'no_match') AS no_match, {R6.format('avg(similarity)')} AS average_confidence,
      {R6.format("count(*) FILTER (confidence = 'high') * 100.0::DOUBLE / count(*)")} AS high_percentage,
      {R6.format("count(*) FILTER (st = 'auto_accepted') * 100.0::DOUBLE / count(*)")} AS auto_acceptance_rate FROM r GROUP BY 1""")
def _(t):
    return review.review_stats(reviewed(t)).select(
        "session_id", "total_images", "total_accepted", "rejected", "no_match", six("average_confidence"), six("high_percentage"), six("auto_acceptance_rate"))


@q("m19_export_import", upto(MATCHES, CLASSED) + f"SELECT session_id, idx AS source_image_index, {RULED} AS status, CASE WHEN confidence <> 'low' THEN url ELSE url END AS selected FROM cl")
def _(t):
    # A reviewed run is exported and put on top of the fresh one: statuses come
    # over, and rows exported without a match keep the one they have.
    back = review.import_sel(classified(t), review.export_sel(reviewed(t)), matches(t))
    return back.select("session_id", "source_image_index", "status", F.col("selected_match.url").alias("selected"))


@q("m20_accepted_to_issues", upto(MATCHES, CLASSED) + """
    SELECT session_id, idx AS source_image_index, c.series_id, c.issue_number, c.name AS title, CAST(TRY_CAST(c.cover_date AS DATE) AS VARCHAR) AS cover_date,
      CASE WHEN parent IS NOT NULL THEN cl.url ELSE c.image_url END AS image_url, 'VERY_FINE' AS condition, parent IS NOT NULL AS is_variants
    FROM cl JOIN catalogue_issues c ON c.id = coalesce(parent, cv) WHERE confidence <> 'low' AND url IS NOT NULL""")
def _(t):
    made = review.accepted_to_issues(reviewed(t), t.catalogue_issues)
    return made.select(
        "session_id", "source_image_index", "series_id", "issue_number", "title", F.col("cover_date").cast("string").alias("cover_date"), "image_url", "condition", "is_variants")


@q("m21_is_variant", """
    SELECT id, CASE n % 3 WHEN 0 THEN false WHEN 1 THEN variant_count > 0 ELSE false END AS is_variant FROM catalogue_issues""")
def _(t):
    image = F.expr("CASE CAST(CAST(issue_number AS INT) % 3 AS INT) WHEN 0 THEN image_url WHEN 1 THEN concat('img/v/', id, '-1') ELSE 'other' END")
    urls = F.transform("variants", lambda v: v["original_url"])
    return t.catalogue_issues.select("id", joins.is_variant(image, F.col("image_url"), urls).alias("is_variant"))

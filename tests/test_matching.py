import itertools
import math
import random

import numpy as np
import pytest

from longbox.operators import matching, review
from longbox.operators.forest import KdForest

DDL = (
    "session_id STRING, image_id BIGINT, role STRING, detector STRING, kp_id BIGINT, x DOUBLE, y DOUBLE, "
    "descriptor ARRAY<DOUBLE>, bits ARRAY<BIGINT>")


def descriptors(images, seed=1, size=8):
    """images: (session, image, role, detector, count)."""
    rng, out, kp = random.Random(seed), [], itertools.count()
    for session, image, role, detector, count in images:
        for _ in range(count):
            vector = [rng.uniform(0, 30) for _ in range(size)]
            bits = [rng.getrandbits(63), rng.getrandbits(63) - 2**62]
            out.append((session, image, role, detector, next(kp), rng.uniform(0, 99), rng.uniform(0, 99), vector, bits))
    return out


def brute(rows, k):
    found = set()
    for q in rows:
        if q[2] != "query":
            continue
        others = [c for c in rows if c[2] == "candidate" and c[0] == q[0] and c[3] == q[3]]
        for image in {c[1] for c in others}:
            def far(c):
                if q[3] in matching.HAMMING:
                    return sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(q[8], c[8]))
                return math.dist(q[7], c[7])
            near = sorted((far(c), c[4]) for c in others if c[1] == image)[:k]
            found |= {(q[4], image, i + 1, kp, round(d, 6)) for i, (d, kp) in enumerate(near)}
    return found


IMAGES = [("a", 1, "query", "sift", 7), ("a", 2, "candidate", "sift", 23), ("a", 3, "candidate", "sift", 4), ("a", 4, "candidate", "sift", 1),
          ("a", 1, "query", "orb", 6), ("a", 2, "candidate", "orb", 19), ("b", 5, "query", "sift", 3), ("b", 6, "candidate", "sift", 9), ("c", 7, "query", "sift", 2)]


@pytest.mark.parametrize("block", [4, 2048])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_knn_equals_brute_force_whole_and_split(spark, block, k):
    rows = descriptors(IMAGES)
    got = matching.knn(spark.createDataFrame(rows, DDL), k, block).collect()
    assert {(r["query_kp"], r["candidate_id"], r["rank"], r["candidate_kp"], round(r["distance"], 6)) for r in got} == brute(rows, k)
    assert len(got) == len(brute(rows, k))


def test_rules_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame(descriptors([("a", 1, "query", "sift", 30), ("a", 2, "candidate", "sift", 40), ("a", 3, "candidate", "sift", 9)]), DDL)
    small, large = (sorted(map(tuple, matching.ratio_test(df, 0.9, b).select("query_kp", "candidate_id", "kp1", "kp2").collect())) for b in (5, 2048))
    assert small == large and small


def test_gate_drops_small_images(spark):
    df = spark.createDataFrame(descriptors([("a", 1, "query", "sift", 8), ("a", 2, "candidate", "sift", 7), ("a", 3, "candidate", "akaze", 5), ("a", 4, "candidate", "akaze", 4)]), DDL)
    kept = {(r["image_id"], r["detector"]) for r in matching.gate(df).collect()}
    assert kept == {(1, "sift"), (3, "akaze")}


def test_forest_finds_most_neighbours(spark):
    draw = random.Random(5)
    centres = [[draw.uniform(0, 100) for _ in range(16)] for _ in range(60)]
    points = [[v + draw.gauss(0, 4) for v in draw.choice(centres)] for _ in range(1200)]
    rows = [("s", 1 if i < 200 else 2 + i % 2, "query" if i < 200 else "candidate", "sift", i, 0.0, 0.0, p, None) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, DDL)
    exact = matching.knn(df, 3)
    assert exact.count() == 200 * 2 * 3
    measured = matching.recall(matching.knn_approx(df, 3), exact).collect()
    assert [(r["detector"], r["n_exact"]) for r in measured] == [("sift", 1200)] and measured[0]["recall"] >= 0.9


def test_forest_of_few_and_equal_points():
    same = KdForest(np.ones((9, 3)))
    at, far = same.search(np.zeros((2, 3)), 4)
    assert at.tolist() == [[0, 1, 2, 3]] * 2 and np.allclose(far, np.sqrt(3))
    points = np.random.default_rng(1).normal(size=(40, 5))
    at, far = KdForest(points).search(points, 60, checks=1000)
    exact = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert np.allclose(far[:, 0], 0) and at.shape == (40, 40)
    assert np.allclose(far[:, :5], np.sort(exact, axis=1)[:, :5])


def test_near_ties_beyond_the_shortlist_are_exact():
    # Far from the origin the product cannot tell these rows apart.
    c = np.full((30, 8), 1e6)
    c[:, 0] += np.arange(30)[::-1] * 1e-3
    at, far = matching._nearest(np.full((1, 8), 1e6), c, False, 3)
    assert at.tolist() == [[29, 28, 27]] and np.allclose(far, [[0, 1e-3, 2e-3]], atol=1e-9)


def test_rules_take_one_or_two_neighbours(spark):
    df = spark.createDataFrame([], DDL)
    with pytest.raises(ValueError, match="one or two"):
        matching.neighbours(df, df, 3)
    with pytest.raises(ValueError, match="1 or more"):
        matching.knn(df, 0)


def good(spark, n, moved=0.0, places=True):
    rows = [("s", 1, 2, "sift", float(i) if places else None, 0.0, float(i + moved * (i % 2)), 0.0, 100.0) for i in range(n)]
    return spark.createDataFrame(rows, "session_id STRING, query_id BIGINT, candidate_id BIGINT, detector STRING, qx DOUBLE, qy DOUBLE, x1 DOUBLE, y1 DOUBLE, d1 DOUBLE")


@pytest.mark.parametrize("n, moved, places, wanted", [(1, 0, True, 0.05), (7, 0, True, 0.35), (8, 0, True, 1.0), (8, 55.0, True, 0.5), (9, 0, False, 0.4)])
def test_geometric(spark, n, moved, places, wanted):
    row = matching.geometric(good(spark, n, moved, places)).first()
    assert (row["good"], round(row["geometric"], 6)) == (n, wanted)


def score(spark, rows):
    return spark.createDataFrame([("s", 1, c, d, g, s) for c, d, g, s in rows], "session_id STRING, query_id BIGINT, candidate_id BIGINT, detector STRING, geometric DOUBLE, similarity DOUBLE")


def test_fuse(spark):
    rows = [(1, "sift", 0.5, 0.4), (2, "sift", 0.0, 0.4), (2, "akaze", 1.0, 0.2), (3, "sift", 1.0, 2.0), (3, "orb", 1.0, 2.0), (4, "sift", 0.0, 0.0)]
    got = {r["candidate_id"]: round(r["similarity"], 6) for r in matching.fuse(score(spark, rows)).collect()}
    base = (0.4 * 0.25 + 0.2 * 0.4) / 0.65
    assert got == {1: 0.55, 2: round(base + 0.15 + 0.08 * (0.3 + 0.7 * base), 6), 3: 0.95}


def test_rank_fills_up_with_zero_candidates(spark):
    images = spark.createDataFrame([("s", 0, "query"), ("s", 9, "query")] + [("s", i, "candidate") for i in range(1, 6)], "session_id STRING, image_id BIGINT, role STRING")
    scores = spark.createDataFrame([("s", 0, 5, 0.4), ("s", 0, 1, 0.4), ("s", 9, 4, 0.9)], "session_id STRING, query_id BIGINT, candidate_id BIGINT, similarity DOUBLE")
    got = [(r["query_id"], r["rank"], r["candidate_id"], r["similarity"]) for r in matching.rank_matches(scores, images, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.4), (0, 2, 5, 0.4), (0, 3, 2, 0.0), (9, 1, 4, 0.9), (9, 2, 1, 0.0), (9, 3, 2, 0.0)]
    assert {r["total_matches"] for r in matching.rank_matches(scores, images, 3).collect()} == {5}


def test_result_docs_forms(spark):
    matches = spark.createDataFrame([("s", 1, 5, 0.3, 1, 9), ("s", 1, 6, 0.7, 2, 9)], "session_id STRING, query_id BIGINT, candidate_id BIGINT, similarity DOUBLE, rank BIGINT, total_matches BIGINT")
    images = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "b", "boom")], "session_id STRING, query_id BIGINT, image_name STRING, error STRING")
    multi, docs = matching.result_docs(matches, images, 0.55)
    row = multi.first()
    assert (row["total_images"], row["successful_matches"], row["failed_uploads"], row["no_matches"], row["best_similarity"]) == (2, 1, 1, 1, 0.7)
    single, _docs = matching.result_docs(matches, images.filter("query_id = 1"), 0.55, multi=False)
    row = single.first()
    assert (row["successful_matches"], row["no_matches"], row["failed_uploads"], row["overall_success"]) == (1, 1, 0, True)
    flags = {r["query_id"]: (r["api_success"], r["status_code"], [m["meets_threshold"] for m in r["matches"] or []]) for r in docs.collect()}
    assert flags == {1: (True, 200, [False, True]), 2: (False, 500, [])}


MATCH = "session_id STRING, source_image_index INT, source_image_name STRING, similarity DOUBLE, url STRING, comic_name STRING, issue_number STRING, comic_vine_id STRING, parent_comic_vine_id STRING"


def reviewed(spark):
    matches = spark.createDataFrame([
        ("s", None, "n", 0.70, "u0", "C", "1", "10", None), ("s", 1, "n", 0.55, "u1", "C", "1", "11", "p"), ("s", 2, "n", 0.54, "u2", "C", "1", "12", None),
        ("s", 2, "n", 0.10, "u9", "C", "1", "19", None)], MATCH)
    images = spark.createDataFrame([("s", i, f"Image {i + 1}") for i in range(4)], "session_id STRING, source_image_index INT, image_name STRING")
    return matches, review.classify(matches, images)


def test_classify_and_rules(spark):
    _matches, results = reviewed(spark)
    got = {r["source_image_index"]: (r["confidence"], r["status"], r["is_variant"]) for r in results.collect()}
    assert got == {0: ("high", "pending", False), 1: ("medium", "pending", True), 2: ("low", "pending", False), 3: ("low", "no_match", False)}
    after = review.apply_rules(review.apply_rules(results, "reject_low"), "accept_all")
    assert {r["source_image_index"]: r["status"] for r in after.collect()} == {0: "auto_accepted", 1: "auto_accepted", 2: "rejected", 3: "no_match"}
    row = review.review_stats(after).first()
    assert (row["auto_accepted"], row["rejected"], row["no_match"], row["auto_acceptance_rate"]) == (2, 1, 1, 50.0)


def test_import_selects_by_identifier(spark):
    matches, results = reviewed(spark)
    chosen = '{"imageIndex": 2, "status": "manually_accepted", "selectedMatchIdentifier": "19-C-1-u9"}'
    lost = '{"imageIndex": 0, "status": "manually_accepted", "selectedMatchIdentifier": "nobody"}'
    back = review.import_sel(results, spark.createDataFrame([("s", chosen), ("s", lost)], "session_id STRING, selection STRING"), matches)
    got = {r["source_image_index"]: (r["status"], r["selected_match"] and r["selected_match"]["url"]) for r in back.collect()}
    assert got == {0: ("manually_accepted", None), 1: ("pending", "u1"), 2: ("manually_accepted", "u9"), 3: ("no_match", None)}

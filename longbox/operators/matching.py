"""Cover matching: nearest neighbours between descriptor sets and score fusion.

Input is one row per keypoint: session_id, image_id, role (query, candidate),
detector, kp_id, x, y, descriptor (doubles) and bits (64-bit words).

Descriptors are never paired up as rows. Both sides of a (session, detector)
are cut into blocks of bounded size by their counts; each pair of blocks is
one small matrix product inside a task, which gives back only the one or two
nearest neighbours, or only those that pass the match rule. A session with a
third of all descriptors is many blocks and so many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.operators.forest import KdForest
from longbox.plans.scale import top_per_group

# Default weights, distance kinds, and scoring constants.
DEFAULT_WEIGHTS = {"sift": 0.25, "orb": 0.25, "akaze": 0.40, "kaze": 0.10}
HAMMING = ("orb", "akaze")
MIN_DESCRIPTORS = {"sift": 8, "orb": 8, "akaze": 5, "kaze": 8}
QUALITY_LIMIT = {"sift": 200.0, "kaze": 150.0}
QUALITY_WEIGHT = 0.2
NEAR = 50.0
RATIO = 0.80
GEOMETRIC_WEIGHT = 0.30
GEOMETRIC_MIN = 8
GEOMETRIC_FAILED = 0.4
CELL = 10.0
DETECTOR_BONUS = 0.08
TOP_SCORE = 0.95
WEIGHT_IF_UNKNOWN = 0.25

BLOCK = 2048
PAIR = ["session_id", "query_id", "candidate_id"]
NEIGHBOURS = (
    "session_id STRING, detector STRING, query_id BIGINT, query_kp BIGINT, qx DOUBLE, qy DOUBLE, "
    "candidate_id BIGINT, kp1 BIGINT, x1 DOUBLE, y1 DOUBLE, d1 DOUBLE, kp2 BIGINT, d2 DOUBLE, split BOOLEAN"
)


def weights(presets: DataFrame) -> DataFrame:
    """Enabled detectors per preset with weights that sum to one."""
    default = F.lit(None).cast("double")
    for name, value in DEFAULT_WEIGHTS.items():
        default = F.when(F.col("detector") == name, value).otherwise(default)
    enabled = presets.filter(F.col("n") > 0).withColumn("weight", F.coalesce("weight", default))
    sums = enabled.groupBy("preset").agg(F.sum("weight").alias("_sum"))
    share = F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(F.col("weight"))
    return enabled.join(sums, "preset").withColumn("weight", share).drop("_sum")


def _side(descriptors: DataFrame, role: str) -> DataFrame:
    return descriptors.filter(F.col("role") == role)


def pair_blocks(descriptors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Work per (session, detector): descriptors, image pairs and blocks.

    This is the pair plan as counts; the pairs themselves are never listed.
    """
    def of(role: str, column: str) -> Column:
        return F.when(F.col("role") == role, F.col(column))

    counted = descriptors.groupBy("session_id", "detector").agg(
        F.count(of("query", "kp_id")).alias("query_descriptors"),
        F.count(of("candidate", "kp_id")).alias("candidate_descriptors"),
        F.count_distinct(of("query", "image_id")).alias("queries"),
        F.count_distinct(of("candidate", "image_id")).alias("candidates"),
    )
    return counted.withColumns(
        {
            "image_pairs": F.col("queries") * F.col("candidates"),
            "query_blocks": F.ceil(F.col("query_descriptors") / block),
            "candidate_blocks": F.ceil(F.col("candidate_descriptors") / block),
        }
    )


def image_counts(descriptors: DataFrame) -> DataFrame:
    return descriptors.groupBy("session_id", "detector", "role", "image_id").agg(F.count("*").alias("n"))


def gate(descriptors: DataFrame) -> DataFrame:
    """Only images with enough descriptors of a detector."""
    needed = F.lit(8)
    for name, least in MIN_DESCRIPTORS.items():
        needed = F.when(F.col("detector") == name, least).otherwise(needed)
    enough = image_counts(descriptors).filter(F.col("n") >= needed).drop("n")
    return descriptors.join(enough, ["session_id", "detector", "role", "image_id"], "left_semi")


def _matrix(side: pd.DataFrame, hamming: bool) -> np.ndarray:
    if not hamming:
        return np.stack(side["descriptor"].to_list()).astype(np.float64)
    words = np.ascontiguousarray(np.stack(side["bits"].to_list()).astype(np.int64))
    # One column per bit as -1 or +1: the dot product then counts equal bits.
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _distances(q: np.ndarray, c: np.ndarray, hamming: bool) -> np.ndarray:
    product = q @ c.T
    if hamming:
        return (q.shape[1] - product.astype(np.float64)) / 2
    squares = (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * product
    return np.sqrt(np.maximum(squares, 0))


def _nearest(q: np.ndarray, c: np.ndarray, hamming: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and exact distances of the ``k`` nearest rows of ``c``.

    L2 is found on the fast product and settled on exact differences: of every
    row whose squared distance may, by the rounding bound of the product, be no
    larger than the k-th.
    """
    k = min(k, c.shape[0])
    if hamming:
        rough = _distances(q, c, hamming)
        # ``c`` is in keypoint order, so a stable sort breaks ties by keypoint.
        at = np.argsort(rough, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(rough, at, 1)
    norms_q, norms_c = (q**2).sum(1), (c**2).sum(1)
    rough = norms_q[:, None] + norms_c[None, :] - 2 * (q @ c.T)
    # Each of the three sums of products is off by less than D eps |q| |c| (or its like).
    slack = 4 * (q.shape[1] + 2) * np.finfo(np.float64).eps * (norms_q + norms_c.max())
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
    few = int((rough <= limit[:, None]).sum(axis=1).max())
    at = np.argsort(rough, axis=1, kind="stable")[:, :few]
    exact = np.empty(at.shape)
    for i in range(few):
        exact[:, i] = np.sqrt(((q - c[at[:, i]]) ** 2).sum(1))
    order = np.lexsort((at, exact), axis=1)[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)


def _in_forest(q: np.ndarray, c: np.ndarray, hamming: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from a forest over ``c``, built where its rows lie."""
    return KdForest(c).search(q, k)


def _block_matcher(k: int, rule: str, ratio: float, near: float):
    names = [f.split(" ")[0] for f in NEIGHBOURS.split(", ")]

    def match(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: [] for n in names}).astype({"session_id": str, "detector": str})
        hamming = q["detector"].iat[0] in HAMMING
        qm, out = _matrix(q, hamming), []
        for image, side in c.groupby("image_id", sort=True):
            side = side.sort_values("kp_id")
            at, far = _nearest(qm, _matrix(side, hamming), hamming, k)
            first, second = at[:, 0], at[:, 1] if at.shape[1] > 1 else None
            d1, d2 = far[:, 0], far[:, 1] if second is not None else np.full(len(q), np.nan)
            split = bool(side["split"].iat[0])
            keep = np.ones(len(q), dtype=bool)
            if not split and rule == "ratio":
                keep = d1 < ratio * d2
            elif not split and rule == "near":
                keep = d1 < near
            kp, xs, ys = (side[name].to_numpy() for name in ("kp_id", "x", "y"))
            rows = pd.DataFrame(
                {
                    "session_id": q["session_id"].to_numpy(),
                    "detector": q["detector"].to_numpy(),
                    "query_id": q["image_id"].to_numpy(),
                    "query_kp": q["kp_id"].to_numpy(),
                    "qx": q["x"].to_numpy(),
                    "qy": q["y"].to_numpy(),
                    "candidate_id": image,
                    "kp1": kp[first],
                    "x1": xs[first],
                    "y1": ys[first],
                    "d1": d1,
                    "kp2": pd.array(kp[second], dtype="Int64") if second is not None else pd.array([pd.NA] * len(q), dtype="Int64"),
                    "d2": pd.array(d2, dtype="Float64") if second is not None else pd.array([pd.NA] * len(q), dtype="Float64"),
                    "split": split,
                }
            )
            out.append(rows[keep])
        return pd.concat(out, ignore_index=True)

    return match


def neighbours(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 2,
    rule: str = "all",
    ratio: float = RATIO,
    near: float = NEAR,
    keys: tuple[str, ...] = ("session_id", "detector"),
    block: int = BLOCK,
) -> DataFrame:
    """Nearest one or two (``k``) candidates per (query keypoint, candidate image).

    ``rule`` keeps all, those passing the ratio test, or the near ones. A
    candidate image stays in one block unless it alone exceeds the block
    size; the parts of such an image are merged before the rule applies.
    """
    if k not in (1, 2):
        raise ValueError("match rules use one or two neighbours; see knn for more")
    flagged = _flagged(candidates, keys, block)
    run = _block_matcher(k, rule, ratio, near)
    whole = _by_blocks(queries, flagged.filter(~F.col("split")), list(keys), block, run)
    parts = _by_blocks(queries, flagged.filter("split"), list(keys), block, run)
    merged = _merge(parts, k)
    if rule == "ratio":
        merged = merged.filter(F.col("d1") < ratio * F.col("d2"))
    elif rule == "near":
        merged = merged.filter(F.col("d1") < near)
    return whole.unionByName(merged).drop("split")


def _by_blocks(queries: DataFrame, candidates: DataFrame, by: list[str], block: int, run, schema: str = NEIGHBOURS) -> DataFrame:
    """Run a matcher on every pair of query and candidate blocks of a key."""
    columns = ["session_id", "detector", "image_id", "kp_id", "x", "y", "descriptor", "bits"]
    columns += [c for c in by if c not in columns]

    def blocks_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias(f"n_{name}"))

    sizes = blocks_of(queries, "q").join(blocks_of(candidates, "c"), by)
    left = queries.select(*columns).join(sizes, by).withColumns(
        {
            "q": F.pmod(F.xxhash64("image_id", "kp_id"), F.col("n_q")).cast("int"),
            "c": F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)),
        }
    ).drop("n_q", "n_c")
    place = F.when(F.col("split"), F.xxhash64("image_id", "kp_id")).otherwise(F.xxhash64("image_id"))
    right = candidates.select(*columns, "split").join(sizes, by).withColumns(
        {
            "c": F.pmod(place, F.col("n_c")).cast("int"),
            "q": F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)),
        }
    ).drop("n_q", "n_c")
    group = [*by, "q", "c"]
    # Both sides may come from one frame; fresh columns keep them apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, schema)


def _merge(parts: DataFrame, k: int) -> DataFrame:
    """The nearest of the neighbours found in several blocks."""
    key = ["session_id", "detector", "query_id", "query_kp", "candidate_id"]
    none = F.lit(None).cast("double")
    one = F.struct(F.col("d1").alias("d"), F.col("kp1").alias("kp"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    two = F.struct(F.col("d2").alias("d"), F.col("kp2").alias("kp"), none.alias("x"), none.alias("y"))
    near = parts.select(*key, "qx", "qy", F.explode(F.array(one, two)).alias("n")).filter(F.col("n.kp").isNotNull())
    # A second neighbour of one block may be the same point as a first of
    # another copy; the one that knows its place wins.
    near = near.groupBy(*key, "qx", "qy", "n.kp", "n.d").agg(F.max("n.x").alias("x"), F.max("n.y").alias("y"))
    ranked = top_per_group(near, key, [F.col("d"), F.col("kp")], k, "r")

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("r") == rank, F.col(column)))

    return ranked.groupBy(*key, "qx", "qy").agg(
        at(1, "kp").alias("kp1"), at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(1, "d").alias("d1"),
        at(2, "kp").alias("kp2"), at(2, "d").alias("d2"), F.lit(True).alias("split"),
    )


def _flagged(candidates: DataFrame, keys: tuple[str, ...], block: int) -> DataFrame:
    """``candidates`` with ``split``: their image is larger than a block."""
    counted = candidates.groupBy(*keys, "image_id").agg((F.count("*") > block).alias("split"))
    return candidates.join(counted, [*keys, "image_id"])


RANKS = (
    "session_id STRING, detector STRING, query_id BIGINT, query_kp BIGINT, candidate_id BIGINT, "
    "candidate_kp BIGINT, rank BIGINT, distance DOUBLE, split BOOLEAN"
)


def _rank_matcher(k: int, find):
    names = [f.split(" ")[0] for f in RANKS.split(", ")]

    def match(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: [] for n in names}).astype({"session_id": str, "detector": str})
        hamming = q["detector"].iat[0] in HAMMING
        qm, out = _matrix(q, hamming), []
        for image, side in c.groupby("image_id", sort=True):
            side = side.sort_values("kp_id")
            at, far = find(qm, _matrix(side, hamming), hamming, k)
            found = (at >= 0).ravel()
            rows = np.repeat(np.arange(len(q)), at.shape[1])[found]
            out.append(
                pd.DataFrame(
                    {
                        "session_id": q["session_id"].to_numpy()[rows],
                        "detector": q["detector"].to_numpy()[rows],
                        "query_id": q["image_id"].to_numpy()[rows],
                        "query_kp": q["kp_id"].to_numpy()[rows],
                        "candidate_id": image,
                        "candidate_kp": side["kp_id"].to_numpy()[at.ravel()[found]],
                        "rank": np.tile(np.arange(1, at.shape[1] + 1), len(q))[found],
                        "distance": far.ravel()[found],
                        "split": bool(side["split"].iat[0]),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return match


def _k_nearest(descriptors: DataFrame, k: int, block: int, find) -> DataFrame:
    """One row per rank; parts of an image larger than a block are merged by rank."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    queries, candidates = _side(descriptors, "query"), _side(descriptors, "candidate")
    flagged = _flagged(candidates, ("session_id", "detector"), block)
    run = _rank_matcher(k, find)
    keys = ["session_id", "detector"]
    whole = _by_blocks(queries, flagged.filter(~F.col("split")), keys, block, run, RANKS)
    parts = _by_blocks(queries, flagged.filter("split"), keys, block, run, RANKS).drop("rank")
    point = ["session_id", "detector", "query_id", "query_kp", "candidate_id"]
    merged = top_per_group(parts, point, [F.col("distance"), F.col("candidate_kp")], k)
    return whole.unionByName(merged).select(*PAIR, "detector", "query_kp", "rank", "candidate_kp", "distance")


def knn(descriptors: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """Exact ``k`` nearest neighbours in each candidate image, one row per rank."""
    return _k_nearest(descriptors, k, block, _nearest)


def knn_approx(descriptors: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """Approximate L2 neighbours from randomised kd-trees, one row per rank.

    Each block of a candidate image has a forest of five trees, built in the task
    that holds it; a query keypoint compares 50 points of it, taken from one queue
    over all trees. Binary descriptors are left out: they have exact counts.
    """
    return _k_nearest(descriptors.filter(~F.col("detector").isin(*HAMMING)), k, block, _in_forest)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(detector, n_exact, recall): share of exact neighbours that were found."""
    key = [*PAIR, "detector", "query_kp", "candidate_kp"]
    both = exact.select(*key).join(found.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return both.groupBy("detector").agg(F.count("*").alias("n_exact"), (F.count("_hit") / F.count("*")).alias("recall"))


def ratio_test(descriptors: DataFrame, ratio: float = RATIO, block: int = BLOCK) -> DataFrame:
    """Good matches: nearest clearly closer than second nearest."""
    ready = gate(descriptors)
    return neighbours(_side(ready, "query"), _side(ready, "candidate"), 2, "ratio", ratio=ratio, block=block)


def _pair_counts(descriptors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the descriptor counts of both images."""
    counts = image_counts(descriptors)
    q = counts.filter(F.col("role") == "query").select(
        "session_id", "detector", F.col("image_id").alias("query_id"), F.col("n").alias("query_n"))
    c = counts.filter(F.col("role") == "candidate").select(
        "session_id", "detector", F.col("image_id").alias("candidate_id"), F.col("n").alias("candidate_n"))
    joined = pairs.join(q, ["session_id", "detector", "query_id"]).join(c, ["session_id", "detector", "candidate_id"])
    return joined.withColumn("total", F.least("query_n", "candidate_n"))


def _weight(weight_of: dict[str, float]) -> Column:
    weight = F.lit(WEIGHT_IF_UNKNOWN)
    for name, value in weight_of.items():
        weight = F.when(F.col("detector") == name, value).otherwise(weight)
    return weight


def score_simple(
    descriptors: DataFrame, weight_of: dict[str, float] = DEFAULT_WEIGHTS, near: float = NEAR, block: int = BLOCK
) -> DataFrame:
    """Weighted share of near matches; pairs without any near match score 0
    and are left out. Weights count every detector both images have."""
    found = neighbours(_side(descriptors, "query"), _side(descriptors, "candidate"), 1, "near", near=near, block=block)
    good = found.groupBy(*PAIR, "detector").agg(F.count("*").alias("good"))
    scored = _pair_counts(descriptors, good).withColumn("w", _weight(weight_of))
    summed = scored.groupBy(*PAIR).agg(F.sum(F.col("good") / F.col("total") * F.col("w")).alias("s"))
    # The weight both images share, from one small row of detectors per image.
    kinds = image_counts(descriptors).withColumn("w", _weight(weight_of)).groupBy("session_id", "role", "image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("detector", "w"))).alias("have"))
    q = kinds.filter(F.col("role") == "query").select("session_id", F.col("image_id").alias("query_id"), F.col("have").alias("qh"))
    c = kinds.filter(F.col("role") == "candidate").select("session_id", F.col("image_id").alias("candidate_id"), F.col("have").alias("ch"))
    both = F.aggregate(
        F.map_values(F.map_filter("qh", lambda d, w: F.map_contains_key("ch", d))), F.lit(0.0), lambda a, w: a + w)
    joined = summed.join(q, ["session_id", "query_id"]).join(c, ["session_id", "candidate_id"])
    return joined.select(*PAIR, (F.col("s") / both).alias("similarity"))


def geometric(good: DataFrame) -> DataFrame:
    """Share of matches moving into the fullest 10-pixel displacement cell.

    Fewer than eight matches score n / 20 (at most 1); eight or more without
    any place known score 0.4.
    """
    key = [*PAIR, "detector"]
    placed = F.col("qx").isNotNull() & F.col("qy").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    dx, dy = F.floor((F.col("x1") - F.col("qx")) / CELL), F.floor((F.col("y1") - F.col("qy")) / CELL)
    cells = good.withColumns({"dx": dx, "dy": dy, "placed": placed}).groupBy(*key, "dx", "dy", "placed").agg(
        F.count("*").alias("n"), F.sum("d1").alias("d"))
    merged = cells.groupBy(*key).agg(
        F.sum("n").alias("good"), F.sum("d").alias("distance_sum"), F.max(F.when(F.col("placed"), F.col("n"))).alias("modal"))
    share = F.coalesce(F.col("modal") / F.col("good"), F.lit(GEOMETRIC_FAILED))
    few = F.least(F.lit(1.0), F.col("good") / 20.0)
    return merged.withColumn("geometric", F.when(F.col("good") >= GEOMETRIC_MIN, share).otherwise(few)).drop("modal")


def detector_score(descriptors: DataFrame, good: DataFrame) -> DataFrame:
    """Similarity per (pair, detector); without a good match there is no row."""
    rows = _pair_counts(descriptors, geometric(good))
    mean = F.col("distance_sum") / F.col("good")
    bonus = F.lit(0.0)
    for name, limit in QUALITY_LIMIT.items():
        gain = F.greatest(F.lit(0.0), (F.lit(limit) - mean) / limit) * QUALITY_WEIGHT
        bonus = F.when(F.col("detector") == name, gain).otherwise(bonus)
    similarity = F.col("good") / F.col("total") + bonus + F.col("geometric") * GEOMETRIC_WEIGHT
    return rows.select(*PAIR, "detector", "good", "geometric", similarity.alias("similarity"))


def fuse(scores: DataFrame, weight_of: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """One similarity per pair from its detectors' scores."""
    w = _weight(weight_of)
    summed = scores.filter(F.col("similarity") > 0).groupBy(*PAIR).agg(
        (F.sum(F.col("similarity") * w) / F.sum(w)).alias("base"),
        F.avg("geometric").alias("geo"),
        F.count("*").alias("detectors"),
    )
    bonus = DETECTOR_BONUS * (F.col("detectors") - 1) * (0.3 + 0.7 * F.col("base"))
    boosted = F.col("base") + F.col("geo") * GEOMETRIC_WEIGHT + bonus
    return summed.select(*PAIR, F.least(F.lit(TOP_SCORE), boosted).alias("similarity"))


def match_images(
    descriptors: DataFrame, weight_of: dict[str, float] = DEFAULT_WEIGHTS, ratio: float = RATIO, block: int = BLOCK
) -> DataFrame:
    """Similarity of all image pairs that have any; the rest is 0."""
    return fuse(detector_score(descriptors, ratio_test(descriptors, ratio, block)), weight_of)


def rank_matches(scores: DataFrame, images: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` candidates per query image with ``rank`` and ``total_matches``.

    ``images``: session_id, image_id, role. Pairs without a score have 0 and
    come last in id order; since at most ``k`` of them can be needed per
    query, only the first ``k`` candidates of its session are looked at.
    """
    queries = images.filter(F.col("role") == "query").select("session_id", F.col("image_id").alias("query_id"))
    listed = images.filter(F.col("role") == "candidate").select("session_id", F.col("image_id").alias("candidate_id"))
    totals = listed.groupBy("session_id").agg(F.count("*").alias("total_matches"))
    head = top_per_group(listed, ["session_id"], [F.col("candidate_id")], k).drop("rank")
    zero = queries.join(head, "session_id").withColumn("similarity", F.lit(0.0))
    both = scores.select(*PAIR, "similarity").unionByName(zero.select(*PAIR, "similarity"))
    # A scored candidate may be among the k zeros too: 2k rows hold k pairs.
    order, key = [F.desc("similarity"), F.col("candidate_id")], ["session_id", "query_id"]
    few = top_per_group(both, key, order, 2 * k).groupBy(*PAIR).agg(F.max("similarity").alias("similarity"))
    return top_per_group(few, key, order, k).join(totals, "session_id")


def pair_status(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """``status`` per match; ``candidates``: session_id, candidate_id, features, error."""
    joined = matches.join(candidates, ["session_id", "candidate_id"], "left")
    status = (
        F.when(F.col("error").isNotNull(), "processing_error")
        .when(F.coalesce("features", F.lit(0)) == 0, "failed_features")
        .otherwise("success")
    )
    kept = F.when(status == "success", F.col("similarity")).otherwise(F.lit(0.0))
    return joined.withColumns({"status": status, "similarity": kept}).drop("features", "error")


def run_summary(images: DataFrame, covers: DataFrame) -> DataFrame:
    """One row per session. ``images``: session_id, total_matches per query
    image; ``covers``: session_id, urls per candidate cover."""
    held = covers.groupBy("session_id").agg(
        F.count("*").alias("total_covers_processed"), F.sum(F.size("urls")).alias("total_urls_processed"))
    hit = F.count_if(F.col("total_matches") > 0)
    summed = images.groupBy("session_id").agg(
        F.count("*").alias("total_images_processed"),
        hit.alias("successful_images"),
        (F.count("*") - hit).alias("failed_images"),
        F.sum("total_matches").alias("total_matches_all_images"),
    )
    return summed.join(held, "session_id", "left").fillna(0, ["total_covers_processed", "total_urls_processed"])


def result_docs(matches: DataFrame, images: DataFrame, threshold: float, multi: bool = True) -> tuple[DataFrame, DataFrame]:
    """(session documents, image documents) of a run.

    ``matches`` are ranked rows (at most k per image, so the list in each
    image document is small); ``images``: session_id, query_id, image_name,
    error. With several images any match is a success; the single form needs
    one at the threshold.
    """
    key = ["session_id", "query_id"]
    item = F.struct("rank", "candidate_id", "similarity", (F.col("similarity") >= threshold).alias("meets_threshold"))
    lists = matches.groupBy(*key).agg(
        F.array_sort(F.collect_list(item)).alias("matches"),
        F.max("similarity").alias("best_similarity"),
        F.max("total_matches").alias("total_matches"),
        F.count_if(F.col("similarity") >= threshold).alias("above"),
    )
    found = images.join(lists, key, "left")
    ok = F.col("error").isNull()
    n = F.coalesce(F.size("matches"), F.lit(0))
    success = (n > 0) if multi else (F.coalesce("above", F.lit(0)) > 0)
    docs = found.select(
        *key,
        "image_name",
        ok.alias("api_success"),
        success.alias("match_success"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"),
        F.when(ok, 200).otherwise(500).alias("status_code"),
        "error",
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"),
        F.coalesce("above", F.lit(0)).alias("above"),
        n.cast("bigint").alias("match_count"),
        "matches",
    )
    hits = F.count_if("match_success")
    if multi:
        good, missed, failed = hits, F.count("*") - hits, F.count("*") - hits
    else:
        good, missed, failed = F.sum("above"), F.sum("match_count") - F.sum("above"), F.lit(0).cast("bigint")
    sessions = docs.groupBy("session_id").agg(
        F.count("*").alias("total_images"),
        good.alias("successful_matches"),
        missed.alias("no_matches"),
        failed.alias("failed_uploads"),
        (good > 0).alias("overall_success"),
        F.max("best_similarity").alias("best_similarity"),
    )
    return sessions, docs.drop("above", "match_count")


def evaluation(images: DataFrame, threshold: float) -> DataFrame:
    """Folder evaluation per session. ``images``: session_id, api_success, best_similarity."""
    hit = F.col("api_success") & (F.col("best_similarity") >= threshold)
    return images.groupBy("session_id").agg(
        F.count_if(hit).alias("successful_matches"),
        F.count_if(F.col("api_success") & ~hit).alias("no_matches"),
        F.count_if(~F.col("api_success")).alias("failed_uploads"),
        F.coalesce(F.max(F.when(hit, F.col("best_similarity"))), F.lit(0.0)).alias("best_similarity"),
        (F.count_if(hit) > 0).alias("overall_success"),
    )

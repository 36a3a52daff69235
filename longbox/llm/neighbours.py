"""Approximate nearest neighbours of feature descriptors by projection.

Descriptors are projected onto a few random Gaussian directions. The normal
distribution is stable: the square of a projected distance over that of the
true one has a chi-square distribution with as many degrees of freedom as there
are directions. A kd-tree gives projected neighbours nearest first, each is
verified with its true nearness, and the search ends when a point nearer than
the worst of the k best so far would, with the probability asked for, have
shown up by now.

Nearness is the inner product. One more coordinate makes all descriptors as
long as the longest, after which the largest product is the least distance.

Equal descriptors are one point, so that a very common one is no burden. Points
are dealt into shards of bounded size; a block of queries searches each shard,
and the k best of all shards are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.storage import stored
from longbox.plans.scale import top_per_group

DIRECTIONS = 8
SEED = 9
LEAF = 512
# Points of a shard, and queries that search it in one task.
SHARD, QUERIES = 65_536, 512
# A better point is missed by one search with at most this probability.
MISSED = 0.02


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability that a chi-square variable of even ``degrees`` exceeds ``x``."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return float(np.exp(-x / 2)) * total


def chi_square_limit(missed: float, degrees: int) -> float:
    """The value that a chi-square variable exceeds with probability ``missed``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > missed else (low, middle)
    return high


class Tree:
    """kd-tree over projected points: boxes of leaves, split at medians."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        # Node: (low corner, high corner, left, right) or (..., start, stop) of a leaf.
        self.low, self.high, self.parts, self.leaf = [], [], [], []
        if len(points):
            self._build(0, len(points))

    def _build(self, start: int, stop: int) -> int:
        own = self.points[self.order[start:stop]]
        node = len(self.parts)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.leaf.append(stop - start <= LEAF)
        self.parts.append((start, stop))
        if stop - start > LEAF:
            axis = int((self.high[node] - self.low[node]).argmax())
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, axis], half)]
            self.parts[node] = (self._build(start, start + half), self._build(start + half, stop))
        return node

    def _bound(self, node: int, at: np.ndarray) -> float:
        gap = np.maximum(0.0, np.maximum(self.low[node] - at, at - self.high[node]))
        return float(gap @ gap)

    def nearest(self, at: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance that all points to come have at least, next points)."""
        heap = [(0.0, 0)] if len(self.points) else []
        while heap:
            bound, node = heapq.heappop(heap)
            first, second = self.parts[node]
            if self.leaf[node]:
                yield bound, self.order[first:second]
            else:
                for child in (first, second):
                    heapq.heappush(heap, (self._bound(child, at), child))


class Index:
    """The points of a shard: vectors made equally long, projections and their tree."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors = vectors
        more = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.square = longest**2
        draw = np.random.default_rng(SEED)
        self.directions = draw.standard_normal((vectors.shape[1] + 1, DIRECTIONS))
        self.tree = Tree(np.column_stack([vectors, more]) @ self.directions)

    def search(self, query: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, products) of about the k points of largest product with ``query``."""
        at = query @ self.directions[:-1]
        square = float(query @ query) + self.square
        places, products, worst = np.empty(0, np.int64), np.empty(0), -np.inf
        for bound, found in self.tree.nearest(at):
            # Squared true distance of the k-th best so far.
            if len(places) >= k and bound > limit * max(square - 2 * worst, 0.0):
                break
            own = self.vectors[found] @ query
            good = own >= worst
            if good.any():
                places, products = np.concatenate([places, found[good]]), np.concatenate([products, own[good]])
                if len(places) > k:
                    # Ties with the k-th stay: which of them counts is a matter of ids.
                    worst = np.partition(products, -k)[-k]
                    places, products = places[products >= worst], products[products >= worst]
                elif len(places) == k:
                    worst = products.min()
        return places, products


def _valid(descriptors: DataFrame) -> DataFrame:
    """Rows with an id and a finite descriptor other than zero."""
    part = F.col("descriptor")
    finite = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = F.col("kp_id").isNotNull() & part.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(part, lambda x: x != 0)
    typed = descriptors.select(F.col("kp_id").cast("bigint").alias("kp_id"), F.col("descriptor").cast("array<double>").alias("descriptor"))
    return typed.filter(kept)


def nearest(descriptors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, kp_id, score): about the ``k`` nearest ``descriptors`` of each query.

    Both tables: kp_id, descriptor. The score is the inner product, computed in
    double precision on the descriptors as given; ties are in order of kp_id. A
    query's own id is no candidate. With no more than k candidates all are
    returned. Descriptors null, empty, zero, or with null or non-finite parts
    take no part, nor do rows without an id; repeated ids are rows of their own
    as candidates, and as queries one. All descriptors must be of one length.
    Empty tables give no rows. Other columns are ignored.
    """
    rows, asked = _valid(descriptors), _valid(queries).dropDuplicates(["kp_id"])
    # Of equal descriptors the k + 1 least ids can be wanted: k and the query's own.
    points = rows.groupBy("descriptor").agg(F.min("kp_id").alias("point"))
    longest = F.sqrt(F.aggregate("descriptor", F.lit(0.0), lambda a, x: a + x * x))
    points = stored(points.withColumn("_length", longest), "points")
    n, most = points.agg(F.count("*"), F.max("_length")).first()
    shards = max(1, -(-n // SHARD))
    blocks = max(1, -(-asked.count() // QUERIES))
    limit = chi_square_limit(MISSED, DIRECTIONS)
    left = points.withColumn("shard", F.pmod(F.xxhash64("descriptor"), F.lit(shards))).select("shard", "point", "descriptor")
    block = F.pmod(F.xxhash64("kp_id"), F.lit(blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    wide = asked.select(each(shards).alias("shard"), block.alias("block"), F.col("kp_id").alias("query_id"), F.col("descriptor").alias("query"))
    # A shard meets each block of queries in a task of its own.
    spread = left.withColumn("block", each(blocks))

    def search(key, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "point": [], "score": []}
        if len(own) and len(others):
            ids, index = own["point"].to_numpy(), Index(np.stack(own["descriptor"].to_numpy()), most)
            for query_id, query in zip(others["query_id"], others["query"]):
                places, products = index.search(np.asarray(query), k + 1, limit)
                out["query_id"] += [query_id] * len(places)
                out["point"] += ids[places].tolist()
                out["score"] += products.tolist()
        return pd.DataFrame(out)

    found = spread.groupBy("shard", "block").cogroup(wide.groupBy("shard", "block")).applyInPandas(
        search, "query_id BIGINT, point BIGINT, score DOUBLE"
    )
    # The points first, then the rows that stand behind each.
    best = top_per_group(found, ["query_id"], [F.desc("score"), F.col("point")], k + 1).drop("rank")
    behind = rows.join(points.select("point", "descriptor"), "descriptor").select("point", "kp_id")
    behind = top_per_group(behind, ["point"], [F.col("kp_id")], k + 1).drop("rank")
    near = best.join(behind, "point").filter("kp_id <> query_id")
    return top_per_group(near, ["query_id"], [F.desc("score"), F.col("kp_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "kp_id", "score"
    )

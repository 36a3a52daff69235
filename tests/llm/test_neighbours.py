import numpy as np
import pytest

from longbox.llm import neighbours
from longbox.llm.queries import suite

DDL = "kp_id BIGINT, descriptor ARRAY<FLOAT>, point STRING"


def brute(ids, vectors, queries, k):
    scores = vectors.astype(np.float64) @ vectors[queries].astype(np.float64).T
    out = {}
    for j, q in enumerate(queries):
        order = sorted((-s, i) for s, i in zip(scores[:, j], ids) if i != ids[q])[:k]
        out[ids[q]] = [(i, -s) for s, i in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["kp_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, wanted):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    return hits / sum(map(len, wanted.values()))


def test_chi_square():
    assert neighbours.chi_square_tail(0, 8) == 1 and abs(neighbours.chi_square_tail(15.507, 8) - 0.05) < 1e-4
    assert abs(neighbours.chi_square_limit(0.05, 8) - 15.507) < 1e-3


def test_the_tree_gives_all_points_nearest_first():
    points = np.random.default_rng(1).standard_normal((1000, 4))
    tree, at = neighbours.Tree(points), np.zeros(4)
    bounds, seen = [], []
    for bound, places in tree.nearest(at):
        bounds.append(bound)
        assert (np.square(points[places]).sum(axis=1) >= bound - 1e-9).all()
        seen += places.tolist()
    assert bounds == sorted(bounds) and sorted(seen) == list(range(1000))


def test_recall_and_scores_in_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((30, 32))
    vectors = (centres[draw.integers(0, 30, 3000)] + 0.4 * draw.standard_normal((3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], DDL)
    found = got(neighbours.nearest(df, df.filter("kp_id % 40 = 0"), 20))
    wanted = brute(list(range(3000)), vectors, list(range(0, 3000, 40)), 20)
    assert found.keys() == wanted.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, wanted) >= 0.9
    for q, rows in found.items():
        assert [s for _, s in rows] == pytest.approx([float(vectors[i].astype(float) @ vectors[q].astype(float)) for i, _ in rows], abs=1e-9)


def test_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])
    found = got(suite.queries["op9_approximate_neighbours"](spark, folder).withColumnRenamed("vec_id", "kp_id"))
    wanted = brute(ids, vectors, [j for j, i in enumerate(ids) if i % 20 == 0], 20)
    assert found.keys() == wanted.keys() and recall(found, wanted) >= 0.9


def test_edge_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same, "x") for i in range(40)] + [(50, [2.0, 4.0], "x"), (51, None, "x"), (52, [0.0, 0.0], "x"), (53, [1.0, None], "x"), (54, [1.0, float("nan")], "x"),
            (55, [float("inf"), 1.0], "x"), (56, [], "x"), (None, same, "x"), (57, [-1.0, 0.5], "x")]
    df = spark.createDataFrame(rows, DDL)
    found = got(neighbours.nearest(df, df.filter("kp_id IN (0, 30, 50, 51, 52)"), 3))
    assert found == {0: [(50, 10.0), (1, 5.0), (2, 5.0)], 30: [(50, 10.0), (0, 5.0), (1, 5.0)], 50: [(0, 10.0), (1, 10.0), (2, 10.0)]}
    few = df.filter("kp_id IN (0, 50, 57)")
    assert got(neighbours.nearest(few, few.filter("kp_id = 0"), 20)) == {0: [(50, 10.0), (57, 0.0)]}
    assert neighbours.nearest(df, df.limit(0), 3).count() == 0 and neighbours.nearest(df.limit(0), df, 3).count() == 0

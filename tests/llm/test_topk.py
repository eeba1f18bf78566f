import numpy as np

from matchloom.llm.topk import BallTree, exact_topk, search_shard


def brute(vectors, queries, k):
    out = []
    for q, v in sorted(queries.items()):
        scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_tree_holds_every_row_within_its_radius():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-50, 50, size=(300, 5)), np.ones((100, 5))]).astype(float)
    tree = BallTree(v, 16)
    assert sorted(tree.order.tolist()) == list(range(400))
    for c, r, (lo, hi) in zip(tree.centres, tree.radii, tree.spans, strict=True):
        assert (np.sqrt(((v[tree.order[lo:hi]] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()


def test_against_brute_force_over_shards(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-20, 20, size=6).astype(float).tolist() for i in range(400)}
    vectors |= {i: [3.0] * 6 for i in range(400, 520)}  # a hot, equal vector
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<double>").repartition(5)
    queries = {i: v for i, v in vectors.items() if i % 20 == 0}
    want = brute(vectors, queries, 5)
    for shard, block in ((64, 7), (100_000, 100_000)):
        got = exact_topk(df, df.where("vec_id % 20 = 0"), 5, shard_rows=shard, block_rows=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0]), (None, [9.0, 9.0]), (6, []), (7, [1.0, 1.0, 1.0]), (20, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS shard")
    got = exact_topk(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 5, 4), (0, 5, 4), (20, 6, 0)]
    assert exact_topk(df.where("false"), df, 5).count() == 0 and exact_topk(df, df.where("false"), 5).count() == 0


def test_scores_beyond_double_precision():
    v = np.array([[2.0**40 + 1, 1.0], [2.0**40, 3.0]])
    found = dict(search_shard(np.array([1, 2]), v, np.array([9]), np.array([[2.0**20, 1.0]]), [-np.inf], 2))
    assert found[0] == [(2**60 + 2**20 + 1, 1), (2**60 + 3, 2)]


def test_a_floor_beyond_double_precision_cuts_no_hit():
    v = np.array([[2.0**40 + 1, 1.0], [2.0**40 - 5, 3.0]])
    floor = 2**60 + 2**20 + 1  # as a double it lies elsewhere
    for f in (floor, floor - 3):
        found = dict(search_shard(np.array([1, 2]), v, np.array([9]), np.array([[2.0**20, 1.0]]), [f], 2))
        assert found[0] == [(floor, 1)]


def test_repeated_ids(spark):
    rows = [(1, [2.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 9.0]), (3, [4.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = exact_topk(df, df.where("vec_id % 50 = 0"), 5, shard_rows=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(50, 1, 3, 9), (50, 2, 1, 0), (50, 3, 1, 0), (50, 4, 1, 0)]

import numpy as np

from loomsearch.llm import neighbours


def brute(rows, query, k):
    q = np.array(dict(rows)[query], float)
    found = sorted((float(np.sqrt(((np.array(v, float) - q) ** 2).sum())), i) for i, v in rows if i != query)
    return found[:k]


def test_recall_order_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 2, (15, 16))
    points = [(centres[k % 15] + rng.normal(0, 1, 16)).astype(np.float32).tolist() for k in range(3000)]
    rows = [(k, p if k % 3 else points[3]) for k, p in enumerate(points)]  # a third has one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 100 = 0"), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["id"]))
    assert set(by) == set(range(0, 3000, 100))
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found) and q not in [f[2] for f in found]
        want = brute(rows, q, 10)
        hit += len({i for _, i in want} & {f[2] for f in found})
        if q % 3 == 0:
            assert [f[2] for f in found] == [i for _, i in want]
    assert hit / (10 * len(by)) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as leaf", "3 as v")
    got = neighbours.search(df, df, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [(0, 7, 0.0), (0, 6, 1.0), (6, 0, 1.0), (6, 7, 1.0), (7, 0, 0.0), (7, 6, 1.0)]
    assert neighbours.search(df.limit(0), df.limit(0), 3).count() == 0


def test_best_bins_visit_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = neighbours._numbered(neighbours.grow(x, 16, 1000, np.random.default_rng(2)))
    leaves = len(tree.leaves())
    assert sorted(tree.best_bins(x[0], leaves)) == list(range(leaves))
    assert tree.best_bins(x[5], leaves)[0] == tree.assign(x[5:6])[0]
    counts, raw = neighbours._packed(tree)
    again = neighbours._numbered(neighbours._unpacked(counts, raw, 8))
    assert len(again.leaves()) == leaves and (again.assign(x) == tree.assign(x)).mean() > 0.99


def test_recall_on_the_driver_s_table_and_depth_that_follows_the_data(spark):
    """Vectors without much structure: the share of rows that a query is compared with falls as rows are added."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = rows.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in vectors], float)
    ids = np.array([r["vec_id"] for r in vectors])
    found: dict[int, set[int]] = {}
    for r in neighbours.search(rows, rows.where("vec_id % 100 = 0"), 10).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    hit = 0
    for q, got in found.items():
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit += len(got & set(ids[np.argsort(d)[:10]].tolist()))
    assert hit >= 0.9 * 10 * len(found)
    shares = []
    for n in (500, 2000):
        index = neighbours.build(rows.where(f"vec_id < {n}").select("embedding").withColumnRenamed("embedding", "v"), 10)
        shares.append((index.visits / index.leaves, index.leaves))
    assert shares[1][0] < shares[0][0] and shares[1][1] > 2 * shares[0][1]

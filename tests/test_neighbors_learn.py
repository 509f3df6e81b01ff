import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rfmspark.operators import learn, neighbors


def points(spark, n=300, d=4, seed=1):
    rng = np.random.default_rng(seed)
    blob1 = rng.normal(0, 0.3, (n // 2, d))
    blob2 = rng.normal(3, 0.3, (n // 2 - 2, d))
    far = np.full((2, d), 20.0) + np.arange(2)[:, None]
    x = np.vstack([blob1, blob2, far])
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    pdf.insert(0, "id", [f"{i:04d}" for i in range(len(x))])
    return spark.createDataFrame(pdf), x, list(pdf.columns[1:])


def brute_knn(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    return np.sort(d, axis=1)[:, k - 1]


@pytest.mark.parametrize("chunk", [2048, 16])  # 16 forces crowded cells to be split
def test_knn_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", chunk)
    df, x, cols = points(spark)
    got = neighbors.k_distance(df, "id", cols, 5).toPandas().sort_values("id").k_distance.to_numpy()
    assert np.allclose(got, brute_knn(x, 5))


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= m
    lab = -np.ones(len(x), dtype=int)
    cid = 0
    for i in range(len(x)):
        if core[i] and lab[i] < 0:
            stack = [i]
            lab[i] = cid
            while stack:
                j = stack.pop()
                for t in np.nonzero(d[j] & core)[0]:
                    if lab[t] < 0:
                        lab[t] = cid
                        stack.append(t)
            cid += 1
    for i in range(len(x)):  # border points: smallest-labelled core neighbour
        if not core[i]:
            ls = lab[np.nonzero(d[i] & core)[0]]
            lab[i] = ls.min() if len(ls) else -1
    return lab, core


def test_dbscan_matches_brute_force(spark, monkeypatch):  # D14
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 32)
    df, x, cols = points(spark, n=200)
    got = neighbors.dbscan(df, "id", cols, 0.8, 5).toPandas().sort_values("id")
    want, core = brute_dbscan(x, 0.8, 5)
    assert (got.core.to_numpy() == core).all()
    assert (got.DBSCAN_Cluster.to_numpy() == want).all()
    assert set(got.DBSCAN_Cluster) == {-1, 0, 1}


def crowd(spark, n=1500, d=9, seed=3):
    """Points of one crowded spot, some of them equal."""
    x = np.round(np.random.default_rng(seed).normal(0, 0.5, (n, d)), 1)
    x[: n // 5] = x[0]
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    pdf.insert(0, "id", [f"{i:04d}" for i in range(n)])
    return spark.createDataFrame(pdf).repartition(2), x, list(pdf.columns[1:])


def test_eps_pairs_ship_packed_tiles_not_points(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 16)
    df, x, cols = crowd(spark)
    met = []
    meet = neighbors._meet
    monkeypatch.setattr(neighbors, "_meet", lambda pairs, left, right, *rest: met.append((pairs.count(), left.count())) or meet(pairs, left, right, *rest))
    got = neighbors.eps_neighbor_counts(df, "id", cols, 1.2).toPandas().sort_values("id").neighbors.to_numpy()
    assert (got == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 1.2).sum(axis=1)).all()
    (pairs, tiles), = met
    assert tiles <= len(x) / 32 and pairs <= tiles * (tiles + 1) / 2  # rows of pairs, not copies of points for each


def test_knn_asks_only_tiles_within_reach_and_breaks_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 64)
    df, x, cols = crowd(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r["id"]: [n["i"] for n in r["neighbors"]] for r in neighbors.knn(df, "id", cols, 5).collect()}
    assert got == {f"{i:04d}": [f"{j:04d}" for j in np.argsort(d[i], kind="stable")[:5]] for i in range(len(x))}


def test_points_without_all_coordinates_take_no_part(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", None, 0.0), ("d", 0.5, float("nan"))], "id string, p double, q double")
    assert {r["id"]: r["k_distance"] for r in neighbors.k_distance(df, "id", ["p", "q"], 2).collect()} == {"a": 1.0, "b": 1.0}
    assert {r["id"]: r["neighbors"] for r in neighbors.eps_neighbor_counts(df, "id", ["p", "q"], 1.0).collect()} == {"a": 2, "b": 2}


def test_stratified_split_exact_and_folds_disjoint(spark):
    df = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(1, 301)], "CustomerID string, Target int")
    s = learn.stratified_split(df).groupBy("Target").agg(F.sum(F.col("is_test").cast("int")).alias("t"),
                                                         F.count(F.lit(1)).alias("n")).collect()
    for r in s:
        assert r.t == int(r.n * 0.2 + 0.5)
    f = learn.stratified_kfold(df, k=3).groupBy("Target", "fold").count().toPandas()
    assert f.groupby("Target")["count"].apply(lambda c: c.max() - c.min()).max() <= 1


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), float(rng.normal()), float(rng.normal()), int(i < 30)) for i in range(100)]
    df = spark.createDataFrame(rows, "CustomerID string, a double, b double, Target int")
    out = learn.smote(df, ["a", "b"], "Target", "CustomerID", k=5, seed=1).toPandas()
    assert (out.Target == 1).sum() == (out.Target == 0).sum() == 70
    mino = out[(out.Target == 1) & ~out.CustomerID.str.contains("_smote_")][["a", "b"]].to_numpy()
    syn = out[out.CustomerID.str.contains("_smote_")][["a", "b"]].to_numpy()
    lo, hi = mino.min(axis=0) - 1e-9, mino.max(axis=0) + 1e-9
    assert ((syn >= lo) & (syn <= hi)).all()


def test_linear_contributions_add_up(spark):
    from rfmspark.operators import explain
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", -1.0, 0.5)], "CustomerID string, x double, y double")
    w = spark.createDataFrame([("x", 0, 0.5), ("y", 1, -2.0), ("__intercept__", 2, 0.1)], "feature string, position int, weight double")
    means = spark.createDataFrame([("x", 0, 0.2, 1.0), ("y", 1, -0.3, 1.0)], "feature string, position int, mean double, scale double")
    c = explain.linear_contributions(df, w, means, ["x", "y"]).toPandas()
    assert np.allclose(c.base_value + c.contrib_x + c.contrib_y, c.margin)


def test_tree_contributions_add_up_to_model_margin(spark):
    from pyspark.ml.functions import vector_to_array

    from rfmspark.operators import explain
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(CustomerID=[str(i) for i in range(200)], Target=y)
    df = spark.createDataFrame(pdf)
    model = learn.gbt(df, ["a", "b", "c"], max_iter=10, max_depth=3, step=0.1)
    c = explain.tree_contributions(df, model, ["a", "b", "c"]).toPandas().sort_values("CustomerID")
    raw = model.transform(learn.assemble(df, ["a", "b", "c"])).select(
        "CustomerID", vector_to_array("rawPrediction")[1].alias("m")).toPandas().sort_values("CustomerID")
    assert np.allclose(c.margin.to_numpy(), raw.m.to_numpy())
    assert np.allclose(c.base_value + c.contrib_a + c.contrib_b + c.contrib_c, c.margin)


def _brute_expected(tree, X, known, node=0):
    """E[tree(x) | x_S] by recursion over the whole tree (the definition)."""
    f = tree["feature"][node]
    if f < 0:
        return np.full(X.shape[0], tree["value"][node])
    lv = _brute_expected(tree, X, known, tree["left"][node])
    rv = _brute_expected(tree, X, known, tree["right"][node])
    if f in known:
        return np.where(X[:, f] <= tree["threshold"][node], lv, rv)
    cl, cr = tree["cover"][tree["left"][node]], tree["cover"][tree["right"][node]]
    return (cl * lv + cr * rv) / (cl + cr)


def _brute_shap(tree, X, m):
    """Shapley values by enumerating every subset of the m features."""
    import itertools
    import math
    phi = np.zeros((X.shape[0], m))
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
            for s in itertools.combinations(others, k):
                phi[:, i] += w * (_brute_expected(tree, X, set(s) | {i}) - _brute_expected(tree, X, set(s)))
    return phi


def _random_tree(rng, depth, m):
    """A random tree that reuses features along paths (so repeated splits are covered)."""
    t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def add(level, cover):
        i = len(t["feature"])
        for a in t.values():
            a.append(None)
        t["cover"][i] = cover
        if level == depth or cover < 2:
            t["feature"][i], t["threshold"][i], t["left"][i], t["right"][i] = -1, 0.0, -1, -1
            t["value"][i] = float(rng.normal())
            return i
        cl = float(rng.integers(1, cover))
        t["feature"][i], t["threshold"][i], t["value"][i] = int(rng.integers(0, m)), float(rng.normal()), 0.0
        t["left"][i] = add(level + 1, cl)
        t["right"][i] = add(level + 1, cover - cl)
        return i
    add(0, 1000.0)
    return t


def test_polynomial_tree_shap_equals_subset_enumeration():
    from rfmspark.operators import explain
    rng = np.random.default_rng(3)
    for depth, m in [(1, 2), (3, 3), (5, 4), (6, 5)]:
        tree = _random_tree(rng, depth, m)
        X = rng.normal(size=(64, m))
        phi, base, margin = explain.tree_shap_batch(tree, explain.leaf_paths(tree), X, m)
        assert np.allclose(phi, _brute_shap(tree, X, m), atol=1e-9)
        assert np.isclose(base, _brute_expected(tree, X, set())[0])
        assert np.allclose(margin, _brute_expected(tree, X, set(range(m))))


def test_parallel_fits_keep_task_order(spark):
    from rfmspark.operators.learn import run_parallel
    tasks = [(lambda i=i: spark.range(i + 1).count()) for i in range(6)]
    assert run_parallel(tasks, parallelism=3) == [1, 2, 3, 4, 5, 6]
    assert run_parallel(tasks, parallelism=1) == [1, 2, 3, 4, 5, 6]


def test_connected_components_long_chain_and_stars(spark):
    from rfmspark.operators.neighbors import connected_components
    rng = np.random.default_rng(11)
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)]            # one path of 301 nodes
    star = [("5000", f"{5000 + i:04d}") for i in range(1, 40)]              # a star
    pair = [("9001", "9000")]                                               # reversed edge
    edges = [chain[i] for i in rng.permutation(len(chain))] + star + pair
    out = dict(connected_components(spark.createDataFrame(edges, "src string, dst string")).collect())
    assert len(out) == 301 + 40 + 2
    assert all(out[f"{i:04d}"] == "0000" for i in range(301))
    assert all(out[f"{5000 + i:04d}"] == "5000" for i in range(40))
    assert out["9001"] == out["9000"] == "9000"


def test_dense_order_matches_sorted_positions(spark):
    from rfmspark.operators.neighbors import dense_order
    keys = [f"k{i:05d}" for i in np.random.default_rng(2).permutation(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "label string").repartition(7)
    got = dict(dense_order(df, "label", "cid").collect())
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}

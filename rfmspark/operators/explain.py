"""Per-customer feature contributions.

For a linear margin b + sum w_i x_i with (assumed independent) features, the exact
Shapley value of feature i is w_i·(x_i - E[x_i]) and the base value is the margin
at the training means; contributions + base = margin. Everything is a row-local
projection over the scored table with a broadcast one-row weight table.
Tree-ensemble contributions use Spark ML's own tree models (see ``tree_contributions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmspark.schemas import MODEL_FEATURES

_DISPLAY = {c: c.replace("_log", "") for c in MODEL_FEATURES}


def linear_contributions(scaled: DataFrame, weights: DataFrame, train_means: DataFrame,
                         cols: list[str] | None = None) -> DataFrame:
    """Adds ``base_value``, ``margin`` and one ``contrib_<feature>`` per model feature."""
    cols = cols or MODEL_FEATURES
    w = weights.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("weight"))).alias(f"_w_{c}")
                                for c in cols + ["__intercept__"]])
    m = train_means.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_mu_{c}") for c in cols])
    d = scaled.crossJoin(F.broadcast(w.crossJoin(m)))
    base = F.col("_w___intercept__")
    margin = F.col("_w___intercept__")
    for c in cols:
        base = base + F.col(f"_w_{c}") * F.col(f"_mu_{c}")
        margin = margin + F.col(f"_w_{c}") * F.col(c)
    out = d.withColumn("base_value", base).withColumn("margin", margin)
    for c in cols:
        out = out.withColumn(f"contrib_{c}", F.col(f"_w_{c}") * (F.col(c) - F.col(f"_mu_{c}")))
    return out.drop(*[x for x in out.columns if x.startswith("_w_") or x.startswith("_mu_")])


def contribution_long(df: DataFrame, id_col: str = "CustomerID", cols: list[str] | None = None) -> DataFrame:
    cols = cols or MODEL_FEATURES
    return df.select(id_col, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"contrib_{c}").alias("value"))
                                                for c in cols])))


def contribution_map(df: DataFrame, id_col: str = "CustomerID", cols: list[str] | None = None) -> DataFrame:
    """feature -> contribution per customer, with the ``_log`` suffix removed from names."""
    cols = cols or MODEL_FEATURES
    return df.select(id_col, "base_value", F.map_from_arrays(
        F.array(*[F.lit(_DISPLAY[c]) for c in cols]), F.array(*[F.col(f"contrib_{c}") for c in cols])).alias("contributions"))


def top_contributions(df: DataFrame, id_col: str = "CustomerID", n: int = 3, cols: list[str] | None = None) -> DataFrame:
    """The ``n`` largest contributions by absolute value with their sign label (ties:
    feature order). An array sort per row - no shuffle."""
    cols = cols or MODEL_FEATURES
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"contrib_{c}").alias("value"))
                    for i, c in enumerate(cols)])
    srt = F.array_sort(arr, lambda l, r: F.when(F.abs(r["value"]) > F.abs(l["value"]), 1)
                       .when(F.abs(r["value"]) < F.abs(l["value"]), -1)
                       .otherwise((l["pos"] - r["pos"]).cast("int")))
    top = df.select(id_col, F.posexplode(F.slice(srt, 1, n)).alias("rank0", "c"))
    return top.select(id_col, (F.col("rank0") + 1).alias("rank"), F.col("c.feature").alias("feature"),
                      F.col("c.value").alias("shap_value"),
                      F.when(F.col("c.value") > 0, "positive").otherwise("negative").alias("influence"))


def sort_contributions(df: DataFrame, id_col: str = "CustomerID", cols: list[str] | None = None) -> DataFrame:
    """All contributions of each customer ranked by absolute value (descending)."""
    return top_contributions(df, id_col, len(cols or MODEL_FEATURES), cols)


def mean_abs_contribution(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Global importance: mean |contribution| per feature over all rows (one aggregate)."""
    cols = cols or MODEL_FEATURES
    one = df.agg(*[F.avg(F.abs(F.col(f"contrib_{c}"))).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_contribution"))
                                         for c in cols])))


# --------------------------------------------------------------------------- tree ensembles

def tree_arrays(model) -> list[dict]:
    """Flatten the trees of a fitted Spark tree-ensemble model into node arrays
    (feature, threshold, left, right, value, cover); read once on the driver, their
    size is bounded by the model (trees x nodes), not by the data."""
    out = []
    for t in model.trees:
        feat, thr, left, right, val, cover = [], [], [], [], [], []

        def add(node):
            i = len(feat)
            for a in (feat, thr, left, right, val, cover):
                a.append(None)
            cover[i] = float(node.impurityStats().count())
            if node.getClass().getSimpleName() == "InternalNode":
                s = node.split()
                feat[i], thr[i], val[i] = int(s.featureIndex()), float(s.threshold()), 0.0
                left[i] = add(node.leftChild())
                right[i] = add(node.rightChild())
            else:
                feat[i], thr[i], left[i], right[i], val[i] = -1, 0.0, -1, -1, float(node.prediction())
            return i
        add(t._java_obj.rootNode())
        out.append({"feature": feat, "threshold": thr, "left": left, "right": right, "value": val, "cover": cover})
    return out


def leaf_paths(tree: dict) -> list[tuple[float, dict]]:
    """Every root-to-leaf path of one tree as (leaf value, {feature: [(node, goes_left)]}):
    the splits on each feature along the path, in order. Bounded by the model size."""
    out = []

    def walk(node, steps):
        f = tree["feature"][node]
        if f < 0:
            by_feature: dict[int, list] = {}
            for feat, parent, left in steps:
                by_feature.setdefault(feat, []).append((parent, left))
            out.append((tree["value"][node], by_feature))
            return
        walk(tree["left"][node], steps + [(f, node, True)])
        walk(tree["right"][node], steps + [(f, node, False)])
    walk(0, [])
    return out


def _path_fractions(tree: dict, X, splits: list):
    """(zero fraction, one fraction) of one feature on one path: the share of training
    cover that follows the path's splits on it, and whether ``x`` follows all of them."""
    import numpy as np
    zero, one = 1.0, np.ones(X.shape[0])
    for node, left in splits:
        cl, cr = tree["cover"][tree["left"][node]], tree["cover"][tree["right"][node]]
        zero *= (cl if left else cr) / (cl + cr)
        go_left = X[:, tree["feature"][node]] <= tree["threshold"][node]
        one = one * (go_left if left else ~go_left)
    return zero, one


def tree_shap_batch(tree: dict, paths: list, X, n_features: int):
    """Path-dependent Shapley values of one tree for a batch of rows, in polynomial time.

    Each leaf contributes v * prod_j (x_S has j ? o_j : z_j) over the distinct features j
    of its path (z = cover share, o = 0/1 whether x follows). For that product the
    Shapley value of feature i is v (o_i - z_i) sum_k c_k k!(d-1-k)!/d!, where c_k is the
    t^k coefficient of prod_{j != i} (z_j + o_j t). The full product is built once per
    leaf (O(d^2) vector operations) and each factor is divided out again (O(d))."""
    import math

    import numpy as np
    n = X.shape[0]
    phi = np.zeros((n, n_features))
    base, margin = 0.0, np.zeros(n)
    for value, by_feature in paths:
        feats = list(by_feature)
        d = len(feats)
        zo = [_path_fractions(tree, X, by_feature[f]) for f in feats]
        poly = np.zeros((d + 1, n))
        poly[0] = 1.0
        for z, o in zo:  # multiply by (z + o t)
            poly[1:] = poly[1:] * z + poly[:-1] * o
            poly[0] = poly[0] * z
        base += value * float(np.prod([z for z, _ in zo]))
        margin += value * poly[d]
        w = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for f, (z, o) in zip(feats, zo):
            # divide (z + o t) back out: by z where o = 0, synthetic division by (t + z) where o = 1
            q = np.zeros((d, n))
            q[d - 1] = poly[d]
            for k in range(d - 1, 0, -1):
                q[k - 1] = poly[k] - z * q[k]
            rest = np.where(o > 0, q, poly[:d] / z if z > 0 else 0.0)  # z = 0 and o = 0: no contribution
            phi[:, f] += value * (o - z) * (w @ rest)
    return phi, base, margin


def tree_contributions(df: DataFrame, model, cols: list[str], id_col: str = "CustomerID") -> DataFrame:
    """Exact Shapley values of the path-dependent expectation for a Spark tree ensemble
    (e.g. GBTClassifier: margin = sum of weight x tree), in time polynomial in the tree
    depth (``tree_shap_batch``). Runs per Arrow batch with ``mapInPandas``; the model's
    leaf paths travel with the function (bounded by the model size)."""
    import numpy as np
    import pandas as pd
    trees = tree_arrays(model)
    paths = [leaf_paths(t) for t in trees]
    weights = [float(w) for w in model.treeWeights]
    m_all = len(cols)

    def run(batches):
        for pdf in batches:
            X = pdf[cols].to_numpy(dtype=float)
            n = X.shape[0]
            phi = np.zeros((n, m_all))
            base = 0.0
            margin = np.zeros(n)
            for tree, tree_paths, w in zip(trees, paths, weights):
                p, b, m = tree_shap_batch(tree, tree_paths, X, m_all)
                phi += w * p
                base += w * b
                margin += w * m
            out = pd.DataFrame({id_col: pdf[id_col].astype(str).to_numpy(), "base_value": np.full(n, base),
                                "margin": margin})
            for i, c in enumerate(cols):
                out[f"contrib_{c}"] = phi[:, i]
            yield out

    schema = f"{id_col} string, base_value double, margin double, " + ", ".join(f"contrib_{c} double" for c in cols)
    return df.select(F.col(id_col).cast("string").alias(id_col), *cols).mapInPandas(run, schema)

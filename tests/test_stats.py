import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rfmspark.operators import features, stats


def test_quartile_and_population_std_and_skew(spark):  # D3
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    q = stats.quantile_row(df, "x", [0.25], ["q1"]).first().q1
    assert q == pytest.approx(1.75)
    p = features.fit_scaler(df, ["x"]).first()
    assert p.scale == pytest.approx(3.5355, abs=1e-4)
    s = features.skewness(df, ["x"]).first().skew
    assert s == pytest.approx(1.7636, abs=1e-4)


@pytest.mark.parametrize("buckets", [4096, 64])  # the second forces many rounds
def test_exact_quantiles_match_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = np.random.default_rng(7)
    vals = np.round(rng.exponential(10, 3000), 2)
    groups = rng.integers(0, 3, 3000)
    pdf = pd.DataFrame({"g": groups.astype(int), "x": vals})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = stats.exact_quantiles(df, "x", probs, ["g"]).toPandas()
    for g in range(3):
        want = np.percentile(vals[groups == g], [p * 100 for p in probs])
        have = got[got.g == g].sort_values("p_index").q.to_numpy()
        assert np.allclose(have, want, rtol=0, atol=1e-9)


def test_cumulative_by_order_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 200, 2000).astype(float), "v": rng.integers(0, 5, 2000)})
    out = stats.cumulative_by_order(spark.createDataFrame(pdf), "k", ["v"], ranges=8).toPandas()
    want = pdf.groupby("k").v.sum().sort_index().cumsum()
    got = out.groupby("k").cum_v.first().sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("buckets", [4096, 64])
def test_ranks_of_any_doubles(spark, monkeypatch, buckets):
    """Against a sort: infinities, NaN (last), both zeros, subnormal and huge values, heavy ties, a null group."""
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = np.random.default_rng(11)
    groups = {"a": [-np.inf, 5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, np.inf, np.inf, np.nan, 1e-300, 3.0],
              "b": [7.0] * 50 + [8.0], None: rng.lognormal(0, 20, 60).tolist(), "c": [np.inf], "d": [np.nan, np.nan]}
    rows = [(g, float(x), 1) for g, xs in groups.items() for x in xs] + [("a", None, 1), ("e", None, 1)]
    df = spark.createDataFrame(rows, "lo string, x double, n int").repartition(3)
    shares = [0.0, 0.2, 0.5, 0.9]
    specs = [(p, lambda n, p=p: F.floor(n * F.lit(p))) for p in shares] + [(1.0, lambda n: n)]
    got = {(r["lo"], r["r_index"]): (r["n"], r["rank"], r["value"]) for r in stats.values_at_ranks(df, "x", specs, ["lo"]).collect()}
    want = {}
    for g, xs in groups.items():
        ordered = np.sort(np.array(xs))
        for i, p in enumerate([*shares, 1.0]):
            rank = min(int(np.floor(len(xs) * p)), len(xs) - 1)
            want[(g, i)] = (len(xs), rank, float(ordered[rank]))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and (got[k][2] == want[k][2] or np.isnan(got[k][2]) and np.isnan(want[k][2])), k


def test_ranks_shuffle_counts_only(spark, monkeypatch):
    """No exchange carries rows by group: all between the scan and the first aggregate stays in place."""
    seen = []
    plain = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a, **k: (seen.append(self._jdf.queryExecution().executedPlan().toString()), plain(self, *a, **k))[1])
    stats.values_at_ranks(spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("g")), "x", [(0.5, lambda n: n / 2)], ["g"]).collect()
    plans = [(s, s.index("Range (0, 1000")) for s in seen if "Range (0, 1000" in s]
    assert len(plans) >= 2
    for s, at in plans:  # a plan's text goes down: the last exchange above the scan takes partial counts
        assert "HashAggregate" in s[s.rindex("Exchange hashpartitioning", 0, at):at]


def test_curves_with_tied_scores(spark):
    """95 % of all rows share one score: areas equal the plain rank sum."""
    from rfmspark.operators import evaluate
    rng = np.random.default_rng(2)
    score = np.where(rng.random(3000) < 0.95, 0.5, rng.random(3000).round(3))
    label = (rng.random(3000) < 0.3 + 0.4 * (score > 0.5)).astype(int)
    df = spark.createDataFrame([(int(t), float(p)) for t, p in zip(label, score)], "Target int, probability double")
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(want) and evaluate.curve_areas(df).first()["roc_auc"] == pytest.approx(want)

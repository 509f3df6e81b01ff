import numpy as np
import pandas as pd
import pytest

from rfmspark.operators import dashboard, drift, segment


def test_label_tie_goes_to_lower_monetary(spark):  # D11
    df = spark.createDataFrame([(0, 100.0, 10.0), (1, 50.0, 20.0), (2, 40.0, 20.0), (3, 10.0, 5.0)],
                               "c int, Monetary double, Recency double")
    lab = {r.c: r.Segment for r in segment.label_segments(df, "c").collect()}
    assert lab == {0: "Champions", 1: "Loyal Customers", 2: "At-Risk", 3: "Lost Customers"}


def test_equidistant_point_takes_first_segment(spark):  # D12
    cents = spark.createDataFrame([("Loyal Customers", 1.0), ("At-Risk", -1.0)], "Segment string, x double")
    pts = spark.createDataFrame([("p", 0.0)], "id string, x double")
    assert segment.nearest_centroid(pts, cents, ["x"]).first().Predicted_Segment == "At-Risk"
    empty = cents.where("false")
    assert segment.nearest_centroid(pts, empty, ["x"]).first().Predicted_Segment == "Unknown"


def test_psi_properties(spark):  # A9, D9, D10
    rng = np.random.default_rng(42)
    a = pd.DataFrame({"f": rng.normal(100, 20, 1000)})
    b = pd.DataFrame({"f": rng.normal(100, 20, 1000)})
    c = pd.DataFrame({"f": rng.normal(120, 20, 1000)})
    A, B, C = (spark.createDataFrame(x) for x in (a, b, c))
    same = drift.psi(A, A, ["f"]).first().psi_value
    stable = drift.psi(A, B, ["f"]).first().psi_value
    moved = drift.psi(A, C, ["f"]).first().psi_value
    assert same == pytest.approx(0.0, abs=1e-12) and stable < 0.1 and moved > stable
    const = spark.createDataFrame(pd.DataFrame({"f": [3.0] * 50}))
    assert drift.psi(const, B, ["f"]).first().psi_value == 0.0


def test_running_accuracy(spark):  # D16
    df = spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 1, 1)], "seq long, Target int, prediction int")
    r = [round(x.running_accuracy, 2) for x in dashboard.running_accuracy(df, "seq").orderBy("seq").collect()]
    assert r == [100.0, 50.0, 66.67]


def test_history_views(spark):  # D17, D18
    from rfmspark.operators.score import latest_feature_lookup
    from rfmspark.schemas import T7_PREDICTION_LOG
    base = {f.name: None for f in T7_PREDICTION_LOG.fields}
    rows = []
    for i, cid in enumerate([None, "", "7", "7"], start=1):
        r_ = dict(base, id=i, customer_id=cid, recency=float(i))
        rows.append(tuple(r_[f.name] for f in T7_PREDICTION_LOG.fields))
    log = spark.createDataFrame(rows, T7_PREDICTION_LOG)
    assert [r.customer_id for r in dashboard.history_project(log).orderBy("id").collect()] == ["N/A", "N/A", "7", "7"]
    assert [r.CustomerID for r in dashboard.history_export(log).orderBy("Inference_ID").collect()] == ["", "", "7", "7"]
    feats = spark.createDataFrame([("7", *[1.0] * 9), ("8", *[2.0] * 9)],
                                  "CustomerID string, " + ", ".join(f"{c} double" for c in __import__("rfmspark.schemas", fromlist=["x"]).FEATURES))
    ids = spark.createDataFrame([("7",), ("8",), ("9",)], "CustomerID string")
    got = {r.CustomerID: (r.source, r.Recency) for r in latest_feature_lookup(ids, log, feats).collect()}
    assert got == {"7": ("log", 4.0), "8": ("features", 2.0), "9": ("unknown", None)}


def test_both_runs_of_the_drift_log_share_one_reference(spark, monkeypatch):
    import datetime as dt
    from types import SimpleNamespace

    from rfmspark.plans import context
    from rfmspark.schemas import FEATURES
    rng = np.random.default_rng(5)
    table = lambda n, up: spark.createDataFrame(pd.DataFrame({"CustomerID": [str(i) for i in range(n)]} | {
        c: rng.normal(10 + up, 3, n) for c in FEATURES}))
    ref, now = table(80, 0), table(90, 2)
    dates = spark.createDataFrame([(dt.datetime(2010, 1, 5),), (dt.datetime(2016, 3, 1),)], "InvoiceDate timestamp_ntz")
    own = drift.psi_bin_edges
    calls = []
    monkeypatch.setattr(drift, "psi_bin_edges", lambda *a, **k: calls.append(1) or own(*a, **k))
    monkeypatch.setattr(context, "_STAGES", {})
    log = context.Ctx.drift_log.fget(SimpleNamespace(state=("own rows",), supervised=ref, features=now, cleaned=dates, stage=lambda df, name: df)).collect()
    assert len(calls) == 1
    want = [*drift.drift_report(ref, ref).collect(), *drift.drift_report(ref, now).collect()]
    got = {(r.id > len(FEATURES), r.feature_name): (r.psi_value, r.status, r.training_mean, r.production_mean) for r in log}
    assert got == {(i >= len(FEATURES), r.feature): (r.psi_value, r.status, r.training_mean, r.production_mean) for i, r in enumerate(want)}


def test_sweep_gives_sparks_kmeans_with_one_job_a_round_for_all_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 1, (120, 3)) for m in (0, 2.5, 5)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3).checkpoint()
    vec = segment._vectors(df, ["a", "b", "c"]).select("features").persist()
    for r in segment.kmeans_sweep(df, ["a", "b", "c"], [2, 4], restarts=2).collect():
        model = min((KMeans(k=r["k"], seed=42 + i, maxIter=300).fit(vec) for i in range(2)), key=lambda m: m.summary.trainingCost)
        assert r["inertia"] == pytest.approx(model.summary.trainingCost, rel=1e-9)
        assert r["silhouette_sq_euclidean"] == pytest.approx(ClusteringEvaluator().evaluate(model.transform(vec)), rel=1e-9)
    blocks, first, jobs = segment._blocks(df, ["a", "b", "c"]), [x[0], x[200]], []
    for fits in (1, 12):
        spark.sparkContext.setJobGroup(f"lloyd {fits}", "")
        found = segment._lloyd(blocks, [first] * fits, 300, 1e-4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lloyd {fits}")))
        assert all(cost == found[0][1] for _, cost in found)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
    even = segment._lloyd(segment._blocks(spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "a double"), ["a"]), [[np.array([0.0]), np.array([2.0])]], 1, 1e-4)
    assert even[0][0].tolist() == [[0.5], [2.0]]  # the row between goes to the first

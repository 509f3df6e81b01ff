"""Model store and training run: round trips, promotion, resampling inside folds, search and stacking."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfmspark.operators import evaluate, features, learn, model_store, training, trees
from rfmspark.operators.model_store import ConstantScorer, ModelStore, PipelineModel
from rfmspark.schemas import FEATURES, MODEL_FEATURES

SMALL = {"random_forest": {"trees": [4, 6], "depth": [3], "split": [2]}, "xgboost": {"trees": [3], "depth": [2], "step": [0.1, 0.3]},
         "lightgbm": {"trees": [3], "leaves": [4, 7], "step": [0.1]}}


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        x = rng.gamma(2, 20, 9)
        rows.append((str(i), *map(float, x.round(3)), int(x[0] + rng.normal(0, 15) > 55)))
    return spark.createDataFrame(rows, ["CustomerID", *FEATURES, "Target"]).withColumn("Target", F.col("Target").cast("int")).checkpoint()


@pytest.fixture(scope="module")
def trained(customers):
    train, test = customers.where("CustomerID % 5 != 0"), customers.where("CustomerID % 5 = 0")
    params = features.fit_scaler(learn.with_model_features(train), MODEL_FEATURES)
    settings = training.SETTINGS | {"gb": {"trees": 3, "depth": 2, "step": 0.1}}
    return training.train_models(train, test, params, SMALL, n_iter=2, settings=settings), test, train, params


def test_five_models_with_folds(trained):
    made, test, *_ = trained
    rows = {r["model"]: r for r in made.metrics.collect()}
    assert list(made.models) == training.ORDER == sorted(rows, key=lambda m: rows[m]["model_order"])
    assert all(0 <= r["roc_auc"] <= 1 and 0 <= r["cv_roc_auc_mean"] <= 1 and r["cv_roc_auc_std"] >= 0 for r in rows.values())
    tried = made.search.groupBy("model").agg(F.count("*").alias("n"), F.max("cv_roc_auc_mean").alias("top"), F.max_by("cv_roc_auc_mean", -F.col("place")).alias("first")).collect()
    assert {r["model"]: r["n"] for r in tried} == {"random_forest": 2, "xgboost": 2, "lightgbm": 2}
    assert all(r["top"] == r["first"] for r in tried)
    scored = model_store.predict(made.models["logistic_regression"], test)
    assert evaluate.roc_auc(scored).first()[0] == pytest.approx(rows["logistic_regression"]["roc_auc"])


def test_no_synthetic_row_meets_its_judges(customers, trained):
    *_, train, params = trained
    scaled = model_store.purchase_inputs(params).transform(train)
    folds, whole = training.training_sets(scaled)
    held = [{r[0] for r in f.held.select("CustomerID").collect()} for f in folds]
    assert set().union(*held) == {r[0] for r in train.select("CustomerID").collect()} and sum(map(len, held)) == train.count()
    for fold, own in zip(folds, held):
        ids = [r[0] for r in fold.fit.select("CustomerID").collect()]
        assert not own & {i.split("_smote_")[0] for i in ids} and any("_smote_" in i for i in ids)
        balance = {r[0]: r[1] for r in fold.fit.groupBy("Target").count().collect()}
        assert balance[0] == balance[1] and not any("_smote_" in i for i in own)


def test_stacked_model_is_its_meta_learner_over_the_bases(trained):
    made, test, *_ = trained
    stages = made.models["stacking_ensemble"].stages
    top = stages[-1]
    out = made.models["stacking_ensemble"].transform(test).limit(5).collect()
    for r in out:
        z = top.intercept + sum(w * r[f"_{n}_share"] for w, n in zip(top.coefficients, training.STACKED))
        assert r["probability"][1] == pytest.approx(1 / (1 + np.exp(-z)))


def test_stored_models_score_as_before(spark, trained, tmp_path):
    made, test, *_ = trained
    store = ModelStore(spark, str(tmp_path))
    ts = datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert store.registry().count() == 0
    with pytest.raises(LookupError):
        store.active()
    store.publish(made.models, made.metrics, True, ts)
    rows = store.registry().collect()
    assert len(rows) == 5 and all(r["is_active"] == 1 and r["filepath"].endswith("_20240506_070809.pkl") for r in rows)
    for name, model in made.models.items():
        again = PipelineModel.load(store.path(store.active(name)["filepath"]))  # from the folder, not from memory
        a, b = (sorted(map(tuple, model_store.predict(m, test).select("CustomerID", "prediction", "probability").collect())) for m in (model, again))
        assert a == b


def test_promotion_rejection_and_half_written_states(spark, customers, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    metric = spark.createDataFrame([("m", 0.5, 0.6, 0.5, 0.1)], "model string, accuracy double, roc_auc double, f1_score double, mcc double")
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    store.publish({"m": PipelineModel([ConstantScorer(0.25)])}, metric, True, at[0])
    store.publish({"m": PipelineModel([ConstantScorer(0.75)])}, metric, False, at[1])
    assert store.active("m")["id"] == 1 and [r["filepath"] for r in store.registry().orderBy("id").collect()][1] == model_store.REJECTED
    (tmp_path / "registry" / "state=3").mkdir()  # a run that died before its commit
    assert store.registry().count() == 2
    store.publish({"m": PipelineModel([ConstantScorer(0.9)])}, metric, True, at[2])
    active = store.registry().where("is_active = 1").collect()
    assert [r["id"] for r in active] == [3] and store.registry().count() == 3
    assert {r["probability"] for r in model_store.predict(store.active_model("m"), customers).collect()} == {0.9}


def test_stream_takes_up_a_promotion_between_batches(spark, customers, tmp_path):
    from rfmspark.schemas import SCALED_FEATURES
    from rfmspark.streaming import stream
    store = ModelStore(spark, str(tmp_path / "store"))
    metric = spark.createDataFrame([("m", 0.5, 0.6, 0.5, 0.1)], "model string, accuracy double, roc_auc double, f1_score double, mcc double")
    params = features.fit_scaler(learn.with_model_features(customers), MODEL_FEATURES)
    centroids = spark.createDataFrame([("A", *[0.0] * 9), ("B", *[1.0] * 9)], ["Segment", *SCALED_FEATURES])
    out, source = str(tmp_path / "out"), str(tmp_path / "src")
    for day, (share, part) in enumerate(((0.25, customers.limit(30)), (0.75, customers.limit(20))), 1):
        store.publish({"m": PipelineModel([ConstantScorer(share)])}, metric, True, datetime.datetime(2024, 1, day))
        part.write.mode("append").parquet(source)
        replay = stream.replay_source(spark, source, customers.schema, 100)
        stream.stream_score_active(replay, store, "m", params, centroids, out, str(tmp_path / "ckpt"))
    got = {(r[0], r[1]): r[2] for r in spark.read.parquet(out).groupBy("model_id", "Purchase_Probability").count().collect()}
    assert got == {(1, 0.25): 30, (2, 0.75): 20}


def test_resampled_estimator_balances_what_it_is_given(spark, trained):
    *_, train, params = trained
    scaled = model_store.purchase_inputs(params).transform(train)
    from pyspark.ml.classification import LogisticRegression
    fit = model_store.Resampled(LogisticRegression(featuresCol="features", labelCol="Target"), model_store.INPUTS).fit(scaled)
    assert fit.numFeatures == 9


def _some_rows(spark, n=500, values=20):
    rng = np.random.default_rng(3)
    x = rng.integers(0, values, (n, 5)) * 20.0 / values
    y = (x[:, 0] + x[:, 1] * x[:, 2] / 10 + rng.normal(0, 4, n) > 20).astype(int)
    rows = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, x)], "Target int, a double, b double, c double, d double, e double")
    return learn.assemble(rows, list("abcde")).withColumn("weight", F.when(F.col("Target") == 1, 0.6).otherwise(1.0)).repartition(3).checkpoint()


def _chance(model, rows):
    from pyspark.ml.functions import vector_to_array
    return np.array([r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect()])


def test_trees_are_those_of_spark_ml(spark, tmp_path):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    rows = _some_rows(spark)
    bounds = trees.bin_bounds(rows, 5)
    assert bounds == [[v + 0.5 for v in range(19)]] * 5
    blocks = trees.packed(rows, bounds)
    for weight in (1.0, 0.6):
        grown = trees.fit("boost", blocks, bounds, {"trees": 6, "depth": 4, "step": 0.1}, weight)
        theirs = GBTClassifier(labelCol="Target", maxIter=6, maxDepth=4, stepSize=0.1, seed=42)
        theirs = (theirs.setWeightCol("weight") if weight != 1 else theirs).fit(rows)
        assert _chance(trees.TreesModel(trees=grown, kind="boost", step=0.1), rows) == pytest.approx(_chance(theirs, rows), abs=1e-5)
    point = {"trees": 60, "depth": 5, "least": 2}
    halves = [t for r in (range(30), range(30, 60)) for t in trees.fit("forest", blocks, bounds, point, numbers=r)]
    assert halves == trees.fit("forest", blocks, bounds, point)  # grown in parts, the same forest
    model = trees.TreesModel(trees=halves, kind="forest")
    ours, theirs = _chance(model, rows), _chance(RandomForestClassifier(labelCol="Target", numTrees=60, maxDepth=5, minInstancesPerNode=2).fit(rows), rows)
    assert np.corrcoef(ours, theirs)[0, 1] > 0.98 and abs(ours - theirs).mean() < 0.05
    model.write().save(str(tmp_path / "forest"))
    assert (_chance(trees.TreesModel.load(str(tmp_path / "forest")), rows) == ours).all()


def test_trees_dont_depend_on_tasks_or_counting(spark, monkeypatch):
    rows = _some_rows(spark, 300, 200)  # more values than bins, so quantiles
    bounds = trees.bin_bounds(rows, 5)
    assert all(20 < len(b) < trees.BINS for b in bounds)
    blocks, point = trees.packed(rows, bounds), {"trees": 2, "depth": 2, "step": 0.1}
    alone = trees.fit("boost", blocks, bounds, point, 0.6)
    assert alone == trees.fit("boost", blocks, bounds, point, 0.6, tasks=2)  # sums over barrier tasks
    got = blocks.toArrow().to_batches()
    one = trees._Rows(got, 5)
    monkeypatch.setattr(trees, "PAIR_ROWS", 0)
    monkeypatch.setattr(trees, "BLOCK", 64)
    two = trees._Rows(got, 5)
    assert two.pairs and not one.pairs
    grown = [list(trees._boost(r, bounds, {"step": 0.1, "depth": 4}, 0.6, range(4), 42, lambda a: a)) for r in (one, two)]
    assert grown[0] == grown[1] and len(grown[0]) == 4 and len(grown[0][0][1]) > 200
    monkeypatch.setattr(trees, "PAIR_NODES", 2)
    forests = []
    for wide in (32, 1 << 20):
        monkeypatch.setattr(trees, "WIDE_BLOCK", wide)
        forests.append(list(trees._forest(two, bounds, {"depth": 6, "least": 1}, 1.0, range(3), 42, lambda a: a)))
    assert forests[0] == forests[1] and len(forests[0][0][1]) > 200


def test_registered_training_run_is_the_whole_search(spark, monkeypatch, customers):
    from rfmspark.plans.context import Ctx
    asked = {}

    def note(train, test, params, *cut, **other):
        asked.update(cut=cut, other=other)
        raise InterruptedError
    monkeypatch.setattr(training, "train_models", note)
    own = type("Own", (), {"split_flags": customers.withColumn("is_test", F.col("CustomerID") % 5 == 0)})()
    own.state = (spark.sparkContext.applicationId, "whole search")
    with pytest.raises(InterruptedError):
        Ctx.trained.fget(own)
    assert asked == {"cut": (), "other": {}}  # the library's grids, draws, rounds and folds
    made = {n: training.draws(g, 5) for n, g in training.GRIDS.items()}
    assert {len(p) for p in made.values()} == {5} and {q["trees"] for p in made.values() for q in p} <= {100, 200, 300}


def test_areas_of_several_fits_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(f, int(y), float(round(p, 1))) for f in range(3) for y, p in zip(rng.integers(0, 2, 40), rng.random(40))]
    scored = spark.createDataFrame(rows, "fit int, Target int, probability double").checkpoint()
    got = {r["fit"]: r["roc_auc"] for r in evaluate.roc_auc(scored, by="fit").collect()}
    assert got == {f: pytest.approx(evaluate.roc_auc(scored.where(F.col("fit") == f)).first()[0]) for f in range(3)}

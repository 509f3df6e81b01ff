"""The training run: five repurchase models, searched, cross-validated and stacked.

Folds are tagged once on the training rows. Of each fold the rows to fit on are balanced by
SMOTE and written once; every fit of the search, the cross-validation and the stacking reads
these tables, so resampling isn't repeated per fit, and no synthetic row comes from rows that
its model is judged on. All fits of the search and the cross-validation run in one pool, forests
and boosted trees by ``trees``, and their fold areas come from one pass over all held-out scores.

A trained model is one pipeline from the nine feature columns to probability and prediction
(see ``model_store``); the stacked one holds its base models, so scoring with it is one
projection without a join.
"""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmspark.operators import evaluate, learn, trees
from rfmspark.operators.model_store import INPUTS, ClassOne, predict, purchase_inputs

# ---------------------------------------------------------------------------
# The search grids and the models' settings.
# ---------------------------------------------------------------------------
GRIDS = {
    "random_forest": {"trees": [100, 200, 300], "depth": [6, 10, 15], "split": [2, 5, 10]},
    "xgboost": {"trees": [100, 200, 300], "depth": [4, 6, 8], "step": [0.01, 0.05, 0.1]},
    "lightgbm": {"trees": [100, 200, 300], "leaves": [15, 31, 63], "step": [0.01, 0.05, 0.1]},
}
SETTINGS = {"logistic_regression": {"C": 1.0}, "svc": {"C": 0.1}, "gb": {"trees": 150, "depth": 3, "step": 0.05}, "meta": {"C": 1.0}}
STACKED = ["random_forest", "xgboost", "lightgbm", "svc", "gb"]
ORDER = ["logistic_regression", "random_forest", "xgboost", "lightgbm", "stacking_ensemble"]


PART_SECONDS = 20  # a forest that takes longer in one task, by the estimate below, is grown in parts


def estimator(name: str, point: dict, rows: int, label: str = "Target", features: str = "features") -> LogisticRegression:
    """Unfitted logistic regression; its output columns carry the name. C is the inverse strength of the penalty on the summed loss."""
    made = LogisticRegression(featuresCol=features, labelCol=label, predictionCol=f"_{name}_label", maxIter=1000,
                              regParam=1.0 / (point["C"] * max(rows, 1)), elasticNetParam=0.0, standardization=False)
    return made.setProbabilityCol(f"_{name}_vector").setRawPredictionCol(f"_{name}_raw")


def _tree_point(name: str, point: dict) -> dict:
    """Trees, depth, step or least rows of a leaf. Leaves become the depth with room for that many; a node of fewer than
    ``split`` rows isn't split: its halves hold split / 2 rows or more."""
    if name == "random_forest":
        return {"trees": point["trees"], "depth": point["depth"], "least": max(1, point["split"] // 2)}
    return {"trees": point["trees"], "depth": point["depth"] if "depth" in point else math.ceil(math.log2(point["leaves"])), "step": point["step"]}


def fit_all(wanted: list[tuple[str, dict, Fold]], label: str = "Target", seed: int = 42) -> list:
    """The fitted model of each (name, point, fold), all in one pool, the longest first."""
    spark = wanted[0][2].fit.sparkSession
    apart = {id(f): f for n, p, f in wanted if "C" not in p and f.binned is None}.values()
    for fold, binned in zip(apart, learn.run_parallel([(lambda f=f: _binned(f, label)) for f in apart])):
        fold.binned = binned
    jobs, most = [], 1  # (estimated seconds, place, task)
    for i, (name, point, fold) in enumerate(wanted):
        if "C" in point:
            jobs.append((math.inf, i, lambda n=name, p=point, f=fold: estimator(n, p, f.rows, label).fit(f.fit)))
            continue
        kind, made = "forest" if name == "random_forest" else "boost", _tree_point(name, point)
        seconds, at_once = 4e-8 * fold.rows * made["trees"] * made["depth"], trees.tasks_of_fit(spark, fold.rows)
        parts = max(1, min(made["trees"], math.ceil(seconds / PART_SECONDS))) if kind == "forest" else 1
        weight, most = fold.weight if name == "xgboost" else 1.0, max(most, at_once)
        for part in range(parts):
            numbers = range(made["trees"] * part // parts, made["trees"] * (part + 1) // parts)
            jobs.append((seconds / parts, i, lambda k=kind, f=fold, m=made, w=weight, r=numbers, t=at_once: trees.fit(k, *f.binned, m, w, seed, t, r)))
    jobs.sort(key=lambda j: -j[0])
    done = learn.run_parallel([task for *_, task in jobs], max(learn.FIT_PARALLELISM, spark.sparkContext.defaultParallelism // most))
    out: list = [[] for _ in wanted]
    for (_, i, _), got in zip(jobs, done):
        out[i].append(got)
    return [got[0] if "C" in point else trees.TreesModel(
        trees=[t for part in got for t in part], kind="forest" if name == "random_forest" else "boost", step=float(point.get("step", 1.0)), featuresCol="features",
        predictionCol=f"_{name}_label", probabilityCol=f"_{name}_vector", rawPredictionCol=f"_{name}_raw") for (name, point, _), got in zip(wanted, out)]


def draws(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different grid points (all, if there are fewer), the same for the same seed."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(n_iter, len(points)))


@dataclass
class Fold:
    fit: DataFrame
    rows: int
    held: DataFrame
    weight: float = 1.0  # of a positive, for the models that weigh
    binned: tuple | None = None  # the rows to fit on as ``trees`` reads them, and the bins' bounds


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    search: DataFrame
    points: dict[str, dict] = field(default_factory=dict)


def _binned(fold: Fold, label: str) -> tuple:
    bounds = trees.bin_bounds(fold.fit, len(INPUTS))
    return trees.packed(fold.fit, bounds, label), bounds


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep").transform(df)


def training_sets(train: DataFrame, k: int = 3, label: str = "Target", id_col: str = "CustomerID", seed: int = 42) -> tuple[list[Fold], Fold]:
    """Of each fold the balanced rows of the others and its own rows as they are; and the same of all rows (without own ones).
    ``train`` has the scaled inputs; the weight of a positive is negatives / positives of the rows before balancing."""
    one = train.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    weight = one["neg"] / max(one["pos"], 1)
    folded = learn.stratified_kfold(train.select(id_col, label, *INPUTS), label, id_col, k, seed).checkpoint()

    def balanced(rows: DataFrame) -> DataFrame:
        return _assembled(learn.smote(rows, INPUTS, label, id_col, seed=seed)).select(id_col, label, "features").checkpoint()

    def fold(f: int) -> Fold:
        fit = balanced(folded.where(F.col("fold") != f))
        return Fold(fit, fit.count(), _assembled(folded.where(F.col("fold") == f)).select(id_col, label, "features").checkpoint(), weight)
    whole = balanced(folded)
    return [fold(f) for f in range(k)], Fold(whole, whole.count(), whole.limit(0), weight)


def _areas(scored: list[tuple]) -> list[float]:
    """ROC-AUC of each (model, held-out rows, name, label), in one pass over all of them."""
    parts = [ClassOne([f"_{name}_vector"], ["probability"]).transform(model.transform(held)).select(F.lit(i).alias("fit"), F.col(label).alias("label"), "probability")
             for i, (model, held, name, label) in enumerate(scored)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = {r["fit"]: r["roc_auc"] for r in evaluate.roc_auc(every, "label", by="fit").collect()}
    return [float(found.get(i) or 0.0) for i in range(len(scored))]


def cross_validate(tried: list[tuple[str, dict]], folds: list[Fold], label: str = "Target", seed: int = 42) -> list[tuple[dict, list[float], list]]:
    """(point, ROC-AUC of every fold, fitted fold models) of each (name, point); all fits share one pool."""
    wanted = [(name, point, fold) for name, point in tried for fold in folds]
    models = fit_all(wanted, label, seed)
    areas = _areas([(model, fold.held, name, label) for model, (name, _, fold) in zip(models, wanted)])
    k = len(folds)
    return [(p, areas[i * k:(i + 1) * k], models[i * k:(i + 1) * k]) for i, (_, p) in enumerate(tried)]


def _mean_std(aucs: list[float]) -> tuple[float, float]:
    mean = sum(aucs) / len(aucs)
    return mean, (sum((a - mean) ** 2 for a in aucs) / len(aucs)) ** 0.5


def search(names: list[str], folds: list[Fold], grids: dict = GRIDS, n_iter: int | dict = 5, label: str = "Target", seed: int = 42,
           fixed: dict | None = None) -> dict[str, list]:
    """Seeded random search over each name's grid: its points with fold areas and models, best first (ties: the earlier draw).
    ``fixed`` names further models with the one point that each is cross-validated at, beside the search."""
    tried = [(name, p) for name in names for p in draws(grids[name], n_iter[name] if isinstance(n_iter, dict) else n_iter, seed)]
    tried += list((fixed or {}).items())
    out: dict[str, list] = {}
    for (name, _), found in zip(tried, cross_validate(tried, folds, label, seed)):
        out.setdefault(name, []).append(found)
    return {name: sorted(found, key=lambda t: -_mean_std(t[1])[0]) for name, found in out.items()}


def search_table(spark, found: dict[str, list]) -> DataFrame:
    """model, place (1 is best), params (JSON), cv_roc_auc_mean and cv_roc_auc_std of every point tried."""
    import json
    rows = [(name, i + 1, json.dumps(p), *_mean_std(aucs)) for name, tried in found.items() for i, (p, aucs, _) in enumerate(tried)]
    return spark.createDataFrame(rows, "model string, place int, params string, cv_roc_auc_mean double, cv_roc_auc_std double")


def _single(inputs, model) -> PipelineModel:
    final = model.copy({model.predictionCol: "prediction", model.probabilityCol: "probability", model.rawPredictionCol: "rawPrediction"})
    return PipelineModel([inputs, VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep"), final])


def train_models(train: DataFrame, test: DataFrame, params: DataFrame, grids: dict = GRIDS, n_iter: int | dict = 5, k: int = 3,
                 settings: dict = SETTINGS, label: str = "Target", id_col: str = "CustomerID", seed: int = 42) -> Trained:
    """Five models fitted on the balanced training rows, with hold-out metrics and fold areas. ``train`` and ``test`` hold the
    nine features and the label; ``params`` is the scaler fitted on the training rows. The stacked model's meta-learner is
    fitted on out-of-fold probabilities of real rows; its own folds leave each fold's probabilities out once."""
    spark, inputs = train.sparkSession, purchase_inputs(params)
    folds, whole = training_sets(inputs.transform(train), k, label, id_col, seed)
    found = search(list(grids), folds, grids, n_iter, label, seed, {n: settings[n] for n in ("logistic_regression", "svc", "gb")})
    best, found = {name: tried[0] for name, tried in found.items()}, {name: found[name] for name in grids}
    names = list(best)
    fitted = dict(zip(names, fit_all([(n, best[n][0], whole) for n in names], label, seed)))
    models = {n: _single(inputs, fitted[n]) for n in ORDER if n in fitted}
    areas = {n: best[n][1] for n in models}

    shares = ClassOne([f"_{n}_vector" for n in STACKED], [f"_{n}_share" for n in STACKED])
    gather = VectorAssembler(inputCols=shares.getOrDefault(shares.outputs), outputCol="shares", handleInvalid="keep")
    parts = [gather.transform(PipelineModel([*(best[n][2][f] for n in STACKED), shares]).transform(fold.held)).select(label, "shares", F.lit(f).alias("fold"))
             for f, fold in enumerate(folds)]
    beyond = parts[0]
    for part in parts[1:]:
        beyond = beyond.unionByName(part)
    beyond = beyond.checkpoint()

    def meta(rows: DataFrame):
        return estimator("meta", settings["meta"], rows.count(), label, "shares").fit(rows)
    tops = learn.run_parallel([(lambda f=f: meta(beyond.where(F.col("fold") != f))) for f in range(k)])
    areas["stacking_ensemble"] = _areas([(m, beyond.where(F.col("fold") == f), "meta", label) for f, m in enumerate(tops)])
    top = meta(beyond)
    top = top.copy({top.predictionCol: "prediction", top.probabilityCol: "probability", top.rawPredictionCol: "rawPrediction"})
    models["stacking_ensemble"] = PipelineModel([inputs, VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep"),
                                                 *(fitted[n] for n in STACKED), shares, gather, top])
    held = test.checkpoint()
    rows = {}
    for name in ORDER:
        mean, std = _mean_std(areas[name])
        rows[name] = evaluate.evaluate(predict(models[name], held), label) \
            .withColumn("cv_roc_auc_mean", F.lit(mean)).withColumn("cv_roc_auc_std", F.lit(std))
    metrics = evaluate.metrics_table(rows).checkpoint()
    return Trained({n: models[n] for n in ORDER}, metrics, search_table(spark, found), {n: b[0] for n, b in best.items()})

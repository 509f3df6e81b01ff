"""The retraining run from raw transactions to a promoted model, resumable after a crash.

Each phase writes one table under ``<out_dir>/run=<id>/<no>_<phase>`` and then its line of the manifest (status and row
count) beside it. A phase whose line is there is read back, one without it is done (again), whatever a dead run left in its
folder. The run's id comes from the rows and parameters, so other input never resumes this run. Models go through the store
``<out_dir>/store``, which all runs of a folder share; a run publishes once, recognised by the time that its gate wrote down.

Defined results: a failed phase raises with its name and leaves the manifest as it was; equal rows in another order are the
same input; a rejected candidate is listed in the registry, inactive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmspark.operators import clean, drift, evaluate, features, learn, segment, training
from rfmspark.operators.model_store import ConstantScorer, ModelStore, linear_pipeline
from rfmspark.schemas import FEATURES, MODEL_FEATURES
from rfmspark.sources.tables import path_exists

PHASES = ["raw_subset", "clean", "features", "segments", "supervised", "train", "gate", "registry", "drift"]
MANIFEST = "phase_no int, phase string, status string, rows long"


def run_id(raw: DataFrame, *parameters) -> str:
    """Name of the run over these rows, in any order, with these parameters (one aggregate)."""
    cols = sorted(raw.columns)
    got = raw.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[f"`{c}`" for c in cols]).cast("decimal(38,0)")).alias("h"))
    return got.select(F.sha2(F.concat_ws("|", "n", "h", *[F.lit(str(p)) for p in (*cols, *parameters)]), 256).alias("id")).first()["id"][:16]


class Manifest:
    """Tables of a run's phases, each finished when its manifest line is written."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def _line(self, name: str) -> str:
        return f"{self.root}/manifest/{PHASES.index(name) + 1}_{name}"

    def finished(self, name: str) -> bool:
        return path_exists(self.spark, f"{self._line(name)}/_SUCCESS")

    def phase(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The phase's table, made now unless it is finished."""
        no = PHASES.index(name) + 1
        path = f"{self.root}/{no}_{name}"
        if not self.finished(name):
            try:
                make().write.mode("overwrite").parquet(path)
                rows = self.spark.read.parquet(path).count()
                self.spark.createDataFrame([(no, name, "completed", rows)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._line(name))
            except Exception as e:
                raise RuntimeError(f"retraining stopped in phase {no} ({name})") from e
        return self.spark.read.parquet(path)

    def status(self) -> DataFrame:
        done = [self._line(n) for n in PHASES if self.finished(n)]
        return self.spark.read.schema(MANIFEST).parquet(*done) if done else self.spark.createDataFrame([], MANIFEST)


def searched_training(split: DataFrame) -> tuple[dict[str, PipelineModel], DataFrame]:
    """The five searched models (``training.train_models``) and their metrics."""
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    made = training.train_models(train, test, features.fit_scaler(learn.with_model_features(train), MODEL_FEATURES))
    return made.models, made.metrics


def linear_training(split: DataFrame) -> tuple[dict[str, PipelineModel], DataFrame]:
    """The closed-form class-mean scorer and the majority baseline."""
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    scored, params, weights = learn.holdout_scores(split)
    share = float(train.agg(F.avg("Target")).first()[0])
    base = evaluate.evaluate(learn.majority_baseline(train, test)).withColumn("cv_roc_auc_mean", F.lit(0.5)).withColumn("cv_roc_auc_std", F.lit(0.0))
    return ({"class_mean_linear": linear_pipeline(params, weights), "baseline_majority": PipelineModel([ConstantScorer(share)])},
            evaluate.metrics_table({"class_mean_linear": evaluate.evaluate(scored), "baseline_majority": base}))


def retrain_pipeline(raw: DataFrame, out_dir: str, country: str | None = None, feature_months: int = 9,
                     train: Callable = searched_training, judged: str = "stacking_ensemble",
                     segmenter: Callable = segment.seeded_segments) -> DataFrame:
    """Run, or finish, the phases over ``raw`` (T1); returns the manifest (phase_no, phase, status, rows). ``train`` gives
    models and metrics from the flagged split, ``judged`` is the model whose area the gate holds against the active one."""
    spark, out_dir = raw.sparkSession, out_dir.rstrip("/")
    root = f"{out_dir}/run={run_id(raw, country, feature_months, train.__name__, judged, segmenter.__name__)}"
    run, store = Manifest(spark, root), ModelStore(spark, f"{out_dir}/store")
    subset = run.phase("raw_subset", lambda: raw.select("CustomerID", "InvoiceNo", "InvoiceDate"))
    cleaned = run.phase("clean", lambda: clean.clean_transactions(raw, country))
    scaled = run.phase("features", lambda: features.standard_scale(features.add_log_features(features.rfm_features(cleaned, subset)), MODEL_FEATURES)[0])
    run.phase("segments", lambda: segmenter(scaled))
    split = run.phase("supervised", lambda: learn.stratified_split(learn.supervised_dataset(cleaned, subset, feature_months)))

    def fit() -> DataFrame:
        models, metrics = train(split)
        for name, model in models.items():
            model.write().overwrite().save(f"{root}/candidates/{name}")
        return metrics
    metrics = run.phase("train", fit)

    def judge() -> DataFrame:
        active = evaluate.active_models(store.registry()).select(F.col("model_name").alias("model"), "roc_auc")
        return evaluate.model_gate(metrics, active, model=judged).withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
    gate = run.phase("gate", judge).first()

    def publish() -> DataFrame:
        mine = F.col("timestamp") == F.lit(gate["ts"])
        if store.registry().where(mine).isEmpty():  # else a dead run published before it could write its line
            names = [r["model"] for r in metrics.select("model").collect()]
            store.publish({n: PipelineModel.load(f"{root}/candidates/{n}") for n in names}, metrics, gate["accepted"], gate["ts"])
        return store.registry().where(mine)
    run.phase("registry", publish)
    run.phase("drift", lambda: drift.drift_report(split, scaled, FEATURES))
    return run.status()

"""Versioned model store: fitted pipelines as Spark ML folders, the model registry (T9) as their manifest.

A model is one ``PipelineModel`` from the nine feature columns to probability and prediction, so a
stored folder holds all that scoring needs (logs, training scaler, classifier). Folders are written
once and never changed. The registry is a small table (one row per model and training run) kept as
numbered states; a state is one file, put in place by the write's commit after the folders of its
models, so a reader sees either the old state or the new one, and a run that died in between leaves
no row and can be repeated. Paths in the registry are relative to the store's folder.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_log1p, fn_sigmoid
from rfmspark.schemas import LOG_FEATURES, MODEL_FEATURES, T9_MODEL_METADATA

INPUTS = [f"_m_{c}" for c in MODEL_FEATURES]
REJECTED = "HEALTH_CHECK_FAILED"


class _Stored(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters given by name and kept with the stage's folder."""

    def _given(self, **values):
        return self._set(**{k: v for k, v in values.items() if v is not None})


class PurchaseInputs(Transformer, _Stored):
    """Nine feature columns -> model features scaled with the training rows' constants (columns ``_m_...``)."""

    means = Param(Params._dummy(), "means", "mean of every model feature", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisor of every model feature", TypeConverters.toListFloat)

    def __init__(self, means: list[float] | None = None, scales: list[float] | None = None):
        super().__init__()
        self._given(means=means, scales=scales)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, name, mean, scale in zip(MODEL_FEATURES, INPUTS, self.getOrDefault(self.means), self.getOrDefault(self.scales)):
            base = c.removesuffix("_log")
            x = fn_log1p(base) if base in LOG_FEATURES else F.col(c).cast("double")
            cols[name] = (x - F.lit(mean)) / F.lit(scale)
        return df.withColumns(cols)


class LinearScorer(Model, _Stored):
    """margin = intercept + sum of weight times input, probability by the logistic function."""

    weights = Param(Params._dummy(), "weights", "weight of every input", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "margin at zero", TypeConverters.toFloat)

    def __init__(self, weights: list[float] | None = None, intercept: float | None = None):
        super().__init__()
        self._given(weights=weights, intercept=intercept)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.getOrDefault(self.intercept))
        for w, name in zip(self.getOrDefault(self.weights), INPUTS):
            z = z + F.lit(w) * F.col(name)
        return df.withColumn("margin", z).withColumn("probability", fn_sigmoid(F.col("margin"))) \
            .withColumn("prediction", (F.col("margin") > 0).cast("double"))


class ConstantScorer(Model, _Stored):
    """The majority baseline: the training share of class 1, and the more frequent class."""

    share = Param(Params._dummy(), "share", "training share of class 1", TypeConverters.toFloat)

    def __init__(self, share: float | None = None):
        super().__init__()
        self._given(share=share)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.getOrDefault(self.share)
        return df.withColumn("probability", F.lit(p)).withColumn("prediction", F.lit(float(p > 0.5)))


class ClassOne(Transformer, _Stored):
    """Probability vectors of several classifiers -> columns with the probability of class 1."""

    vectors = Param(Params._dummy(), "vectors", "probability vector columns", TypeConverters.toListString)
    outputs = Param(Params._dummy(), "outputs", "their columns of class 1", TypeConverters.toListString)

    def __init__(self, vectors: list[str] | None = None, outputs: list[str] | None = None):
        super().__init__()
        self._given(vectors=vectors, outputs=outputs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        return df.withColumns({o: vector_to_array(v)[1] for v, o in zip(self.getOrDefault(self.vectors), self.getOrDefault(self.outputs))})


def purchase_inputs(params: DataFrame) -> PurchaseInputs:
    """From a fitted scaler table (feature, mean, scale): one row per feature."""
    by = {r["feature"]: r for r in params.collect()}
    return PurchaseInputs([float(by[c]["mean"]) for c in MODEL_FEATURES], [float(by[c]["scale"]) for c in MODEL_FEATURES])


def linear_pipeline(params: DataFrame, weights: DataFrame) -> PipelineModel:
    """The class-mean scorer with its scaler."""
    by = {r["feature"]: float(r["weight"]) for r in weights.collect()}
    return PipelineModel([purchase_inputs(params), LinearScorer([by[c] for c in MODEL_FEATURES], by["__intercept__"])])


def predict(model: PipelineModel, df: DataFrame, prob: str = "probability", pred: str = "prediction") -> DataFrame:
    """``df`` with the model's probability of class 1 and its label; columns in between are dropped."""
    from pyspark.ml.functions import vector_to_array
    own = df.select(F.struct("*").alias("_row"), "*")  # the input's columns, whatever the stages add
    out = model.transform(own)
    p = vector_to_array("probability")[1] if out.schema["probability"].dataType.typeName() != "double" else F.col("probability")
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in (prob, pred)]
    return out.select(*kept, p.alias(prob), F.col("prediction").cast("int").alias(pred))


_LOADED: dict[tuple[str, str], PipelineModel] = {}


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, filepath: str) -> str:
        return f"{self.root}/{filepath}"

    def save(self, model: PipelineModel, filepath: str) -> str:
        model.write().overwrite().save(self.path(filepath))
        return filepath

    def load(self, filepath: str) -> PipelineModel:
        """The stored model; folders don't change, so each is read once per application."""
        key = (self.spark.sparkContext.applicationId, self.path(filepath))
        if key not in _LOADED:
            _LOADED[key] = PipelineModel.load(self.path(filepath))
        return _LOADED[key]

    def _last_state(self) -> int:
        """Number of the newest complete state; 0 before the first."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.root}/registry")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        names = [s.getPath() for s in fs.listStatus(folder)]
        done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("state=") and fs.exists(hadoop.Path(p, "_SUCCESS"))]
        return max(done, default=0)

    def registry(self) -> DataFrame:
        """T9 as it stands."""
        last = self._last_state()
        if not last:
            return self.spark.createDataFrame([], T9_MODEL_METADATA)
        return self.spark.read.schema(T9_MODEL_METADATA).parquet(f"{self.root}/registry/state={last}")

    def commit(self, registry: DataFrame) -> DataFrame:
        """Make ``registry`` (T9) the next state."""
        registry.select(*T9_MODEL_METADATA.names).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/registry/state={self._last_state() + 1}")
        return self.registry()

    def publish(self, models: dict[str, PipelineModel], metrics: DataFrame, accepted: bool, ts) -> DataFrame:
        """The next state with one row per candidate (``metrics``: model and its metrics): accepted ones are stored, then
        active instead of all others; rejected ones are listed inactive and not stored."""
        from rfmspark.operators.evaluate import registry_promote
        if accepted:
            for name, model in models.items():
                self.save(model, f"models/{name}_{ts:%Y%m%d_%H%M%S}.pkl")
        return self.commit(registry_promote(self.registry(), metrics.where(F.col("model").isin(list(models))), accepted, ts))

    def active(self, name: str | None = None):
        """Registry row of the newest active model (of that name); an error if there is none."""
        rows = self.registry().where("is_active = 1")
        rows = rows.where(F.col("model_name") == name) if name else rows
        row = rows.orderBy(F.desc("id")).first()
        if row is None:
            raise LookupError(f"no active model {name or ''} in {self.root}")
        return row

    def active_model(self, name: str | None = None) -> PipelineModel:
        return self.load(self.active(name)["filepath"])


class Resampled(Estimator):
    """Fits ``estimator`` on the rows that ``smote`` balances. Whoever fits it (a cross-validator, a stacking run) passes
    training rows only, so no synthetic row comes from, or goes into, the rows that it is judged on."""

    def __init__(self, estimator: Estimator, cols: list[str], label: str = "Target", id_col: str = "CustomerID", k: int = 5, seed: int = 42):
        super().__init__()
        self.estimator, self.cols, self.label, self.id_col, self.k, self.seed = estimator, cols, label, id_col, k, seed

    def copy(self, extra=None):
        return Resampled(self.estimator.copy(extra), self.cols, self.label, self.id_col, self.k, self.seed)

    def _fit(self, df: DataFrame):
        from rfmspark.operators.learn import assemble, smote
        return self.estimator.fit(assemble(smote(df, self.cols, self.label, self.id_col, self.k, self.seed), self.cols))

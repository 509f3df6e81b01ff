"""Supervised dataset, splits and learners.

The dataset is relational (two aggregates and a semi-join over the cleaned
transactions). Learners are Spark ML estimators on an assembled vector column;
the closed-form class-mean scorer is the one model whose scores SQL can
reproduce exactly, so it backs the oracle-checked scoring and metric queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_log1p, fn_sigmoid, fn_split_date
from rfmspark.operators import features as feat
from rfmspark.operators.stats import values_at_ranks
from rfmspark.schemas import FEATURES, LOG_FEATURES, MODEL_FEATURES

# --------------------------------------------------------------------------- dataset


def split_date(tx: DataFrame, feature_months: int) -> DataFrame:
    return tx.agg(fn_split_date(F.min("InvoiceDate"), feature_months).alias("split"))


def split_date_value(tx: DataFrame, feature_months: int):
    """The split timestamp as a Python value (one scalar), so later filters are literals."""
    return split_date(tx, feature_months).first()["split"]


def target_label(feats: DataFrame, target_rows: DataFrame, label: str = "Target") -> DataFrame:
    buyers = target_rows.select("CustomerID").distinct().withColumn("_buyer", F.lit(1))
    return feats.join(buyers, "CustomerID", "left").withColumn(
        label, F.when(F.col("_buyer").isNotNull(), 1).otherwise(0)).drop("_buyer")


def semi_join_target(feats: DataFrame, target_rows: DataFrame, anti: bool = False) -> DataFrame:
    """Customers who buy again in the target period (or, with ``anti``, who do not)."""
    return feats.join(target_rows.select("CustomerID"), "CustomerID", "left_anti" if anti else "left_semi")


def supervised_dataset(tx: DataFrame, raw: DataFrame, feature_months: int = 9) -> DataFrame:
    """T6: F9 over the first ``feature_months`` (Recency against the split date,
    ReturnRate from raw rows before it) and Target = buys again on/after the split."""
    split = split_date_value(tx, feature_months)
    before = tx.where(F.col("InvoiceDate") < F.lit(split))
    after = tx.where(F.col("InvoiceDate") >= F.lit(split))
    f = feat.rfm_features(before, raw, as_of=F.lit(split), raw_before=F.lit(split))
    return target_label(f, after).select("CustomerID", *FEATURES, "Target")


def with_model_features(df: DataFrame) -> DataFrame:
    for c in LOG_FEATURES:
        df = df.withColumn(f"{c}_log", fn_log1p(c))
    return df


# --------------------------------------------------------------------------- splits

def key_hash(id_col: str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order for ids of any kind: the first 13 hex digits of the MD5 of
    id and seed, 52 bits that a double holds exactly."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "Target", id_col: str = "CustomerID", test: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact per-class hold-out: in each class the round(test·n) rows with the smallest
    key hash are the test rows. Adds ``is_test``. The per-class cut is found by
    distributed rank selection (no class is sorted in one task)."""
    d = df.withColumn("_h", key_hash(id_col, seed))
    cut = values_at_ranks(d, "_h", [(test, lambda n: F.floor(n * F.lit(test) + F.lit(0.5)) - 1)], [label])
    cut = cut.select(label, F.col("value").alias("_cut"), F.col("n").alias("_n"))
    d = d.join(F.broadcast(cut), label, "left")  # one row per class
    n_test = F.floor(F.col("_n") * F.lit(test) + F.lit(0.5))
    return d.withColumn("is_test", (n_test > 0) & (F.col("_h") <= F.col("_cut"))).drop("_h", "_cut", "_n")


def stratified_kfold(df: DataFrame, label: str = "Target", id_col: str = "CustomerID", k: int = 3,
                     seed: int = 42) -> DataFrame:
    """Fold id 0..k-1, balanced per class: position of the key hash within its class
    modulo k. Positions come from ranks of a permutation, computed without a global sort."""
    from rfmspark.operators.stats import cumulative_by_order
    d = df.withColumn("_h", key_hash(id_col, seed)).withColumn("_one", F.lit(1).cast("bigint"))
    c = cumulative_by_order(d, "_h", ["_one"], group_cols=[label])
    return c.withColumn("fold", F.pmod(F.col("cum__one") - 1, F.lit(k)).cast("int")).drop("_h", "_one", "cum__one")


def save_model(model, path: str) -> str:
    """Write a fitted Spark ML model of any kind."""
    model.write().overwrite().save(path)
    return path


def load_model(spark, path: str):
    """The model that ``save_model`` wrote, whatever its class."""
    from pyspark.ml.util import DefaultParamsReader
    return DefaultParamsReader.loadParamsInstance(path, spark)


def class_weight(df: DataFrame, label: str = "Target", out: str = "weight") -> DataFrame:
    """Weight positives by negatives/positives (scale_pos_weight), negatives 1."""
    w = feat.scale_pos_weight(df, label)
    return df.crossJoin(F.broadcast(w)).withColumn(
        out, F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))).drop("scale_pos_weight")


# --------------------------------------------------------------------------- closed-form scorer

def fit_class_mean_scorer(train_scaled: DataFrame, cols: list[str], label: str = "Target") -> DataFrame:
    """Linear scorer from class means of scaled features: w = mu1 - mu0,
    b = -w·(mu1 + mu0)/2. One row per feature (feature, position, weight) plus the
    intercept under feature '__intercept__'."""
    mu = train_scaled.groupBy().agg(*[x for c in cols for x in (
        F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"_p_{c}"),
        F.avg(F.when(F.col(label) == 0, F.col(c))).alias(f"_n_{c}"))])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                     (F.col(f"_p_{c}") - F.col(f"_n_{c}")).alias("weight")) for i, c in enumerate(cols)]
    b = None
    for c in cols:
        t = (F.col(f"_p_{c}") - F.col(f"_n_{c}")) * (F.col(f"_p_{c}") + F.col(f"_n_{c}"))
        b = t if b is None else b + t
    rows.append(F.struct(F.lit("__intercept__").alias("feature"), F.lit(len(cols)).alias("position"),
                         (-b / F.lit(2.0)).alias("weight")))
    return mu.select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def apply_linear_scorer(df: DataFrame, weights: DataFrame, cols: list[str], prob: str = "probability",
                        pred: str = "prediction", margin: str = "margin") -> DataFrame:
    """margin = b + sum w_i x_i (in column order), probability = sigmoid, prediction = margin > 0."""
    wide = weights.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("weight"))).alias(f"_w_{c}")
                                   for c in cols + ["__intercept__"]])
    out = df.crossJoin(F.broadcast(wide))
    z = F.col("_w___intercept__")
    for c in cols:
        z = z + F.col(f"_w_{c}") * F.col(c)
    out = out.withColumn(margin, z).withColumn(prob, fn_sigmoid(F.col(margin))).withColumn(
        pred, (F.col(margin) > 0).cast("int"))
    return out.drop(*[f"_w_{c}" for c in cols + ["__intercept__"]])


def holdout_scores(sup: DataFrame, feature_cols: list[str] | None = None, label: str = "Target"):
    """Split -> train-only scaler -> class-mean scorer -> scored test rows
    (CustomerID, Target, margin, probability, prediction) and the fitted pieces. Rows
    that already carry ``is_test`` (a stored ``stratified_split``) are not split again."""
    cols = feature_cols or MODEL_FEATURES
    d = with_model_features(sup)
    if "is_test" not in sup.columns:
        d = stratified_split(d, label)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    params = feat.fit_scaler(train, cols)
    tr = feat.apply_scaler(train, params, cols, replace=True)
    te = feat.apply_scaler(test, params, cols, replace=True)
    w = fit_class_mean_scorer(tr, cols, label)
    return apply_linear_scorer(te, w, cols), params, w


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "Target") -> DataFrame:
    """Predict the most frequent training class (ties -> the smaller label) with
    probability = its training share for class 1 as the score."""
    stats = train.groupBy().agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    stats = stats.select((F.col("_pos") * 2 > F.col("_n")).cast("int").alias("_maj"),
                         (F.col("_pos") / F.col("_n")).alias("_p1"))
    return test.crossJoin(F.broadcast(stats)).withColumn("prediction", F.col("_maj")).withColumn(
        "probability", F.col("_p1")).drop("_maj", "_p1")


# --------------------------------------------------------------------------- Spark ML learners

def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def logreg(train: DataFrame, cols: list[str], label: str = "Target", C: float = 1.0, max_iter: int = 1000,
           weight_col: str | None = None):
    """L2 logistic regression with the inverse-strength convention C: regParam = 1/(C·n),
    no internal standardisation (inputs are already scaled)."""
    from pyspark.ml.classification import LogisticRegression
    n = train.count()
    est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1.0 / (C * max(n, 1)),
                             elasticNetParam=0.0, standardization=False)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est.fit(assemble(train, cols))


def random_forest(train: DataFrame, cols: list[str], label: str = "Target", n_trees: int = 100, max_depth: int = 10,
                  min_instances: int = 1, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees, maxDepth=max_depth,
                                  minInstancesPerNode=min_instances, seed=seed).fit(assemble(train, cols))


def gbt(train: DataFrame, cols: list[str], label: str = "Target", max_iter: int = 150, max_depth: int = 3,
        step: float = 0.05, seed: int = 42, weight_col: str | None = None):
    from pyspark.ml.classification import GBTClassifier
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        seed=seed)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est.fit(assemble(train, cols))


def score_model(model, df: DataFrame, cols: list[str], prob: str = "probability", pred: str = "prediction") -> DataFrame:
    """Apply a fitted Spark ML classifier: probability of class 1 and the label."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(assemble(df, cols))
    return out.withColumn("_p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "features") \
        .withColumn(pred, F.col("prediction").cast("int")).withColumnRenamed("_p", prob)


def feature_importance(model, cols: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = sorted(zip(cols, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# --------------------------------------------------------------------------- cross-validation (search and stacking: training.py)

def _auc(scored: DataFrame, label: str = "Target") -> float:
    """Exact ROC-AUC of a fold (Spark's evaluator, unbinned; ties averaged)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    return float(BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label,
                                               metricName="areaUnderROC", numBins=0)
                 .evaluate(scored.withColumn(label, F.col(label).cast("double"))))


FIT_PARALLELISM = 4  # independent model fits submitted at once (like CrossValidator's ``parallelism``)


def run_parallel(tasks, parallelism: int = FIT_PARALLELISM) -> list:
    """Run independent Spark jobs (model fits) from a small thread pool, results in
    task order. Each task is its own distributed job; the pool only keeps the cluster
    busy while a fit's stages are short (as Spark ML's CrossValidator does)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession
    tasks = list(tasks)
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())  # local properties and job tags
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        return list(pool.map(lambda t: inherit(t)(), tasks))


def cv_fold_aucs(train: DataFrame, fit, cols: list[str], k: int = 3, label: str = "Target",
                 parallelism: int = FIT_PARALLELISM) -> list[float]:
    """ROC-AUC of each of the k folds (folds balanced per class); the fold fits run in parallel."""
    folded = stratified_kfold(train, label, k=k).persist()

    def one(f):
        return lambda: _auc(score_model(fit(folded.where(F.col("fold") != f)), folded.where(F.col("fold") == f), cols),
                            label)
    aucs = run_parallel([one(f) for f in range(k)], parallelism)
    folded.unpersist()
    return aucs


def _mean_std(aucs: list[float]) -> tuple[float, float]:
    mean = sum(aucs) / len(aucs)
    return mean, (sum((a - mean) ** 2 for a in aucs) / len(aucs)) ** 0.5


def cv_score(train: DataFrame, fit, cols: list[str], k: int = 3, label: str = "Target") -> DataFrame:
    """k-fold ROC-AUC (folds balanced per class): one row (cv_roc_auc_mean, cv_roc_auc_std)
    with the population std, plus the per-fold values."""
    aucs = cv_fold_aucs(train, fit, cols, k, label)
    mean, std = _mean_std(aucs)
    return train.sparkSession.createDataFrame(
        [(mean, std, aucs)], "cv_roc_auc_mean double, cv_roc_auc_std double, fold_auc array<double>")


# --------------------------------------------------------------------------- SMOTE

def smote(train: DataFrame, cols: list[str], label: str = "Target", id_col: str = "CustomerID", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Oversample the minority class to parity: each synthetic row lies on the segment
    between a minority row and one of its k nearest minority neighbours (exact kNN,
    blocked). Rows per seed point are spread evenly; neighbour choice and position
    come from a hash of (id, sample, seed), so reruns give the same rows."""
    from rfmspark.operators.neighbors import knn
    from rfmspark.operators.stats import cumulative_by_order
    counts = {r_[label]: r_["n"] for r_ in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return train.select(id_col, *cols, label)
    minority = min(counts, key=lambda v: (counts[v], v))
    need = max(counts.values()) - counts[minority]
    n_min = counts[minority]
    if need == 0 or n_min < 2:
        return train.select(id_col, *cols, label)
    mino = train.where(F.col(label) == F.lit(minority)).select(F.col(id_col).cast("string").alias(id_col), *cols)
    kk = min(k, n_min - 1)
    nb = knn(mino, id_col, cols, kk + 1).select(id_col, F.slice("neighbors", 2, kk).alias("nb"))  # drop self
    base, extra = divmod(need, n_min)
    ordered = cumulative_by_order(mino.withColumn("_h", key_hash(id_col, seed)).withColumn("_one", F.lit(1).cast("bigint")),
                                  "_h", ["_one"])
    reps = ordered.withColumn("_reps", F.lit(base) + F.when(F.col("cum__one") <= extra, 1).otherwise(0)) \
        .where(F.col("_reps") > 0).join(nb, id_col)
    ex = reps.select(id_col, *cols, "nb", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)).alias("_s"))
    hj = F.xxhash64(F.col(id_col), F.col("_s"), F.lit(seed))
    ex = ex.withColumn("_nid", F.element_at("nb", (F.pmod(hj, F.size("nb")) + 1).cast("int"))["i"]) \
        .withColumn("_u", F.pmod(F.xxhash64(F.col(id_col), F.col("_s"), F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30))
    partner = mino.select(F.col(id_col).alias("_nid"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    syn = ex.join(partner, "_nid").select(
        F.concat(F.col(id_col), F.lit("_smote_"), F.col("_s").cast("string")).alias(id_col),
        *[(F.col(c) + F.col("_u") * (F.col(f"_p_{c}") - F.col(c))).alias(c) for c in cols],
        F.lit(minority).alias(label))
    return train.select(F.col(id_col).cast("string").alias(id_col), *cols, label).unionByName(syn)

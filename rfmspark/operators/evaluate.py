"""Classifier evaluation and the model registry.

Metrics are conditional sums in one aggregate. ROC/PR curves need running sums in
score order; they run through :func:`cumulative_by_order` over the distinct
scores, so no single task ever sorts the whole scored set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_title_case
from rfmspark.operators.stats import cumulative_by_order
from rfmspark.schemas import GATE_MIN_AUC, GATE_NEW_DEFAULT, GATE_OLD_DEFAULT, GATE_TOLERANCE, METRIC_NAMES


def confusion_matrix(scored: DataFrame, label: str = "Target", pred: str = "prediction") -> DataFrame:
    """All four cells (actual, predicted, count), zeros included."""
    c = scored.agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias(f"c{a}{p}")
                     for a in (0, 1) for p in (0, 1)])
    return c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                                 F.col(f"c{a}{p}").alias("count"))
                                        for a in (0, 1) for p in (0, 1)])).alias("x")).select("x.*")


def classification_metrics(scored: DataFrame, label: str = "Target", pred: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, f1_score, mcc (undefined ratios -> 0) plus the cells."""
    y, p = F.col(label), F.col(pred)
    c = scored.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                   F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)
    return c.select("tp", "fp", "fn", "tn", ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1_score"), mcc.alias("mcc"))


def _score_counts(scored: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    return scored.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("pos"), F.count_if(F.col(label) != 1).cast("bigint").alias("neg"))


def roc_curve(scored: DataFrame, label: str = "Target", score: str = "probability") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest threshold first in meaning
    (order by threshold desc to read it)."""
    c = cumulative_by_order(_score_counts(scored, label, score), "threshold", ["pos", "neg"], descending=True)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return c.crossJoin(F.broadcast(tot)).select(
        "threshold", F.coalesce(F.try_divide(F.col("cum_neg").cast("double"), F.col("N")), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), F.col("P")), F.lit(0.0)).alias("tpr"))


def roc_auc(scored: DataFrame, label: str = "Target", score: str = "probability", by: str | None = None) -> DataFrame:
    """Area under ROC with tied scores averaged (Mann-Whitney rank sum); a row for each value of ``by``, if given."""
    g = (by,) if by else ()
    c = cumulative_by_order(_score_counts(scored, label, score, g), "threshold", ["neg"], list(g), descending=False)
    # positives at a score beat the negatives strictly below and tie half of those equal
    contrib = F.col("pos") * (F.col("cum_neg") - F.col("neg")) + F.col("pos") * F.col("neg") * 0.5
    return c.groupBy(*g).agg(F.try_divide(F.sum(contrib.cast("double")), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def pr_curve(scored: DataFrame, label: str = "Target", score: str = "probability") -> DataFrame:
    """(threshold, precision, recall) for thresholds down to the first one reaching full
    recall, plus the closing point (recall 0, precision 1) with a NULL threshold."""
    c = cumulative_by_order(_score_counts(scored, label, score), "threshold", ["pos", "neg"], descending=True)
    tot = c.agg(F.sum("pos").alias("P"))
    c = c.crossJoin(F.broadcast(tot))
    full = c.where(F.col("cum_pos") == F.col("P")).agg(F.max("threshold").alias("_tmin"))
    c = c.crossJoin(F.broadcast(full)).where(F.col("threshold") >= F.col("_tmin"))
    pts = c.select("threshold", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                   F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), F.col("P")), F.lit(0.0)).alias("recall"))
    close = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                                F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(close)


def pr_auc(scored: DataFrame, label: str = "Target", score: str = "probability") -> DataFrame:
    """Trapezoid area under the PR curve closed at (recall 0, precision 1). The previous
    curve point of each threshold is its running sums minus its own counts, so every
    trapezoid is computed row-locally (no ordering window over the thresholds)."""
    c = cumulative_by_order(_score_counts(scored, label, score), "threshold", ["pos", "neg"], descending=True)
    tot = c.agg(F.sum("pos").alias("P"))
    c = c.crossJoin(F.broadcast(tot))
    full = c.where(F.col("cum_pos") == F.col("P")).agg(F.max("threshold").alias("_tmin"))
    c = c.crossJoin(F.broadcast(full)).where(F.col("threshold") >= F.col("_tmin"))
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    tp0, fp0 = (F.col("cum_pos") - F.col("pos")).cast("double"), (F.col("cum_neg") - F.col("neg")).cast("double")
    rec, rec0 = tp / F.col("P"), tp0 / F.col("P")
    prec = tp / (tp + fp)
    prec0 = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    return c.agg(F.sum((rec - rec0) * (prec + prec0) / 2).alias("pr_auc"))


def curve_areas(scored: DataFrame, label: str = "Target", score: str = "probability") -> DataFrame:
    """One row (roc_auc, pr_auc) from a single running-sum pass in descending score
    order: the negatives strictly below a score are N minus the running negatives, so
    the Mann-Whitney sum needs no second (ascending) pass; the PR trapezoids are the
    rows from the first threshold that reaches full recall, as in ``pr_auc``."""
    c = cumulative_by_order(_score_counts(scored, label, score), "threshold", ["pos", "neg"], descending=True)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = c.crossJoin(F.broadcast(tot))
    full = c.where(F.col("cum_pos") == F.col("P")).agg(F.max("threshold").alias("_tmin"))
    c = c.crossJoin(F.broadcast(full))
    below = (F.col("N") - F.col("cum_neg")).cast("double")
    auc_term = (F.col("pos") * below + F.col("pos") * F.col("neg") * 0.5).cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    tp0, fp0 = (F.col("cum_pos") - F.col("pos")).cast("double"), (F.col("cum_neg") - F.col("neg")).cast("double")
    rec, rec0 = tp / F.col("P"), tp0 / F.col("P")
    prec = tp / (tp + fp)
    prec0 = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    pr_term = F.when(F.col("threshold") >= F.col("_tmin"), (rec - rec0) * (prec + prec0) / 2)
    return c.agg(F.try_divide(F.sum(auc_term), F.first("P").cast("double") * F.first("N")).alias("roc_auc"),
                 F.sum(pr_term).alias("pr_auc"))


def evaluate(scored: DataFrame, label: str = "Target", score: str = "probability", pred: str = "prediction") -> DataFrame:
    """One row with the published metric set (cv fields NULL: filled by cross-validation)."""
    m = classification_metrics(scored, label, pred)
    areas = curve_areas(scored, label, score)
    return m.crossJoin(areas).select(
        "accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "mcc",
        F.lit(None).cast("double").alias("cv_roc_auc_mean"), F.lit(None).cast("double").alias("cv_roc_auc_std"))


def model_leaderboard(metrics: DataFrame, order_col: str = "model_order") -> DataFrame:
    """Best model by CV ROC-AUC (or ROC-AUC where CV is missing/0); strict '>' so the
    first model in ``order_col`` wins ties. One row: model, score, reason."""
    s = F.coalesce(F.when(F.col("cv_roc_auc_mean") != 0, F.col("cv_roc_auc_mean")), F.col("roc_auc"), F.lit(0.0))
    best = metrics.withColumn("_s", s).agg(F.max_by(F.struct("model", "_s"), F.struct("_s", -F.col(order_col))).alias("b"))
    return best.select(F.col("b.model").alias("recommended_model"), F.col("b._s").alias("score"),
                       F.format_string("Model recommends '%s' due to highest 3-Fold Cross-Validation ROC-AUC of %.4f.",
                                       fn_title_case(F.col("b.model")), F.col("b._s")).alias("recommendation_reason"))


def best_per_metric(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "mcc"]
    return metrics.agg(*[F.max(n).alias(n) for n in names])


def model_gate(new: DataFrame, old: DataFrame, model: str = "stacking_ensemble", floor: float = GATE_MIN_AUC,
               tol: float = GATE_TOLERANCE) -> DataFrame:
    """Accept the candidate if its ROC-AUC >= floor and >= old - tol (missing old -> 0.5,
    missing new -> 0.0). One row: new_auc, old_auc, accepted, reasons."""
    n = new.where(F.col("model") == model).agg(F.max("roc_auc").alias("_n"))
    o = old.where(F.col("model") == model).agg(F.max("roc_auc").alias("_o"))
    j = n.crossJoin(o).select(F.coalesce("_n", F.lit(GATE_NEW_DEFAULT)).alias("new_auc"),
                              F.coalesce("_o", F.lit(GATE_OLD_DEFAULT)).alias("old_auc"))
    low = F.col("new_auc") < F.lit(floor)
    worse = F.col("new_auc") < F.col("old_auc") - F.lit(tol)
    reasons = F.filter(F.array(
        F.when(low, F.format_string(f"AUC too low: %.4f < {floor}", "new_auc")),
        F.when(worse, F.format_string("Deteriorated from benchmark: %.4f vs benchmark %.4f", "new_auc", "old_auc"))),
        lambda x: x.isNotNull())
    return j.select("new_auc", "old_auc", (~low & ~worse).alias("accepted"), F.array_join(reasons, ", ").alias("reasons"))


def registry_promote(registry: DataFrame, candidates: DataFrame, accepted: bool, ts, filepath_of=None) -> DataFrame:
    """New registry state (T9): on acceptance every active row is deactivated and the
    candidates are appended active; on rejection they are appended inactive with
    filepath HEALTH_CHECK_FAILED. ``candidates``: model + metric columns."""
    start = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    w = Window.orderBy("model")  # over the handful of candidate models
    path = (F.concat(F.lit("models/"), F.col("model"), F.lit("_"), F.date_format(F.lit(ts), "yyyyMMdd_HHmmss"), F.lit(".pkl"))
            if accepted else F.lit("HEALTH_CHECK_FAILED"))
    new_rows = candidates.crossJoin(F.broadcast(start)).select(
        (F.col("_base") + F.row_number().over(w)).cast("bigint").alias("id"), F.lit(ts).cast("timestamp_ntz").alias("timestamp"),
        F.col("model").alias("model_name"), path.alias("filepath"), "accuracy", "roc_auc", "f1_score", "mcc",
        F.lit(1 if accepted else 0).alias("is_active"))
    old = registry.withColumn("is_active", F.lit(0)) if accepted else registry
    return old.select(*new_rows.columns).unionByName(new_rows)


def active_models(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("is_active") == 1)


def metrics_table(named: dict) -> DataFrame:
    """Stack {model: one-row metrics DataFrame} into (model, model_order, metrics...)."""
    out = None
    for i, (name, df) in enumerate(named.items()):
        row = df.select(F.lit(name).alias("model"), F.lit(i).alias("model_order"), *METRIC_NAMES)
        out = row if out is None else out.unionByName(row)
    return out

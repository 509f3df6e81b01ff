"""Batch scoring, the prediction log and feature lookup.

Scoring is one narrow projection per row: log1p, the stored scalers and the
broadcast centroids / weights (all bounded by the number of features or
segments), so a scoring job never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_log1p, fn_round_half_up, fn_sigmoid
from rfmspark.operators.features import apply_scaler
from rfmspark.operators.segment import nearest_centroid
from rfmspark.schemas import FEATURES, LOG_FEATURE_COLUMNS, LOG_FEATURES, MODEL_FEATURES, MODEL_PREFIX, SCALED_FEATURES


def require_features(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Schema check before any action: name the missing feature columns."""
    missing = [c for c in (required or FEATURES) if c not in df.columns]
    if missing:
        raise ValueError(f"CSV file missing required feature columns: {missing}")
    return df


def linear_margin(weights: DataFrame, value_cols: list[str], names: list[str]) -> tuple[DataFrame, Column]:
    """One-row weight table (broadcast) and the margin expression b + sum w_i x_i."""
    wide = weights.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("weight"))).alias(f"_w_{c}")
                                   for c in names + ["__intercept__"]])
    z = F.col("_w___intercept__")
    for name, col in zip(names, value_cols):
        z = z + F.col(f"_w_{name}") * F.col(col)
    return wide, z


def with_segment(feats: DataFrame, seg_params: DataFrame, centroids: DataFrame) -> DataFrame:
    """Input rows with F9 -> + Predicted_Segment: the nearest centroid in the space that the centroids were built in."""
    d = require_features(feats)
    own = [f"_seg_{c}" for c in MODEL_FEATURES]
    d = d.withColumns({s: fn_log1p(c.removesuffix("_log")) if c.endswith("_log") else F.col(c) for s, c in zip(own, MODEL_FEATURES)})
    d = apply_scaler(d, seg_params.withColumn("feature", F.concat(F.lit("_seg_"), "feature")), own, replace=True)
    seg = nearest_centroid(d, centroids.select("Segment", *[F.col(s).alias(o) for s, o in zip(SCALED_FEATURES, own)]), own,
                           out="Predicted_Segment", dist_out=None)
    return seg.select(*feats.columns, "Predicted_Segment")


def score_stored(feats: DataFrame, seg_params: DataFrame, centroids: DataFrame, model) -> DataFrame:
    """``score_batch`` with a model of the store (a fitted pipeline that brings its own scaler)."""
    from rfmspark.operators.model_store import predict
    return predict(model, with_segment(feats, seg_params, centroids), "Purchase_Probability", "Predicted_Purchase_Label")


def score_batch(feats: DataFrame, seg_params: DataFrame, centroids: DataFrame, model_params: DataFrame,
                weights: DataFrame) -> DataFrame:
    """Input rows with F9 -> + Predicted_Segment (nearest centroid in the space the
    centroids were built in), Predicted_Purchase_Label, Purchase_Probability
    (class-mean linear scorer on its own training scaler)."""
    d = require_features(feats)
    for c in LOG_FEATURES:
        d = d.withColumn(f"_{c}_log", fn_log1p(c))
    src = {c: (f"_{c}" if c.endswith("_log") else c) for c in MODEL_FEATURES}
    # segmentation space: scaled with the scaler the centroids were made with
    seg_in = d.select("*", *[F.col(src[c]).alias(f"_seg_{c}") for c in MODEL_FEATURES])
    seg_in = apply_scaler(seg_in, seg_params.withColumn("feature", F.concat(F.lit("_seg_"), "feature")),
                          [f"_seg_{c}" for c in MODEL_FEATURES], replace=True)
    seg = nearest_centroid(seg_in, centroids.select("Segment", *[F.col(s).alias(f"_seg_{c}") for s, c in
                                                                 zip(SCALED_FEATURES, MODEL_FEATURES)]),
                           [f"_seg_{c}" for c in MODEL_FEATURES], out="Predicted_Segment", dist_out=None)
    # model space: scaled with the training scaler
    m_in = seg.select("*", *[F.col(src[c]).alias(f"_m_{c}") for c in MODEL_FEATURES])
    m_in = apply_scaler(m_in, model_params.withColumn("feature", F.concat(F.lit("_m_"), "feature")),
                        [f"_m_{c}" for c in MODEL_FEATURES], replace=True)
    wide, z = linear_margin(weights, [f"_m_{c}" for c in MODEL_FEATURES], MODEL_FEATURES)
    out = m_in.crossJoin(F.broadcast(wide)).withColumn("_z", z)
    out = out.withColumn("Purchase_Probability", fn_sigmoid(F.col("_z"))).withColumn(
        "Predicted_Purchase_Label", (F.col("_z") > 0).cast("int"))
    return out.select(*feats.columns, "Predicted_Segment", "Predicted_Purchase_Label", "Purchase_Probability")


def prediction_log_rows(scored: DataFrame, id_col: Column, ts: Column, fanout: bool = True) -> DataFrame:
    """Scored rows -> prediction-log rows (T7). With ``fanout`` the single model's
    label/probability fill every model column pair (as batch and stream logging do);
    without it only the ensemble pair is set and the others stay NULL."""
    cols = [id_col.cast("bigint").alias("id"), ts.cast("timestamp_ntz").alias("timestamp"),
            F.col("CustomerID").cast("string").alias("customer_id")]
    cols += [F.col(k).cast("double").alias(v) for k, v in LOG_FEATURE_COLUMNS.items()]
    cols.append(F.col("Predicted_Segment").alias("predicted_segment"))
    for name, p in MODEL_PREFIX.items():
        on = fanout or name == "stacking_ensemble"
        cols.append((F.col("Predicted_Purchase_Label") if on else F.lit(None)).cast("int").alias(f"{p}_pred"))
        cols.append((F.col("Purchase_Probability") if on else F.lit(None)).cast("double").alias(f"{p}_prob"))
    return scored.select(*cols)


def score_fanout(log: DataFrame, compat: bool = False) -> DataFrame:
    """Model columns of a log: only the ensemble's own pair unless ``compat``."""
    if compat:
        return log
    for name, p in MODEL_PREFIX.items():
        if name != "stacking_ensemble":
            log = log.withColumn(f"{p}_pred", F.lit(None).cast("int")).withColumn(f"{p}_prob", F.lit(None).cast("double"))
    return log


def latest_feature_lookup(ids: DataFrame, log: DataFrame, feature_table: DataFrame) -> DataFrame:
    """Per requested customer, the first source that has it: the newest prediction-log
    row (highest id), else the feature table. Unknown ids get source 'unknown'.
    Priority resolution is a max_by aggregate per customer (partial per partition)."""
    inv = {v: k for k, v in LOG_FEATURE_COLUMNS.items()}
    a = log.select(F.col("customer_id").alias("CustomerID"), F.lit(0).alias("_prio"), F.col("id").alias("_ord"),
                   *[F.col(c).alias(inv[c]) for c in LOG_FEATURE_COLUMNS.values()])
    b = feature_table.select("CustomerID", F.lit(1).alias("_prio"), F.lit(0).cast("bigint").alias("_ord"),
                             *[F.col(c).cast("double").alias(c) for c in FEATURES])
    cand = a.unionByName(b).join(ids.select("CustomerID").distinct(), "CustomerID", "left_semi")
    best = cand.groupBy("CustomerID").agg(F.max_by(F.struct(*FEATURES, "_prio"),
                                                   F.struct(-F.col("_prio"), F.col("_ord"))).alias("b"))
    res = best.select("CustomerID", F.when(F.col("b._prio") == 0, "log").otherwise("features").alias("source"),
                      *[F.col(f"b.{c}").alias(c) for c in FEATURES])
    unknown = ids.select("CustomerID").distinct().join(res, "CustomerID", "left_anti").select(
        "CustomerID", F.lit("unknown").alias("source"), *[F.lit(None).cast("double").alias(c) for c in FEATURES])
    return res.unionByName(unknown)


def what_if_order_value(df: DataFrame) -> DataFrame:
    """Recompute AvgOrderValue from (edited) Monetary and Frequency when Frequency > 0."""
    return df.withColumn("AvgOrderValue", F.when(F.col("Frequency") > 0,
                                                 fn_round_half_up(F.col("Monetary") / F.col("Frequency"), 2))
                         .otherwise(F.col("AvgOrderValue")))

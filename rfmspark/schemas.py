"""Table schemas (T1-T9) and fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# The nine per-customer features (F9), in their canonical order.
FEATURES = [
    "Recency", "Frequency", "Monetary", "AvgOrderValue", "UniqueProducts", "ReturnRate",
    "CustomerLifetimeDays", "PurchaseFrequencyMonthly", "AvgQuantityPerOrder",
]
# The three skewed features that are log1p-transformed.
LOG_FEATURES = ["Recency", "Frequency", "Monetary"]
# The nine model features (M9): F9 with the first three replaced by their logs.
MODEL_FEATURES = [
    "Recency_log", "Frequency_log", "Monetary_log", "AvgOrderValue", "UniqueProducts", "ReturnRate",
    "CustomerLifetimeDays", "PurchaseFrequencyMonthly", "AvgQuantityPerOrder",
]
SCALED_FEATURES = [f"{c}_scaled" for c in MODEL_FEATURES]

# Business segment labels and their ordinal (Lost 0 .. Champions 3).
SEGMENT_ORDER = {"Lost Customers": 0, "At-Risk": 1, "Loyal Customers": 2, "Champions": 3}
SEGMENTS = ["At-Risk", "Champions", "Lost Customers", "Loyal Customers"]  # alphabetical

# Recommended campaign per segment (constant text).
SEGMENT_ACTIONS = {
    "Champions": "VIP Reward Action: Offer early access, zero-shipping loyalty programs, and high-value brand advocacy items.",
    "Loyal Customers": "Growth Strategy: Cross-sell premium categories, trigger monthly email updates, and run referral perks.",
    "At-Risk": "Re-activation Campaign: Send a high-discount win-back offer ('We miss you, take 30% off') within 48 hours.",
    "Lost Customers": "Retention Save: Automated low-cost reactivation. Avoid high spend on acquisition channels.",
}

# Upload column synonyms: lower-cased name without '_' and ' ' -> canonical name.
COLUMN_SYNONYMS = {
    "customerid": "CustomerID", "invoiceid": "InvoiceNo", "invoiceno": "InvoiceNo",
    "stockcode": "StockCode", "description": "Description", "quantity": "Quantity", "qty": "Quantity",
    "invoicedate": "InvoiceDate", "date": "InvoiceDate", "unitprice": "UnitPrice", "price": "UnitPrice",
    "country": "Country",
}
# Constants for optional columns missing from an upload.
UPLOAD_DEFAULTS = {"StockCode": "85123A", "Description": "Added via Upload console", "Country": "United Kingdom"}
UPLOAD_REQUIRED = ["CustomerID", "InvoiceNo", "Quantity", "UnitPrice", "InvoiceDate"]

# PSI thresholds and drift statuses.
PSI_STABLE_BELOW = 0.1
PSI_MONITOR_UP_TO = 0.25
PSI_EPS = 1e-4
PSI_EDGE_PAD = 1e-5
STATUS_RANK = {"Stable": 0, "Monitor": 1, "Retrain Alert": 2}

# Model gate: minimum AUC and tolerated degradation against the active model.
GATE_MIN_AUC = 0.55
GATE_TOLERANCE = 0.05
GATE_OLD_DEFAULT = 0.5
GATE_NEW_DEFAULT = 0.0

# Model names in the registry and their prediction-log column prefixes.
MODEL_NAMES = ["logistic_regression", "random_forest", "xgboost", "lightgbm", "stacking_ensemble"]
MODEL_PREFIX = {"logistic_regression": "lr", "random_forest": "rf", "xgboost": "xgb",
                "lightgbm": "lgb", "stacking_ensemble": "stacking"}

# ---------------------------------------------------------------------------
# Schemas. Fixed values too: column names and types of the tables T1, T7 to T9, of the
# metrics and drift reports, and the names of the metrics.
# ---------------------------------------------------------------------------

T1_RAW = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])
RAW_COLUMNS = [f.name for f in T1_RAW.fields]

# Uploaded files arrive as text; types are coerced by the ingest job.
T1_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in T1_RAW.fields])

F9_TYPES = {
    "Recency": T.LongType(), "Frequency": T.LongType(), "Monetary": T.DoubleType(),
    "AvgOrderValue": T.DoubleType(), "UniqueProducts": T.LongType(), "ReturnRate": T.DoubleType(),
    "CustomerLifetimeDays": T.LongType(), "PurchaseFrequencyMonthly": T.DoubleType(),
    "AvgQuantityPerOrder": T.DoubleType(),
}
# Features as supplied for scoring (all doubles, like the single-prediction schema).
FEATURE_INPUT = T.StructType([T.StructField("CustomerID", T.StringType())]
                             + [T.StructField(c, T.DoubleType()) for c in FEATURES])

T7_PREDICTION_LOG = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
     T.StructField("customer_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in [
        "recency", "frequency", "monetary", "avg_order_value", "unique_products", "return_rate",
        "customer_lifetime_days", "purchase_frequency_monthly", "avg_quantity_per_order"]]
    + [T.StructField("predicted_segment", T.StringType())]
    + [f for p in ["lr", "rf", "xgb", "lgb", "stacking"]
       for f in (T.StructField(f"{p}_pred", T.IntegerType()), T.StructField(f"{p}_prob", T.DoubleType()))]
)
LOG_FEATURE_COLUMNS = dict(zip(FEATURES, [
    "recency", "frequency", "monetary", "avg_order_value", "unique_products", "return_rate",
    "customer_lifetime_days", "purchase_frequency_monthly", "avg_quantity_per_order"]))

T8_DRIFT_METRICS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("feature_name", T.StringType()), T.StructField("psi_value", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("training_mean", T.DoubleType()),
    T.StructField("production_mean", T.DoubleType()),
])

T9_MODEL_METADATA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("model_name", T.StringType()), T.StructField("filepath", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("roc_auc", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()), T.StructField("mcc", T.DoubleType()),
    T.StructField("is_active", T.IntegerType()),
])

METRIC_NAMES = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "mcc",
                "cv_roc_auc_mean", "cv_roc_auc_std"]
METRICS_JSON = T.MapType(T.StringType(), T.StructType(
    [T.StructField(m, T.DoubleType()) for m in METRIC_NAMES]))

DRIFT_JSON = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("overall_status", T.StringType()),
    T.StructField("metrics", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("psi_value", T.DoubleType()),
        T.StructField("status", T.StringType()), T.StructField("training_mean", T.DoubleType()),
        T.StructField("production_mean", T.DoubleType()),
    ]))),
])

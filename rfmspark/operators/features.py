"""Per-customer features, scaling and descriptive statistics.

Aggregations are declared once per key so Catalyst plans a single partial +
final hash aggregate per table (distinct counts are pre-aggregated map-side on
(customer, value), which also keeps a very active customer from landing in one
task with all its rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfmspark.functions.scalar import (fn_avg_order_value, fn_avg_qty_per_order, fn_day_diff, fn_is_cancelled,
                                       fn_log1p, fn_purchase_freq_monthly)
from rfmspark.operators.stats import exact_quantiles, stack_columns
from rfmspark.schemas import FEATURES, LOG_FEATURES, MODEL_FEATURES

# --------------------------------------------------------------------------- RFM


def snapshot_date(tx: DataFrame) -> DataFrame:
    """One row: ``snapshot`` = max(InvoiceDate) + 1 day."""
    return tx.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("snapshot"))


MONEY = "decimal(38,4)"


def money_sum(c) -> Column:
    """Exact sum of amounts at 1e-4 resolution, returned as double: the result does
    not depend on summation order (partitioning), so equal row sets give equal sums."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(MONEY)).cast("double")


def rfm_core(tx: DataFrame) -> DataFrame:
    """Per customer: last/first purchase, distinct invoices, spend, quantity, distinct products.
    Two two-level aggregates (per invoice, per product), so no row is copied for a second distinct count."""
    invoices = tx.groupBy("CustomerID", "InvoiceNo").agg(
        F.max("InvoiceDate").alias("_last"), F.min("InvoiceDate").alias("_first"),
        F.sum(F.col("TotalPrice").cast(MONEY)).alias("_spend"), F.sum("Quantity").alias("_quantity"))
    core = invoices.groupBy("CustomerID").agg(
        F.max("_last").alias("LastPurchase"), F.min("_first").alias("FirstPurchase"), F.count("InvoiceNo").alias("Frequency"),
        F.sum("_spend").cast("double").alias("Monetary"), F.sum("_quantity").cast("bigint").alias("TotalQuantity"))
    products = unique_products(tx).withColumnRenamed("CustomerID", "_customer")
    return core.join(products, F.col("CustomerID").eqNullSafe(F.col("_customer"))).drop("_customer")


def unique_products(tx: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return tx.groupBy("CustomerID").agg(F.approx_count_distinct("StockCode").alias("UniqueProducts"))
    return tx.select("CustomerID", "StockCode").distinct().groupBy("CustomerID").agg(F.count("StockCode").alias("UniqueProducts"))


def return_rate(raw: DataFrame, before=None) -> DataFrame:
    """Distinct cancelled invoices / distinct invoices per customer, over raw rows
    (optionally only rows before a split). NULL invoice numbers are not invoices."""
    r = raw.where(F.col("CustomerID").isNotNull())
    if before is not None:
        r = r.where(F.col("InvoiceDate") < (before if isinstance(before, Column) else F.lit(before)))
    inv = F.trim(F.col("InvoiceNo"))
    per_invoice = r.select("CustomerID", inv.alias("_inv")).distinct()
    return (per_invoice.groupBy("CustomerID")
            .agg(F.count(F.when(fn_is_cancelled(F.col("_inv")), F.col("_inv"))).alias("_cancelled"),
                 F.count("_inv").alias("_invoices"))
            .select("CustomerID", F.coalesce(F.try_divide(F.col("_cancelled").cast("double"), F.col("_invoices")),
                                             F.lit(0.0)).alias("ReturnRate")))


def align_divide(num: DataFrame, den: DataFrame, key: str, num_col: str, den_col: str, out: str) -> DataFrame:
    """Key-aligned division ``num/den``; keys missing from ``num`` give 0."""
    return (den.join(num, key, "left")
            .select(key, F.coalesce(F.try_divide(F.col(num_col).cast("double"), F.col(den_col)), F.lit(0.0)).alias(out)))


def join_unique_products(feats: DataFrame, tx: DataFrame) -> DataFrame:
    return feats.join(unique_products(tx), "CustomerID", "left")


def join_return_rate(feats: DataFrame, rates: DataFrame) -> DataFrame:
    return feats.join(rates, "CustomerID", "left").fillna({"ReturnRate": 0.0})


def derive_features(core: DataFrame, as_of_col: str) -> DataFrame:
    """F9 (without ReturnRate) from ``rfm_core`` output and an as-of timestamp column."""
    return core.select(
        "CustomerID",
        fn_day_diff(F.col("LastPurchase"), F.col(as_of_col)).alias("Recency"),
        F.col("Frequency"), F.col("Monetary"),
        fn_avg_order_value("Monetary", "Frequency").alias("AvgOrderValue"),
        F.col("UniqueProducts"),
        fn_day_diff(F.col("FirstPurchase"), F.col("LastPurchase")).alias("CustomerLifetimeDays"),
        F.col("TotalQuantity"),
    ).select("*", fn_purchase_freq_monthly("Frequency", "CustomerLifetimeDays").alias("PurchaseFrequencyMonthly"),
             fn_avg_qty_per_order("TotalQuantity", "Frequency").alias("AvgQuantityPerOrder")).drop("TotalQuantity")


def rfm_features(tx: DataFrame, raw: DataFrame, as_of=None, raw_before=None) -> DataFrame:
    """F9 per customer. ``as_of`` defaults to the snapshot date (max + 1 day); the
    one-row snapshot is broadcast. ReturnRate comes from ``raw`` (missing -> 0)."""
    core = rfm_core(tx)
    if as_of is None:
        core = core.crossJoin(F.broadcast(snapshot_date(tx).withColumnRenamed("snapshot", "_as_of")))
    else:
        core = core.withColumn("_as_of", as_of if isinstance(as_of, Column) else F.lit(as_of))
    feats = derive_features(core, "_as_of")
    feats = join_return_rate(feats, return_rate(raw, raw_before))
    return feats.select("CustomerID", *FEATURES)


def add_log_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    for c in cols or LOG_FEATURES:
        df = df.withColumn(f"{c}_log", fn_log1p(c))
    return df


# --------------------------------------------------------------------------- scaling


def fit_scaler(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per feature: (feature, mean, scale) with population std; zero -> 1."""
    cols = cols or MODEL_FEATURES
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"m_{c}").alias("mean"),
                              F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) == 0, F.lit(1.0))
                              .otherwise(F.col(f"s_{c}")).alias("scale")) for i, c in enumerate(cols)])
    return one.select(F.explode(rows).alias("p")).select("p.*")


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str] | None = None, suffix: str = "_scaled",
                 replace: bool = False) -> DataFrame:
    """``(x - mean) / scale`` with the (bounded, one row per feature) parameters broadcast."""
    cols = cols or MODEL_FEATURES
    wide = params.groupBy().agg(*[x for c in cols for x in (
        F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m_{c}"),
        F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(wide))
    for c in cols:
        out = out.withColumn(c if replace else f"{c}{suffix}", (F.col(c).cast("double") - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    return out.drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])


def standard_scale(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    params = fit_scaler(df, cols)
    return apply_scaler(df, params, cols), params


def standard_scale_train_only(train: DataFrame, test: DataFrame, cols: list[str] | None = None):
    params = fit_scaler(train, cols)
    return apply_scaler(train, params, cols, replace=True), apply_scaler(test, params, cols, replace=True), params


def customer_features(tx: DataFrame, raw: DataFrame) -> DataFrame:
    """T4: CustomerID, F9, three logs, nine scaled model features."""
    f = add_log_features(rfm_features(tx, raw))
    scaled, _ = standard_scale(f, MODEL_FEATURES)
    return scaled


# --------------------------------------------------------------------------- descriptive statistics


def summary_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column (long form)."""
    long = stack_columns(df, cols)
    base = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                       F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("p_index") == i, F.col("q"))).alias(n)
                                    for i, n in enumerate(["q25", "q50", "q75"])])
    return base.join(qw, "feature")


def skewness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected sample skewness (as pandas ``skew``) per column."""
    long = stack_columns(df, cols)
    n = F.count("value").cast("double")
    g1 = F.skewness("value")
    corr = F.sqrt(n * (n - 1)) / (n - 2)
    return long.groupBy("feature").agg(F.when(n > 2, g1 * corr).alias("skew"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation for every pair (long form f1, f2, r), one aggregate pass."""
    cols = cols or FEATURES
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    rows = []
    for a, b in pairs:
        r = F.lit(1.0) if a == b else F.col(f"{a}__{b}")
        rows.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), r.alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("f1"), F.lit(a).alias("f2"), F.col(f"{a}__{b}").alias("r")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def class_balance(df: DataFrame, label: str = "Target") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def scale_pos_weight(df: DataFrame, label: str = "Target") -> DataFrame:
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"),
                               F.count_if(F.col(label) == 1)).alias("scale_pos_weight"))


def feature_means(ref: DataFrame, prod: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or FEATURES
    a = stack_columns(ref, cols).groupBy("feature").agg(F.avg("value").alias("training_mean"))
    b = stack_columns(prod, cols).groupBy("feature").agg(F.avg("value").alias("production_mean"))
    return a.join(b, "feature", "full")

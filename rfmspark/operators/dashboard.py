"""Dashboard aggregates, top-k, histograms and log-table views.

Global top-k uses ``orderBy().limit()`` (TakeOrderedAndProject: per-partition
top-k, then a k-row merge). Top-k per group is two-level: first per (group,
salt) then per group, so one customer with a third of all rows is still cut
into ``salt_buckets`` parallel sorts of its distinct items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_format_ts, fn_month, fn_round_half_up, fn_truncate_label
from rfmspark.operators.stats import values_at_ranks
from rfmspark.schemas import LOG_FEATURE_COLUMNS, SEGMENTS


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
                    salt_cols: list[str] | None = None, salt_buckets: int = 32, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order_cols`` (which must end with a unique
    tie-break). ``salt_cols`` spread a group over ``salt_buckets`` pre-selections."""
    d = df
    if salt_cols and salt_buckets > 1:
        d = d.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt_buckets)))
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
        d = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return d.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def dataset_stats(tx: DataFrame) -> DataFrame:
    """One row. Distinct keys are grouped first and then counted: no row is copied per counted column, and the keys of a
    count never meet in one task."""
    def distinct(column: str, name: str) -> DataFrame:
        return tx.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1)).agg(F.count(F.lit(1)).alias(name))
    rows = tx.agg(F.count(F.lit(1)).alias("total_records"),
                  fn_format_ts(F.min("InvoiceDate"), "yyyy-MM-dd").alias("start_date"),
                  fn_format_ts(F.max("InvoiceDate"), "yyyy-MM-dd").alias("end_date"))
    return rows.crossJoin(distinct("CustomerID", "total_customers")).crossJoin(distinct("InvoiceNo", "total_transactions")) \
        .select("total_records", "total_customers", "total_transactions", "start_date", "end_date")


def country_breakdown(tx: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Value counts of Country, most frequent first; NULL countries are dropped. With ``countries`` (CustomerID, Country)
    the rows are counted by customer before the one lookup is joined; without it the rows carry Country themselves."""
    rows = tx.select("Country", F.lit(1).cast("bigint").alias("_n")) if countries is None else \
        tx.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("_n")).join(countries, "CustomerID")
    return (rows.where(F.col("Country").isNotNull()).groupBy("Country").agg(F.sum("_n").alias("count"))
            .orderBy(F.col("count").desc(), F.col("Country")))


def top_products(tx: DataFrame, n: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Best-selling descriptions. With ``names`` (StockCode, Description) the rows are summed by code before the one lookup
    is joined; without it the rows carry Description themselves."""
    if names is not None:
        tx = tx.groupBy("StockCode").agg(F.sum("Quantity").alias("Quantity"), F.sum("TotalPrice").alias("TotalPrice")).join(names, "StockCode")
    return (tx.where(F.col("Description").isNotNull()).groupBy("Description")
            .agg(F.sum("Quantity").cast("bigint").alias("quantity"), F.sum("TotalPrice").alias("revenue"))
            .orderBy(F.col("quantity").desc(), F.col("Description")).limit(n)
            .withColumnRenamed("Description", "description"))


def top5_products(tx: DataFrame, label_len: int = 20, names: DataFrame | None = None) -> DataFrame:
    t = top_products(tx, 5, names)
    return t.select(fn_truncate_label(F.col("description"), label_len).alias("name"), "quantity", "revenue")


def customer_summary(tx: DataFrame, customer_id: str | None = None) -> DataFrame:
    d = tx if customer_id is None else tx.where(F.col("CustomerID") == F.lit(str(customer_id).strip()))
    return d.groupBy("CustomerID").agg(F.sum("TotalPrice").alias("total_spend"),
                                       F.sum("Quantity").cast("bigint").alias("total_quantity"),
                                       F.countDistinct("InvoiceNo").alias("num_invoices"))


def customer_top_items(tx: DataFrame, customer_id: str | None = None, n: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Top ``n`` (StockCode, Description) by quantity per customer (or for one). With ``names`` (one Description per
    StockCode) only the rows of the result are looked up; without it the rows carry Description themselves."""
    d = tx if customer_id is None else tx.where(F.col("CustomerID") == F.lit(str(customer_id).strip()))
    if names is not None:
        items = d.groupBy("CustomerID", "StockCode").agg(F.sum("Quantity").cast("bigint").alias("quantity"), F.sum("TotalPrice").alias("revenue"))
        top = top_k_per_group(items, ["CustomerID"], [F.col("quantity").desc(), F.col("StockCode")], n, salt_cols=["StockCode"])
        return top.join(names, "StockCode", "left").select("CustomerID", "StockCode", "Description", "quantity", "revenue", "rank")
    items = d.groupBy("CustomerID", "StockCode", "Description").agg(
        F.sum("Quantity").cast("bigint").alias("quantity"), F.sum("TotalPrice").alias("revenue"))
    order = [F.col("quantity").desc(), F.col("StockCode"), F.col("Description")]
    return top_k_per_group(items, ["CustomerID"], order, n, salt_cols=["StockCode"])


def customer_report(tx: DataFrame, customer_id: str | None = None, n: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Per customer: summary line plus top items as text lines (customer, line_no, line)."""
    s = customer_summary(tx, customer_id)
    head = s.select("CustomerID", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.format_string("Transaction Summary for Customer ID %s:", "CustomerID").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.format_string("- Total Spend: £%.2f", "total_spend").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.format_string("- Total Quantity Purchased: %d", "total_quantity").alias("line")),
        F.struct(F.lit(3).alias("line_no"), F.format_string("- Unique Invoices count: %d", "num_invoices").alias("line")),
        F.struct(F.lit(4).alias("line_no"), F.lit("Top Purchased Products:").alias("line")),
        F.struct(F.lit(5).alias("line_no"), F.lit("StockCode | Description | Quantity | Total Revenue").alias("line")),
    )).alias("l")).select("CustomerID", "l.*")
    items = customer_top_items(tx, customer_id, n, names).select(
        "CustomerID", (F.col("rank") + 5).alias("line_no"),
        F.format_string("%s | %s | %d | £%.2f", "StockCode", "Description", "quantity", "revenue").alias("line"))
    return head.unionByName(items)


def join_segment_inner(tx: DataFrame, seg: DataFrame) -> DataFrame:
    """Transactions of segmented customers with their segment (inner join on the key;
    the strategy is left to AQE since the segment table grows with the customers)."""
    return tx.join(seg.select("CustomerID", "Segment"), "CustomerID", "inner")


def segment_distribution(seg: DataFrame) -> DataFrame:
    c = seg.groupBy("Segment").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over <= k rows
    return c.withColumn("percentage", F.col("count") * 100.0 / total)


def segment_centroids_raw(seg: DataFrame,
                          cols=("Recency", "Frequency", "Monetary", "AvgOrderValue", "UniqueProducts", "ReturnRate")):
    return seg.groupBy("Segment").agg(*[F.avg(c).alias(c) for c in cols])


def monthly_segment_trend(tx: DataFrame, seg: DataFrame) -> DataFrame:
    j = join_segment_inner(tx, seg)
    return j.groupBy(fn_month("InvoiceDate").alias("Month"), "Segment").agg(
        F.sum("TotalPrice").alias("spend"), F.countDistinct("CustomerID").alias("customers"))


def monthly_trend_pivot(tx: DataFrame, seg: DataFrame, value: str = "spend") -> DataFrame:
    """Months x segments (fixed segment list), missing cells 0, sorted by month."""
    t = monthly_segment_trend(tx, seg)
    p = t.groupBy("Month").pivot("Segment", SEGMENTS).agg(F.first(value))
    return p.na.fill(0, subset=SEGMENTS).orderBy("Month")


def monthly_revenue(tx: DataFrame, seg: DataFrame) -> DataFrame:
    t = monthly_segment_trend(tx, seg)
    return t.groupBy("Month").agg(fn_round_half_up(F.sum("spend"), 2).alias("revenue")).orderBy("Month")


def quantile_histogram(seg: DataFrame, fields: list[str], bins: int = 10) -> DataFrame:
    """Per segment and field: edges are the values at sorted positions floor(i/bins·n)
    (and the last value), de-duplicated; each value counts in the last bin whose
    start it reaches. With two or fewer edges: one bin per distinct value.
    Output: Segment, field, bin_start, bin_end, count."""
    long = seg.select("Segment", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("kv")
    ).select("Segment", "kv.field", "kv.v").where(F.col("v").isNotNull())
    # positions as floating point, floor((i / bins) * n), like the dashboard computes them
    specs = [(i / bins, lambda n, i=i: F.least(F.floor(F.lit(i / bins) * n), n - 1)) for i in range(bins + 1)]
    edges_long = values_at_ranks(long, "v", specs + [(1.0, lambda n: n - 1)], ["Segment", "field"])
    edges = edges_long.groupBy("Segment", "field").agg(F.array_sort(F.collect_set("value")).alias("edges"))
    j = long.join(F.broadcast(edges), ["Segment", "field"])  # <= bins+2 edges per (segment, field)
    m = F.size("edges")
    idx = F.size(F.filter(F.slice("edges", 1, m - 1), lambda e: e <= F.col("v"))) - 1
    binned = j.withColumn("_few", m <= 2).withColumn(
        "bin_start", F.when(F.col("_few"), F.col("v")).otherwise(F.element_at("edges", idx + 1))).withColumn(
        "bin_end", F.when(F.col("_few"), F.col("v")).otherwise(F.element_at("edges", idx + 2)))
    return binned.groupBy("Segment", "field", "bin_start", "bin_end").agg(F.count(F.lit(1)).alias("count"))


def union_append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


# --------------------------------------------------------------------------- prediction log (T7)

_HISTORY_FEATURES = list(LOG_FEATURE_COLUMNS.values())


def history_latest(log: DataFrame, n: int = 50) -> DataFrame:
    cols = ["id", "timestamp"] + _HISTORY_FEATURES + ["predicted_segment"] + [
        f"{p}_{s}" for p in ["lr", "rf", "xgb", "lgb", "stacking"] for s in ["pred", "prob"]]
    return log.select(*cols).orderBy(F.col("id").desc()).limit(n)


def history_project(log: DataFrame) -> DataFrame:
    cid = F.when(F.col("customer_id").isNull() | (F.col("customer_id") == ""), "N/A").otherwise(F.col("customer_id"))
    return log.select("id", "timestamp", cid.alias("customer_id"), *_HISTORY_FEATURES, "predicted_segment",
                      "stacking_pred", "stacking_prob")


def history_page(log: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return history_project(log).orderBy(F.col("id").desc()).offset(offset).limit(limit)


def history_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"))


def history_export(log: DataFrame) -> DataFrame:
    names = {"recency": "Recency", "frequency": "Frequency", "monetary": "Monetary", "avg_order_value": "AvgOrderValue",
             "unique_products": "UniqueProducts", "return_rate": "ReturnRate",
             "customer_lifetime_days": "CustomerLifetimeDays", "purchase_frequency_monthly": "PurchaseFrequencyMonthly",
             "avg_quantity_per_order": "AvgQuantityPerOrder"}
    return log.select(F.col("id").alias("Inference_ID"), F.col("timestamp").alias("Timestamp"),
                      F.coalesce(F.col("customer_id"), F.lit("")).alias("CustomerID"),
                      *[F.col(k).alias(v) for k, v in names.items()],
                      F.col("predicted_segment").alias("Predicted_Segment"),
                      F.col("stacking_pred").alias("Prediction_Repurchase"),
                      F.col("stacking_prob").alias("Repurchase_Probability"))


def latest_per_customer(log: DataFrame) -> DataFrame:
    """Newest log row (highest id) per customer: a max_by aggregate, partial per partition."""
    cols = [c for c in log.columns if c not in ("customer_id",)]
    latest = log.groupBy("customer_id").agg(F.max_by(F.struct(*cols), F.col("id")).alias("r"))
    return latest.select("customer_id", "r.*")


def running_accuracy(scored: DataFrame, order_col: str, label: str = "Target", pred: str = "prediction") -> DataFrame:
    """Cumulative correct / processed x 100 in replay order (distributed ordered sums)."""
    from rfmspark.operators.stats import cumulative_by_order
    d = scored.withColumn("_correct", (F.col(label) == F.col(pred)).cast("bigint")).withColumn("_one", F.lit(1).cast("bigint"))
    c = cumulative_by_order(d, order_col, ["_correct", "_one"])
    return c.withColumn("total_processed", F.col("cum__one")).withColumn(
        "running_accuracy", F.col("cum__correct") * 100.0 / F.col("cum__one")).drop(
        "_correct", "_one", "cum__correct", "cum__one")

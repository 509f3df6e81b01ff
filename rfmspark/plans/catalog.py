"""Registered queries: one per operator of the inventory, each a DataFrame plan over
the given tables, paired (where SQL can express it) with an independent DuckDB query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmspark.operators import clean, features
from rfmspark.plans.context import FEATURE_MONTHS, Ctx, fround, rounded
from rfmspark.plans.sqlparts import r, rnd, with_ctes
from rfmspark.schemas import FEATURES, MODEL_FEATURES

REGISTRY: dict[str, tuple[Callable[[Ctx], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ============================================================== features (flagship)

@query("rfm_features", with_ctes(f"""
SELECT CustomerID, Recency, Frequency, {rnd(["Monetary", "AvgOrderValue"])}, UniqueProducts,
       {rnd(["ReturnRate"])}, CustomerLifetimeDays, {rnd(["PurchaseFrequencyMonthly", "AvgQuantityPerOrder"])}
FROM features""", "features"))
def q_rfm_features(ctx: Ctx) -> DataFrame:
    return rounded(ctx.features)


# ============================================================== cleaning

_T2_COLS = f"InvoiceNo, StockCode, Quantity, InvoiceDate, {rnd(['UnitPrice'])}, CustomerID, {rnd(['TotalPrice'])}"
_T2 = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "TotalPrice"]


@query("clean_transactions", with_ctes(f"SELECT {_T2_COLS} FROM cleaned", "cleaned"))
def q_clean_transactions(ctx: Ctx) -> DataFrame:
    return rounded(ctx.cleaned.select(*_T2))


@query("iqr_filter", with_ctes(f"""
SELECT b.lo AS lower, b.hi AS upper, (SELECT count(*) FROM after_qty) AS rows_kept, 'Quantity' AS column_name FROM qty_bounds b
UNION ALL
SELECT {r('b.lo')}, {r('b.hi')}, (SELECT count(*) FROM cleaned), 'TotalPrice' FROM tp_bounds b""", "cleaned"))
def q_iqr_filter(ctx: Ctx) -> DataFrame:
    pre = ctx.cleaning[0]  # the row-filtered transactions (materialised stage table)
    after_q = clean.iqr_filter(pre, "Quantity")
    after_tp = clean.iqr_filter(after_q, "TotalPrice")
    qb = clean.iqr_bounds(pre, "Quantity").crossJoin(after_q.agg(F.count(F.lit(1)).alias("rows_kept")))
    tb = clean.iqr_bounds(after_q, "TotalPrice").crossJoin(after_tp.agg(F.count(F.lit(1)).alias("rows_kept")))
    return (qb.select("lower", "upper", "rows_kept", F.lit("Quantity").alias("column_name"))
            .unionByName(rounded(tb.select("lower", "upper", "rows_kept", F.lit("TotalPrice").alias("column_name")))))


@query("iqr_filter_events", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, user_id, event_type, value FROM events, b
WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_iqr_filter_events(ctx: Ctx) -> DataFrame:
    ev = ctx.table("events", ["event_id", "user_id", "event_type", "value"])
    return clean.iqr_filter(ev, "value")


@query("cleaning_audit", with_ctes(f"""
SELECT * , {r('CAST(rows_out AS DOUBLE) * 100.0 / rows_in')} AS retained_pct FROM (
  SELECT 0 AS step_no, 'drop_null_customer' AS step, (SELECT count(*) FROM retail) AS rows_in,
         (SELECT count(*) FROM retail WHERE CustomerID IS NOT NULL) AS rows_out
  UNION ALL SELECT 1, 'drop_cancelled', (SELECT count(*) FROM retail WHERE CustomerID IS NOT NULL),
         (SELECT count(*) FROM retail WHERE CustomerID IS NOT NULL AND NOT coalesce(starts_with(trim(InvoiceNo), 'C'), false))
  UNION ALL SELECT 2, 'positive_qty_price',
         (SELECT count(*) FROM retail WHERE CustomerID IS NOT NULL AND NOT coalesce(starts_with(trim(InvoiceNo), 'C'), false)),
         (SELECT count(*) FROM pre_clean)
  UNION ALL SELECT 3, 'country_filter', (SELECT count(*) FROM pre_clean), (SELECT count(*) FROM pre_clean)
  UNION ALL SELECT 4, 'iqr_quantity', (SELECT count(*) FROM pre_clean), (SELECT count(*) FROM after_qty)
  UNION ALL SELECT 5, 'iqr_total_price', (SELECT count(*) FROM after_qty), (SELECT count(*) FROM cleaned)
  UNION ALL SELECT 6, 'overall', (SELECT count(*) FROM retail), (SELECT count(*) FROM cleaned))""", "cleaned"))
def q_cleaning_audit(ctx: Ctx) -> DataFrame:
    return clean.cleaning_audit(ctx.retail(["InvoiceNo", "Quantity", "UnitPrice", "CustomerID"]),
                                bounds=ctx.cleaning[1])


# ============================================================== filters / projections on the transactions

_RAW_SQL = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, {u}, CustomerID, Country".format(u=rnd(["UnitPrice"]))
_RAW6 = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


@query("drop_cancelled", with_ctes(f"""
SELECT InvoiceNo, CustomerID, Quantity FROM retail
WHERE NOT coalesce(starts_with(trim(InvoiceNo), 'C'), false)""", "retail"))
def q_drop_cancelled(ctx: Ctx) -> DataFrame:
    return clean.drop_cancelled(ctx.retail(["InvoiceNo", "CustomerID", "Quantity"], returned=False))


@query("only_cancelled", with_ctes("""
SELECT InvoiceNo, CustomerID, Quantity FROM retail WHERE coalesce(starts_with(trim(InvoiceNo), 'C'), false)""", "retail"))
def q_only_cancelled(ctx: Ctx) -> DataFrame:
    return clean.only_cancelled(ctx.retail(["InvoiceNo", "CustomerID", "Quantity"], returned=True))


@query("positive_qty_price", with_ctes(f"""
SELECT InvoiceNo, CustomerID, Quantity, {rnd(['UnitPrice'])} FROM retail WHERE Quantity > 0 AND UnitPrice > 0""", "retail"))
def q_positive_qty_price(ctx: Ctx) -> DataFrame:
    return rounded(clean.positive_qty_price(ctx.retail(["InvoiceNo", "CustomerID", "Quantity", "UnitPrice"])))


@query("drop_null_customer", with_ctes("""
SELECT InvoiceNo, CustomerID FROM retail WHERE CustomerID IS NOT NULL""", "retail"))
def q_drop_null_customer(ctx: Ctx) -> DataFrame:
    return clean.drop_null_customer(ctx.retail(["InvoiceNo", "CustomerID"]))


@query("drop_null_keys", with_ctes("""
SELECT InvoiceNo, CustomerID, InvoiceDate FROM retail WHERE CustomerID IS NOT NULL AND InvoiceDate IS NOT NULL""", "retail"))
def q_drop_null_keys(ctx: Ctx) -> DataFrame:
    return clean.drop_null_keys(ctx.retail(["InvoiceNo", "CustomerID", "InvoiceDate"]))


@query("country_filter", with_ctes("""
SELECT InvoiceNo, CustomerID, Country FROM retail WHERE Country = 'NATION_7'""", "retail"))
def q_country_filter(ctx: Ctx) -> DataFrame:
    return clean.country_filter(ctx.retail(["InvoiceNo", "CustomerID", "Country"]), "NATION_7")


@query("total_price", with_ctes(f"""
SELECT InvoiceNo, StockCode, {rnd(['TotalPrice'])} FROM (SELECT *, Quantity * UnitPrice AS TotalPrice FROM retail)""", "retail"))
def q_total_price(ctx: Ctx) -> DataFrame:
    return rounded(clean.total_price(ctx.retail(["InvoiceNo", "StockCode", "Quantity", "UnitPrice"]))
                   .select("InvoiceNo", "StockCode", "TotalPrice"))


@query("select_canonical", with_ctes(f"SELECT {_RAW_SQL} FROM retail", "retail"))
def q_select_canonical(ctx: Ctx) -> DataFrame:
    return rounded(clean.select_canonical(ctx.retail()))


@query("src_column_pruned", with_ctes("SELECT CustomerID, InvoiceNo FROM retail", "retail"))
def q_src_column_pruned(ctx: Ctx) -> DataFrame:
    path = files.sink_parquet(ctx.raw_tx, files.scratch_table(ctx.spark, "raw_tx"))
    return files.src_column_pruned(ctx.spark, path, ["CustomerID", "InvoiceNo"])


@query("sink_raw_subset", with_ctes("SELECT CustomerID, InvoiceNo, InvoiceDate FROM retail", "retail"))
def q_sink_raw_subset(ctx: Ctx) -> DataFrame:
    return files.read_parquet(ctx.spark, files.sink_raw_subset(ctx.raw_tx, files.scratch_table(ctx.spark, "raw_subset")))


@query("before_split", with_ctes("""
SELECT InvoiceNo, CustomerID, InvoiceDate FROM cleaned, sup_split WHERE InvoiceDate < split""", "cleaned", "sup_split"))
def q_before_split(ctx: Ctx) -> DataFrame:
    from rfmspark.operators.learn import split_date_value
    return clean.before_split(ctx.cleaned, split_date_value(ctx.cleaned, FEATURE_MONTHS)).select("InvoiceNo", "CustomerID", "InvoiceDate")


@query("after_split", with_ctes("""
SELECT InvoiceNo, CustomerID, InvoiceDate FROM cleaned, sup_split WHERE InvoiceDate >= split""", "cleaned", "sup_split"))
def q_after_split(ctx: Ctx) -> DataFrame:
    from rfmspark.operators.learn import split_date_value
    return clean.after_split(ctx.cleaned, split_date_value(ctx.cleaned, FEATURE_MONTHS)).select("InvoiceNo", "CustomerID", "InvoiceDate")


@query("customer_lookup", with_ctes(f"""
SELECT InvoiceNo, StockCode, Quantity, {rnd(['TotalPrice'])} FROM cleaned
WHERE CustomerID = (SELECT CustomerID FROM cleaned GROUP BY CustomerID ORDER BY count(*) DESC, CustomerID LIMIT 1)""",
                                      "cleaned"))
def q_customer_lookup(ctx: Ctx) -> DataFrame:
    """Rows of the most active customer (the id is looked up, then pushed as a literal)."""
    top = (ctx.cleaned.groupBy("CustomerID").count().orderBy(F.col("count").desc(), F.col("CustomerID"))
           .first()["CustomerID"])
    return rounded(clean.customer_lookup(ctx.cleaned, top).select("InvoiceNo", "StockCode", "Quantity", "TotalPrice"))


# ============================================================== aggregates on features

@query("rfm_core", with_ctes(f"""
SELECT CustomerID, LastPurchase, FirstPurchase, Frequency, {rnd(['Monetary'])}, TotalQuantity, UniqueProducts
FROM rfm_core""", "rfm_core"))
def q_rfm_core(ctx: Ctx) -> DataFrame:
    return rounded(features.rfm_core(ctx.cleaned))


@query("snapshot_date", with_ctes("SELECT snapshot FROM snap", "snap"))
def q_snapshot_date(ctx: Ctx) -> DataFrame:
    return features.snapshot_date(ctx.cleaned)


@query("unique_products", with_ctes("""
SELECT CustomerID, count(DISTINCT StockCode) AS UniqueProducts FROM cleaned GROUP BY CustomerID""", "cleaned"))
def q_unique_products(ctx: Ctx) -> DataFrame:
    return features.unique_products(ctx.cleaned)


@query("return_rate", with_ctes(f"SELECT CustomerID, {rnd(['ReturnRate'])} FROM return_rate", "return_rate"))
def q_return_rate(ctx: Ctx) -> DataFrame:
    return rounded(features.return_rate(ctx.raw_subset))


@query("join_unique_products", with_ctes("""
SELECT c.CustomerID, c.Frequency, u.UniqueProducts FROM rfm_core c
LEFT JOIN (SELECT CustomerID, count(DISTINCT StockCode) AS UniqueProducts FROM cleaned GROUP BY CustomerID) u
  ON c.CustomerID = u.CustomerID""", "rfm_core"))
def q_join_unique_products(ctx: Ctx) -> DataFrame:
    core = features.rfm_core(ctx.cleaned).select("CustomerID", "Frequency")
    return features.join_unique_products(core, ctx.cleaned)


@query("join_return_rate", with_ctes(f"""
SELECT c.CustomerID, c.Frequency, {r('coalesce(rr.ReturnRate, 0.0)')} AS ReturnRate
FROM rfm_core c LEFT JOIN return_rate rr ON c.CustomerID = rr.CustomerID""", "rfm_core", "return_rate"))
def q_join_return_rate(ctx: Ctx) -> DataFrame:
    core = features.rfm_core(ctx.cleaned).select("CustomerID", "Frequency")
    return rounded(features.join_return_rate(core, features.return_rate(ctx.raw_subset)))


@query("align_divide", with_ctes(f"""
SELECT d.CustomerID, {r('coalesce(CAST(n.c AS DOUBLE) / d.c, 0.0)')} AS ReturnRate
FROM (SELECT CustomerID, count(DISTINCT trim(InvoiceNo)) AS c FROM retail WHERE CustomerID IS NOT NULL GROUP BY 1) d
LEFT JOIN (SELECT CustomerID, count(DISTINCT trim(InvoiceNo)) AS c FROM retail
           WHERE CustomerID IS NOT NULL AND starts_with(trim(InvoiceNo), 'C') GROUP BY 1) n
  ON d.CustomerID = n.CustomerID""", "retail"))
def q_align_divide(ctx: Ctx) -> DataFrame:
    """Cancelled invoices / invoices per customer as two key-aligned series."""
    raw = clean.drop_null_customer(ctx.raw_subset).withColumn("InvoiceNo", F.trim("InvoiceNo"))
    den = raw.groupBy("CustomerID").agg(F.countDistinct("InvoiceNo").alias("c"))
    num = clean.only_cancelled(raw).groupBy("CustomerID").agg(F.countDistinct("InvoiceNo").alias("n"))
    return rounded(features.align_divide(num, den, "CustomerID", "n", "c", "ReturnRate"))


@query("features_scaled", with_ctes("SELECT CustomerID, " + ", ".join(
    f"{r(c)} AS {c}" for c in [f"{m}_log" for m in ["Recency", "Frequency", "Monetary"]] + [f"{m}_scaled" for m in MODEL_FEATURES])
    + " FROM scaled", "scaled"))
def q_features_scaled(ctx: Ctx) -> DataFrame:
    """T4 logs and scaled model features (population std, zero variance -> 1)."""
    cols = [f"{m}_log" for m in ["Recency", "Frequency", "Monetary"]] + [f"{m}_scaled" for m in MODEL_FEATURES]
    return rounded(ctx.features_scaled.select("CustomerID", *cols))


@query("standard_scale", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, {r('m_' + c)} AS mean, {r('s_' + c)} AS scale FROM scaler"
    for i, c in enumerate(MODEL_FEATURES)), "scaler"))
def q_standard_scale(ctx: Ctx) -> DataFrame:
    return rounded(ctx.scaler_params)


@query("summary_describe", with_ctes(" UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
       {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont({c}, 0.25)')} AS q25,
       {r(f'quantile_cont({c}, 0.5)')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM cleaned"""
                                                        for c in ["Quantity", "TotalPrice"]), "cleaned"))
def q_summary_describe(ctx: Ctx) -> DataFrame:
    return rounded(features.summary_describe(ctx.cleaned, ["Quantity", "TotalPrice"]))


_SKEW_COLS = ["Recency", "Frequency", "Monetary", "Recency_log", "Frequency_log", "Monetary_log"]


@query("skewness", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'skewness({c})')} AS skew FROM features_log" for c in _SKEW_COLS), "features_log"))
def q_skewness(ctx: Ctx) -> DataFrame:
    """Bias-corrected skew (pandas/DuckDB ``skewness``) before and after log1p."""
    return rounded(features.skewness(features.add_log_features(ctx.features), _SKEW_COLS))


@query("correlation_matrix", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {r('max(1.0)' if a == b else f'corr({a}, {b})')} AS r FROM features"
    for a in FEATURES for b in FEATURES), "features"))
def q_correlation_matrix(ctx: Ctx) -> DataFrame:
    return rounded(features.correlation_matrix(ctx.features, FEATURES))


# ============================================================== segments

from rfmspark.operators import dashboard, segment  # noqa: E402
from rfmspark.plans.sqlparts import SCALED, SEG_ORDER_SQL, dist_sql  # noqa: E402
from rfmspark.schemas import SCALED_FEATURES  # noqa: E402


@query("seeded_segments", with_ctes("SELECT CustomerID, Seed_Cluster, Segment, Segment_Order FROM segmented", "segmented"))
def q_seeded_segments(ctx: Ctx) -> DataFrame:
    return ctx.segmented.select("CustomerID", "Seed_Cluster", "Segment", "Segment_Order")


@query("label_segments", with_ctes("SELECT Seed_Cluster, Segment FROM seed_labels", "seed_labels"))
def q_label_segments(ctx: Ctx) -> DataFrame:
    return segment.label_segments(ctx.segmented, "Seed_Cluster")


@query("join_map_label", with_ctes("SELECT CustomerID, Seed_Cluster, seed_segment AS Segment FROM seed_first", "seed_first"))
def q_join_map_label(ctx: Ctx) -> DataFrame:
    labels = segment.label_segments(ctx.segmented, "Seed_Cluster")
    return segment.join_map_label(ctx.segmented.select("CustomerID", "Seed_Cluster"), labels, "Seed_Cluster")


@query("segment_order", with_ctes(f"""
SELECT DISTINCT Segment, {SEG_ORDER_SQL.format(c='Segment')} AS Segment_Order FROM segmented""", "segmented"))
def q_segment_order(ctx: Ctx) -> DataFrame:
    return segment.segment_order(ctx.segmented.select("Segment").distinct())


@query("cluster_profile", with_ctes(f"""
SELECT Seed_Cluster, {r('avg(Recency)')} AS Recency, {r('avg(Frequency)')} AS Frequency, {r('avg(Monetary)')} AS Monetary
FROM seeded GROUP BY Seed_Cluster""", "seeded"))
def q_cluster_profile(ctx: Ctx) -> DataFrame:
    return rounded(segment.cluster_profile(ctx.segmented, "Seed_Cluster"))


@query("segment_distribution", with_ctes(f"""
SELECT Segment, count(*) AS count, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percentage
FROM segmented GROUP BY Segment""", "segmented"))
def q_segment_distribution(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.segment_distribution(ctx.segmented))


_RAW_CENT = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "UniqueProducts", "ReturnRate"]


@query("segment_centroids_raw", with_ctes("SELECT Segment, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in _RAW_CENT)
                                          + " FROM segmented GROUP BY Segment", "segmented"))
def q_segment_centroids_raw(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.segment_centroids_raw(ctx.segmented))


@query("segment_centroids_scaled", with_ctes("SELECT Segment, " + ", ".join(f"{r(c)} AS {c}" for c in SCALED)
                                             + " FROM seg_cents", "seg_cents"))
def q_segment_centroids_scaled(ctx: Ctx) -> DataFrame:
    return rounded(segment.segment_centroids(ctx.segmented, SCALED_FEATURES))


@query("nearest_centroid", with_ctes(f"""
SELECT CustomerID, Predicted_Segment, {r('d')} AS Centroid_Distance FROM (
  SELECT s.CustomerID, c.Segment AS Predicted_Segment, {dist_sql(['s.' + x for x in SCALED], ['c.' + x for x in SCALED])} AS d,
         row_number() OVER (PARTITION BY s.CustomerID
                            ORDER BY {dist_sql(['s.' + x for x in SCALED], ['c.' + x for x in SCALED])}, c.Segment) AS rn
  FROM segmented s CROSS JOIN seg_cents c) WHERE rn = 1""", "segmented", "seg_cents"))
def q_nearest_centroid(ctx: Ctx) -> DataFrame:
    """Every customer against the segment centroids (a second assignment step)."""
    cents = segment.segment_centroids(ctx.segmented, SCALED_FEATURES)
    out = segment.nearest_centroid(ctx.segmented.select("CustomerID", *SCALED_FEATURES), cents, SCALED_FEATURES)
    return rounded(out.select("CustomerID", "Predicted_Segment", "Centroid_Distance"))


# ============================================================== dashboard

@query("dataset_stats", with_ctes("""
SELECT count(*) AS total_records, count(DISTINCT CustomerID) AS total_customers,
       count(DISTINCT InvoiceNo) AS total_transactions, strftime(min(InvoiceDate), '%Y-%m-%d') AS start_date,
       strftime(max(InvoiceDate), '%Y-%m-%d') AS end_date FROM cleaned""", "cleaned"))
def q_dataset_stats(ctx: Ctx) -> DataFrame:
    return dashboard.dataset_stats(ctx.cleaned)


@query("country_breakdown", with_ctes("""
SELECT Country, count(*) AS count FROM cleaned WHERE Country IS NOT NULL GROUP BY Country""", "cleaned"))
def q_country_breakdown(ctx: Ctx) -> DataFrame:
    return dashboard.country_breakdown(ctx.cleaned, ctx.customer_countries)


@query("top_products", with_ctes(f"""
SELECT Description AS description, CAST(sum(Quantity) AS BIGINT) AS quantity, {r('sum(TotalPrice)')} AS revenue
FROM cleaned WHERE Description IS NOT NULL GROUP BY Description ORDER BY quantity DESC, Description LIMIT 10""", "cleaned"))
def q_top_products(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.top_products(ctx.cleaned, 10, ctx.product_names))


@query("top5_products", with_ctes(f"""
SELECT CASE WHEN length(description) > 20 THEN substr(description, 1, 20) || '...' ELSE description END AS name,
       quantity, revenue FROM (
  SELECT Description AS description, CAST(sum(Quantity) AS BIGINT) AS quantity, {r('sum(TotalPrice)')} AS revenue
  FROM cleaned WHERE Description IS NOT NULL GROUP BY Description ORDER BY quantity DESC, Description LIMIT 5)""", "cleaned"))
def q_top5_products(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.top5_products(ctx.cleaned, names=ctx.product_names))


@query("customer_summary", with_ctes(f"""
SELECT CustomerID, {r('sum(TotalPrice)')} AS total_spend, CAST(sum(Quantity) AS BIGINT) AS total_quantity,
       count(DISTINCT InvoiceNo) AS num_invoices FROM cleaned GROUP BY CustomerID""", "cleaned"))
def q_customer_summary(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.customer_summary(ctx.cleaned))


_TOP_ITEMS_SQL = f"""
SELECT * FROM (
  SELECT CustomerID, StockCode, Description, quantity, revenue,
         row_number() OVER (PARTITION BY CustomerID ORDER BY quantity DESC, StockCode, Description) AS rank
  FROM (SELECT CustomerID, StockCode, Description, CAST(sum(Quantity) AS BIGINT) AS quantity, sum(TotalPrice) AS revenue
        FROM cleaned GROUP BY CustomerID, StockCode, Description)) WHERE rank <= 10"""


@query("customer_top_items", with_ctes(f"""
SELECT CustomerID, StockCode, Description, quantity, {r('revenue')} AS revenue, CAST(rank AS INTEGER) AS rank
FROM ({_TOP_ITEMS_SQL})""", "cleaned"))
def q_customer_top_items(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.customer_top_items(ctx.cleaned, names=ctx.product_names))


@query("customer_report", with_ctes(f"""
SELECT CustomerID, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT CustomerID, 0 AS line_no, printf('Transaction Summary for Customer ID %s:', CustomerID) AS line FROM s
  UNION ALL SELECT CustomerID, 1, printf('- Total Spend: £%.2f', total_spend) FROM s
  UNION ALL SELECT CustomerID, 2, printf('- Total Quantity Purchased: %d', total_quantity) FROM s
  UNION ALL SELECT CustomerID, 3, printf('- Unique Invoices count: %d', num_invoices) FROM s
  UNION ALL SELECT CustomerID, 4, 'Top Purchased Products:' FROM s
  UNION ALL SELECT CustomerID, 5, 'StockCode | Description | Quantity | Total Revenue' FROM s
  UNION ALL SELECT CustomerID, rank + 5, printf('%s | %s | %d | £%.2f', StockCode, Description, quantity, revenue)
            FROM ({_TOP_ITEMS_SQL}))""".replace(
    "FROM s", "FROM (SELECT CustomerID, sum(TotalPrice) AS total_spend, CAST(sum(Quantity) AS BIGINT) AS total_quantity, "
              "count(DISTINCT InvoiceNo) AS num_invoices FROM cleaned GROUP BY CustomerID)"), "cleaned"))
def q_customer_report(ctx: Ctx) -> DataFrame:
    return dashboard.customer_report(ctx.cleaned, names=ctx.product_names)


@query("join_segment_inner", with_ctes(f"""
SELECT c.InvoiceNo, c.StockCode, c.CustomerID, s.Segment, {r('c.TotalPrice')} AS TotalPrice
FROM cleaned c JOIN segmented s ON c.CustomerID = s.CustomerID""", "cleaned", "segmented"))
def q_join_segment_inner(ctx: Ctx) -> DataFrame:
    j = dashboard.join_segment_inner(ctx.cleaned, ctx.segmented)
    return rounded(j.select("InvoiceNo", "StockCode", "CustomerID", "Segment", "TotalPrice"))


_TREND_SQL = """
SELECT strftime(c.InvoiceDate, '%Y-%m') AS Month, s.Segment, sum(c.TotalPrice) AS spend,
       count(DISTINCT c.CustomerID) AS customers
FROM cleaned c JOIN segmented s ON c.CustomerID = s.CustomerID GROUP BY 1, 2"""


@query("monthly_segment_trend", with_ctes(f"SELECT Month, Segment, {r('spend')} AS spend, customers FROM ({_TREND_SQL})",
                                          "cleaned", "segmented"))
def q_monthly_segment_trend(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.monthly_segment_trend(ctx.cleaned, ctx.segmented))


@query("monthly_trend_pivot", with_ctes("SELECT Month, " + ", ".join(
    f"""{r(f"coalesce(sum(CASE WHEN Segment = '{sname}' THEN spend END), 0)")} AS "{sname}\""""
    for sname in ["At-Risk", "Champions", "Lost Customers", "Loyal Customers"])
    + f" FROM ({_TREND_SQL}) GROUP BY Month", "cleaned", "segmented"))
def q_monthly_trend_pivot(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.monthly_trend_pivot(ctx.cleaned, ctx.segmented, "spend"))


@query("monthly_revenue", with_ctes(f"SELECT Month, {r('sum(spend)', 2)} AS revenue FROM ({_TREND_SQL}) GROUP BY Month",
                                    "cleaned", "segmented"))
def q_monthly_revenue(ctx: Ctx) -> DataFrame:
    return dashboard.monthly_revenue(ctx.cleaned, ctx.segmented)


_HIST_FIELDS = ["Recency", "Frequency", "Monetary"]
_HV = " UNION ALL ".join(f"SELECT Segment, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM segmented" for f in _HIST_FIELDS)


@query("quantile_histogram", with_ctes(f"""
WITH hv AS ({_HV}),
hr AS (SELECT *, row_number() OVER (PARTITION BY Segment, field ORDER BY v) - 1 AS rk,
              count(*) OVER (PARTITION BY Segment, field) AS n FROM hv),
he AS (SELECT Segment, field, list_sort(list_distinct(list(v))) AS edges
       FROM hr, (SELECT unnest(range(0, 11)) AS i) g
       WHERE rk = least(CAST(floor((i / 10) * n) AS BIGINT), n - 1) OR rk = n - 1 GROUP BY Segment, field)
SELECT Segment, field,
       {r("CASE WHEN len(edges) <= 2 THEN v ELSE edges[len(list_filter(edges[1:len(edges) - 1], lambda e: e <= v))] END")} AS bin_start,
       {r("CASE WHEN len(edges) <= 2 THEN v ELSE edges[len(list_filter(edges[1:len(edges) - 1], lambda e: e <= v)) + 1] END")} AS bin_end,
       count(*) AS count
FROM hv JOIN he USING (Segment, field) GROUP BY ALL""".replace("WITH hv AS", "SELECT * FROM (WITH hv AS", 1) + ")",
                                       "segmented"))
def q_quantile_histogram(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.quantile_histogram(ctx.segmented, _HIST_FIELDS, 10))


@query("distinct_values", with_ctes("SELECT DISTINCT CustomerID FROM cleaned", "cleaned"))
def q_distinct_values(ctx: Ctx) -> DataFrame:
    return dashboard.distinct_values(ctx.cleaned, ["CustomerID"])


@query("union_append", with_ctes(f"""
SELECT InvoiceNo, CustomerID, {rnd(['TotalPrice'])} FROM cleaned
UNION ALL
SELECT InvoiceNo, CustomerID, {rnd(['TotalPrice'])} FROM (SELECT *, Quantity * UnitPrice AS TotalPrice FROM retail)
WHERE coalesce(starts_with(trim(InvoiceNo), 'C'), false)""", "cleaned", "retail"))
def q_union_append(ctx: Ctx) -> DataFrame:
    """Cleaned rows with the cancelled raw rows appended (no de-duplication)."""
    new = clean.total_price(clean.only_cancelled(ctx.retail(["InvoiceNo", "CustomerID", "Quantity", "UnitPrice"],
                                                            returned=True)))
    return rounded(dashboard.union_append(ctx.cleaned.select("InvoiceNo", "CustomerID", "TotalPrice"),
                                          new.select("InvoiceNo", "CustomerID", "TotalPrice")))


# ============================================================== supervised dataset, split, scorer, metrics

from rfmspark.operators import drift as drift_ops  # noqa: E402
from rfmspark.operators import evaluate as ev  # noqa: E402
from rfmspark.operators import learn  # noqa: E402

_F9_SQL = ("CustomerID, Recency, Frequency, " + rnd(["Monetary", "AvgOrderValue"]) + ", UniqueProducts, "
           + rnd(["ReturnRate"]) + ", CustomerLifetimeDays, " + rnd(["PurchaseFrequencyMonthly", "AvgQuantityPerOrder"]))


@query("supervised_dataset", with_ctes(f"SELECT {_F9_SQL}, Target FROM supervised", "supervised"))
def q_supervised_dataset(ctx: Ctx) -> DataFrame:
    return rounded(ctx.supervised)


@query("target_label", with_ctes("SELECT CustomerID, Target FROM supervised", "supervised"))
def q_target_label(ctx: Ctx) -> DataFrame:
    return ctx.supervised.select("CustomerID", "Target")


@query("semi_join_target", with_ctes("""
SELECT CustomerID FROM sup_features f WHERE EXISTS (SELECT 1 FROM sup_target t WHERE t.CustomerID = f.CustomerID)""",
                                     "sup_features", "sup_target"))
def q_semi_join_target(ctx: Ctx) -> DataFrame:
    split = learn.split_date_value(ctx.cleaned, FEATURE_MONTHS)
    after = clean.after_split(ctx.cleaned, split)
    return learn.semi_join_target(ctx.supervised.select("CustomerID"), after)


@query("stratified_split", with_ctes("SELECT CustomerID, Target, is_test FROM ho_flag", "ho_flag"))
def q_stratified_split(ctx: Ctx) -> DataFrame:
    return ctx.split_flags.select("CustomerID", "Target", "is_test")


@query("class_balance", with_ctes("SELECT Target, count(*) AS count FROM supervised GROUP BY Target", "supervised"))
def q_class_balance(ctx: Ctx) -> DataFrame:
    return features.class_balance(ctx.supervised)


@query("scale_pos_weight", with_ctes(f"""
SELECT {r('CAST(count_if(Target = 0) AS DOUBLE) / count_if(Target = 1)')} AS scale_pos_weight
FROM ho_flag WHERE NOT is_test""", "ho_flag"))
def q_scale_pos_weight(ctx: Ctx) -> DataFrame:
    return rounded(features.scale_pos_weight(ctx.split_flags.where(~F.col("is_test"))))


@query("standard_scale_train_only", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r('m_' + c)} AS mean, {r('s_' + c)} AS scale FROM ho_scaler" for c in MODEL_FEATURES),
    "ho_scaler"))
def q_standard_scale_train_only(ctx: Ctx) -> DataFrame:
    return rounded(ctx.holdout[1].select("feature", "mean", "scale"))


@query("class_mean_scorer", with_ctes(f"SELECT CustomerID, Target, {r('margin')} AS margin, {r('probability')} AS probability, "
                                      "prediction FROM ho_scored", "ho_scored"))
def q_class_mean_scorer(ctx: Ctx) -> DataFrame:
    return rounded(ctx.holdout[0].select("CustomerID", "Target", "margin", "probability", "prediction"))


@query("majority_baseline", with_ctes(f"SELECT CustomerID, Target, prediction, {r('probability')} AS probability "
                                      "FROM ho_baseline", "ho_baseline"))
def q_majority_baseline(ctx: Ctx) -> DataFrame:
    return rounded(ctx.baseline_scored.select("CustomerID", "Target", "prediction", "probability"))


@query("confusion_matrix", with_ctes("""
SELECT a.actual, p.predicted, count(s.Target) AS count
FROM (SELECT 0 AS actual UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS predicted UNION ALL SELECT 1) p
LEFT JOIN ho_scored s ON s.Target = a.actual AND s.prediction = p.predicted GROUP BY 1, 2""", "ho_scored"))
def q_confusion_matrix(ctx: Ctx) -> DataFrame:
    return ev.confusion_matrix(ctx.holdout[0])


_METRIC_COLS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "mcc"]


@query("classification_metrics", with_ctes(
    "SELECT " + ", ".join(f"{r(c)} AS {c}" for c in ["accuracy", "precision", "recall", "f1_score", "mcc"])
    + " FROM model_metrics WHERE model = 'class_mean_linear'", "model_metrics"))
def q_classification_metrics(ctx: Ctx) -> DataFrame:
    m = ev.classification_metrics(ctx.holdout[0])
    return rounded(m.select("accuracy", "precision", "recall", "f1_score", "mcc"))


@query("roc_auc", with_ctes(f"SELECT model, {r('roc_auc')} AS roc_auc FROM model_metrics", "model_metrics"))
def q_roc_auc(ctx: Ctx) -> DataFrame:
    a = ev.roc_auc(ctx.holdout[0]).select(F.lit("class_mean_linear").alias("model"), "roc_auc")
    b = ev.roc_auc(ctx.baseline_scored).select(F.lit("baseline_majority").alias("model"), "roc_auc")
    return rounded(a.unionByName(b))


@query("pr_auc", with_ctes(f"SELECT model, {r('pr_auc')} AS pr_auc FROM model_metrics", "model_metrics"))
def q_pr_auc(ctx: Ctx) -> DataFrame:
    a = ev.pr_auc(ctx.holdout[0]).select(F.lit("class_mean_linear").alias("model"), "pr_auc")
    b = ev.pr_auc(ctx.baseline_scored).select(F.lit("baseline_majority").alias("model"), "pr_auc")
    return rounded(a.unionByName(b))


@query("roc_curve", with_ctes(f"""
SELECT {r('t')} AS threshold, {r('CAST(cum_neg AS DOUBLE) / N')} AS fpr, {r('CAST(cum_pos AS DOUBLE) / P')} AS tpr
FROM (SELECT * FROM (__CUM__))""".replace("__CUM__", __import__("rfmspark.plans.sqlparts", fromlist=["x"]).cum_sql("ho_scored")),
                              "ho_scored"))
def q_roc_curve(ctx: Ctx) -> DataFrame:
    return rounded(ev.roc_curve(ctx.holdout[0]))


@query("pr_curve", with_ctes(f"""
SELECT {r('t')} AS threshold, {r('CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg)')} AS precision,
       {r('CAST(cum_pos AS DOUBLE) / P')} AS recall
FROM (__CUM__) x WHERE t >= (SELECT max(t) FROM (__CUM__) y WHERE cum_pos = P)
UNION ALL SELECT NULL, 1.0, 0.0""".replace("__CUM__", __import__("rfmspark.plans.sqlparts", fromlist=["x"]).cum_sql("ho_scored")),
                             "ho_scored"))
def q_pr_curve(ctx: Ctx) -> DataFrame:
    return rounded(ev.pr_curve(ctx.holdout[0]))


_MM_SQL = "model, " + ", ".join(f"{r(c)} AS {c}" for c in _METRIC_COLS + ["cv_roc_auc_mean", "cv_roc_auc_std"])


@query("model_metrics", with_ctes(f"SELECT {_MM_SQL} FROM model_metrics", "model_metrics"))
def q_model_metrics(ctx: Ctx) -> DataFrame:
    return rounded(ctx.model_metrics.drop("model_order"))


@query("model_leaderboard", with_ctes(f"""
SELECT model AS recommended_model, {r('s')} AS score,
       printf('Model recommends ''%s'' due to highest 3-Fold Cross-Validation ROC-AUC of %.4f.',
              list_aggr(list_transform(string_split(replace(model, '_', ' '), ' '),
                                       lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), s) AS recommendation_reason
FROM (SELECT *, coalesce(CASE WHEN cv_roc_auc_mean <> 0 THEN cv_roc_auc_mean END, roc_auc, 0.0) AS s FROM model_metrics)
ORDER BY s DESC, model_order LIMIT 1""", "model_metrics"))
def q_model_leaderboard(ctx: Ctx) -> DataFrame:
    return rounded(ev.model_leaderboard(ctx.model_metrics))


@query("best_per_metric", with_ctes("SELECT " + ", ".join(f"{r(f'max({c})')} AS {c}" for c in _METRIC_COLS)
                                    + " FROM model_metrics", "model_metrics"))
def q_best_per_metric(ctx: Ctx) -> DataFrame:
    return rounded(ev.best_per_metric(ctx.model_metrics))


_GATE_SQL = f"""
SELECT {r('new_auc')} AS new_auc, {r('old_auc')} AS old_auc, NOT (new_auc < 0.55) AND NOT (new_auc < old_auc - 0.05) AS accepted,
       concat_ws(', ', CASE WHEN new_auc < 0.55 THEN printf('AUC too low: %.4f < 0.55', new_auc) END,
                 CASE WHEN new_auc < old_auc - 0.05
                      THEN printf('Deteriorated from benchmark: %.4f vs benchmark %.4f', new_auc, old_auc) END) AS reasons
FROM (SELECT coalesce((SELECT max(roc_auc) FROM model_metrics WHERE model = 'class_mean_linear'), 0.0) AS new_auc,
             coalesce((SELECT max(roc_auc) FROM model_metrics WHERE model = 'baseline_majority'), 0.5) AS old_auc)"""


@query("model_gate", with_ctes(_GATE_SQL, "model_metrics"))
def q_model_gate(ctx: Ctx) -> DataFrame:
    """Candidate = the class-mean scorer, benchmark = the majority baseline."""
    m = ctx.model_metrics
    new = m.where(F.col("model") == "class_mean_linear")
    old = m.where(F.col("model") == "baseline_majority").withColumn("model", F.lit("class_mean_linear"))
    return rounded(ev.model_gate(new, old, model="class_mean_linear"))


# ============================================================== drift

_DRIFT_COLS = ["psi_value", "training_mean", "production_mean"]


@query("psi_bin_edges", with_ctes(f"""
SELECT feature, CAST(i AS INTEGER) AS edge_index, {r('edges[i + 1]', 6)} AS edge
FROM (SELECT feature, edges, unnest(range(0, len(edges))) AS i FROM drift_edges)""", "drift_edges"))
def q_psi_bin_edges(ctx: Ctx) -> DataFrame:
    e = drift_ops.psi_bin_edges(features.stack_columns(ctx.supervised, FEATURES))
    return e.select("feature", F.posexplode("edges").alias("edge_index", "edge")).select(
        "feature", F.col("edge_index").cast("int"), fround("edge", 6).alias("edge"))


@query("histogram_by_edges", with_ctes("SELECT feature, CAST(bin AS INTEGER) AS bin, cnt AS count FROM drift_ha",
                                       "drift_ha"))
def q_histogram_by_edges(ctx: Ctx) -> DataFrame:
    """Production counts per reference bin (bin NULL = outside the reference range)."""
    e = drift_ops.psi_bin_edges(features.stack_columns(ctx.supervised, FEATURES))
    h = drift_ops.histogram_by_edges(features.stack_columns(ctx.features, FEATURES), e)
    return h.select("feature", F.col("bin").cast("int"), "count")


@query("psi", with_ctes(f"SELECT feature, {r('psi_value', 6)} AS psi_value FROM drift_psi", "drift_psi"))
def q_psi(ctx: Ctx) -> DataFrame:
    p = drift_ops.psi(ctx.supervised, ctx.features, FEATURES)
    return p.select("feature", fround("psi_value", 6).alias("psi_value"))  # already rounded: not passed to rounded()


@query("drift_report", with_ctes(f"""
SELECT feature, {r('psi_value')} AS psi_value, status, {rnd(['training_mean', 'production_mean'])}, overall_status
FROM drift_report""", "drift_report"))
def q_drift_report(ctx: Ctx) -> DataFrame:
    return rounded(drift_ops.drift_report(ctx.supervised, ctx.features, FEATURES))


@query("feature_means", with_ctes(f"SELECT feature, {rnd(['training_mean', 'production_mean'])} FROM drift_report",
                                  "drift_report"))
def q_feature_means(ctx: Ctx) -> DataFrame:
    return rounded(features.feature_means(ctx.supervised, ctx.features, FEATURES))


@query("retrain_trigger", with_ctes("""
SELECT max(psi_value) > 0.25 OR bool_or(overall_status = 'Retrain Alert') AS retrain FROM drift_report""", "drift_report"))
def q_retrain_trigger(ctx: Ctx) -> DataFrame:
    return drift_ops.retrain_trigger(drift_ops.drift_report(ctx.supervised, ctx.features, FEATURES))


# ============================================================== scoring and the prediction log (T7)

from rfmspark.operators import score as score_ops  # noqa: E402
from rfmspark.plans.sqlparts import score_sql  # noqa: E402
from rfmspark.schemas import LOG_FEATURE_COLUMNS  # noqa: E402

_LOGF = list(LOG_FEATURE_COLUMNS.values())
_T7_DOUBLES = _LOGF + [f"{p}_prob" for p in ["lr", "rf", "xgb", "lgb", "stacking"]]
_T7_SQL = ", ".join(["id", "timestamp", "customer_id"] + [f"{r(c)} AS {c}" for c in _LOGF] + ["predicted_segment"]
                    + [x for p in ["lr", "rf", "xgb", "lgb", "stacking"] for x in (f"{p}_pred", f"{r(p + '_prob')} AS {p}_prob")])


def _seg_pieces(ctx: Ctx):
    cents = segment.segment_centroids(ctx.segmented, SCALED_FEATURES)
    return ctx.scaler_params, cents, ctx.holdout[1], ctx.holdout[2]


@query("score_batch", with_ctes(f"""
SELECT CustomerID, Predicted_Segment, Predicted_Purchase_Label, {r('Purchase_Probability')} AS Purchase_Probability
FROM ({score_sql('features')})""", "features", "scaler", "seg_cents", "ho_scaler", "ho_w"))
def q_score_batch(ctx: Ctx) -> DataFrame:
    """Every customer's current features: segment, purchase label and probability by the store's active model."""
    s = score_ops.score_stored(ctx.features, *_seg_pieces(ctx)[:2], ctx.scorer_store.active_model())
    return rounded(s.select("CustomerID", "Predicted_Segment", "Predicted_Purchase_Label", "Purchase_Probability"))


@query("assign_segment", with_ctes("SELECT CustomerID, Predicted_Segment FROM (" + score_sql("log_run1") + ")",
                                   "log_run1", "scaler", "seg_cents", "ho_scaler", "ho_w"))
def q_assign_segment(ctx: Ctx) -> DataFrame:
    """Feature-period customers placed in the current segments (nearest centroid with the
    scaler the centroids were made with)."""
    s = score_ops.with_segment(ctx.supervised.select("CustomerID", *FEATURES), *_seg_pieces(ctx)[:2])
    return s.select("CustomerID", "Predicted_Segment")


@query("sink_prediction_log", with_ctes(f"SELECT {_T7_SQL} FROM prediction_log", "prediction_log"))
def q_sink_prediction_log(ctx: Ctx) -> DataFrame:
    """The two scoring runs appended to a Parquet log table and read back."""
    from rfmspark.sources import files
    path = files.scratch_table(ctx.spark, "prediction_logs")
    log = ctx.prediction_log
    for ts in [r_["timestamp"] for r_ in log.select("timestamp").distinct().orderBy("timestamp").collect()]:
        files.sink_append(log.where(F.col("timestamp") == F.lit(ts)), path)
    return rounded(files.read_parquet(ctx.spark, path))


@query("score_fanout", with_ctes(f"""
SELECT id, customer_id, stacking_pred, {r('stacking_prob')} AS stacking_prob, true AS other_models_null
FROM prediction_log""", "prediction_log"))
def q_score_fanout(ctx: Ctx) -> DataFrame:
    """Log rows with only the ensemble's own model columns (compat=False): the other
    pairs are NULL for every row."""
    f = score_ops.score_fanout(ctx.prediction_log, compat=False)
    others = F.lit(True)
    for p in ["lr", "rf", "xgb", "lgb"]:
        others = others & F.col(f"{p}_pred").isNull() & F.col(f"{p}_prob").isNull()
    return rounded(f.select("id", "customer_id", "stacking_pred", "stacking_prob", others.alias("other_models_null")))


_HIST_COLS = ["id", "timestamp"] + _LOGF + ["predicted_segment"] + [
    x for p in ["lr", "rf", "xgb", "lgb", "stacking"] for x in (f"{p}_pred", f"{p}_prob")]


@query("history_latest", with_ctes("SELECT " + ", ".join(
    [f"{r(c)} AS {c}" if c in _T7_DOUBLES else c for c in _HIST_COLS]) + " FROM prediction_log ORDER BY id DESC LIMIT 50",
                                   "prediction_log"))
def q_history_latest(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.history_latest(ctx.prediction_log, 50))


_PROJ = ["id", "timestamp", "CASE WHEN customer_id IS NULL OR customer_id = '' THEN 'N/A' ELSE customer_id END AS customer_id"] \
    + [f"{r(c)} AS {c}" for c in _LOGF] + ["predicted_segment", "stacking_pred", f"{r('stacking_prob')} AS stacking_prob"]


@query("history_project", with_ctes("SELECT " + ", ".join(_PROJ) + " FROM prediction_log", "prediction_log"))
def q_history_project(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.history_project(ctx.prediction_log))


@query("history_page", with_ctes("SELECT " + ", ".join(_PROJ) + " FROM prediction_log ORDER BY id DESC LIMIT 200 OFFSET 100",
                                 "prediction_log"))
def q_history_page(ctx: Ctx) -> DataFrame:
    """Second-and-a-half page: 200 rows after skipping the newest 100."""
    return rounded(dashboard.history_page(ctx.prediction_log, limit=200, offset=100))


@query("history_count", with_ctes("SELECT count(*) AS total FROM prediction_log", "prediction_log"))
def q_history_count(ctx: Ctx) -> DataFrame:
    return dashboard.history_count(ctx.prediction_log)


_EXPORT = ["id AS Inference_ID", "timestamp AS Timestamp", "coalesce(customer_id, '') AS CustomerID"] + [
    f"{r(v)} AS {k}" for k, v in LOG_FEATURE_COLUMNS.items()] + [
    "predicted_segment AS Predicted_Segment", "stacking_pred AS Prediction_Repurchase",
    f"{r('stacking_prob')} AS Repurchase_Probability"]


@query("history_export", with_ctes("SELECT " + ", ".join(_EXPORT) + " FROM prediction_log", "prediction_log"))
def q_history_export(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.history_export(ctx.prediction_log))


@query("latest_per_customer", with_ctes(f"""
SELECT * EXCLUDE (rn) FROM (SELECT customer_id, {", ".join(c for c in _T7_SQL.split(", ") if not c.startswith("customer_id"))},
       row_number() OVER (PARTITION BY customer_id ORDER BY id DESC) AS rn FROM prediction_log) WHERE rn = 1""",
                                        "prediction_log"))
def q_latest_per_customer(ctx: Ctx) -> DataFrame:
    return rounded(dashboard.latest_per_customer(ctx.prediction_log))


@query("latest_feature_lookup", with_ctes(f"""
SELECT CustomerID, source, {rnd(FEATURES)} FROM (
  SELECT f.CustomerID, CASE WHEN l.customer_id IS NOT NULL THEN 'log' ELSE 'features' END AS source,
         {", ".join(f"CASE WHEN l.customer_id IS NOT NULL THEN l.{v} ELSE CAST(f.{k} AS DOUBLE) END AS {k}"
                    for k, v in LOG_FEATURE_COLUMNS.items())}
  FROM features f LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY id DESC) AS rn FROM prediction_log)
    WHERE rn = 1) l ON l.customer_id = f.CustomerID)""", "features", "prediction_log"))
def q_latest_feature_lookup(ctx: Ctx) -> DataFrame:
    """Every current customer: newest log row if logged, else the feature table."""
    return rounded(score_ops.latest_feature_lookup(ctx.features.select("CustomerID"), ctx.prediction_log, ctx.features))


@query("what_if_order_value", with_ctes(f"""
SELECT CustomerID, Frequency, {rnd(['Monetary'])},
       CASE WHEN Frequency > 0 THEN {r('Monetary / Frequency', 2)} ELSE {r('AvgOrderValue')} END AS AvgOrderValue
FROM (SELECT CustomerID, Frequency, Monetary * 1.1 AS Monetary, AvgOrderValue FROM features)""", "features"))
def q_what_if_order_value(ctx: Ctx) -> DataFrame:
    """Spend raised by 10%: the order value follows."""
    d = ctx.features.select("CustomerID", "Frequency", (F.col("Monetary") * 1.1).alias("Monetary"), "AvgOrderValue")
    return rounded(score_ops.what_if_order_value(d))


@query("running_accuracy", with_ctes(f"""
SELECT id, Target, prediction,
       count(*) OVER (ORDER BY id) AS total_processed,
       {r('sum(CAST(Target = prediction AS INTEGER)) OVER (ORDER BY id) * 100.0 / count(*) OVER (ORDER BY id)')} AS running_accuracy
FROM (SELECT CAST(CustomerID AS BIGINT) AS id, Target, prediction FROM ho_scored)""", "ho_scored"))
def q_running_accuracy(ctx: Ctx) -> DataFrame:
    """Hold-out rows replayed in customer order: cumulative accuracy (%)."""
    d = ctx.holdout[0].select(F.col("CustomerID").cast("bigint").alias("id"), "Target", "prediction")
    return rounded(dashboard.running_accuracy(d, "id"))


# ============================================================== drift log (T8) and registry (T9)

_T8_SQL = f"id, timestamp, feature_name, {r('psi_value')} AS psi_value, status, {rnd(['training_mean', 'production_mean'])}"
_T9_SQL = f"id, timestamp, model_name, filepath, {rnd(['accuracy', 'roc_auc', 'f1_score', 'mcc'])}, is_active"


@query("sink_drift_log", with_ctes(f"SELECT {_T8_SQL} FROM drift_log", "drift_log"))
def q_sink_drift_log(ctx: Ctx) -> DataFrame:
    """Both drift runs appended to a Parquet table (one shared timestamp per run), read back."""
    from rfmspark.sources import files
    path = files.scratch_table(ctx.spark, "drift_metrics")
    for ts in [x["timestamp"] for x in ctx.drift_log.select("timestamp").distinct().orderBy("timestamp").collect()]:
        files.sink_append(ctx.drift_log.where(F.col("timestamp") == F.lit(ts)), path)
    return rounded(files.read_parquet(ctx.spark, path))


@query("latest_drift", with_ctes(f"""
SELECT {_T8_SQL}, CASE max(CASE status WHEN 'Stable' THEN 0 WHEN 'Monitor' THEN 1 ELSE 2 END) OVER ()
                   WHEN 0 THEN 'Stable' WHEN 1 THEN 'Monitor' ELSE 'Retrain Alert' END AS overall_status
FROM drift_log WHERE timestamp = (SELECT timestamp FROM drift_log ORDER BY id DESC LIMIT 1)""", "drift_log"))
def q_latest_drift(ctx: Ctx) -> DataFrame:
    return rounded(drift_ops.latest_drift(ctx.drift_log))


@query("registry_promote", with_ctes(f"SELECT {_T9_SQL} FROM registry", "registry"))
def q_registry_promote(ctx: Ctx) -> DataFrame:
    return rounded(ctx.registry)


@query("active_models", with_ctes(f"SELECT {_T9_SQL} FROM registry WHERE is_active = 1", "registry"))
def q_active_models(ctx: Ctx) -> DataFrame:
    return rounded(ev.active_models(ctx.registry))


@query("sink_model_registry", with_ctes(f"SELECT {_T9_SQL} FROM registry", "registry"))
def q_sink_model_registry(ctx: Ctx) -> DataFrame:
    from rfmspark.sources import files
    path = files.scratch_table(ctx.spark, "model_metadata")
    files.sink_append(ctx.registry, path)
    return rounded(files.read_parquet(ctx.spark, path))


@query("psi_status", with_ctes("SELECT feature, status FROM drift_report", "drift_report"))
def q_psi_status(ctx: Ctx) -> DataFrame:
    return drift_ops.psi_status(drift_ops.psi(ctx.supervised, ctx.features, FEATURES)).select("feature", "status")


@query("sample_production", with_ctes(f"""
SELECT {_F9_SQL} FROM features
WHERE CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#42'), 1, 13) AS BIGINT) < {int(0.2 * (1 << 52))}""", "features"))
def q_sample_production(ctx: Ctx) -> DataFrame:
    """A seeded 20% sample of the customer features by key hash (a sampling operator)."""
    return rounded(drift_ops.sample_production(ctx.features, 0.2, 42))


# ============================================================== sources and sinks (round trips through files)

from rfmspark.sources import files  # noqa: E402

_T1_ROUND = f"InvoiceNo, StockCode, Description, Quantity, InvoiceDate, {rnd(['UnitPrice'])}, CustomerID, Country"


def _write_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


@query("src_transactions_csv", with_ctes(f"SELECT {_T1_ROUND}, {r('Quantity * UnitPrice')} AS TotalPrice FROM retail",
                                         "retail"))
def q_src_transactions_csv(ctx: Ctx) -> DataFrame:
    """Transactions written as UTF-8 CSV, read back with the declared text schema and
    coerced by the upload rules."""
    path = _write_csv(ctx.retail(), files.scratch_table(ctx.spark, "transactions_csv"))
    return rounded(clean.ingest_upload(files.src_transactions_csv(ctx.spark, path)))


@query("ingest_upload", with_ctes(f"""
SELECT InvoiceNo, '85123A' AS StockCode, 'Added via Upload console' AS Description, Quantity, InvoiceDate,
       {rnd(['UnitPrice'])}, CustomerID, 'United Kingdom' AS Country, {r('Quantity * UnitPrice')} AS TotalPrice
FROM retail""", "retail"))
def q_ingest_upload(ctx: Ctx) -> DataFrame:
    """An upload with synonym headers and without the optional columns: names are
    normalised, types coerced, defaults filled."""
    src = ctx.retail(["InvoiceNo", "Quantity", "UnitPrice", "InvoiceDate", "CustomerID"]).toDF(
        "Invoice_No", "qty", "price", "date", "Customer ID")
    path = _write_csv(src, files.scratch_table(ctx.spark, "upload_csv"))
    raw = ctx.spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rounded(clean.ingest_upload(raw))


_UPLOADED = """(SELECT *, CASE WHEN Quantity = 7 THEN 'no CustomerID' WHEN Quantity = 8 THEN 'no InvoiceDate'
                               WHEN Quantity = 9 THEN 'unreadable InvoiceDate' END AS reason FROM retail)"""


@query("upload_append", with_ctes(f"""
SELECT 'cleaned' AS tab, '' AS reason, count(*) AS n, {r('sum(TotalPrice)', 2)} AS total
FROM (SELECT TotalPrice FROM cleaned UNION ALL SELECT Quantity * UnitPrice FROM {_UPLOADED} WHERE reason IS NULL)
UNION ALL SELECT 'raw_subset', '', (SELECT count(*) FROM retail) + (SELECT count(*) FROM {_UPLOADED} WHERE reason IS NULL), 0.0
UNION ALL SELECT 'rejected', reason, count(*), 0.0 FROM {_UPLOADED} WHERE reason IS NOT NULL GROUP BY reason""", "retail", "cleaned"))
def q_upload_append(ctx: Ctx) -> DataFrame:
    """Every raw row uploaded as text, some without customer, date or a readable date; the same upload is sent twice and
    counts once in T2, T3 and the table of rejected rows."""
    from rfmspark.sources.uploads import TransactionTables
    q = F.col("Quantity")
    src = ctx.retail(["InvoiceNo", "Quantity", "UnitPrice", "InvoiceDate", "CustomerID"]).select(
        F.col("InvoiceNo").alias("Invoice_No"), q.cast("string").alias("qty"), F.col("UnitPrice").cast("string").alias("price"),
        F.when(q == 9, "some day").when(q != 8, F.col("InvoiceDate").cast("string")).alias("date"),
        F.when(q != 7, F.col("CustomerID")).alias("Customer ID"))
    upload = ctx.stage(src, "upload")
    t = TransactionTables(ctx.spark, files.scratch_table(ctx.spark, "uploads"), ctx.cleaned, ctx.raw_subset)
    for _ in range(2):
        t.append(upload, "first")
    zero = F.lit(0.0).alias("total")
    return t.cleaned().agg(F.lit("cleaned").alias("tab"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"), fround(F.sum("TotalPrice"), 2).alias("total")) \
        .unionByName(t.raw_subset().agg(F.lit("raw_subset").alias("tab"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"), zero)) \
        .unionByName(t.rejected().groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("tab"), "reason", "n", zero))


@query("normalize_columns", with_ctes("SELECT InvoiceNo, Quantity, CustomerID FROM retail", "retail"))
def q_normalize_columns(ctx: Ctx) -> DataFrame:
    src = ctx.retail(["InvoiceNo", "Quantity", "CustomerID"]).toDF(" invoice id ", "QTY", "customer_id")
    return clean.normalize_columns(src)


@query("default_columns", with_ctes("""
SELECT InvoiceNo, CustomerID, '85123A' AS StockCode, 'Added via Upload console' AS Description,
       'United Kingdom' AS Country FROM retail""", "retail"))
def q_default_columns(ctx: Ctx) -> DataFrame:
    return clean.default_columns(ctx.retail(["InvoiceNo", "CustomerID"]))


@query("src_customer_features_csv", with_ctes(f"SELECT {_F9_SQL} FROM features", "features"))
def q_src_customer_features_csv(ctx: Ctx) -> DataFrame:
    path = _write_csv(ctx.features, files.scratch_table(ctx.spark, "features_csv"))
    f = files.src_customer_features_csv(ctx.spark, path)
    return rounded(f.select("CustomerID", *[F.col(c).cast(features_type(c)) for c in FEATURES]))


def features_type(c: str) -> str:
    from rfmspark.schemas import F9_TYPES
    return F9_TYPES[c].simpleString()


@query("sink_csv", with_ctes("SELECT CustomerID, Segment, Segment_Order FROM segmented", "segmented"))
def q_sink_csv(ctx: Ctx) -> DataFrame:
    path = files.sink_csv(ctx.segmented.select("CustomerID", "Segment", "Segment_Order"),
                          files.scratch_table(ctx.spark, "segments_csv"))
    return ctx.spark.read.schema("CustomerID string, Segment string, Segment_Order int").option("header", True).csv(path)


@query("sink_append", with_ctes(f"""
SELECT InvoiceNo, CustomerID, {rnd(['TotalPrice'])} FROM cleaned
UNION ALL SELECT InvoiceNo, CustomerID, {r('Quantity * UnitPrice')} FROM retail""", "cleaned", "retail"))
def q_sink_append(ctx: Ctx) -> DataFrame:
    """Cleaned rows, then every raw row appended as an upload would be (no de-duplication)."""
    path = files.scratch_table(ctx.spark, "cleaned_append")
    files.sink_append(ctx.cleaned.select("InvoiceNo", "CustomerID", "TotalPrice"), path)
    new = clean.total_price(ctx.retail(["InvoiceNo", "CustomerID", "Quantity", "UnitPrice"]))
    files.sink_append(new.select("InvoiceNo", "CustomerID", "TotalPrice"), path)
    return rounded(files.read_parquet(ctx.spark, path))


@query("src_metrics_json", with_ctes(f"SELECT {_MM_SQL} FROM model_metrics", "model_metrics"))
def q_src_metrics_json(ctx: Ctx) -> DataFrame:
    path = files.sink_metrics_json(ctx.model_metrics, files.scratch_table(ctx.spark, "model_metrics_json"))
    return rounded(files.src_metrics_json(ctx.spark, path))


@query("src_drift_json", with_ctes(f"""
SELECT feature, {r('psi_value')} AS psi_value, status, {rnd(['training_mean', 'production_mean'])}, overall_status
FROM drift_report""", "drift_report"))
def q_src_drift_json(ctx: Ctx) -> DataFrame:
    rep = drift_ops.drift_report(ctx.supervised, ctx.features, FEATURES)
    path = files.sink_drift_json(rep, files.scratch_table(ctx.spark, "drift_report_json"), "run")
    return rounded(files.src_drift_json(ctx.spark, path))


@query("sink_json_report", with_ctes("SELECT overall_status, count(*) AS n_metrics FROM drift_report GROUP BY 1",
                                     "drift_report"))
def q_sink_json_report(ctx: Ctx) -> DataFrame:
    """Drift report nested under ``metrics`` per overall status, read back and counted."""
    rep = drift_ops.drift_report(ctx.supervised, ctx.features, FEATURES)
    path = files.sink_json_report(rep, files.scratch_table(ctx.spark, "drift_nested"), "metrics", ["overall_status"])
    back = ctx.spark.read.json(path)
    return back.select("overall_status", F.size("metrics").cast("bigint").alias("n_metrics"))


@query("src_tables", with_ctes("""
SELECT 'prediction_logs' AS table_name, count(*) AS row_count FROM prediction_log
UNION ALL SELECT 'drift_metrics', count(*) FROM drift_log
UNION ALL SELECT 'model_metadata', count(*) FROM registry""", "prediction_log", "drift_log", "registry"))
def q_src_tables(ctx: Ctx) -> DataFrame:
    base = files.scratch_table(ctx.spark, "db")
    for name, df in [("prediction_logs", ctx.prediction_log), ("drift_metrics", ctx.drift_log),
                     ("model_metadata", ctx.registry)]:
        files.sink_parquet(df, f"{base}/{name}")
    tabs = files.src_tables(ctx.spark, ["prediction_logs", "drift_metrics", "model_metadata"], base)
    out = None
    for name, df in tabs.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


# ============================================================== read-only SQL and the customer report

from rfmspark.plans import jobs  # noqa: E402

SQL_EXAMPLE = ("SELECT customer_id, monetary FROM prediction_logs WHERE predicted_segment = 'Champions' "
               "ORDER BY monetary DESC, customer_id LIMIT 5")


@query("sql_query", with_ctes("""
SELECT customer_id, monetary FROM prediction_log WHERE predicted_segment = 'Champions'
ORDER BY monetary DESC, customer_id LIMIT 5""", "prediction_log"))
def q_sql_query(ctx: Ctx) -> DataFrame:
    """A read-only question over the registered log tables (first 100 rows at most)."""
    return jobs.sql_query(ctx.spark, SQL_EXAMPLE, {"prediction_logs": ctx.prediction_log,
                                                   "drift_metrics": ctx.drift_log, "model_metadata": ctx.registry})


# ============================================================== scalar functions over the transactions

from rfmspark.functions import scalar as fn  # noqa: E402


@query("scalar_functions", with_ctes(f"""
SELECT InvoiceNo, StockCode,
       strftime(InvoiceDate, '%Y-%m') AS month, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS ts_text,
       trim(regexp_replace(CustomerID || '.0', '\\.0$', '')) AS clean_id,
       CAST(CAST(CAST(CustomerID AS DOUBLE) AS BIGINT) AS VARCHAR) AS id_text,
       coalesce(CAST(trunc(TRY_CAST(trim(CAST(UnitPrice AS VARCHAR)) AS DOUBLE)) AS INTEGER), 1) AS price_int,
       CASE WHEN length(Description) > 20 THEN substr(Description, 1, 20) || '...' ELSE Description END AS label,
       starts_with(trim(InvoiceNo), 'C') AS cancelled,
       least(greatest(Quantity, 5), 40) AS qty_clipped,
       CASE WHEN Quantity - 25 > 0 THEN 'positive' ELSE 'negative' END AS influence,
       {r('ln(1 + UnitPrice)')} AS price_log1p
FROM retail""", "retail"))
def q_scalar_functions(ctx: Ctx) -> DataFrame:
    t = ctx.retail(["InvoiceNo", "StockCode", "InvoiceDate", "CustomerID", "UnitPrice", "Description", "Quantity"])
    return rounded(t.select(
        "InvoiceNo", "StockCode", fn.fn_month("InvoiceDate").alias("month"), fn.fn_format_ts("InvoiceDate").alias("ts_text"),
        fn.fn_clean_customer_id(F.concat("CustomerID", F.lit(".0"))).alias("clean_id"),
        fn.fn_id_float_to_str("CustomerID").alias("id_text"),
        fn.fn_to_int_default(F.col("UnitPrice").cast("string"), 1).alias("price_int"),
        fn.fn_truncate_label("Description").alias("label"), fn.fn_is_cancelled("InvoiceNo").alias("cancelled"),
        fn.fn_clip(F.col("Quantity"), 5, 40).alias("qty_clipped"), fn.fn_influence(F.col("Quantity") - 25).alias("influence"),
        fn.fn_log1p("UnitPrice").alias("price_log1p")))


# ============================================================== streaming (drained with availableNow)

from rfmspark.streaming import stream as st  # noqa: E402


def _replay_stream(ctx: Ctx):
    """The hold-out customers (feature period, with labels) laid out as four files in
    replay order, read back as a file-source stream in four micro-batches."""
    rows = (ctx.supervised.join(ctx.split_flags.where(F.col("is_test")).select("CustomerID"), "CustomerID", "left_semi")
            .withColumn("seq", F.col("CustomerID").cast("bigint")))
    n_files, per_trigger = st.replay_layout(ctx.spark, batches=4)
    src = st.write_replay_files(rows, files.scratch_table(ctx.spark, "replay_src"), "seq", files=n_files)
    return st.replay_source(ctx.spark, src, rows.schema, files_per_trigger=per_trigger)


def _scored_stream(ctx: Ctx):
    return st.stream_score(_replay_stream(ctx), *_seg_pieces(ctx))


@query("stream_score", with_ctes(f"""
SELECT CustomerID, seq, Target, Predicted_Segment, Predicted_Purchase_Label, {r('Purchase_Probability')} AS Purchase_Probability,
       correct FROM replay_scored""", "replay_scored"))
def q_stream_score(ctx: Ctx) -> DataFrame:
    """The replayed stream, every micro-batch scored by the model that is active at its begin."""
    out = files.scratch_table(ctx.spark, "stream_scored")
    st.stream_score_active(_replay_stream(ctx), ctx.scorer_store, "class_mean_linear", *_seg_pieces(ctx)[:2], out, out + "_ckpt")
    return rounded(files.read_parquet(ctx.spark, out, ["CustomerID", "seq", "Target", "Predicted_Segment", "Predicted_Purchase_Label",
                                                       "Purchase_Probability", "correct"]))


@query("stream_running_accuracy", with_ctes(f"""
SELECT count(*) AS total_processed, CAST(sum(correct) AS BIGINT) AS correct,
       {r('sum(correct) * 100.0 / count(*)')} AS running_accuracy FROM replay_scored""", "replay_scored"))
def q_stream_running_accuracy(ctx: Ctx) -> DataFrame:
    out = files.scratch_table(ctx.spark, "stream_accuracy")
    st.run_to_table(st.stream_running_accuracy(_scored_stream(ctx)), out, out + "_ckpt", "complete")
    return rounded(files.read_parquet(ctx.spark, out))


@query("stream_segment_counts", with_ctes("""
SELECT Predicted_Segment AS segment, count(*) AS count FROM replay_scored GROUP BY 1""", "replay_scored"))
def q_stream_segment_counts(ctx: Ctx) -> DataFrame:
    out = files.scratch_table(ctx.spark, "stream_segments")
    st.run_to_table(st.stream_segment_counts(_scored_stream(ctx)), out, out + "_ckpt", "complete")
    return files.read_parquet(ctx.spark, out)


@query("stream_throughput", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
       count(*) AS records FROM events GROUP BY 1, 2""")
def q_stream_throughput(ctx: Ctx) -> DataFrame:
    """Events replayed as a stream in time order: records per one-minute event-time window."""
    ev = ctx.table("events", ["event_id", "ts", "event_type"])
    n_files, per_trigger = st.replay_layout(ctx.spark, batches=4)
    src = st.write_replay_files(ev, files.scratch_table(ctx.spark, "events_src"), "ts", files=n_files)
    s = st.replay_source(ctx.spark, src, ev.schema, files_per_trigger=per_trigger)
    out = files.scratch_table(ctx.spark, "stream_throughput")
    st.run_to_table(st.stream_throughput(s, "ts", "1 minute", "10 minutes"), out, out + "_ckpt", "complete")
    return files.read_parquet(ctx.spark, out)


@query("stream_throughput_closed", """
SELECT window_start, window_start + INTERVAL 1 SECOND AS window_end, count(*) AS records
FROM (SELECT time_bucket(INTERVAL 1 SECOND, ts) AS window_start FROM events)
WHERE window_start + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events) GROUP BY 1""")
def q_stream_throughput_closed(ctx: Ctx) -> DataFrame:
    """Events replayed in time order: records of each one-second window, written once when the watermark (10 seconds) has
    passed it, then dropped from the state; the windows of the last 10 seconds are open still."""
    ev = ctx.table("events", ["event_id", "ts", "event_type"])
    _, per_trigger = st.replay_layout(ctx.spark, batches=4)
    src = st.write_replay_batches(ev, files.scratch_table(ctx.spark, "events_batches"), "ts", 4, per_trigger)
    s = st.replay_source(ctx.spark, src, ev.schema, files_per_trigger=per_trigger)
    out = files.scratch_table(ctx.spark, "stream_throughput_closed")
    st.run_to_table(st.stream_throughput(s, "ts", "1 second", "10 seconds"), out, out + "_ckpt", "append")
    return files.read_parquet(ctx.spark, out)


@query("stream_log", with_ctes(f"""
SELECT CAST(CustomerID AS BIGINT) AS id, CustomerID AS customer_id, {", ".join(f"{r(f'CAST({k} AS DOUBLE)')} AS {v}"
                                                                            for k, v in LOG_FEATURE_COLUMNS.items())},
       Predicted_Segment AS predicted_segment, Predicted_Purchase_Label AS stacking_pred,
       {r('Purchase_Probability')} AS stacking_prob FROM replay_scored""", "replay_scored"))
def q_stream_log(ctx: Ctx) -> DataFrame:
    out = files.scratch_table(ctx.spark, "stream_log")
    st.stream_score_active(_replay_stream(ctx), ctx.scorer_store, "class_mean_linear", *_seg_pieces(ctx)[:2], out, out + "_ckpt",
                           lambda scored: score_ops.prediction_log_rows(scored, F.col("seq"), F.current_timestamp()))
    log = files.read_parquet(ctx.spark, out)
    return rounded(log.select("id", "customer_id", *_LOGF, "predicted_segment", "stacking_pred", "stacking_prob"))


@query("stream_feed_last50", with_ctes(f"""
SELECT seq, CustomerID, Predicted_Segment, {r('Purchase_Probability')} AS Purchase_Probability
FROM replay_scored ORDER BY seq DESC LIMIT 50""", "replay_scored"))
def q_stream_feed_last50(ctx: Ctx) -> DataFrame:
    out = files.scratch_table(ctx.spark, "stream_feed")
    s = _scored_stream(ctx).select("seq", "CustomerID", "Predicted_Segment", "Purchase_Probability")
    path = st.stream_feed_last50(s, out, out + "_ckpt", "seq", 50)
    return rounded(files.read_parquet(ctx.spark, path))


# ============================================================== contributions (linear Shapley values of the scorer)

from rfmspark.operators import explain  # noqa: E402


def _holdout_contrib(ctx: Ctx) -> DataFrame:
    _, params, weights = ctx.holdout
    d = learn.with_model_features(ctx.split_flags)
    d = features.apply_scaler(d, params, MODEL_FEATURES, replace=True)
    train_means = features.fit_scaler(d.where(~F.col("is_test")), MODEL_FEATURES)
    return explain.linear_contributions(d.where(F.col("is_test")), weights, train_means)


@query("shap_values", with_ctes("SELECT CustomerID, " + ", ".join(
    f"{r(c)} AS {c}" for c in ["base_value", "margin"] + [f"contrib_{m}" for m in MODEL_FEATURES]) + " FROM ho_contrib",
                                "ho_contrib"))
def q_shap_values(ctx: Ctx) -> DataFrame:
    """Exact per-feature contributions of the linear scorer (base + contributions = margin)."""
    c = _holdout_contrib(ctx)
    return rounded(c.select("CustomerID", "base_value", "margin", *[f"contrib_{m}" for m in MODEL_FEATURES]))


_RANKED_SQL = """
SELECT CustomerID, CAST(rank AS INTEGER) AS rank, feature, {v} AS shap_value,
       CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS influence
FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY abs(value) DESC, pos) AS rank FROM ho_contrib_long)
WHERE rank <= {n}"""


@query("top_contributions", with_ctes(_RANKED_SQL.format(v=r("value"), n=3), "ho_contrib_long"))
def q_top_contributions(ctx: Ctx) -> DataFrame:
    return rounded(explain.top_contributions(_holdout_contrib(ctx), n=3))


@query("sort_contributions", with_ctes(_RANKED_SQL.format(v=r("value"), n=len(MODEL_FEATURES)), "ho_contrib_long"))
def q_sort_contributions(ctx: Ctx) -> DataFrame:
    return rounded(explain.sort_contributions(_holdout_contrib(ctx)))


@query("mean_abs_contribution", with_ctes(f"SELECT feature, {r('avg(abs(value))')} AS mean_abs_contribution "
                                          "FROM ho_contrib_long GROUP BY feature", "ho_contrib_long"))
def q_mean_abs_contribution(ctx: Ctx) -> DataFrame:
    return rounded(explain.mean_abs_contribution(_holdout_contrib(ctx)))


@query("contribution_map", with_ctes(f"""
SELECT CustomerID, replace(feature, '_log', '') AS feature, {r('value')} AS contribution FROM ho_contrib_long""",
                                     "ho_contrib_long"))
def q_contribution_map(ctx: Ctx) -> DataFrame:
    """The map feature -> contribution (names without ``_log``), shown as its entries."""
    m = explain.contribution_map(_holdout_contrib(ctx))
    return rounded(m.select("CustomerID", F.explode("contributions").alias("feature", "contribution")))


# ============================================================== Spark ML: clustering, PCA, learners (rows-only)


def _train_test(ctx: Ctx):
    _, params, _ = ctx.holdout
    d = features.apply_scaler(learn.with_model_features(ctx.split_flags), params, MODEL_FEATURES, replace=True)
    return d.where(~F.col("is_test")), d.where(F.col("is_test"))


@query("kmeans_fit")
def q_kmeans_fit(ctx: Ctx) -> DataFrame:
    """K-Means (k=4, k-means||, 10 seeded restarts, lowest cost wins) on the scaled
    features, then business labels from the cluster means."""
    res, _ = segment.kmeans_fit(ctx.features_scaled, SCALED_FEATURES, k=4, restarts=10, seed=42)
    labels = segment.label_segments(res, "KMeans_Cluster")
    out = segment.segment_order(segment.join_map_label(res, labels, "KMeans_Cluster"))
    return out.select("CustomerID", "KMeans_Cluster", "Segment", "Segment_Order")


@query("kmeans_sweep")
def q_kmeans_sweep(ctx: Ctx) -> DataFrame:
    """k = 2..10: inertia and silhouette (squared Euclidean) per k."""
    return segment.kmeans_sweep(ctx.features_scaled, SCALED_FEATURES, range(2, 11), seed=42)


@query("silhouette")
def q_silhouette(ctx: Ctx) -> DataFrame:
    """Silhouette of the seeded segmentation (squared Euclidean, Spark's evaluator)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    v = segment._vectors(ctx.segmented.withColumn("cluster", F.col("Segment_Order").cast("double")), SCALED_FEATURES)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(v)
    return ctx.spark.range(1).select(F.lit(sil).alias("silhouette_sq_euclidean"))


@query("pca_2d")
def q_pca_2d(ctx: Ctx) -> DataFrame:
    proj, ratios = segment.pca_2d(ctx.features_scaled, SCALED_FEATURES)
    return proj.withColumn("explained_1", F.lit(ratios[0])).withColumn("explained_2", F.lit(ratios[1]))


def _fit_and_score(ctx: Ctx, fit) -> DataFrame:
    tr, te = _train_test(ctx)
    model = fit(tr)
    return learn.score_model(model, te, MODEL_FEATURES).select("CustomerID", "Target", "prediction", "probability")


@query("logreg")
def q_logreg(ctx: Ctx) -> DataFrame:
    """Logistic regression (C=1, L2, no internal standardisation) scored on the hold-out."""
    return _fit_and_score(ctx, lambda tr: learn.logreg(tr, MODEL_FEATURES, C=1.0))


def _held_out(ctx: Ctx, name: str) -> DataFrame:
    from rfmspark.operators.model_store import predict
    test = ctx.split_flags.where(F.col("is_test"))
    return predict(ctx.trained[1].active_model(name), test).select("CustomerID", "Target", "prediction", "probability")


@query("trained_metrics")
def q_trained_metrics(ctx: Ctx) -> DataFrame:
    """Hold-out metrics and fold areas of the five trained models."""
    return ctx.trained[0].metrics.drop("model_order")


@query("random_forest")
def q_random_forest(ctx: Ctx) -> DataFrame:
    """The tuned forest of the training run, loaded from the store, on the hold-out."""
    return _held_out(ctx, "random_forest")


@query("gbt_base")
def q_gbt_base(ctx: Ctx) -> DataFrame:
    """Gradient-boosted trees, 150 rounds, step 0.05."""
    return _fit_and_score(ctx, lambda tr: learn.gbt(tr, MODEL_FEATURES, max_iter=150, max_depth=3, step=0.05))


@query("gbt_a")
def q_gbt_a(ctx: Ctx) -> DataFrame:
    """Tuned boosted trees with positive-class weighting, loaded from the store, on the hold-out."""
    return _held_out(ctx, "xgboost")


@query("gbt_b")
def q_gbt_b(ctx: Ctx) -> DataFrame:
    """Tuned boosted trees without weights, loaded from the store, on the hold-out."""
    return _held_out(ctx, "lightgbm")


@query("class_weight", with_ctes(f"""
SELECT CustomerID, Target, CASE WHEN Target = 1 THEN {r('CAST(count_if(Target = 0) OVER () AS DOUBLE) / count_if(Target = 1) OVER ()')}
                                ELSE 1.0 END AS weight FROM ho_flag WHERE NOT is_test""", "ho_flag"))
def q_class_weight(ctx: Ctx) -> DataFrame:
    tr = ctx.split_flags.where(~F.col("is_test"))
    return rounded(learn.class_weight(tr).select("CustomerID", "Target", "weight"))


@query("stratified_kfold", with_ctes("""
SELECT CustomerID, Target, CAST((row_number() OVER (PARTITION BY Target
         ORDER BY CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#42'), 1, 13) AS BIGINT)) - 1) % 3 AS INTEGER) AS fold
FROM ho_flag WHERE NOT is_test""", "ho_flag"))
def q_stratified_kfold(ctx: Ctx) -> DataFrame:
    return learn.stratified_kfold(ctx.split_flags.where(~F.col("is_test"))).select("CustomerID", "Target", "fold")


@query("cv_score")
def q_cv_score(ctx: Ctx) -> DataFrame:
    """3-fold ROC-AUC of logistic regression on the training set: mean and population std."""
    tr, _ = _train_test(ctx)
    return learn.cv_score(tr, lambda d: learn.logreg(d, MODEL_FEATURES, C=1.0), MODEL_FEATURES, k=3)


@query("random_search")
def q_random_search(ctx: Ctx) -> DataFrame:
    """Every point that the training run tried on the three grids: 3-fold ROC-AUC, balanced inside the folds (place 1 is best)."""
    return ctx.trained[0].search


@query("stacking")
def q_stacking(ctx: Ctx) -> DataFrame:
    """Five base learners -> out-of-fold probabilities (3 folds) -> logistic meta-learner; one stored pipeline, loaded and applied."""
    return _held_out(ctx, "stacking_ensemble")


@query("feature_importance")
def q_feature_importance(ctx: Ctx) -> DataFrame:
    tr, _ = _train_test(ctx)
    return learn.feature_importance(learn.random_forest(tr, MODEL_FEATURES, n_trees=100, max_depth=10), MODEL_FEATURES)


# ============================================================== neighbours, DBSCAN, Ward, SMOTE

from rfmspark.operators import neighbors as nbr  # noqa: E402

_KNN_SQL = f"""
SELECT a.CustomerID, b.CustomerID AS neighbor_id,
       {dist_sql(['a.' + x for x in SCALED], ['b.' + x for x in SCALED])} AS dist FROM scaled a, scaled b"""


@query("knn_self_join", with_ctes(f"""
SELECT CustomerID, CAST(rank AS INTEGER) AS rank, neighbor_id, {r('dist')} AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY dist, neighbor_id) AS rank FROM ({_KNN_SQL}))
WHERE rank <= 5""", "scaled"))
def q_knn_self_join(ctx: Ctx) -> DataFrame:
    """Five nearest customers in the scaled feature space (the customer itself first)."""
    return rounded(nbr.knn_self_join(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 5))


@query("k_distance", with_ctes(f"""
SELECT CustomerID, {r('dist')} AS k_distance FROM (
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY dist, neighbor_id) AS rank FROM ({_KNN_SQL}))
WHERE rank = 5""", "scaled"))
def q_k_distance(ctx: Ctx) -> DataFrame:
    return rounded(nbr.k_distance(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 5))


@query("eps_range_join", with_ctes(f"""
SELECT CustomerID, count(*) AS neighbors FROM ({_KNN_SQL}) WHERE dist <= 1.2 GROUP BY CustomerID""", "scaled"))
def q_eps_range_join(ctx: Ctx) -> DataFrame:
    """Customers within eps = 1.2 of each customer (counted, itself included)."""
    return nbr.eps_neighbor_counts(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 1.2)


@query("dbscan")
def q_dbscan(ctx: Ctx) -> DataFrame:
    """DBSCAN (eps 1.2, min_samples 5) on the scaled features."""
    return nbr.dbscan(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 1.2, 5)


@query("cluster_noise_stats")
def q_cluster_noise_stats(ctx: Ctx) -> DataFrame:
    return segment.cluster_noise_stats(nbr.dbscan(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 1.2, 5))


@query("hierarchical_ward")
def q_hierarchical_ward(ctx: Ctx) -> DataFrame:
    return segment.hierarchical_ward(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 4, 200)[0]


@query("ward_merge_table")
def q_ward_merge_table(ctx: Ctx) -> DataFrame:
    return segment.ward_merge_table(ctx.features_scaled, "CustomerID", SCALED_FEATURES, 30, 200)


@query("smote")
def q_smote(ctx: Ctx) -> DataFrame:
    """Training rows plus synthetic minority rows up to class parity."""
    tr, _ = _train_test(ctx)
    return learn.smote(tr, MODEL_FEATURES, "Target", "CustomerID", 5, 42)


# ============================================================== remaining projections

from rfmspark.schemas import SEGMENT_ACTIONS  # noqa: E402

_LIST8 = ["CustomerID", "Recency", "Frequency", "Monetary", "AvgOrderValue", "UniqueProducts", "ReturnRate", "Segment"]


@query("customer_list", with_ctes(f"""
SELECT CustomerID, Recency, Frequency, {rnd(['Monetary', 'AvgOrderValue'])}, UniqueProducts, {rnd(['ReturnRate'])}, Segment
FROM segmented""", "segmented"))
def q_customer_list(ctx: Ctx) -> DataFrame:
    return rounded(ctx.segmented.select(*_LIST8))


@query("feature_vector")
def q_feature_vector(ctx: Ctx) -> DataFrame:
    """The nine scaled model features assembled into one ML vector per customer."""
    return segment._vectors(ctx.features_scaled, SCALED_FEATURES).select("CustomerID", "features")


@query("drop_columns", with_ctes(f"SELECT {_F9_SQL} FROM scaled", "scaled"))
def q_drop_columns(ctx: Ctx) -> DataFrame:
    temp = [f"{c}_log" for c in ["Recency", "Frequency", "Monetary"]] + SCALED_FEATURES
    return rounded(clean.drop_columns(ctx.features_scaled, temp))


@query("segment_action", with_ctes("SELECT CustomerID, Segment, CASE Segment " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in SEGMENT_ACTIONS.items())
    + " END AS action FROM segmented", "segmented"))
def q_segment_action(ctx: Ctx) -> DataFrame:
    m = F.create_map(*[x for k, v in SEGMENT_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return ctx.segmented.select("CustomerID", "Segment", m[F.col("Segment")].alias("action"))


@query("drop_bad_dates", with_ctes("""
SELECT InvoiceNo, InvoiceDate FROM retail WHERE NOT starts_with(InvoiceNo, 'C')""", "retail"))
def q_drop_bad_dates(ctx: Ctx) -> DataFrame:
    """Dates as text, unreadable for returned lines: those rows are dropped after parsing."""
    t = ctx.retail(["InvoiceNo", "InvoiceDate"])
    txt = F.when(F.col("InvoiceNo").startswith("C"), F.lit("bad")).otherwise(F.date_format("InvoiceDate", "M/d/yyyy H:mm"))
    parsed = t.select("InvoiceNo", fn.fn_to_timestamp_safe(txt).alias("InvoiceDate"))
    return clean.drop_bad_dates(parsed)


@query("apply_scaler", with_ctes("SELECT CustomerID, " + ", ".join(
    f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}_scaled" for c in MODEL_FEATURES)
    + " FROM (SELECT *, ln(1 + Recency) AS Recency_log, ln(1 + Frequency) AS Frequency_log, "
      "ln(1 + Monetary) AS Monetary_log FROM supervised), scaler", "supervised", "scaler"))
def q_apply_scaler(ctx: Ctx) -> DataFrame:
    """Feature-period rows transformed with the stored full-data scaler parameters."""
    d = features.add_log_features(ctx.supervised)
    return rounded(features.apply_scaler(d, ctx.scaler_params, MODEL_FEATURES).select(
        "CustomerID", *SCALED_FEATURES))


@query("score_multi_model")
def q_score_multi_model(ctx: Ctx) -> DataFrame:
    """Label and probability of the five stored models per hold-out customer (one column pair each), in one projection."""
    from rfmspark.operators.model_store import predict
    from rfmspark.schemas import MODEL_PREFIX
    out = ctx.split_flags.where(F.col("is_test"))
    for name, p in MODEL_PREFIX.items():
        out = predict(ctx.trained[1].active_model(name), out, f"{p}_prob", f"{p}_pred")
    return out.select("CustomerID", "Target", *[f"{p}_{x}" for p in MODEL_PREFIX.values() for x in ("pred", "prob")])


@query("retrain_job")
def q_retrain_job(ctx: Ctx) -> DataFrame:
    """The retraining run as one job: clean -> features -> segments -> supervised set ->
    scorer and metrics -> gate -> registry -> drift; one status row per phase."""
    return jobs.retrain(ctx)


@query("retrain_pipeline", with_ctes("""
SELECT * FROM (VALUES (1, 'raw_subset', (SELECT count(*) FROM lineitem)), (2, 'clean', (SELECT count(*) FROM cleaned)),
    (3, 'features', (SELECT count(*) FROM features)), (4, 'segments', (SELECT count(*) FROM features)),
    (5, 'supervised', (SELECT count(*) FROM supervised)), (6, 'train', 2), (7, 'gate', 1), (8, 'registry', 2),
    (9, 'drift', (SELECT count(*) FROM drift_report))) t(phase_no, phase, rows), (SELECT 'completed' AS status)""",
                                     "cleaned", "features", "supervised", "drift_report"))
def q_retrain_pipeline(ctx: Ctx) -> DataFrame:
    """The resumable retraining run over the raw transactions, with the class-mean scorer and the baseline as candidates."""
    from rfmspark.operators import retrain
    return retrain.retrain_pipeline(ctx.raw_tx, files.scratch_table(ctx.spark, "retrain"), feature_months=FEATURE_MONTHS,
                                    train=retrain.linear_training, judged="class_mean_linear")


# ============================================================== one query per scalar function

from rfmspark.plans.sqlparts import _days  # noqa: E402

_ZERO = ["0.0"] * len(SCALED)
_FN_SPECS = {
    # name: (source, key columns, Spark column builder, SQL expression, sql source)
    "fn_recency_days": ("core", ["CustomerID"], lambda: fn.fn_recency_days("LastPurchase", "snapshot"),
                        _days("LastPurchase", "snapshot"), "rfm_core, snap"),
    "fn_lifetime_days": ("core", ["CustomerID"], lambda: fn.fn_lifetime_days("FirstPurchase", "LastPurchase"),
                         _days("FirstPurchase", "LastPurchase"), "rfm_core, snap"),
    "fn_avg_order_value": ("core", ["CustomerID"], lambda: fn.fn_avg_order_value("Monetary", "Frequency"),
                           r("Monetary / Frequency"), "rfm_core, snap"),
    "fn_purchase_freq_monthly": ("feat", ["CustomerID"], lambda: fn.fn_purchase_freq_monthly("Frequency", "CustomerLifetimeDays"),
                                 r("CAST(Frequency AS DOUBLE) / (CustomerLifetimeDays + 30) * 30.0"), "features"),
    "fn_avg_qty_per_order": ("core", ["CustomerID"], lambda: fn.fn_avg_qty_per_order("TotalQuantity", "Frequency"),
                             r("CAST(TotalQuantity AS DOUBLE) / Frequency"), "rfm_core, snap"),
    "fn_log1p": ("feat", ["CustomerID"], lambda: fn.fn_log1p("Monetary"), r("ln(1 + Monetary)"), "features"),
    "fn_month": ("clean", ["InvoiceNo", "StockCode"], lambda: fn.fn_month("InvoiceDate"),
                 "strftime(InvoiceDate, '%Y-%m')", "cleaned"),
    "fn_format_ts": ("clean", ["InvoiceNo", "StockCode"], lambda: fn.fn_format_ts("InvoiceDate"),
                     "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S')", "cleaned"),
    "fn_clean_customer_id": ("clean", ["InvoiceNo", "StockCode"],
                             lambda: fn.fn_clean_customer_id(F.concat(F.lit(" "), "CustomerID", F.lit(".0"))),
                             "trim(regexp_replace(' ' || CustomerID || '.0', '\\.0$', ''))", "cleaned"),
    "fn_id_float_to_str": ("clean", ["InvoiceNo", "StockCode"], lambda: fn.fn_id_float_to_str(F.col("CustomerID").cast("double")),
                           "CAST(CAST(CAST(CustomerID AS DOUBLE) AS BIGINT) AS VARCHAR)", "cleaned"),
    "fn_to_int_default": ("clean", ["InvoiceNo", "StockCode"],
                          lambda: fn.fn_to_int_default(F.when(F.col("Quantity") > 25, F.lit("n/a"))
                                                       .otherwise(F.col("UnitPrice").cast("string"))),
                          "CASE WHEN Quantity > 25 THEN 1 ELSE CAST(trunc(UnitPrice) AS INTEGER) END", "cleaned"),
    "fn_to_double_default": ("clean", ["InvoiceNo", "StockCode"],
                             lambda: fn.fn_to_double_default(F.when(F.col("Quantity") > 25, F.lit("abc"))
                                                             .otherwise(F.col("Quantity").cast("string"))),
                             "CASE WHEN Quantity > 25 THEN 0.0 ELSE CAST(Quantity AS DOUBLE) END", "cleaned"),
    "fn_to_timestamp_safe": ("clean", ["InvoiceNo", "StockCode"],
                             lambda: fn.fn_to_timestamp_safe(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")),
                             "InvoiceDate", "cleaned"),
    "fn_strip": ("clean", ["StockCode"], lambda: fn.fn_strip(F.concat(F.lit("  "), "InvoiceNo", F.lit(" "))),
                 "trim('  ' || InvoiceNo || ' ')", "cleaned"),
    "fn_startswith": ("raw", ["StockCode", "InvoiceNo"], lambda: fn.fn_startswith(F.col("InvoiceNo"), "C"),
                      "starts_with(InvoiceNo, 'C')", "retail"),
    "fn_truncate_label": ("full", ["InvoiceNo", "StockCode"], lambda: fn.fn_truncate_label("Description"),
                          "CASE WHEN length(Description) > 20 THEN substr(Description, 1, 20) || '...' ELSE Description END",
                          "cleaned"),
    "fn_title_case": ("seg", ["CustomerID"], lambda: fn.fn_title_case(F.regexp_replace(F.lower("Segment"), " ", "_")),
                      "list_aggr(list_transform(string_split(lower(Segment), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')",
                      "segmented"),
    "fn_l2_distance": ("seg", ["CustomerID"], lambda: fn.fn_l2_distance(F.array(*SCALED_FEATURES), F.array(*[F.lit(0.0)] * 9)),
                       r(dist_sql(SCALED, _ZERO)), "segmented"),
    "fn_psi_term": ("feat", ["CustomerID"], lambda: fn.fn_psi_term(F.col("ReturnRate") + 0.01, F.lit(0.5)),
                    r("((ReturnRate + 0.01) - 0.5) * ln((ReturnRate + 0.01) / 0.5)"), "features"),
    "fn_psi_status": ("feat", ["CustomerID"], lambda: fn.fn_psi_status(F.col("ReturnRate")),
                      "CASE WHEN ReturnRate < 0.1 THEN 'Stable' WHEN ReturnRate <= 0.25 THEN 'Monitor' ELSE 'Retrain Alert' END",
                      "features"),
    "fn_clip": ("clean", ["InvoiceNo", "StockCode"], lambda: fn.fn_clip(F.col("Quantity"), 5, 40),
                "least(greatest(Quantity, 5), 40)", "cleaned"),
    "fn_round": ("feat", ["CustomerID"], lambda: fn.fn_round_half_even(F.col("Monetary"), 0), "round_even(Monetary, 0)",
                 "features"),
    "fn_influence": ("seg", ["CustomerID"], lambda: fn.fn_influence(F.col("Recency_log_scaled")),
                     "CASE WHEN Recency_log_scaled > 0 THEN 'positive' ELSE 'negative' END", "segmented"),
    "fn_to_json": ("feat", ["CustomerID"], lambda: fn.fn_to_json("CustomerID", "Frequency", "UniqueProducts"),
                   "CAST(to_json({'CustomerID': CustomerID, 'Frequency': Frequency, 'UniqueProducts': UniqueProducts}) AS VARCHAR)",
                   "features"),
    "fn_from_json": ("feat", ["CustomerID"],
                     lambda: fn.fn_from_json(fn.fn_to_json("Frequency", "UniqueProducts"),
                                             "Frequency bigint, UniqueProducts bigint")["UniqueProducts"],
                     "UniqueProducts", "features"),
}


def _fn_source(ctx: Ctx, kind: str) -> DataFrame:
    if kind == "core":
        return features.rfm_core(ctx.cleaned).crossJoin(features.snapshot_date(ctx.cleaned))
    if kind == "feat":
        return ctx.features
    if kind == "clean":
        return ctx.cleaned
    if kind == "full":
        return ctx.cleaned_full
    if kind == "raw":
        return ctx.retail(["InvoiceNo", "StockCode"])
    return ctx.segmented


def _register_fn(name: str, spec) -> None:
    kind, keys, build, sql_expr, src = spec
    needed = [x.strip() for x in src.split(",")]

    def run(ctx: Ctx) -> DataFrame:
        return rounded(_fn_source(ctx, kind).select(*keys, build().alias("value")))
    run.__name__ = f"q_{name}"
    run.__doc__ = f"Scalar function {name} applied to every row."
    REGISTRY[name] = (run, with_ctes(f"SELECT {', '.join(keys)}, {sql_expr} AS value FROM {src}", *needed))


for _n, _spec in _FN_SPECS.items():
    _register_fn(_n, _spec)


@query("fn_split_date", with_ctes("SELECT split FROM sup_split", "sup_split"))
def q_fn_split_date(ctx: Ctx) -> DataFrame:
    return learn.split_date(ctx.cleaned, FEATURE_MONTHS)


@query("shap_values_tree")
def q_shap_values_tree(ctx: Ctx) -> DataFrame:
    """Exact path-dependent Shapley contributions of the boosted-tree model (150 rounds,
    depth 3) for every hold-out customer; base + contributions = margin."""
    tr, te = _train_test(ctx)
    model = learn.gbt(tr, MODEL_FEATURES, max_iter=150, max_depth=3, step=0.05)
    return explain.tree_contributions(te, model, MODEL_FEATURES)

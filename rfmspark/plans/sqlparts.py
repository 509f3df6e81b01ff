"""Independent ANSI SQL (DuckDB dialect) for the oracle check.

Each named CTE lists the CTEs it reads; :func:`with_ctes` emits them in
dependency order. These are hand-written twins of the DataFrame code, not a
translation layer: the DataFrame side never reads them.
"""

from __future__ import annotations

from rfmspark.schemas import FEATURES, MODEL_FEATURES

MICROS_PER_DAY = "86400000000.0"


def _days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / {MICROS_PER_DAY}) AS BIGINT)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("retail", [], """
SELECT (CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(o.o_orderkey AS VARCHAR) AS InvoiceNo,
       CAST(l.l_partkey AS VARCHAR) AS StockCode,
       p.p_name AS Description,
       CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER) AS Quantity,
       o.o_orderdate AS InvoiceDate,
       l.l_extendedprice / l.l_quantity AS UnitPrice,
       CAST(o.o_custkey AS VARCHAR) AS CustomerID,
       cn.n_name AS Country
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN (SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey) cn
       ON o.o_custkey = cn.c_custkey""")

cte("pre_clean", ["retail"], """
SELECT * REPLACE (trim(InvoiceNo) AS InvoiceNo), Quantity * UnitPrice AS TotalPrice
FROM retail
WHERE CustomerID IS NOT NULL AND NOT coalesce(starts_with(trim(InvoiceNo), 'C'), false)
  AND Quantity > 0 AND UnitPrice > 0""")

cte("qty_bounds", ["pre_clean"], """
SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM (SELECT quantile_cont(Quantity, 0.25) AS q1, quantile_cont(Quantity, 0.75) AS q3 FROM pre_clean)""")

cte("after_qty", ["pre_clean", "qty_bounds"], """
SELECT pre_clean.* FROM pre_clean, qty_bounds WHERE Quantity >= lo AND Quantity <= hi""")

cte("tp_bounds", ["after_qty"], """
SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM (SELECT quantile_cont(TotalPrice, 0.25) AS q1, quantile_cont(TotalPrice, 0.75) AS q3 FROM after_qty)""")

cte("cleaned", ["after_qty", "tp_bounds"], """
SELECT after_qty.* FROM after_qty, tp_bounds WHERE TotalPrice >= lo AND TotalPrice <= hi""")

cte("snap", ["cleaned"], "SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot FROM cleaned")

cte("rfm_core", ["cleaned"], """
SELECT CustomerID, max(InvoiceDate) AS LastPurchase, min(InvoiceDate) AS FirstPurchase,
       count(DISTINCT InvoiceNo) AS Frequency, CAST(sum(CAST(TotalPrice AS DECIMAL(38, 4))) AS DOUBLE) AS Monetary,
       CAST(sum(Quantity) AS BIGINT) AS TotalQuantity, count(DISTINCT StockCode) AS UniqueProducts
FROM cleaned GROUP BY CustomerID""")

cte("return_rate", ["retail"], """
SELECT CustomerID,
       coalesce(CAST(count(DISTINCT CASE WHEN starts_with(trim(InvoiceNo), 'C') THEN trim(InvoiceNo) END) AS DOUBLE)
                / nullif(count(DISTINCT trim(InvoiceNo)), 0), 0.0) AS ReturnRate
FROM retail WHERE CustomerID IS NOT NULL GROUP BY CustomerID""")

cte("features", ["rfm_core", "snap", "return_rate"], f"""
SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, UniqueProducts, ReturnRate,
       CustomerLifetimeDays, CAST(Frequency AS DOUBLE) / (CustomerLifetimeDays + 30) * 30.0 AS PurchaseFrequencyMonthly,
       AvgQuantityPerOrder
FROM (
  SELECT c.CustomerID, {_days('c.LastPurchase', 's.snapshot')} AS Recency, c.Frequency, c.Monetary,
         c.Monetary / c.Frequency AS AvgOrderValue, c.UniqueProducts, coalesce(r.ReturnRate, 0.0) AS ReturnRate,
         {_days('c.FirstPurchase', 'c.LastPurchase')} AS CustomerLifetimeDays,
         CAST(c.TotalQuantity AS DOUBLE) / c.Frequency AS AvgQuantityPerOrder
  FROM rfm_core c CROSS JOIN snap s LEFT JOIN return_rate r ON c.CustomerID = r.CustomerID)""")

cte("features_log", ["features"], """
SELECT *, ln(1 + Recency) AS Recency_log, ln(1 + Frequency) AS Frequency_log, ln(1 + Monetary) AS Monetary_log
FROM features""")

_scaler_aggs = ",\n       ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}"
                                for c in MODEL_FEATURES)
cte("scaler", ["features_log"], f"SELECT {_scaler_aggs} FROM features_log")

_scaled_cols = ",\n       ".join(f"({c} - m_{c}) / s_{c} AS {c}_scaled" for c in MODEL_FEATURES)
cte("scaled", ["features_log", "scaler"], f"""
SELECT features_log.*,
       {_scaled_cols}
FROM features_log CROSS JOIN scaler""")


def with_ctes(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def r(expr: str, n: int = 4) -> str:
    """Half-up rounding as IEEE arithmetic (same formula as the DataFrame side)."""
    return f"(floor(({expr}) * {10 ** n}.0 + 0.5001) / {10 ** n}.0)"


def rnd(cols: list[str], n: int = 4) -> str:
    return ", ".join(f"{r(c, n)} AS {c}" for c in cols)


F9_DOUBLES = ["Monetary", "AvgOrderValue", "ReturnRate", "PurchaseFrequencyMonthly", "AvgQuantityPerOrder"]
F9_INTS = [c for c in FEATURES if c not in F9_DOUBLES]


# ------------------------------------------------------------------ helpers for generated columns

SCALED = [f"{c}_scaled" for c in MODEL_FEATURES]


def dist_sql(xs: list[str], cs: list[str]) -> str:
    """Euclidean distance summed left to right from 0.0 (same order as the DataFrame fold)."""
    acc = "0.0"
    for x, c in zip(xs, cs):
        acc = f"({acc} + ({x} - {c}) * ({x} - {c}))"
    return f"sqrt({acc})"


def labels_sql(src: str, cluster: str) -> str:
    return f"""
SELECT {cluster}, CASE WHEN pos = 1 THEN 'Champions' WHEN pos = k THEN 'Lost Customers'
                   WHEN rpos = 1 THEN 'At-Risk' ELSE 'Loyal Customers' END AS Segment
FROM (SELECT *, row_number() OVER (PARTITION BY (pos > 1 AND pos < k) ORDER BY r DESC, pos DESC) AS rpos
      FROM (SELECT *, row_number() OVER (ORDER BY m DESC, {cluster}) AS pos, count(*) OVER () AS k
            FROM (SELECT {cluster}, avg(Monetary) AS m, avg(Recency) AS r FROM {src} GROUP BY {cluster})))"""


SEG_ORDER_SQL = ("CASE {c} WHEN 'Lost Customers' THEN 0 WHEN 'At-Risk' THEN 1 WHEN 'Loyal Customers' THEN 2 "
                 "WHEN 'Champions' THEN 3 END")


def features_sql(core: str, rr: str, asof_from: str, asof_col: str) -> str:
    return f"""
SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, UniqueProducts, ReturnRate,
       CustomerLifetimeDays, CAST(Frequency AS DOUBLE) / (CustomerLifetimeDays + 30) * 30.0 AS PurchaseFrequencyMonthly,
       AvgQuantityPerOrder
FROM (
  SELECT c.CustomerID, {_days('c.LastPurchase', 's.' + asof_col)} AS Recency, c.Frequency, c.Monetary,
         c.Monetary / c.Frequency AS AvgOrderValue, c.UniqueProducts, coalesce(r.ReturnRate, 0.0) AS ReturnRate,
         {_days('c.FirstPurchase', 'c.LastPurchase')} AS CustomerLifetimeDays,
         CAST(c.TotalQuantity AS DOUBLE) / c.Frequency AS AvgQuantityPerOrder
  FROM {core} c CROSS JOIN {asof_from} s LEFT JOIN {rr} r ON c.CustomerID = r.CustomerID)"""


# ------------------------------------------------------------------ seeded segmentation (T5)

cte("seg_base", ["scaled"], f"SELECT *, {r('Monetary', 2)} AS _mc FROM scaled")
cte("seg_q", ["seg_base"], """
SELECT quantile_cont(_mc, 0.25) AS q0, quantile_cont(_mc, 0.5) AS q1, quantile_cont(_mc, 0.75) AS q2 FROM seg_base""")
cte("seeded", ["seg_base", "seg_q"], """
SELECT seg_base.*, CASE WHEN _mc <= q0 THEN 0 WHEN _mc <= q1 THEN 1 WHEN _mc <= q2 THEN 2 ELSE 3 END AS Seed_Cluster
FROM seg_base, seg_q""")
cte("seed_labels", ["seeded"], labels_sql("seeded", "Seed_Cluster"))
cte("seed_first", ["seeded", "seed_labels"], """
SELECT seeded.*, l.Segment AS seed_segment FROM seeded JOIN seed_labels l USING (Seed_Cluster)""")
cte("seed_cents", ["seed_first"], "SELECT seed_segment AS Segment, "
    + ", ".join(f"avg({c}) AS {c}" for c in SCALED) + " FROM seed_first GROUP BY seed_segment")
cte("segmented", ["seed_first", "seed_cents"], f"""
SELECT * EXCLUDE (rn, _d), {SEG_ORDER_SQL.format(c='Segment')} AS Segment_Order FROM (
  SELECT f.* EXCLUDE (seed_segment, _mc), c.Segment,
         {dist_sql(['f.' + x for x in SCALED], ['c.' + x for x in SCALED])} AS _d,
         row_number() OVER (PARTITION BY f.CustomerID
                            ORDER BY {dist_sql(['f.' + x for x in SCALED], ['c.' + x for x in SCALED])}, c.Segment) AS rn
  FROM seed_first f CROSS JOIN seed_cents c) WHERE rn = 1""")
cte("seg_cents", ["segmented"], "SELECT Segment, "
    + ", ".join(f"avg({c}) AS {c}" for c in SCALED) + " FROM segmented GROUP BY Segment")

# ------------------------------------------------------------------ supervised dataset (T6)

FEATURE_MONTHS = 70

cte("sup_split", ["cleaned"], f"SELECT min(InvoiceDate) + INTERVAL {FEATURE_MONTHS} MONTH AS split FROM cleaned")
cte("sup_core", ["cleaned", "sup_split"], """
SELECT CustomerID, max(InvoiceDate) AS LastPurchase, min(InvoiceDate) AS FirstPurchase,
       count(DISTINCT InvoiceNo) AS Frequency, CAST(sum(CAST(TotalPrice AS DECIMAL(38, 4))) AS DOUBLE) AS Monetary,
       CAST(sum(Quantity) AS BIGINT) AS TotalQuantity, count(DISTINCT StockCode) AS UniqueProducts
FROM cleaned, sup_split WHERE InvoiceDate < split GROUP BY CustomerID""")
cte("sup_rr", ["retail", "sup_split"], """
SELECT CustomerID,
       coalesce(CAST(count(DISTINCT CASE WHEN starts_with(trim(InvoiceNo), 'C') THEN trim(InvoiceNo) END) AS DOUBLE)
                / nullif(count(DISTINCT trim(InvoiceNo)), 0), 0.0) AS ReturnRate
FROM retail, sup_split WHERE CustomerID IS NOT NULL AND InvoiceDate < split GROUP BY CustomerID""")
cte("sup_target", ["cleaned", "sup_split"], "SELECT DISTINCT CustomerID FROM cleaned, sup_split WHERE InvoiceDate >= split")
cte("sup_features", ["sup_core", "sup_rr", "sup_split"], features_sql("sup_core", "sup_rr", "sup_split", "split"))
cte("supervised", ["sup_features", "sup_target"], """
SELECT f.*, CASE WHEN t.CustomerID IS NOT NULL THEN 1 ELSE 0 END AS Target
FROM sup_features f LEFT JOIN sup_target t ON f.CustomerID = t.CustomerID""")

# ------------------------------------------------------------------ hold-out split and class-mean scorer

cte("ho_flag", ["supervised"], """
SELECT * EXCLUDE (_h), row_number() OVER (PARTITION BY Target ORDER BY _h)
                       <= floor(count(*) OVER (PARTITION BY Target) * 0.2 + 0.5) AS is_test
FROM (SELECT *, CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#42'), 1, 13) AS BIGINT) AS _h FROM supervised)""")
cte("ho_log", ["ho_flag"], """
SELECT *, ln(1 + Recency) AS Recency_log, ln(1 + Frequency) AS Frequency_log, ln(1 + Monetary) AS Monetary_log
FROM ho_flag""")
cte("ho_scaler", ["ho_log"], "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in MODEL_FEATURES)
    + " FROM ho_log WHERE NOT is_test")
cte("ho_scaled", ["ho_log", "ho_scaler"], "SELECT CustomerID, Target, is_test, " + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in MODEL_FEATURES) + " FROM ho_log, ho_scaler")
cte("ho_means", ["ho_scaled"], "SELECT " + ", ".join(
    f"avg(CASE WHEN Target = 1 THEN {c} END) AS p_{c}, avg(CASE WHEN Target = 0 THEN {c} END) AS n_{c}"
    for c in MODEL_FEATURES) + " FROM ho_scaled WHERE NOT is_test")
_b = " + ".join(f"(p_{c} - n_{c}) * (p_{c} + n_{c})" for c in MODEL_FEATURES)
cte("ho_w", ["ho_means"], "SELECT " + ", ".join(f"p_{c} - n_{c} AS w_{c}" for c in MODEL_FEATURES)
    + f", -({_b}) / 2.0 AS w0 FROM ho_means")
_margin = "w0" + "".join(f" + w_{c} * {c}" for c in MODEL_FEATURES)
cte("ho_scored", ["ho_scaled", "ho_w"], f"""
SELECT CustomerID, Target, margin, 1.0 / (1.0 + exp(-margin)) AS probability, CAST(margin > 0 AS INTEGER) AS prediction
FROM (SELECT s.*, {_margin} AS margin FROM ho_scaled s, ho_w WHERE is_test)""")
cte("ho_baseline", ["ho_flag"], """
SELECT f.CustomerID, f.Target, b.maj AS prediction, b.p1 AS probability
FROM ho_flag f, (SELECT CAST(count_if(Target = 1) * 2 > count(*) AS INTEGER) AS maj,
                        count_if(Target = 1) / count(*) AS p1 FROM ho_flag WHERE NOT is_test) b
WHERE f.is_test""")


def cum_sql(scored: str) -> str:
    """Distinct scores with counts and running sums in descending score order."""
    return f"""
SELECT t, pos, neg,
       sum(pos) OVER (ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
       sum(neg) OVER (ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
       sum(pos) OVER () AS P, sum(neg) OVER () AS N
FROM (SELECT probability AS t, count_if(Target = 1) AS pos, count_if(Target <> 1) AS neg FROM {scored} GROUP BY probability)"""


def metrics_sql(scored: str) -> str:
    """One row: accuracy, precision, recall, f1_score, roc_auc, pr_auc, mcc over a scored table."""
    return f"""
SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
       auc.roc_auc, pr.pr_auc,
       CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
            ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
                 / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
FROM (SELECT count_if(Target = 1 AND prediction = 1) AS tp, count_if(Target = 0 AND prediction = 1) AS fp,
             count_if(Target = 1 AND prediction = 0) AS fn, count_if(Target = 0 AND prediction = 0) AS tn
      FROM {scored}) c,
     (SELECT sum(pos * (cum_neg_asc - neg) + pos * neg * 0.5) / (sum(pos) * sum(neg)) AS roc_auc
      FROM (SELECT *, sum(neg) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg_asc
            FROM (SELECT probability AS t, count_if(Target = 1) AS pos, count_if(Target <> 1) AS neg
                  FROM {scored} GROUP BY probability))) auc,
     (SELECT sum((CAST(cum_pos AS DOUBLE) / P - CAST(cum_pos - pos AS DOUBLE) / P)
                 * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg)
                    + coalesce(CAST(cum_pos - pos AS DOUBLE) / nullif(cum_pos - pos + cum_neg - neg, 0), 1.0)) / 2) AS pr_auc
      FROM ({cum_sql(scored)}) x
      WHERE t >= (SELECT max(t) FROM ({cum_sql(scored)}) y WHERE cum_pos = P)) pr"""


cte("model_metrics", ["ho_scored", "ho_baseline"], f"""
SELECT 'class_mean_linear' AS model, 0 AS model_order, m.*, CAST(NULL AS DOUBLE) AS cv_roc_auc_mean,
       CAST(NULL AS DOUBLE) AS cv_roc_auc_std FROM ({metrics_sql('ho_scored')}) m
UNION ALL
SELECT 'baseline_majority', 1, b.*, 0.5, 0.0 FROM ({metrics_sql('ho_baseline')}) b""")

# ------------------------------------------------------------------ drift between the feature period and now


def long_sql(src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in FEATURES)


_PCTS = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"
cte("drift_ref", ["supervised"], long_sql("supervised"))
cte("drift_prod", ["features"], long_sql("features"))
cte("drift_edges", ["drift_ref"], f"""
SELECT feature, CASE WHEN len(e) < 2 THEN e
                     ELSE list_concat([e[1] - 1e-5], e[2:len(e) - 1], [e[len(e)] + 1e-5]) END AS edges, len(e) AS n_edges
FROM (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PCTS}))) AS e FROM drift_ref GROUP BY feature)""")


def hist_sql(src: str) -> str:
    return f"""
SELECT feature, CASE WHEN n_edges >= 2 AND value >= edges[1] AND value <= edges[n_edges] THEN
                  CASE WHEN value = edges[n_edges] THEN n_edges - 2 ELSE len(list_filter(edges, lambda x: x <= value)) - 1 END
                ELSE -1 END AS bin, count(*) AS cnt
FROM {src} JOIN drift_edges USING (feature) GROUP BY ALL"""


cte("drift_he", ["drift_ref", "drift_edges"], hist_sql("drift_ref"))
cte("drift_ha", ["drift_prod", "drift_edges"], hist_sql("drift_prod"))
cte("drift_psi", ["drift_he", "drift_ha", "drift_edges"], """
SELECT d.feature, coalesce(p.psi_value, 0.0) AS psi_value FROM drift_edges d LEFT JOIN (
  SELECT feature, sum((a - e) * ln(a / e)) AS psi_value FROM (
    SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS e, a / sum(a) OVER (PARTITION BY feature) AS a FROM (
      SELECT g.feature,
             CASE WHEN coalesce(he.cnt, 0) = 0 THEN 1e-4 ELSE he.cnt / ne.n END AS e,
             CASE WHEN coalesce(ha.cnt, 0) = 0 THEN 1e-4 ELSE ha.cnt / na.n END AS a
      FROM (SELECT feature, unnest(range(0, n_edges - 1)) AS bin FROM drift_edges WHERE n_edges >= 2) g
      LEFT JOIN drift_he he ON he.feature = g.feature AND he.bin = g.bin
      LEFT JOIN drift_ha ha ON ha.feature = g.feature AND ha.bin = g.bin
      JOIN (SELECT feature, sum(cnt) AS n FROM drift_he GROUP BY feature) ne ON ne.feature = g.feature
      LEFT JOIN (SELECT feature, sum(cnt) AS n FROM drift_ha GROUP BY feature) na ON na.feature = g.feature))
  GROUP BY feature) p ON d.feature = p.feature""")
cte("drift_report", ["drift_psi", "drift_ref", "drift_prod"], """
SELECT *, CASE max(CASE status WHEN 'Stable' THEN 0 WHEN 'Monitor' THEN 1 ELSE 2 END) OVER ()
            WHEN 0 THEN 'Stable' WHEN 1 THEN 'Monitor' ELSE 'Retrain Alert' END AS overall_status
FROM (SELECT p.feature, p.psi_value,
             CASE WHEN p.psi_value < 0.1 THEN 'Stable' WHEN p.psi_value <= 0.25 THEN 'Monitor' ELSE 'Retrain Alert' END AS status,
             a.training_mean, b.production_mean
      FROM drift_psi p
      JOIN (SELECT feature, avg(value) AS training_mean FROM drift_ref GROUP BY feature) a USING (feature)
      JOIN (SELECT feature, avg(value) AS production_mean FROM drift_prod GROUP BY feature) b USING (feature))""")


# ------------------------------------------------------------------ batch scoring and the prediction log (T7)


def score_sql(src: str) -> str:
    """Score a table with F9 columns: segment by nearest centroid in the full-data scaled
    space, class-mean scorer on the training scaler. Adds Predicted_* columns."""
    seg = [f"({c} - m_{c}) / s_{c}" for c in MODEL_FEATURES]
    d = dist_sql(seg, [f"c.{x}" for x in SCALED])
    mdl = "w0" + "".join(f" + w_{c} * ((t.{c} - hs.m_{c}) / hs.s_{c})" for c in MODEL_FEATURES)
    return f"""
SELECT t.* EXCLUDE (Recency_log, Frequency_log, Monetary_log), n.Predicted_Segment,
       CAST(({mdl}) > 0 AS INTEGER) AS Predicted_Purchase_Label,
       1.0 / (1.0 + exp(-({mdl}))) AS Purchase_Probability
FROM (SELECT *, ln(1 + Recency) AS Recency_log, ln(1 + Frequency) AS Frequency_log, ln(1 + Monetary) AS Monetary_log
      FROM {src}) t
JOIN (SELECT CustomerID, Segment AS Predicted_Segment FROM (
        SELECT x.CustomerID, c.Segment, row_number() OVER (PARTITION BY x.CustomerID ORDER BY {d}, c.Segment) AS rn
        FROM (SELECT *, ln(1 + Recency) AS Recency_log, ln(1 + Frequency) AS Frequency_log,
                     ln(1 + Monetary) AS Monetary_log FROM {src}) x, scaler, seg_cents c) WHERE rn = 1) n
  ON t.CustomerID = n.CustomerID
CROSS JOIN ho_scaler hs CROSS JOIN ho_w"""


_LOG_FEATS = ", ".join(f"CAST({k} AS DOUBLE) AS {v}" for k, v in [
    ("Recency", "recency"), ("Frequency", "frequency"), ("Monetary", "monetary"), ("AvgOrderValue", "avg_order_value"),
    ("UniqueProducts", "unique_products"), ("ReturnRate", "return_rate"),
    ("CustomerLifetimeDays", "customer_lifetime_days"), ("PurchaseFrequencyMonthly", "purchase_frequency_monthly"),
    ("AvgQuantityPerOrder", "avg_quantity_per_order")])
_PAIRS = ", ".join(f"Predicted_Purchase_Label AS {p}_pred, Purchase_Probability AS {p}_prob"
                   for p in ["lr", "rf", "xgb", "lgb", "stacking"])

cte("log_run1", ["supervised"], "SELECT " + ", ".join(["CustomerID"] + list(FEATURES)) + " FROM supervised")
cte("log_run2", ["features", "ho_flag"], "SELECT " + ", ".join(["f.CustomerID"] + [f"f.{c}" for c in FEATURES])
    + " FROM features f JOIN ho_flag h ON f.CustomerID = h.CustomerID WHERE h.is_test")
cte("prediction_log", ["log_run1", "log_run2", "scaler", "seg_cents", "ho_scaler", "ho_w", "sup_split", "snap"], f"""
SELECT CAST(CustomerID AS BIGINT) * 2 AS id, (SELECT split FROM sup_split) AS timestamp, CustomerID AS customer_id,
       {_LOG_FEATS}, Predicted_Segment AS predicted_segment, {_PAIRS}
FROM ({score_sql('log_run1')})
UNION ALL
SELECT CAST(CustomerID AS BIGINT) * 2 + 1, (SELECT snapshot FROM snap), CustomerID,
       {_LOG_FEATS}, Predicted_Segment, {_PAIRS}
FROM ({score_sql('log_run2')})""")


# ------------------------------------------------------------------ drift log (T8) and model registry (T9)

FEATURE_POS_SQL = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATURES)) + " END"

cte("drift_log", ["drift_report", "drift_ref", "sup_split", "snap"], f"""
SELECT CAST(1 + {FEATURE_POS_SQL} AS BIGINT) AS id, (SELECT split FROM sup_split) AS timestamp, feature AS feature_name,
       0.0 AS psi_value, 'Stable' AS status, avg(value) AS training_mean, avg(value) AS production_mean
FROM drift_ref GROUP BY feature
UNION ALL
SELECT CAST(1 + {len(FEATURES)} + {FEATURE_POS_SQL} AS BIGINT), (SELECT snapshot FROM snap), feature, psi_value, status, training_mean,
       production_mean FROM drift_report""")

cte("gate", ["model_metrics"], """
SELECT NOT (new_auc < 0.55) AND NOT (new_auc < old_auc - 0.05) AS accepted
FROM (SELECT coalesce((SELECT max(roc_auc) FROM model_metrics WHERE model = 'class_mean_linear'), 0.0) AS new_auc,
             coalesce((SELECT max(roc_auc) FROM model_metrics WHERE model = 'baseline_majority'), 0.5) AS old_auc)""")

cte("registry", ["model_metrics", "gate", "sup_split", "snap"], """
SELECT CAST(1 AS BIGINT) AS id, (SELECT split FROM sup_split) AS timestamp, model AS model_name, 'models/baseline_majority.pkl' AS filepath,
       accuracy, roc_auc, f1_score, mcc, CASE WHEN (SELECT accepted FROM gate) THEN 0 ELSE 1 END AS is_active
FROM model_metrics WHERE model = 'baseline_majority'
UNION ALL
SELECT 2, (SELECT snapshot FROM snap), model,
       CASE WHEN (SELECT accepted FROM gate) THEN 'models/' || model || '_' || strftime((SELECT snapshot FROM snap), '%Y%m%d_%H%M%S') || '.pkl'
            ELSE 'HEALTH_CHECK_FAILED' END,
       accuracy, roc_auc, f1_score, mcc, CASE WHEN (SELECT accepted FROM gate) THEN 1 ELSE 0 END
FROM model_metrics WHERE model = 'class_mean_linear'""")


# ------------------------------------------------------------------ replayed hold-out stream

cte("replay", ["supervised", "ho_flag"], "SELECT " + ", ".join(["s.CustomerID"] + [f"s.{c}" for c in FEATURES])
    + ", s.Target, CAST(s.CustomerID AS BIGINT) AS seq FROM supervised s JOIN ho_flag h ON s.CustomerID = h.CustomerID"
    " WHERE h.is_test")
cte("replay_scored", ["replay", "scaler", "seg_cents", "ho_scaler", "ho_w"],
    "SELECT *, CAST(Predicted_Purchase_Label = Target AS INTEGER) AS correct FROM (" + score_sql("replay") + ")")


# ------------------------------------------------------------------ linear contributions on the hold-out

_base = "w0" + "".join(f" + w_{c} * m_{c}" for c in MODEL_FEATURES)
_tm = ", ".join(f"avg({c}) AS m_{c}" for c in MODEL_FEATURES)
cte("ho_contrib", ["ho_scaled", "ho_w"], f"""
SELECT s.CustomerID, {_base} AS base_value, {_margin} AS margin,
       {", ".join(f"w_{c} * (s.{c} - m_{c}) AS contrib_{c}" for c in MODEL_FEATURES)}
FROM ho_scaled s, ho_w, (SELECT {_tm} FROM ho_scaled WHERE NOT is_test) tm WHERE s.is_test""")
cte("ho_contrib_long", ["ho_contrib"], " UNION ALL ".join(
    f"SELECT CustomerID, {i} AS pos, '{c}' AS feature, contrib_{c} AS value FROM ho_contrib"
    for i, c in enumerate(MODEL_FEATURES)))

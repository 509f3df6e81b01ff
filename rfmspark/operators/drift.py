"""Population Stability Index and drift report.

All features are handled in one pass over an unpivoted (feature, value) table:
bin edges are exact per-feature percentiles of the reference sample (one
bounded array per feature, broadcast), each value of both samples finds its bin
with an array expression in the same pass, and PSI is array arithmetic over the
small per-feature count table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_psi_status, fn_psi_term
from rfmspark.operators.stats import exact_quantiles, stack_columns
from rfmspark.schemas import FEATURES, PSI_EDGE_PAD, PSI_EPS, STATUS_RANK


def psi_bin_edges(ref_long: DataFrame, bins: int = 10) -> DataFrame:
    """Per feature: the bins+1 linear percentiles of the reference, de-duplicated and
    sorted; the first lowered and the last raised by 1e-5. (feature, edges, n_edges)"""
    q = exact_quantiles(ref_long, "value", [i / bins for i in range(bins + 1)], ["feature"])
    e = q.groupBy("feature").agg(F.array_sort(F.collect_set("q")).alias("_e"))
    m = F.size("_e")
    edges = F.when(m < 2, F.col("_e")).otherwise(F.concat(
        F.array(F.element_at("_e", 1) - F.lit(PSI_EDGE_PAD)),
        F.slice("_e", 2, F.greatest(m - 2, F.lit(0))),
        F.array(F.element_at("_e", -1) + F.lit(PSI_EDGE_PAD))))
    return e.select("feature", edges.alias("edges"), m.alias("n_edges"))


def histogram_by_edges(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per (feature, bin): bins are half-open [e_i, e_i+1), the last one closed;
    values outside the edges are dropped. Also returns the sample size n per feature
    (values outside still count in n)."""
    j = long.join(F.broadcast(edges), "feature")  # one row per feature, <= bins+1 edges each
    b = j.select("feature", _bin_index(F.col("n_edges"), F.col("value")).alias("bin"))  # -1: outside the edges
    return b.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))


def _bin_index(m, value) -> Column:
    """Bin of ``value`` for the broadcast ``edges``/``n_edges`` columns: half-open bins,
    the last one closed, -1 outside the edges (or when there are fewer than two)."""
    idx = F.size(F.filter("edges", lambda e: e <= value)) - 1
    idx = F.when(value == F.element_at("edges", -1), m - 2).otherwise(idx)
    valid = (m >= 2) & (value >= F.element_at("edges", 1)) & (value <= F.element_at("edges", -1))
    return F.when(valid, idx).otherwise(F.lit(-1))


def psi_summary(ref: DataFrame, prod: DataFrame, cols: list[str] | None = None, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """One row per feature with reference edges: (feature, psi_value, training_mean,
    production_mean, n_a). Both samples are binned in a single pass (the edges, at most
    bins+1 per feature, are broadcast) into a count table of at most
    features x 2 x (bins+1) rows; shares, the 1e-4 floor for empty bins, the
    renormalisation and the PSI sum are array expressions on that feature's row. ``edges`` are those of
    ``psi_bin_edges`` for the reference, if they are known."""
    cols = cols or FEATURES
    edges = psi_bin_edges(stack_columns(ref, cols), bins) if edges is None else edges
    both = stack_columns(ref, cols).withColumn("side", F.lit("e")).unionByName(
        stack_columns(prod, cols).withColumn("side", F.lit("a")))
    counts = (both.join(F.broadcast(edges), "feature")
              .select("feature", "side", "value", _bin_index(F.col("n_edges"), F.col("value")).alias("bin"))
              .groupBy("feature", "side", "bin")
              .agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("s"), F.count("value").alias("nv")))

    def on(side, c):
        return F.when(F.col("side") == side, F.col(c))

    def bin_counts(side):
        return F.map_from_entries(F.collect_list(F.when((F.col("side") == side) & (F.col("bin") >= 0),
                                                        F.struct(F.col("bin"), F.col("c")))))
    per = counts.groupBy("feature").agg(
        F.sum(on("e", "c")).alias("n_e"), F.sum(on("a", "c")).alias("n_a"),
        F.try_divide(F.sum(on("e", "s")), F.sum(on("e", "nv"))).alias("training_mean"),
        F.try_divide(F.sum(on("a", "s")), F.sum(on("a", "nv"))).alias("production_mean"),
        bin_counts("e").alias("m_e"), bin_counts("a").alias("m_a"))
    j = per.join(F.broadcast(edges.select("feature", "n_edges")), "feature")
    grid = F.sequence(F.lit(0), F.greatest(F.col("n_edges") - 2, F.lit(0)))

    def shares(m, n, floor_null):
        def one(b):
            sh = F.coalesce(F.try_element_at(F.col(m), b), F.lit(0)) / F.col(n)
            test = F.coalesce(sh, F.lit(0.0)) if floor_null else sh
            return F.when(test == 0, F.lit(PSI_EPS)).otherwise(sh)
        return F.transform(grid, one)

    def normalised(arr):
        total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(arr, lambda x: x / total)
    j = j.withColumn("_e", normalised(shares("m_e", "n_e", False))).withColumn(
        "_a", normalised(shares("m_a", "n_a", True)))
    terms = F.zip_with("_a", "_e", lambda a, e: fn_psi_term(a, e))
    value = F.when(F.col("n_edges") >= 2, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    return j.select("feature", F.coalesce(value, F.lit(0.0)).alias("psi_value"), "training_mean", "production_mean",
                    "n_a")


def psi(ref: DataFrame, prod: DataFrame, cols: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(feature, psi) for every column: shares over the full sample size, empty bins
    -> 1e-4, renormalised, sum of (a - e)·ln(a / e). Fewer than two edges -> 0."""
    return psi_summary(ref, prod, cols, bins).select("feature", "psi_value")


def drift_report(ref: DataFrame, prod: DataFrame, cols: list[str] | None = None, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(feature, psi_value, status, training_mean, production_mean, overall_status); the
    means come from the same pass as the bin counts. Reports on one reference can share its ``edges``."""
    r = psi_summary(ref, prod, cols or FEATURES, bins, edges).where(F.col("n_a").isNotNull()) \
        .withColumn("status", fn_psi_status(F.col("psi_value")))
    rank = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    names = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))])
    worst = F.max(rank[F.col("status")]).over(Window.partitionBy())  # over <= len(cols) rows
    return r.withColumn("overall_status", names[worst]).select(
        "feature", "psi_value", "status", "training_mean", "production_mean", "overall_status")


def psi_status(df: DataFrame, col: str = "psi_value") -> DataFrame:
    return df.withColumn("status", fn_psi_status(F.col(col)))


def retrain_trigger(report: DataFrame, threshold: float = 0.25) -> DataFrame:
    return report.agg(((F.max("psi_value") > F.lit(threshold)) |
                       F.max((F.col("overall_status") == "Retrain Alert").cast("int")).cast("boolean"))
                      .alias("retrain"))


def latest_drift(drift_log: DataFrame) -> DataFrame:
    """Rows of the newest run (timestamp of the highest id) with the overall status recomputed."""
    ts = drift_log.agg(F.max_by("timestamp", "id").alias("_ts"))
    rows = drift_log.join(F.broadcast(ts), F.col("timestamp") == F.col("_ts")).drop("_ts")
    rank = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    names = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))])
    worst = F.max(rank[F.col("status")]).over(Window.partitionBy())  # one run: a handful of rows
    return rows.withColumn("overall_status", names[worst])


def sample_production(df: DataFrame, frac: float = 0.2, seed: int = 42, id_col: str = "CustomerID") -> DataFrame:
    """Seeded sample of a fraction of the rows: those whose key hash is in the lowest ``frac`` of its 52 bits, so the
    same rows are drawn in any partitioning."""
    from rfmspark.operators.learn import key_hash
    return df.where(key_hash(id_col, seed) < F.lit(int(frac * (1 << 52))))


def drift_log_rows(report: DataFrame, ts, first_id: int = 1) -> DataFrame:
    """Drift report -> drift_metrics rows (T8) sharing one timestamp; ids follow the
    feature order of the report's column list."""
    pos = F.create_map(*[x for i, c in enumerate(FEATURES) for x in (F.lit(c), F.lit(i))])
    return report.select((F.lit(first_id) + pos[F.col("feature")]).cast("bigint").alias("id"),
                         F.lit(ts).cast("timestamp_ntz").alias("timestamp"), F.col("feature").alias("feature_name"),
                         "psi_value", "status", "training_mean", "production_mean")

"""Composed jobs: read-only SQL over registered tables and the retraining run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_WRITE_WORDS = ["DELETE", "INSERT", "UPDATE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "MERGE",
                "USE", "CACHE", "REFRESH", "LOAD"]


def check_read_only(query: str) -> str:
    """Accept exactly one SELECT / WITH statement; reject anything that writes."""
    q = query.strip().rstrip(";").strip()
    if ";" in q:
        raise ValueError("Only a single statement is allowed.")
    if not re.match(r"(?is)^\s*(select|with)\b", q):
        raise ValueError("Only read-only SELECT queries are allowed.")
    upper = f" {q.upper()} "
    for w in _WRITE_WORDS:
        if re.search(rf"\b{w}\b", upper):
            raise ValueError(f"{w} is not allowed in a read-only query")
    if re.search(r"(?i)`?\b(try_reflect|reflect|java_method)`?\s*\(", q):
        raise ValueError("this function is not allowed in read-only queries")
    return q


def sql_query(spark: SparkSession, query: str, views: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """Run a read-only query over the tables as temporary views (at most ``limit`` rows). The views exist,
    and files as relations are off, while Spark analyses the query; functions that call into the JVM are refused."""
    q = check_read_only(query)
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        return spark.sql(q).limit(limit)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)
        for name in views:
            spark.catalog.dropTempView(name)


def retrain(ctx) -> DataFrame:
    """Phases of the retraining run (clean, features, segments, supervised set, scoring,
    gate + registry, drift), each materialised as a stage table; returns
    (phase_no, phase, status, rows)."""
    from pyspark.sql import functions as F

    from rfmspark.operators import drift as drift_ops
    from rfmspark.schemas import FEATURES
    phases = []

    def step(name, fn):
        try:
            n = fn()
        except Exception as e:
            raise RuntimeError(f"retraining stopped in phase {len(phases) + 1} ({name})") from e
        phases.append((len(phases) + 1, name, "completed", int(n)))

    step("clean", lambda: ctx.cleaned.count())
    step("features", lambda: ctx.features_scaled.count())
    step("segments", lambda: ctx.segmented.count())
    step("supervised", lambda: ctx.supervised.count())
    step("train_and_evaluate", lambda: ctx.model_metrics.count())
    step("gate_and_registry", lambda: ctx.registry.where(F.col("is_active") == 1).count())
    step("drift", lambda: drift_ops.drift_report(ctx.supervised, ctx.features, FEATURES).count())
    return ctx.spark.createDataFrame(phases, "phase_no int, phase string, status string, rows long")

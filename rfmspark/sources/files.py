"""File sources and sinks: CSV, JSON and Parquet tables with declared
schemas, append-mode log tables, and scratch tables under the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmspark.schemas import DRIFT_JSON, FEATURES, METRIC_NAMES, METRICS_JSON, T1_TEXT
from rfmspark.session import ensure_checkpoint_dir


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh table folder inside the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rfmspark-tables/{uuid.uuid4().hex}/{name}"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


#: RFC 4180: quotes inside a quoted field are doubled.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"'}


def csv_options(spark: SparkSession, path: str, encoding: str | None = None) -> dict:
    """Reader options of one source, from one scan of its lines: UTF-8, or Latin-1 if any line isn't valid UTF-8; and whether a
    quoted field holds a line end. A line with an odd number of quotes begins or ends such a field; only a source that has one is
    read as a whole per file, any other is split between tasks."""
    seen = spark.read.text(path).agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("other"),
        F.bool_or(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("spans")).first()
    return {**CSV_DIALECT, "encoding": encoding or ("ISO-8859-1" if seen["other"] else "UTF-8"), "multiLine": bool(seen["spans"])}


def src_transactions_csv(spark: SparkSession, path: str, encoding: str | None = None, schema=None) -> DataFrame:
    """Transaction CSV with a header and a declared (text) schema; malformed lines are
    kept with NULLs (PERMISSIVE); the caller coerces types (see ``ingest_upload``). Without
    ``encoding`` it is UTF-8, falling back to Latin-1."""
    return spark.read.schema(schema or T1_TEXT).options(**csv_options(spark, path, encoding)).option("mode", "PERMISSIVE").csv(path)


def src_customer_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV for scoring: header names decide the columns; the nine features are
    required and named when missing (checked before any job runs)."""
    df = spark.read.options(**csv_options(spark, path)).option("inferSchema", False).csv(path)
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"these feature columns are not in the file: {missing}")
    return df.select(*[F.col(c).cast("double").alias(c) if c in FEATURES else F.col(c) for c in df.columns])


def src_column_pruned(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def src_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested model metrics (model -> nine metrics) flattened to one row per model."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", METRICS_JSON).alias("m"))
    return parsed.select(F.explode("m").alias("model", "v")).select("model", *[F.col(f"v.{c}").alias(c) for c in METRIC_NAMES])


def src_drift_json(spark: SparkSession, path: str) -> DataFrame:
    """Drift report JSON (overall status + metrics array) flattened per feature."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", DRIFT_JSON).alias("r"))
    return raw.select("r.overall_status", F.explode("r.metrics").alias("m")).select(
        F.col("m.feature").alias("feature"), "m.psi_value", "m.status", "m.training_mean", "m.production_mean",
        "overall_status")


def src_tables(spark: SparkSession, names: list[str], base: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}") for n in names}


def sink_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def sink_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def sink_append(df: DataFrame, path: str) -> str:
    """Append rows to a Parquet table (no de-duplication)."""
    df.write.mode("append").parquet(path)
    return path


def sink_raw_subset(raw: DataFrame, path: str) -> str:
    return sink_parquet(raw.select("CustomerID", "InvoiceNo", "InvoiceDate"), path)


def sink_json_report(report: DataFrame, path: str, nest: str = "metrics", keys: list[str] | None = None) -> str:
    """Write rows nested under one array field (one JSON document per key group)."""
    keys = keys or []
    payload = [c for c in report.columns if c not in keys]
    doc = report.groupBy(*keys).agg(F.collect_list(F.struct(*payload)).alias(nest))
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def sink_metrics_json(metrics: DataFrame, path: str) -> str:
    """Model metrics as one JSON object {model: {metric: value}} (a handful of rows)."""
    doc = metrics.agg(F.map_from_entries(F.collect_list(F.struct(
        "model", F.struct(*[F.col(c).cast("double").alias(c) for c in METRIC_NAMES])))).alias("m"))
    doc.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def sink_drift_json(report: DataFrame, path: str, ts: str) -> str:
    doc = report.agg(F.first("overall_status").alias("overall_status"), F.collect_list(F.struct(
        "feature", "psi_value", "status", "training_mean", "production_mean")).alias("metrics"))
    doc.select(F.to_json(F.struct(F.lit(ts).alias("timestamp"), "overall_status", "metrics")).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)
    return path

"""Uploads appended to the transaction tables: each upload is one partition, written as a whole.

The cleaned transactions (T2), the raw subset (T3) and the rejected rows each get a folder
``upload_id=<id>``. Writing the same upload again replaces its folders, so a repeated request, or one
that died between two tables and is sent again, leaves every row once. Readers see all uploads, and
the tables that they are appended to, as one.

Defined results: a row without CustomerID or InvoiceDate, or whose date can't be read, is rejected with
its reason and its text as it came; every other row is ingested by the upload rules (names by synonyms,
defaults, no cleaning filters); equal rows of one upload all stay; an upload of no rows is an empty partition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmspark.operators import clean
from rfmspark.schemas import T1_RAW, UPLOAD_REQUIRED
from rfmspark.sources.tables import path_exists

#: Why a row isn't ingested, in the order in which it is looked at.
REASONS = ["no CustomerID", "no InvoiceDate", "unreadable InvoiceDate"]


def rejected_rows(upload: DataFrame) -> DataFrame:
    """The rows of an upload that ``clean.ingest_upload`` leaves out: reason and the row as JSON text."""
    df = clean.normalize_columns(upload)
    clean.require_columns(df, UPLOAD_REQUIRED)
    row = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]))
    date = clean.coerce_upload(df.withColumn("InvoiceDate", F.col("InvoiceDate").cast("string")).withColumn("_row", row)
                               .withColumn("_no_id", F.col("CustomerID").isNull()).withColumn("_no_date", F.col("InvoiceDate").isNull()))
    reason = F.when(F.col("_no_id"), REASONS[0]).when(F.col("_no_date"), REASONS[1]).when(F.col("InvoiceDate").isNull(), REASONS[2])
    return date.select(reason.alias("reason"), F.col("_row").alias("row")).where(F.col("reason").isNotNull())


class TransactionTables:
    """T2, T3 and the rejected rows of all uploads under one folder, over base tables that others write."""

    def __init__(self, spark: SparkSession, root: str, cleaned: DataFrame | None = None, raw_subset: DataFrame | None = None):
        self.spark, self.root, self._base = spark, root.rstrip("/"), {"cleaned": cleaned, "raw_subset": raw_subset}

    def append(self, upload: DataFrame, upload_id: str) -> None:
        """Ingest an upload (text columns as they came) under its id; the same id again replaces what it left."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", upload_id):
            raise ValueError(f"an upload id has letters, digits, '_', '.' and '-' only, not {upload_id!r}")
        rows = clean.ingest_upload(upload, check_empty=False)
        place = {name: f"{self.root}/{name}/upload_id={upload_id}" for name in ("rejected", "cleaned", "raw_subset")}
        rejected_rows(upload).write.mode("overwrite").parquet(place["rejected"])
        rows.write.mode("overwrite").parquet(place["cleaned"])
        # from the rows as written, so that they are parsed once
        read = self.spark.read.schema(rows.schema).parquet(place["cleaned"])
        read.select("CustomerID", "InvoiceNo", "InvoiceDate").write.mode("overwrite").parquet(place["raw_subset"])

    def _read(self, name: str, schema: str) -> DataFrame:
        base = self._base.get(name)
        path = f"{self.root}/{name}"
        kept = None
        if path_exists(self.spark, path):
            kept = self.spark.read.schema(f"{schema}, upload_id string").parquet(path)
        if base is None:
            return kept if kept is not None else self.spark.createDataFrame([], f"{schema}, upload_id string")
        base = base.withColumn("upload_id", F.lit(None).cast("string"))
        return base if kept is None else base.unionByName(kept.select(*base.columns))

    def cleaned(self) -> DataFrame:
        """T2; upload_id is null for rows of the base table."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T1_RAW)
        return self._read("cleaned", f"{kinds}, TotalPrice double")

    def raw_subset(self) -> DataFrame:
        """T3."""
        return self._read("raw_subset", "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz")

    def rejected(self) -> DataFrame:
        """upload_id, reason and the row as it came."""
        return self._read("rejected", "reason string, row string")

"""Uploads appended once, with a table of what was left out."""

import json

import pytest

from rfmspark.sources.uploads import REASONS, TransactionTables

HEAD = "`Customer ID` string, invoice_no string, qty string, price string, date string, note string"


def upload(spark, rows):
    return spark.createDataFrame(rows, HEAD)


GOOD = [("12.0", "A1", "3", "2.5", "2011-12-09", None), ("12.0", "A1", "3", "2.5", "2011-12-09", None), ("13", "A2", "x", "y", "2011-12-10 08:00", "n")]
BAD = [(None, "A3", "1", "1", "2011-12-09", None), ("14", "A4", "1", "1", None, None), ("15", "A5", "1", "1", "soon", "why"), (None, "A6", "1", "1", None, None)]


def test_same_upload_counts_once_and_rejects_are_kept(spark, tmp_path):
    base = spark.createDataFrame([("7", 1.5)], "CustomerID string, TotalPrice double")
    t = TransactionTables(spark, str(tmp_path), base)
    assert t.cleaned().count() == 1 and t.raw_subset().count() == 0 and t.rejected().count() == 0
    for _ in range(2):
        t.append(upload(spark, GOOD + BAD), "u-1")
    t.append(upload(spark, GOOD[:1]), "u-2")
    rows = t.cleaned().collect()
    assert sorted((r["upload_id"] or "", r["CustomerID"], r["TotalPrice"]) for r in rows) == \
        [("", "7", 1.5), ("u-1", "12", 7.5), ("u-1", "12", 7.5), ("u-1", "13", 0.0), ("u-2", "12", 7.5)]
    assert t.raw_subset().count() == 4
    left = {r["reason"]: r["n"] for r in t.rejected().groupBy("reason").count().withColumnRenamed("count", "n").collect()}
    assert left == {REASONS[0]: 2, REASONS[1]: 1, REASONS[2]: 1}
    kept = [json.loads(r["row"]) for r in t.rejected().where("reason = 'unreadable InvoiceDate'").collect()]
    assert kept[0]["InvoiceDate"] == "soon" and kept[0]["note"] == "why"


def test_run_that_died_between_tables_is_repeated(spark, tmp_path):
    t = TransactionTables(spark, str(tmp_path))
    upload(spark, BAD).selectExpr("'x' AS reason", "'y' AS row").write.parquet(f"{tmp_path}/rejected/upload_id=u")  # the others were never written
    t.append(upload(spark, GOOD + BAD), "u")
    assert t.rejected().where("reason = 'x'").count() == 0 and t.rejected().count() == 4 and t.cleaned().count() == 3


def test_empty_uploads_and_bad_ids(spark, tmp_path):
    t = TransactionTables(spark, str(tmp_path))
    t.append(upload(spark, []), "none")
    assert t.cleaned().count() == 0 and t.rejected().count() == 0
    with pytest.raises(ValueError):
        t.append(upload(spark, GOOD), "../u")
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("1",)], "CustomerID string"), "u")

"""Input layouts that retail files come in: quoted fields, encodings, dates; and changed base tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_round_half_up, fn_to_timestamp_safe
from rfmspark.operators import learn
from rfmspark.operators.learn import stratified_split
from rfmspark.plans.jobs import sql_query
from rfmspark.sources import files, tables

HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def test_quotes_line_ends_and_encodings(spark, tmp_path):
    rows = '1,A,"BOX ""A"", RED",6,2011-12-09,2.5,17,France\n2,B,"two\nlines",1,2011-12-09,1.0,18,Spain\n'
    (tmp_path / "u.csv").write_text(HEAD + rows + "3,C,CAFÉ,1,2011-12-09,1.0,19,France\n", encoding="utf-8")
    (tmp_path / "l.csv").write_text(HEAD + rows + "3,C,CAFÉ,1,2011-12-09,1.0,19,France\n", encoding="latin-1")
    for name in ("u.csv", "l.csv"):
        got = {r["InvoiceNo"]: r for r in files.src_transactions_csv(spark, str(tmp_path / name)).collect()}
        assert got["1"]["Description"] == 'BOX "A", RED' and str(got["1"]["Quantity"]) == "6" and got["2"]["Description"] == "two\nlines"
        assert got["3"]["Description"] == "CAFÉ" and len(got) == 3
    back = files.sink_csv(spark.createDataFrame([('x "y", z', 1)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.options(**files.CSV_DIALECT).csv(back).first()["a"] == 'x "y", z'


def test_date_layouts(spark):
    want = {"2011-12-09T12:50:00Z": (12, 50), "2011-12-09 12:50:00.123": (12, 50), "2011/12/09": (0, 0), "9-Dec-2011": (0, 0),
            "12/09/11": (0, 0), "12/9/2011 8:26": (8, 26), "2011-12-09": (0, 0), "2011-12-09 12:50": (12, 50)}
    df = spark.createDataFrame([(k,) for k in want] + [("soon",), (None,)], "t string").select("t", fn_to_timestamp_safe(F.col("t")).alias("p"))
    got = {r["t"]: r["p"] for r in df.collect()}
    assert got["soon"] is None and got[None] is None
    for k, (h, m) in want.items():
        assert got[k] is not None and got[k].date() == dt.date(2011, 12, 9) and (got[k].hour, got[k].minute) == (h, m), k


def test_rounding_is_plain(spark):
    r = spark.range(1).select(fn_round_half_up(F.lit(1.234999), 2).alias("a"), fn_round_half_up(F.lit(0.49995), 0).alias("b"), fn_round_half_up(F.lit(1.005), 2).alias("c")).first()
    assert tuple(r) == (1.23, 0.0, 1.01)


def test_split_is_exact_for_large_and_text_ids(spark):
    rows = [(str(i * (2 ** 31 - 1)), i % 2) for i in range(204)] + [(f"34_smote_{i}", i % 2) for i in range(204)]
    df = spark.createDataFrame(rows, "CustomerID string, Target int")
    n = {r["Target"]: r["n"] for r in stratified_split(df).where("is_test").groupBy("Target").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 41, 1: 41}


def test_read_only_sql(spark):
    views = {"t": spark.range(5).toDF("x")}
    assert sql_query(spark, "select sum(x) s from t", views).first()["s"] == 10
    for bad in ("SELECT reflect('java.lang.System','getProperty','user.dir')", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "DROP TABLE t", "select 1; select 2"):
        with pytest.raises(Exception):
            sql_query(spark, bad, views).collect()
    assert not spark.catalog.tableExists("t") and sql_query(spark, "select replace('a', 'a', 'b') r", {}).first()["r"] == "b"


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert tables.fingerprint(spark, path) == ()
    spark.range(10).write.parquet(path)
    before = tables.fingerprint(spark, path)
    spark.range(10).write.mode("append").parquet(path)
    assert tables.fingerprint(spark, path) != before


def test_stored_models_score_the_same(spark, tmp_path):
    df = spark.createDataFrame([(str(i), float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(120)], "CustomerID string, a double, b double, Target int")
    for fit in (lambda: learn.logreg(df, ["a", "b"]), lambda: learn.gbt(df, ["a", "b"], max_iter=3)):
        model = fit()
        back = learn.load_model(spark, learn.save_model(model, str(tmp_path / type(model).__name__)))
        assert type(back) is type(model)
        one, two = ({r["CustomerID"]: r["probability"] for r in learn.score_model(m, df, ["a", "b"]).collect()} for m in (model, back))
        assert one == two

import datetime as dt

from pyspark.sql import functions as F

from rfmspark.functions import scalar as fn


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("v")).collect()


def test_recency_is_floor_of_24h_periods(spark):  # D1
    rows = one(spark, fn.fn_recency_days("a", "b"), [(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))],
               "a timestamp_ntz, b timestamp_ntz")
    assert rows[0].v == 0


def test_split_date_keeps_time_and_clips_month_end(spark):  # D2
    rows = one(spark, fn.fn_split_date("a", 9), [(dt.datetime(2010, 12, 1, 8, 26),), (dt.datetime(2011, 5, 31, 10),)],
               "a timestamp_ntz")
    assert rows[0].v == dt.datetime(2011, 9, 1, 8, 26)
    assert rows[1].v == dt.datetime(2012, 2, 29, 10)


def test_upload_coercions(spark):  # D8
    df = spark.createDataFrame([("12345.0", "3.7", "abc", "bad"), (" 12345 ", "x", "2.5", "2011-01-02 10:00:00")],
                               "c string, q string, p string, d string")
    r = df.select(fn.fn_clean_customer_id("c").alias("c"), fn.fn_to_int_default("q").alias("q"),
                  fn.fn_to_double_default("p").alias("p"), fn.fn_to_timestamp_safe("d").alias("d")).collect()
    assert [x.c for x in r] == ["12345", "12345"]
    assert [x.q for x in r] == [3, 1]
    assert [x.p for x in r] == [0.0, 2.5]
    assert r[0].d is None and r[1].d == dt.datetime(2011, 1, 2, 10)


def test_dates_are_tried_only_where_their_shape_fits(spark):
    texts = ["2011-01-02", "2011-01-02 10:00", "2011-01-02 10:00:05.123", "2011-01-02T10:00:05", "2011-01-02t10:00:05Z", "2011-01-02 10:00+02:00", "2011-13-02",
             "2011-02-30", "2011-1-2", "2011/1/2", "2011/01/02 7:05", "2011/2/30 7:05", "1/2/2011", "12/25/2011 7:05:09", "25/12/2011", "25/12/2011 7:05", "1/2/11", "1/2/11 10:00",
             "13/2/11", "007/004/2011", "2-Jan-2011", "2-jan-2011 9:30", "2-January-2011", "2.1.2011", "2.1.2011 9:30:00", "2.13.2011", "some day", "", " ", " 2011-01-02 ",
             "2011-01-02\n", "+12011-01-02", "12011-01-02", "-2011-01-02", "0000-01-02", "1/2/+12011", "1/2/12011", "1/2/011", "\uff12011-01-02", "2011-01-02 25:00", None]
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("d"), F.lit(f)) for f in fn.TIMESTAMP_FORMATS]).cast("timestamp_ntz")
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    rows = df.select("d", fn.fn_to_timestamp_safe("d").cast("string").alias("got"), tried.cast("string").alias("want")).collect()
    assert [(r.d, r.got) for r in rows] == [(r.d, r.want) for r in rows]
    assert sum(r.got is not None for r in rows) >= 18
    assert all(fn.timestamp_shape(f) for f in fn.TIMESTAMP_FORMATS) and fn.timestamp_shape("yyyyMMdd") is None
    shaped = df.select(fn.fn_to_timestamp_safe("d"))._jdf.queryExecution().analyzed().toString()
    assert "WHEN RLIKE" in shaped


def test_labels_and_status(spark):  # A10
    df = spark.createDataFrame([(0.05, "random_forest", "a" * 25), (0.15, "x", "short"), (0.30, "y", "b" * 20)],
                               "p double, m string, d string")
    r = df.select(fn.fn_psi_status("p").alias("s"), fn.fn_title_case("m").alias("t"),
                  fn.fn_truncate_label("d").alias("l")).collect()
    assert [x.s for x in r] == ["Stable", "Monitor", "Retrain Alert"]
    assert r[0].t == "Random Forest"
    assert r[0].l == "a" * 20 + "..." and r[2].l == "b" * 20


def test_round_half_up_is_engine_stable(spark):
    r = spark.createDataFrame([(880307.59 / 8,), (2.5,)], "x double").select(fn.fn_round_half_up("x", 4).alias("v"),
                                                                             fn.fn_round_half_up("x", 0).alias("w")).collect()
    assert r[0].v == 110038.4488 and r[1].w == 3.0


def test_l2_distance(spark):
    r = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>").select(
        fn.fn_l2_distance("a", "b").alias("d")).collect()
    assert r[0].d == 5.0
    assert F is not None

"""Dashboard operators with lookups joined late against rows that carry the names themselves."""

import pytest

from rfmspark.operators import dashboard


@pytest.fixture(scope="module")
def tables(spark):
    # two codes share a description, one has none; one customer has no country
    names = spark.createDataFrame([("a", "Mug"), ("b", "Mug"), ("c", "Pen"), ("d", None)], "StockCode string, Description string")
    countries = spark.createDataFrame([("1", "France"), ("2", "Spain"), ("3", None)], "CustomerID string, Country string")
    rows = [(str(1 + i % 4), "abcde"[i % 5], f"I{i % 7}", i % 9 + 1, float(i % 9 + 1) * 2.5) for i in range(200)] + [(None, "a", None, 1, 1.0)]
    tx = spark.createDataFrame(rows, "CustomerID string, StockCode string, InvoiceNo string, Quantity int, TotalPrice double")
    return tx, names, countries, tx.join(names, "StockCode", "left").join(countries, "CustomerID", "left")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_late_lookups_give_the_same(tables):
    tx, names, countries, full = tables
    assert rows(dashboard.country_breakdown(tx, countries)) == rows(dashboard.country_breakdown(full))
    assert rows(dashboard.top_products(tx, 10, names)) == rows(dashboard.top_products(full))
    assert rows(dashboard.top5_products(tx, names=names)) == rows(dashboard.top5_products(full))
    for customer in (None, "2"):
        late = dashboard.customer_top_items(tx, customer, 3, names)
        early = dashboard.customer_top_items(full, customer, 3)
        assert rows(late.select(*early.columns)) == rows(early)


def test_one_lookup_after_the_aggregate(spark):
    from rfmspark.plans.context import Ctx
    ctx = Ctx(spark, "/root/testdata/sf0.001")
    for df, lookup in ((dashboard.country_breakdown(ctx.cleaned, ctx.customer_countries), "customer.parquet"),
                       (dashboard.top_products(ctx.cleaned, 10, ctx.product_names), "part.parquet")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        join, fact = plan.index("Join"), plan.index("TotalPrice" if "TotalPrice" in plan else "CustomerID")
        assert plan.count("Join") == (2 if lookup == "customer.parquet" else 1) and "Aggregate" in plan[join:] and fact > 0


def test_dataset_stats_counts_distinct_keys(spark):
    import datetime
    day = datetime.datetime(2011, 1, 2)
    df = spark.createDataFrame([("1", "x", day), ("1", "y", day), (None, "y", day), ("2", None, None)], "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz")
    r = dashboard.dataset_stats(df).first()
    assert (r["total_records"], r["total_customers"], r["total_transactions"], r["start_date"]) == (4, 2, 2, "2011-01-02")
    assert dashboard.dataset_stats(df.limit(0)).first()["total_customers"] == 0

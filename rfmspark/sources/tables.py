"""Readers for the driver tables and the ``retail`` transaction view (T1).

The transaction table is not stored as such: it is the line items of the orders,
mapped onto the retail columns. Only the joins a caller needs are planned, so a
feature job that never looks at ``Description`` or ``Country`` scans two tables.

    InvoiceNo   = 'C' || o_orderkey for returned lines (l_returnflag = 'R'), else o_orderkey
    StockCode   = l_partkey                 Description = p_name (left lookup)
    Quantity    = l_quantity, negative for returned lines
    InvoiceDate = o_orderdate               UnitPrice   = l_extendedprice / l_quantity
    CustomerID  = o_custkey                 Country     = n_name of the customer (left lookup)

No broadcast hints: dimension tables are joined by key and AQE/auto-broadcast
decide by measured size (the TPC-H ``part``/``customer`` grow with the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through the Hadoop FileSystem API (any file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Length, number of files and newest change of a table's files: differs after a write."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ()
    total = fs.getContentSummary(p)
    newest = max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])
    return int(total.getLength()), int(total.getFileCount()), int(newest)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with column pruning."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def retail(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
           returned: bool | None = None) -> DataFrame:
    """Raw transactions (T1). ``columns`` limits the output and therefore the joins.
    ``returned`` keeps only returned (cancelled-invoice) lines or only the others; the
    condition is on ``l_returnflag`` and so reaches the lineitem scan before the join
    (a filter on the derived InvoiceNo cannot be pushed through it)."""
    from rfmspark.schemas import RAW_COLUMNS
    cols = list(columns or RAW_COLUMNS)
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"])
    if returned is not None:
        is_r = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))  # a NULL flag is not a return
        li = li.where(is_r if returned else ~is_r)
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    tx = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    returned = F.col("l_returnflag") == F.lit("R")
    mapped = {
        "InvoiceNo": F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")), F.col("o_orderkey").cast("string")),
        "StockCode": F.col("l_partkey").cast("string"),
        "Quantity": F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int"),
        "InvoiceDate": F.col("o_orderdate"),
        "UnitPrice": F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "CustomerID": F.col("o_custkey").cast("string"),
    }
    if "Description" in cols:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
        tx = tx.join(part, tx.l_partkey == part.p_partkey, "left")
        mapped["Description"] = F.col("p_name")
    if "Country" in cols:
        cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
        nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
        cn = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "n_name")
        tx = tx.join(cn, tx.o_custkey == cn.c_custkey, "left")
        mapped["Country"] = F.col("n_name")
    return tx.select(*[mapped[c].alias(c) for c in cols])


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """StockCode, Description: one row per product."""
    return read_table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select(
        F.col("p_partkey").cast("string").alias("StockCode"), F.col("p_name").alias("Description"))


def customer_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CustomerID, Country: one row per customer."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("CustomerID"), F.col("n_name").alias("Country"))


def add_lookups(spark: SparkSession, sf_dir: str, tx: DataFrame) -> DataFrame:
    """Attach Description (part name by StockCode) and Country (nation of the customer)
    to transaction rows by left key lookups - the same values the full view carries."""
    return tx.join(product_names(spark, sf_dir), "StockCode", "left").join(customer_countries(spark, sf_dir), "CustomerID", "left") \
        .select(*tx.columns, "Description", "Country")


def raw_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3: CustomerID, InvoiceNo, InvoiceDate of every raw row (column pruning makes
    a materialised copy unnecessary)."""
    return retail(spark, sf_dir, ["CustomerID", "InvoiceNo", "InvoiceDate"])


def events(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, sf_dir, "events", columns)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")

"""Star-schema views over the given tables, clean and with arithmetic defects.

A row is hit by defect k when ``(key * 7919 + k) % 50 = 0``: two percent of dense keys, a
different set for every k, and the same rows in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_KEY, DUPLICATE, ORPHAN, FUTURE, OUTLIER, PROMO, DIM_NULL = 11, 7, 23, 31, 42, 3, 5


def hit(key: str | Column, k: int, every: int = 50) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return (key * 7919 + k) % every == 0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The clean star: three facts, one empty fact, four dimensions."""
    opened: dict[str, DataFrame] = {}

    def t(name: str, *columns: str) -> DataFrame:
        if name not in opened:                       # one look at the file footers per table
            opened[name] = read(spark, sf_dir, name)
        return opened[name].selectExpr(*columns)

    return {
        "fact_orders": t(
            "orders", "o_orderkey AS order_id", "o_custkey AS customer_id",
            "o_orderdate AS order_date", "o_totalprice AS total_price",
            "CAST(o_orderkey % 11 AS DOUBLE) AS discount_pct",
            "o_orderstatus AS status", "o_orderpriority AS priority"),
        "fact_lineitems": t(
            "lineitem", "l_orderkey AS order_id", "l_partkey AS part_id", "l_suppkey AS supplier_id",
            "l_linenumber AS line_number", "l_quantity AS quantity", "l_extendedprice AS price",
            "l_discount AS discount", "l_tax AS tax", "l_shipdate AS ship_date"),
        "fact_events": t("events", "event_id", "user_id", "ts AS event_date", "value", "event_type"),
        "fact_returns": t("lineitem", "l_orderkey AS order_id", "l_quantity AS quantity")
            .where("quantity < 0"),
        "dim_customers": t(
            "customer", "c_custkey AS customer_id", "c_name AS customer_name",
            "c_acctbal AS balance", "c_mktsegment AS segment"),
        "dim_parts": t(
            "part", "p_partkey AS part_id", "p_name AS part_name", "p_brand AS brand",
            "p_retailprice AS retail_price"),
        "dim_suppliers": t(
            "supplier", "s_suppkey AS supplier_id", "s_name AS supplier_name", "s_acctbal AS balance"),
        "dim_users": t(
            "customer", "c_custkey AS user_id", "c_name AS user_name", "c_nationkey AS nation_code"),
    }


def dirty_orders(orders: DataFrame) -> DataFrame:
    """``fact_orders`` with missing, orphaned, future, inflated and copied rows."""
    k = F.col("order_id")
    bad = orders.select(
        "order_id",
        F.when(hit(k, NULL_KEY), None).when(hit(k, ORPHAN), F.col("customer_id") + 1000000)
        .otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(hit(k, FUTURE), F.lit("2099-01-01").cast("timestamp_ntz"))
        .otherwise(F.col("order_date")).alias("order_date"),
        F.when(hit(k, OUTLIER), F.col("total_price") * 10).otherwise(F.col("total_price")).alias("total_price"),
        F.when(hit(k, PROMO), F.col("discount_pct") * 3).otherwise(F.col("discount_pct")).alias("discount_pct"),
        "status", "priority")
    return bad.unionByName(bad.where(hit("order_id", DUPLICATE)))


def dirty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star with known defects in orders, customers and line items."""
    tables = star(spark, sf_dir)
    tables["fact_orders"] = dirty_orders(tables["fact_orders"])
    tables["dim_customers"] = tables["dim_customers"].withColumn(
        "customer_name", F.when(~hit("customer_id", DIM_NULL, 33), F.col("customer_name")))
    tables["fact_lineitems"] = tables["fact_lineitems"].withColumn(
        "tax", F.when(F.col("order_id") % 3 == 0, F.col("tax") * 3).otherwise(F.col("tax")))
    return tables

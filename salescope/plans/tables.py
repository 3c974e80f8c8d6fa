"""Canonical inputs derived from the driver's parquet tables.

Every function here is lazy and joins only what the asked-for columns need, so a
plan over revenue alone scans one table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions.numbers import to_money
from salescope.operators.mapping import with_profit
from salescope.session import spread

SALES_COLUMNS = [
    "date", "customer", "product", "brand", "region", "revenue", "cost", "currency", "quantity", "payment_status",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Timestamps in the tables carry no zone; UTC keeps them unshifted.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Order lines as the canonical sales table; ``profit`` may be asked for too.

    Dimensions are left joins from the order line: no line is lost, and a join
    that no wanted column needs is not planned at all. Lines and orders are dealt to
    partitions by the number of lines, which the files' footers tell.
    """
    wanted = list(columns or [*SALES_COLUMNS, "profit"])
    base = {c for c in wanted if c != "profit"} | ({"revenue", "cost"} if "profit" in wanted else set())
    lineitem = table(spark, sf_dir, "lineitem")
    lines = lineitem.select(
        "l_orderkey",
        "l_partkey",
        to_money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        to_money(F.col("l_extendedprice") * 0.6).alias("cost"),
        F.col("l_quantity").alias("quantity"),
    )
    needs_geo = base & {"region", "currency"}
    needs_customer = needs_geo or "customer" in base
    if needs_customer or base & {"date", "payment_status"}:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey",
            "o_custkey",
            F.col("o_orderdate").cast("date").alias("date"),
            F.when(F.col("o_orderstatus") == "F", "paid")
            .when(F.col("o_orderstatus") == "P", "pending")
            .when(F.col("o_orderstatus") == "O", "failed")
            .alias("payment_status"),
        )
        if needs_customer:
            customers = table(spark, sf_dir, "customer").select(
                "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("customer")
            )
            if needs_geo:
                nations = table(spark, sf_dir, "nation").select(
                    "n_nationkey", "n_regionkey", currency_of_nation(F.col("n_nationkey")).alias("currency")
                )
                regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
                places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
                customers = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        rows = lineitem.count()
        lines, orders = spread(lines, rows, "l_orderkey"), spread(orders, rows, "o_orderkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if base & {"product", "brand"}:
        parts = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_type").alias("product"), F.col("p_brand").alias("brand")
        )
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return (with_profit(lines) if "profit" in wanted else lines).select(*wanted)


def currency_of_nation(key):
    return (
        F.when(key % 4 == 0, "USD").when(key % 4 == 1, "EUR").when(key % 4 == 2, "GBP").otherwise("JPY")
    )


SALES_SQL = """
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CASE WHEN c_acctbal >= 0 THEN c_name END AS customer,
         p_type AS product, p_brand AS brand, r_name AS region,
         CAST(floor(l_extendedprice * (1 - l_discount) * 100) / 100 AS DECIMAL(18,2)) AS revenue,
         CAST(floor(l_extendedprice * 0.6 * 100) / 100 AS DECIMAL(18,2)) AS cost,
         CASE n_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
         l_quantity AS quantity,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' WHEN 'O' THEN 'failed' END AS payment_status,
         CAST(floor(l_extendedprice * (1 - l_discount) * 100) / 100 AS DECIMAL(18,2))
           - CAST(floor(l_extendedprice * 0.6 * 100) / 100 AS DECIMAL(18,2)) AS profit
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""


def over_sales(body: str) -> str:
    """SQL over the same sales rows; ``body`` may start with more CTEs after a comma."""
    return f"WITH {SALES_SQL}{body}"

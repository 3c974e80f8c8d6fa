"""Physical plans keep to what scales: no cross joins, no row-at-a-time Python, pruned scans."""

import re

import pytest

import __spark_entry__ as entry
from salescope.operators import aggregates
from salescope.plans import catalog
from salescope.plans.tables import sales

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
# Jobs that already run while the frame is built have nothing left to plan.
LAZY = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_or_row_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit", "GlobalLimit"):
        assert word not in plan


def test_only_wanted_tables_and_columns_are_read(spark):
    plan = plan_of(aggregates.kpis(sales(spark, SF, ["revenue", "cost"])))
    assert "Join" not in plan
    assert re.search(r"ReadSchema: struct<l_extendedprice:double,l_discount:double>", plan)
    plan = plan_of(aggregates.revenue_by(sales(spark, SF, ["product", "revenue"]), "product"))
    assert plan.count("FileScan") == 2 and "orders" not in plan


def test_sums_are_combined_before_the_shuffle(spark):
    plan = plan_of(aggregates.revenue_by(sales(spark, SF, ["customer", "revenue"]), "customer"))
    assert "partial_sum" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["metrics_of_type"](spark, SF))
    assert "PushedFilters" in plan and "l_linenumber" in plan


@pytest.mark.parametrize("name", ["revenue_by_region", "top_customers", "history_page", "similar_failures", "operation_stats"])
def test_same_results_without_broadcasts(spark, name):
    """What a large cluster would plan: sort-merge joins and many partitions."""
    from tests.compare import difference, duck

    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = QUERIES[name](spark, SF)
        assert "BroadcastHashJoin" not in plan_of(df)
        assert difference(df, duck(SF), entry.oracle_sql()[name]) is None
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_many_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Lines and orders meet in partitions of a bounded number of lines; lines without an order are kept."""
    from salescope import session

    spark.range(1000).selectExpr(
        "if(id % 50 = 0, null, id div 3) AS l_orderkey", "id AS l_partkey", "10.0D AS l_extendedprice", "0.0D AS l_discount", "1.0D AS l_quantity"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp_ntz'2024-01-01 00:00:00' AS o_orderdate", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    plain = sorted(map(str, sales(spark, str(tmp_path), ["date", "revenue"]).collect()))
    monkeypatch.setattr(session, "LEFT_TO_SPARK", 100)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    dealt = sales(spark, str(tmp_path), ["date", "revenue"])
    assert "REPARTITION_BY_NUM" in plan_of(dealt) and dealt.rdd.getNumPartitions() >= 20
    assert sorted(map(str, dealt.collect())) == plain and len(plain) == 1000

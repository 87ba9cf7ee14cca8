"""Plans: what reaches the scan, and what never appears."""

import pytest

from entityframe.session import shared_dir
import __spark_entry__  # noqa: F401
from showcase.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(df, table: str) -> str:
    return next(line for line in plan_of(df).splitlines() if "FileScan" in line and f"{table}.parquet" in line)


def test_flagship_scans_only_what_it_uses(spark):
    df = QUERIES["dag_flagship"](spark, SF)
    orders = scan_of(df, "orders")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in orders
    assert "o_orderpriority" not in orders.split("ReadSchema")[1]
    assert "c_acctbal" not in scan_of(df, "customer").split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan_of(df)


def test_filters_push_down(spark):
    assert "EqualTo(p_type,SMALL)" in scan_of(QUERIES["join_left_array"](spark, SF), "part")
    wanted = scan_of(QUERIES["dag_filter_in_array"](spark, SF), "orders")
    assert "In(o_orderpriority" in wanted and "In(o_orderstatus" in wanted


def test_left_join_does_not_read_unused_columns(spark):
    assert "o_orderdate" not in scan_of(QUERIES["join_anti"](spark, SF), "orders").split("ReadSchema")[1]


@pytest.mark.parametrize(
    "name",
    [
        "join_literal_nullsafe", "join_entity_reference", "join_left_array", "join_anti_array", "join_reference_canonical",
        "saved_join_array_dups", "tree_ancestors", "tree_descendants", "links_dangling", "dag_total", "lookup_references",
    ],
)
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")


def test_hot_key_join_is_split_at_run_time(spark):
    """A third of the lines on one key: the adaptive plan cuts the hot partition."""
    from pyspark.sql import functions as F

    from entityframe.operators import joins

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v")
        )
        right = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
        out = joins.key_join(left, right, F.col("k"), F.col("key"), joins.INNER)
        out.collect()
        assert "skew=true" in plan_of(out)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
